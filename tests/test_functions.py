"""Functions and operators without SQL, against expected values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern import catalog, registry
from lectern.functions import align, udfs
from lectern.functions import text as X
from lectern.operators import ingest, matching, packing, search, sequence, state, tree
from lectern.operators import lookup as L
from lectern.sources import files


def test_fold_of_whole_texts(spark, tmp_path):
    texts = ["Été " * 100 + end for end in ("one", "two")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fold for r in catalog.queries()["word_fingerprints"](spark, str(tmp_path)).collect()}
    assert got == {0: "ete " * 100 + "one", 1: "ete " * 100 + "two"}


def test_dictionary_forms_of_all_documents(spark, tmp_path):
    docs = [(1, "Unknown forms"), (2, "unknown POLISHED"), (51, "unknown another")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Small polished tin")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["dictionary_forms"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("another", 51), ("forms", 1), ("unknown", 1), ("unknown", 2)]


def test_shared_runs_of_all_languages(spark, tmp_path):
    run = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"a {run}", "en", "src2"), (2, f"{run} b", "fr", "src3"), (3, f"c {run}", None, None), (4, run[:-4], "de", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "w0 w1 b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.queries()["shingle_overlap"](spark, str(tmp_path)).collect()
    assert sorted((r.first, r.doc_id, r.shared) for r in got) == [(1, 2, 1), (1, 3, 1)]
    assert [tuple(r) for r in catalog.queries()["guide_share"](spark, str(tmp_path)).collect()] == [(7, 0.5)]


def test_merged_spans_of_all_suppliers(spark, tmp_path):
    lines = [(s, p, 2.0) for s in (3, 500) for p in (10, 11, 20)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["merged_spans"](spark, str(tmp_path)).collect()
    assert sorted((r.l_suppkey, r.lo, r.hi) for r in got) == [(s, *x) for s in (3, 500) for x in ((10, 13), (20, 22))]


def brute_place(query, text):
    """The least cost of the whole query in the text, by the plain table."""
    last = [0.0] * (len(text) + 1)
    for c in query:
        row = [last[0] + 1.0]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1.0, row[-1] + 1.0, last[j - 1] + (0.0 if c == x else 1.5)))
        last = row
    return min(last), last.index(min(last))


def test_aligned_quotes_over_whole_texts(spark, tmp_path):
    """The place lies beyond 2,000 characters, and what differs beyond 60 characters of the quote counts."""
    rng = random.Random(7)
    fill = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    quote = "what the reader took from the old book was a long line of many plain words and then some more of them at the end of it"
    near = quote.replace("some more of", "sum more off")
    docs = [(1, f"{fill} {quote} tail"), (2, f"head {near} {fill}"), (3, f"{fill} and then some more of them"), (4, fill)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in catalog.queries()["aligned_quotes"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert {i: (r.cost, r.end) for i, r in got.items()} == {i: brute_place(quote, text) for i, text in docs[:3]}
    assert (got[1].cost, got[1].start) == (0.0, len(fill) + 1) and 0 < got[2].cost < 10


def test_library_of_references(spark):
    """The cases of a small library: lines, ranges, whole sections, titles that begin other titles, absent books."""
    refs = [("Genesis 1:1", "Genesis"), ("Genesis 1:2", "Genesis"), ("Genesis 1:3", "Genesis"), ("Genesis 10:1", "Genesis"), ("Genesis Rabbah 1:1", "Genesis Rabbah"), ("Berakhot 2a:1", "Berakhot"), ("Kuzari 1", "Kuzari"), ("Kuzari 2", "Kuzari")]
    rows = spark.createDataFrame([(i, r, t, i) for i, (r, t) in enumerate(refs)], "id long, ref string, title string, seq long")
    asked = ["Genesis 1", "Genesis 1:1-2", "Exodus 3:14", "Genesis", "Berakhot 2a", "Kuzari", "Genesis 1:2"]
    got = {}
    for r in L.resolve(rows, spark.createDataFrame(list(enumerate(asked)), "pos int, ref string")).collect():
        got.setdefault(asked[r.pos], []).append((r.seq, r.ref))
    assert [r for _, r in sorted(got["Genesis 1"])] == ["Genesis 1:1", "Genesis 1:2", "Genesis 1:3"]
    assert [r for _, r in sorted(got["Genesis 1:1-2"])] == ["Genesis 1:1", "Genesis 1:2"]
    assert "Exodus 3:14" not in got and len(got["Genesis"]) == 4 and len(got["Kuzari"]) == 2 and len(got["Berakhot 2a"]) == 1 and got["Genesis 1:2"] == [(1, "Genesis 1:2")]


def test_rate_limit(spark):
    hits = [(1, ms, i) for i, ms in enumerate([0, 10, 20, 30, 40, 50, 3_600_000, 3_600_001])] + [(2, 5, 99)]
    got = {r.id: r.allowed for r in state.rate_limited(spark.createDataFrame(hits, "key long, ms long, id long"), 5, 3_600_000).collect()}
    assert [got[i] for i in range(8)] == [True] * 5 + [False, True, True] and got[99]


def test_stream_resumes(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)
    put = lambda df, n: seen.extend(r.id for r in df.collect())
    for _ in range(2):
        ingest.resume(spark, source, "id long", str(tmp_path / "checkpoint"), put)
    spark.range(5, 8).write.mode("append").parquet(source)
    ingest.resume(spark, source, "id long", str(tmp_path / "checkpoint"), put)
    assert sorted(seen) == list(range(8))


def stream_in_steps(spark, tmp_path, make, steps, schema):
    """The rows of a stream that gets each step as a batch, and how many keys it remembers after each."""
    source, name = tmp_path / "in", f"steps_{tmp_path.name.replace('-', '_')}"
    source.mkdir()
    q = make(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName(name).outputMode("append").start()
    held = []
    for rows in steps:
        spark.createDataFrame([(r[0], r[1] + 10_000, *r[2:]) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()], held


def test_stream_rate_limit(spark, tmp_path):
    from lectern.streaming.rates import hourly, rate_limit

    steps = [[(1, 0, 1), (1, 2, 3), (1, 1, 2), (2, 0, 4)], [(1, 999, 5), (1, 5000, 6)], [(3, 9_000_000, 7)], [(3, 9_000_001, 8)], [(1, 9_000_500, 9)]]
    rows, held = stream_in_steps(spark, tmp_path, lambda s: rate_limit(s, 2, 1000, "1 second"), steps, "key long, ms long, id long")
    assert sorted((r[2], r[4]) for r in rows) == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True), (8, True), (9, True)]
    # keys 1 and 2 are forgotten once the watermark is past their windows
    assert held[0] == 2 and held[3] == 1
    assert hourly(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).agg(F.sum("n")).first()[0] == 1000


def test_stream_tokens(spark, tmp_path):
    from lectern.streaming.rates import one_time

    zero, far = 10_000, 9_010_000
    steps = [[(1, 50, 1, zero), (1, 40, 2, zero), (2, 2000, 3, zero)], [(1, 1060, 4, zero), (3, 1500, 5, zero + 1000)], [(9, 9_000_000, 6, far)], [(8, 9_000_001, 7, far)]]
    rows, held = stream_in_steps(spark, tmp_path, lambda s: one_time(s, 1000, "1 second"), steps, "token long, ms long, id long, issued long")
    assert sorted((r[2], r[3]) for r in rows) == [(1, False), (2, True), (3, False), (4, False), (5, True), (6, True), (7, True)]
    assert held[:2] == [1, 2] and held[3] == 2


def test_footnotes_and_cleaning():
    assert udfs.without_notes('a<sup>1</sup><i class="footnote">x <i>y</i> z</i> b <i>c</i>') == "a b <i>c</i>"
    assert udfs.readable("<p>a&amp;b<br>c  d</p><script>x</script>") == "a&b\nc d"
    assert udfs.blocks("<h2>H</h2><p>one</p><ul><li>x</li><li>y</li></ul><p>two</p>") == ["H\none", "- x\n- y", "two"]
    assert udfs.split_long("aaaa. bbbb. cccc", 12) == ["aaaa. bbbb.", "cccc"]
    assert udfs.fnv("שלום עולם") == "dbd9eeb4" and udfs.folded("Rashi's  Éclair!") == "rashi eclair"


def test_packing():
    assert packing.merge_orders([["a", "b", "d"], ["a", "c", "d"], ["e"]]) == ["e", "a", "c", "b", "d"]
    assert [len(p) for p in packing.parts_of(["w"] * 145)] == [70, 75] and packing.parts_of([]) == []
    assert sum(map(len, packing.parts_of(["w."] * 200))) == 200


def test_balance(spark):
    got = packing.balance(spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2)], "title string, n long"), 2).collect()
    assert sorted(sum(r.n for r in got if r.shard == s) for s in (0, 1)) == [7, 7]


def test_align():
    text = "the quick brown fox jumps"
    assert align.align("quick", text) == (0.0, 4, 9) and align.align("quack", text)[0] == 1.5
    r = random.Random(1)
    for _ in range(40):
        q, t = ("".join(r.choice("ab") for _ in range(n)) for n in (4, 7))
        rows = [[0.0] * (len(t) + 1)]
        for c in q:
            row = [rows[-1][0] + 1]
            for j, d in enumerate(t):
                row.append(min(rows[-1][j] + (0 if c == d else 1.5), rows[-1][j + 1] + 1, row[-1] + 1))
            rows.append(row)
        assert align.costs(q, t)[0].tolist() == pytest.approx(rows[-1])
    assert len(align.best_places("ab", "abxxab", 3, 0.5)) == 2
    assert align.chain([[(0, 1.0), (50, 0.1)], [(10, 0.2), (40, 0.1)]], 250) == [0.0, 40.0]
    assert align.is_abbreviation("ibm", ["international", "business", "machines"]) and not align.is_abbreviation("abc", ["xyz"])


def test_tree_and_spans(spark):
    assert list(tree.leaves([["a", ""], [["b"]]], "T")) == [("T 1:1", "a"), ("T 2:1:1", "b")]
    s = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 6, 7), ("k", 20, 21)], "k string, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in matching.merge_spans(s, ["k"], gap=1).collect()) == [(0, 7), (20, 21)]
    g = spark.createDataFrame([(1, i, v) for i, v in enumerate([7, None, None, None, 9])] + [(2, i, v) for i, v in enumerate([1, *[None] * 8, 2])], "k long, i long, v long")
    got = {(r.k, r.i): r.v for r in sequence.fill_gaps(g, "k", "i", "v", 6).collect()}
    assert [got[1, i] for i in range(5)] == [7, 7, 7, 9, 9] and got[2, 4] is None


def test_prune_and_changes(spark):
    key = lambda n: spark.range(n).select(F.col("id").alias("k"))
    assert state.prune(key(100), key(80), ["k"]).count() == 20 and state.prune(key(100), key(60), ["k"]).count() == 0
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, check string")
    listed = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k long, check string")
    assert {r.k: r.step for r in ingest.classify(stored, listed, "k").collect()} == {1: "gone", 2: "same", 3: "changed", 4: "new"}
    assert sorted((r.k, r.check) for r in ingest.apply_changes(stored, listed, "k").collect()) == [(2, "b"), (3, "x"), (4, "d")]


def test_spellings(spark):
    rows = spark.createDataFrame([("Kiddushin", "Kedushin"), ("Brachos", "Berakhot"), ("Kesubos", "Ketubot")], "a string, b string")
    assert all(r.x == r.y for r in rows.select(X.skeleton(F.col("a")).alias("x"), X.skeleton(F.col("b")).alias("y")).collect())
    books = spark.createDataFrame([(0, "Berakhot"), (1, "Genesis"), (2, "Genesis Rabbah")], "ord int, title string")
    asked = spark.createDataFrame([("brachos",), ("genesis",)], "q string")
    got = {r.q: r.title for r in search.search_books(books, asked, 1).collect()}
    assert got == {"brachos": "Berakhot", "genesis": "Genesis"}


def test_files(spark, tmp_path):
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://a.example.org/x</loc></url><url><loc>https://a.example.org/y</loc></url></urlset>")
    assert files.read_sitemap(spark, str(tmp_path / "map.xml")).count() == 2
    (tmp_path / "links.csv").write_text("a,b,kind,t,u\nx,y,k,m,n\nshort,row\n")
    assert files.read_links(spark, str(tmp_path / "links.csv")).count() == 1
    line = spark.createDataFrame([("x" * 150,)], "s string").select(files.calendar_line(F.col("s"))).first()[0]
    assert [len(p) for p in line.split("\r\n")] == [73, 74, 5]


def test_parsers():
    from lectern.functions import parse

    assert parse.loose_object('x {y} {"refs": ["a",], “english”: []}') == {"refs": ["a"], "english": []} and parse.loose_object("none {}") is None
    assert parse.loose_object('{"hebrew": ["רש"י"]}') == {"hebrew": ["רש״י"]}
    assert parse.by_reference("intro\n[A 1]\none\n[Z]\nmore\n[B 2]\ntwo", {"A 1", "B 2"}) == {"A 1": "one", "B 2": "two"}
    assert parse.reply_sections("GENERAL: g\nWORDS:\na | b\nREADINGS:\nx | y | r | q") == {"GENERAL": ["g"], "WORDS": [["a", "b"]], "READINGS": [["x", "y", "r", "q"]]}
    assert parse.read_markers("a [[read X  1]] b [[read no]] c", {"x 1": "X 1"}) == [("text", "a "), ("read", "X 1"), ("text", " b "), ("text", " c")]
    assert parse.entry_text({"headword": "h", "alt_headwords": ["i"], "content": [{"number": 1, "d": "<b>x</b>"}]}) == "h (also i) 1) x"
    assert parse.first_sense("bread (pl. x; [y; z]) food; money") == "bread food" and parse.first_sense("") == ""
    assert parse.word_forms("והמלכים")[:2] == ["והמלכים", "והמלכ"[:-1] + "ך"] and "מלך" in parse.word_forms("המלכים")
    assert parse.speech_pieces("One. " * 100)[0].count("One") == 44 and all(len(p) <= 700 for p in parse.speech_pieces("word " * 900))


def test_posts_source(spark, tmp_path):
    import json

    from lectern.sources.posts import Posts

    (tmp_path / "listing.json").write_text(json.dumps([{"id": i, "modified": f"2024-01-0{i}"} for i in range(1, 6)]))
    for i in range(1, 6):
        (tmp_path / f"{i}.json").write_text(json.dumps({"content": f"<p>{i}</p>"}))
    spark.dataSource.register(Posts)
    listed = spark.read.format("posts").option("path", str(tmp_path)).option("batch", "2").load()
    assert listed.count() == 5 and listed.where("body is not null").count() == 0
    some = spark.read.format("posts").option("path", str(tmp_path)).option("ids", "2,4,9").option("bodies", "true").load()
    assert sorted((r.id, r.body) for r in some.collect()) == [(2, "<p>2</p>"), (4, "<p>4</p>")]


def test_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(registry.COVERS) == set(catalog.queries())


def test_running_numbers_of_any_keys(spark):
    from lectern.operators.sequence import neighbours_in_order, running_number

    rows = spark.createDataFrame([(w, i) for i in range(40) for w in ("b", "a", None, "é")], "w string, i int")
    got = running_number(rows.repartition(6), ["w", "i"], "n", 5).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 161)) and [(r["w"], r["i"]) for r in got] == sorted(((w, i) for i in range(40) for w in ("b", "a", None, "é")), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    near = neighbours_in_order(spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "v string, k int"), ["k"], "v").collect()
    assert sorted((r["v"], r["before"], r["after"]) for r in near) == [("x", "z", None), ("y", None, "z"), ("z", "y", "x")]
    assert running_number(rows.where("false"), ["w"], "n").count() == 0


def broadcasts(df):
    """The plan below each broadcast of a query, as text."""
    return df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[1:]


def test_respelled_texts_stay_apart_and_are_not_broadcast(spark, tmp_path):
    """Turns beyond 1,000 make ids that are not unique; the texts, small as files, are large as pieces and never a broadcast side."""
    rows = [(1, 1000, "the end"), (2, 0, "no end and the end"), (2, 1, None), (3, 1, "the end"), (3, 2, "end")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["respelled"](spark, str(tmp_path))
    assert sorted((r.id, r.text or "") for r in got.collect()) == [(2000, "no end und thuh end"), (2000, "thuh end"), (2001, ""), (3001, "thuh end"), (3002, "end")]
    assert not any("regexp_extract_all(text" in "\n".join(x.split("\n")[:4]) for x in broadcasts(got))


def test_phrases_leave_words_where_they_are(spark, monkeypatch):
    """No word is shuffled to find phrases or to tag words, and both ways to meet the phrases give the same places."""
    from lectern.operators import phrases

    every = {}
    for small in (phrases.SMALL, 0):
        monkeypatch.setattr(phrases, "SMALL", small)
        for name in ("phrases_found", "tokens_tagged", "words_studied"):
            df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
            if small:
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert not any("pos#" in line.split("Inner")[0].split("LeftOuter")[0] for line in plan.split("\n") if "MergeJoin [" in line), name
            every.setdefault(name, []).append(sorted(map(repr, df.collect())))
    assert all(a == b for a, b in every.values())


def exchanges(df):
    """What a query deals its rows out by, from the plan."""
    return [line.split("Exchange ")[1] for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_runs_are_shuffled_once(spark):
    rows = [(1, "a b c d"), (2, "x b c d"), (3, "b c d b c d"), (4, "q")]
    got = matching.twins(spark.createDataFrame(rows, "ref long, text string").select("ref", F.split("text", " ").alias("words")), 2)
    assert sum("h#" in x for x in exchanges(got)) == 1
    assert sorted(map(tuple, got.collect())) == [(2, 1, 2), (3, 1, 2)]


def test_phrases_are_counted_beside_their_texts(spark):
    """Overlaps, words of one letter, marks between words; no word leaves its task, which the one shuffle by doc_id shows."""
    docs = [(1, "The the THE"), (2, "a.b, a b-a"), (3, "xthe the thex"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = lambda p: {r.doc_id: r.f for r in df.select("doc_id", search._times(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "  ")), F.lit(" ")), p).alias("f")).collect()}
    assert counts(["the", "the"]) == {1: 2, 2: 0, 3: 0, 4: None, 5: 0} and counts(["a", "b", "a"])[2] == 2 and counts(["the"])[3] == 1
    top = search.rank_phrases(df, ["the the", "a b a", "the"], 9)
    assert {r.doc_id for r in top.collect()} == {1, 2, 3}
    assert not any("pos" in x or "start" in x for x in exchanges(top))


def test_words_get_their_lines_in_one_shuffle_of_pages(spark, tmp_path, monkeypatch):
    from lectern.operators import layout

    lines = [(page, n, n * 2 + page, 1 + n % 2, 5.0, 0.25 * n) for page in range(20) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(layout, "CLAIMS", 5, raising=False)
    for name in ("words_on_lines", "pages_whole"):
        got = catalog.queries()[name](spark, str(tmp_path))
        dealt = exchanges(got)
        assert not any("word#" in x for x in dealt) and any(", 12)" in x or ", 12," in x for x in dealt), dealt


def test_citations_are_dealt_by_number_and_nulls_come_last(spark, tmp_path):
    lines = [(None, 7, 1), (5, 7, 2), (5, 7, 1), (6, None, 1), (4, None, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["citations_once"](spark, str(tmp_path))
    assert all("REPARTITION_BY_NUM" in x for x in exchanges(got))
    assert {(r.block, r.ref, r.pos, r.first_anywhere) for r in got.collect()} == {(None, 7, 1, False), (5, 7, 1, True), (6, None, 1, False), (4, None, 3, True)}


def test_batches_of_whole_texts_are_bounded(spark):
    """The tables of every query bound what goes to a Python worker at once, by rows and by bytes."""
    own = spark.newSession()
    registry.Tables(own, "/root/testdata/sf0.001")("pages")
    held = [int(own.conf.get(f"spark.sql.execution.arrow.max{x}PerBatch").rstrip("b")) for x in ("Records", "Bytes")]
    assert 0 < held[0] <= 1000 and 0 < held[1] <= 4 << 20
