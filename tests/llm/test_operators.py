"""Each operator against a brute-force version on small texts, and its defined results at the edges."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, lang_id, mixing, near_dedup, page_text, pieces, ppm, prefix_prints, records, toxicity
from lectern.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, component long"


def frame(spark, texts, ids=None, lang="en", source="s"):
    """Documents with extra columns whose names clash with those that operators make."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def some_texts(n=60, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(80)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        words = t.split()
        for _ in range(r.randint(0, 3)):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    return [*out, None, "", " ", "  a\t b ", "a b", base[0], base[0].upper(), "one two three", "One Two\nThree"]


# ---------------------------------------------------------------- exact dedup


def test_exact_groups(spark):
    texts = some_texts()
    norm = [" ".join(exact_dedup.squeeze((t or "").encode()).decode().split(" ")) for t in texts]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_edges(spark):
    rows = exact_dedup.exact_groups(frame(spark, ["a", "a", None, "b", "b"], [1, 1, None, None, 7])).collect()
    assert len(rows) == 5 and [r.kept for r in rows if r.doc_id == 7] == [True] and sum(r.group_size == 2 for r in rows) == 4
    assert exact_dedup.exact_groups(frame(spark, ["x"]).where("false")).count() == 0
    left = exact_dedup.drop_copies(frame(spark, ["a", "a", "a"], [1, 1, 2]))
    assert left.count() == 1 and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_exact_when_fingerprints_collide(spark, monkeypatch):
    """With one fingerprint for all texts of a length the chunks still tell them apart."""

    def mark(batches):
        import pyarrow as pa

        for b in exact_dedup._mark(batches):
            yield b.set_column(3, "fp", pa.array([7] * b.num_rows, pa.int64()))

    monkeypatch.setattr(exact_dedup, "_MARK", mark)
    texts = ["a" * 100, "b" * 100, "a" * 100, "c", "d", "e e"]
    got = {x.doc_id: x for x in exact_dedup.exact_groups(frame(spark, texts), chunk_bytes=16).collect()}
    assert [(got[i].keep_id, got[i].group_size) for i in range(6)] == [(0, 2), (1, 1), (0, 2), (3, 1), (4, 1), (5, 1)]


def test_exact_long_texts(spark):
    """Texts of several chunks that differ only in white space, or in the last character."""
    long = " ".join(f"w{i}" for i in range(60_000))
    got = {x.doc_id: x for x in exact_dedup.exact_groups(frame(spark, [long, long.replace(" ", "\n\t"), long[:-1] + "x", None, ""])).collect()}
    assert [(got[i].keep_id, got[i].group_size) for i in range(5)] == [(0, 2), (0, 2), (2, 1), (3, 2), (3, 2)]
    many = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    assert exact_dedup.exact_groups(many).where("group_size = 3000 and keep_id = 0").count() == 3000


@pytest.mark.parametrize("which", [0, 1])
def test_fingerprints_compose(which):
    data = random.Random(1).randbytes(20_000)
    base = exact_dedup.BASES[which]
    whole = exact_dedup.fingerprints([data])[0, which]
    plain = 0
    for b in data:
        plain = (plain * base + b) % exact_dedup.PRIME
    left, right = exact_dedup.fingerprints([data[:7777], data[7777:]])[:, which]
    assert whole == plain == exact_dedup.combine(int(left), int(right), len(data) - 7777, base)


# ---------------------------------------------------------------- near dedup


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_groups(spark):
    texts = some_texts()
    got = {r.doc_id: r for r in near_dedup.near_groups(frame(spark, texts)).collect()}
    for i, (n, c) in enumerate(brute_components(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_near_crowd_below_the_threshold(spark):
    """A crowd of look-alikes around the threshold: many are linked only through others."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(80)] = f"x{k}{r.randrange(99)}"
        texts.append(" ".join(words))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, texts)).collect()}
    assert [got[i] for i in range(70)] == [c for _, c in brute_components(texts)]


def test_near_edges(spark):
    rows = near_dedup.near_groups(frame(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f"], [3, 3, 5, None])).collect()
    assert len(rows) == 4 and all(x.kept for x in rows if x.doc_id == 5)
    assert near_dedup.near_groups(frame(spark, ["x"]).where("false")).count() == 0


def test_near_repeated_ids(spark):
    """Rows that share a doc_id are linked by their own texts."""
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "tu")
    got = near_dedup.near_groups(frame(spark, [one, two, one + " tail", two + " tail", two], [1, 1, 5, 9, 1])).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (1, 1), (1, 1), (5, 1), (9, 1)]
    # one row of each of the two components stays
    left = near_dedup.drop_near_copies(frame(spark, [one, two, one + " tail", two + " tail", two], [1, 1, 5, 9, 1])).collect()
    assert sorted(x.text for x in left) == [one, two]
    r = random.Random(8)
    texts = some_texts(40, 9)
    ids = [r.randrange(30) for _ in texts]
    got = near_dedup.near_groups(frame(spark, texts, ids)).collect()
    brute = brute_components(texts)
    least = {c: min(i for i, (_, d) in zip(ids, brute, strict=True) if c == d) for _, c in brute}
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((i, n, least[c]) for i, (n, c) in zip(ids, brute, strict=True))


def test_near_long_texts(spark):
    """A text of 200,000 words and one that differs in every twelfth word stay apart; one with a changed head is linked."""
    words = [f"w{i * 7919 % 100_003}x{i}" for i in range(200_000)]
    far = [w if i % 12 else "z" + w for i, w in enumerate(words)]
    got = {x.doc_id: x for x in near_dedup.near_groups(frame(spark, [" ".join(words), " ".join(far), " ".join(["head", *words[20:]]), ""])).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 1, 0, 3] and got[0].n_shingles == 199_996 and got[3].n_shingles == 0


def test_posterior_bound():
    """The bound is the least m whose upper tail still reaches the miss probability."""
    for n in (60, 120, 360):
        m = near_dedup.least_matches(n)
        grid = np.linspace(1e-4, 1 - 1e-4, 20_001)
        tail = lambda k: (lambda d: d[grid >= 0.75].sum() / d.sum())(np.exp(k * np.log(grid) + (n - k) * np.log(1 - grid)))  # noqa: B023, E731
        assert tail(m) >= near_dedup.MISS * 0.5 and (m == 0 or tail(m - 1) < near_dedup.MISS * 2)


def test_shingles_against_sets():
    texts = [(t or "").encode() for t in some_texts()]
    values, bounds = shingle_sets(texts)
    assert np.diff(bounds).tolist() == [n for n, _ in brute_components([t.decode() for t in texts])]


# ---------------------------------------------------------------- mixing


def test_targets_by_water_filling(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), ("d", 0), (None, 300), ("e", 40)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, (s, _) in enumerate(order)}
    total, full, size = sum(n for _, n in sizes), set(), dict(sizes)
    while True:
        unit = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        above = {s for s in size if s not in full and unit * weight[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    for s in size:
        assert got[s] == pytest.approx(3 * size[s] if s in full else unit * weight[s])


def test_mix_takes_what_it_says(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randint(0, 10**9)}" + r.choice(["", "\n"]) for _ in range(r.randint(0, 300))), "en", f"s{i % 5}", 0, "x", 1) for i in range(300)] + [(900, None, "en", None, 0, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a = sorted(mixing.taken(docs, length=16).collect(), key=str)
    assert a == sorted(mixing.taken(docs.repartition(7), length=16).collect(), key=str)
    assert len(a) == 301 and all(0 <= x.taken <= 3 * x.size for x in a)
    by = {}
    for x in a:
        by.setdefault((x.source_size, x.target), []).append(x.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1
    texts = mixing.mixed_documents(docs, length=16)
    got = texts.collect()
    assert texts.columns == docs.columns and sum(len((x.text or "").split()) for x in got) == sum(x.taken for x in a)
    # what is taken of a document keeps the white space that it has there
    whole = {x[0]: x[1] for x in rows}
    assert any("\n " in x.text and x.text != whole[x.doc_id] for x in got) and all(x.text.split()[0] in whole[x.doc_id] for x in got)
    assert mixing.taken(docs.where("false")).count() == 0 and mixing.mixed_documents(docs.where("false")).count() == 0
    # the shards hold the same words, in slots of fixed length, and mix the sources
    shards = mixing.mixed_shards(docs, length=16, shard_blocks=32).collect()
    words = lambda found: sorted(w for x in found for w in x.text.split())
    assert words(shards) == words(got) and all(len(x.text.split()) == x.n_words <= 16 for x in shards)
    count = {k: sum(x.shard == k for x in shards) for k in {x.shard for x in shards}}
    assert [count[k] for k in sorted(count)][:-1] == [32] * (len(count) - 1) and len({(x.shard, x.place) for x in shards}) == len(shards)
    assert len({tuple(sum(x.shard == k and x.source == s for x in shards) for s in ("s0", "s1", "s2")) for k in count}) > 1
    assert mixing.mixed_shards(docs.where("false")).count() == 0


def test_mix_meets_small_targets(spark):
    """Three sources of 100 words have targets of 50, 100 and 150 words, and get them."""
    docs = frame(spark, [" ".join(["w"] * 100)] * 3).withColumn("source", F.concat(F.lit("s"), F.col("doc_id")))
    assert [(x.doc_id, x.target, x.taken) for x in sorted(mixing.taken(docs).collect())] == [(0, 50.0, 50), (1, 100.0, 100), (2, 150.0, 150)]


def test_shard_counts_keep_the_totals():
    counts = np.array([5, 0, 700, 41], dtype=np.int64)
    of = mixing.shard_counts(counts, 64, 3)
    got = [of(k) for k in range(12)]
    assert (sum(n for _, n in got) == counts).all() and [int(n.sum()) for _, n in got] == [64] * 11 + [42]
    assert all((got[k][0] + got[k][1] == got[k + 1][0]).all() for k in range(11))
    # a split has the mean and the spread of the hypergeometric distribution
    some = np.array([mixing.halves(counts, 373, seed, 0, 12)[3] for seed in range(2000)])
    assert abs(some.mean() - 20.5) < 0.5 and abs(some.var() - 41 * 0.25 * 705 / 745) < 1
    huge = np.array([3 * 10**9, 10**9, 7], dtype=np.int64)
    assert mixing.halves(huge, 2 * 10**9, 1, 0, 2).sum() == 2 * 10**9


def test_spans_of():
    assert mixing.spans_of(b" a  b\nc d\te ", [(3, 4), (0, 1), (1, 2)]) == b"a  b\nd"


def test_permutation():
    for n in (1, 2, 7, 100, 1000):
        i = np.arange(n)
        assert sorted(mixing.permute(i, np.full(n, n), np.full(n, 99, dtype=np.uint64)).tolist()) == i.tolist()


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for x in ("zorgle", "Zorglest", "plimfo"):
                w[r.randrange(40)] = x
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    texts = [t for _, t in rows]
    got = {x.doc_id: x for x in toxicity.score_texts(frame(spark, [*texts, None, ""], [*range(400), 900, None]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in range(400) if got[i].held_out) == held
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values()) and len(got) == 402


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity.score_texts(frame(spark, ["a", None]), none).collect()] == [0.0, 0.0]


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([3.0, 1, 2, 4, 2]), np.array([1.0, 0, 1, 1, 0]), np.ones(5))
    assert (np.diff(ys) >= 0).all() and np.interp(2, xs, ys) == pytest.approx(0.5)


def test_obfuscation():
    f = toxicity.Featuriser({"w:idiot": 2.0})
    assert f.text("you are an 1d1ot now")[5] > 0 and f.text("i d i o t")[1] > 0 and f.text("idyll")[1] == 0


# ---------------------------------------------------------------- records


def test_crc_and_frames():
    assert records.crc32c([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    parts = [random.Random(3).randbytes(n) for n in (0, 1, 3, 4, 2047, 2048, 2049, 9000)]
    framed = records.frame(parts)
    data, at = b"".join(framed), np.cumsum([0, *map(len, framed)])[:-1].tolist()
    assert records.unframe(data, at, [len(p) for p in parts]) == parts
    with pytest.raises(ValueError):
        records.unframe(data[:-1] + b"\x07", at, [len(p) for p in parts])


def test_records_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    texts = [*some_texts(20), "don't <|endoftext|> x", "日本 語"]
    got = sorted(records.round_trip(frame(spark, texts), spec, 1).collect())
    ids = [e.ids + [1] for e in Tokenizer.from_str(spec).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    start = 0
    for row, own in zip(got, ids, strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        start += len(own)
    assert records.round_trip(frame(spark, ["x"]).where("false"), spec, 1).count() == 0
    assert len(records.round_trip(frame(spark, ["b", "a", "a"], [None, 2, 2]), spec, 1).collect()) == 3


# ---------------------------------------------------------------- SentencePiece


def field(n, value):
    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    if isinstance(value, float):
        return varint(n << 3 | 5) + np.float32(value).tobytes()
    return varint(n << 3 | 2) + varint(len(value)) + value


def unigram_model():
    """A small unigram model with byte fallback, written field by field."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    vocabulary += [(p, -float(i + 1), 1) for i, p in enumerate(["▁", "▁the", "a", "b", "ab", "▁ab", "e", "h", "t", "the"])]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in vocabulary)
    return body + field(2, field(3, 1) + field(35, 1) + field(40, 0)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_pieces_parity(kind):
    import public_tokenizers
    import sentencepiece

    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read() if kind == "bpe" else unigram_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", " ", "the ab abba", "  the  tab ", "x ", " x", "日本 語", "a\n\nb", "▁a▁ ▁b", *(t or "" for t in some_texts(20))]
    encoder = pieces.Encoder(data)
    for text, (ids, same, back) in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(ids, dtype="<u4").tolist()
        assert ids == reference.encode(text) and same and (back or "▁" in text)
        assert encoder.decode(ids) == reference.decode(ids)


def test_pieces_frame(spark):
    import public_tokenizers

    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    got = pieces.encode_documents(frame(spark, [None, "", "a b", "a b"], [1, 2, 3, 3]), model).collect()
    assert sorted(x.n_tokens for x in got) == [0, 0, 2, 2] and all(x.parity and x.round_trip for x in got)


# ---------------------------------------------------------------- prefix fingerprints


def test_prefix_fingerprints(spark):
    texts = [*some_texts(20), "é日🙂", "é日🙂"]
    got = {x.doc_id: x for x in prefix_prints.fingerprints(frame(spark, texts), range_bytes=300).collect()}
    plain = [t or "" for t in texts]

    def like(x, y):
        p = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        s = next((i for i in range(min(len(x), len(y))) if x[-1 - i] != y[-1 - i]), min(len(x), len(y)))
        return min(p + s, len(x), len(y)) / max(len(x), len(y)) if x or y else 1.0

    def most(x, y):
        """As ``like``, with all common spans of an anchor's length."""
        have = {y[i : i + n] for i in range(len(y)) for n in (prefix_prints.ANCHOR,)}
        spans = [(i, i + prefix_prints.ANCHOR) for i in range(len(x) - prefix_prints.ANCHOR + 1) if x[i : i + prefix_prints.ANCHOR] in have]
        return like(x, y) + prefix_prints.covered(spans) / max(len(x), len(y), 1)

    for i, x in enumerate(plain):
        y = plain[(i + 1) % len(plain)]
        m = len(x) // 2
        edited = x[: len(x) - m] + y[:m]
        r = got[i]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, y)):
            assert like(x, other) - 1e-9 <= near <= min(1.0, most(x, other)) + 1e-9
        assert (r.fingerprint == got[(i + 1) % len(plain)].fingerprint) == (x == y)
        assert r.edited_fingerprint == prefix_prints.Prefixes(edited).fingerprint()


def test_prefix_edges(spark):
    assert prefix_prints.fingerprints(frame(spark, ["x"]).where("false")).count() == 0
    assert prefix_prints.fingerprints(frame(spark, ["ab"])).first().near_next == 1.0
    assert prefix_prints.fingerprints(frame(spark, ["a", "a", "b", "c"], [1, 1, None, 3])).count() == 4
    # many rows without an id are dealt by their texts
    many = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    assert prefix_prints.fingerprints(many, range_bytes=100).count() == 500


def test_likeness_with_changed_head_and_foot():
    r = random.Random(12)
    body = "".join(r.choice("abcdefgh ") for _ in range(2500))
    one, two = prefix_prints.Prefixes("A head. " + body + " its foot"), prefix_prints.Prefixes("Another, longer head: " + body + " and foot.")
    assert prefix_prints.likeness(one, two) > 0.95 and prefix_prints.likeness(two, one) > 0.95
    moved = prefix_prints.Prefixes(body[1000:] + "-" + body[:1000])
    assert prefix_prints.likeness(prefix_prints.Prefixes(body), moved) > 0.55
    other = prefix_prints.Prefixes("".join(r.choice("abcdefgh ") for _ in range(2500)))
    assert prefix_prints.likeness(one, other) < 0.05
    # repeated text counts once on the side that has it once
    assert prefix_prints.likeness(prefix_prints.Prefixes(body[:200] * 5), prefix_prints.Prefixes("x" + body[:200] + "y" * 799)) < 0.25


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav>
<div class="ad">buy</div><article><header>top</header><h1>Head &amp; tail</h1><p><b>One<br><p>Two   words</p><div class="x">Follow our  page</div><p>Text %s</p><form>f</form></article>
<div id="comments"><p>reader</p></div><footer>&copy; x</footer></body></html>"""


def test_page_text(spark):
    rows = [(i, f"http://h.example.org/{i}", PAGE % i) for i in range(6)] + [(10, None, None), (11, "http://o.example.org/", "<p>only &lt;this&gt;</p>"), (12, "x", ""), (13, "http://o.example.org/", "<div><p>cut off")]
    got = {x.page_id: x for x in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[2].text == "Head & tail\nOne\nTwo words\nText 2" and got[2].n_chars == len(got[2].text)
    assert (got[10].text, got[11].text, got[12].text, got[13].text) == ("", "only <this>", "", "cut off")
    assert page_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_text_by_counts(spark):
    """Subtrees without a telling name go by their count on the host, outside the article and inside it; prose of an article stays."""
    promo = "<section><article><p>Buy our long and repeated offer of the week.</p></article></section>"
    words = [f"Real words of article number {i}, longer than the offer of any week on this host." for i in range(5)] + ["Short."]
    page = "<body>" + promo + "<article><p>%s</p><div>Read on with our plan.</div><p>Quoted %d.</p></article></body>"
    rows = [(i, f"http://p.example.org/{i}", page % (x, i)) for i, x in enumerate(words)]
    rows += [(9, "http://q.example.org/9", "<article><p>Own.</p><div>Read on with our plan.</div></article>")]
    got = {x.page_id: x.text for x in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == words[0] + "\nQuoted 0." and got[5] == "Short.\nQuoted 5."
    assert [i for i, x in got.items() if "Read on" in x] == [9]


def test_page_text_counts_the_whole_page():
    root = page_text.parse("<body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>T</h1><p>One <b>two</b></p></article><footer>x</footer></body>")
    main = page_text.article(root)
    got = page_text.hashes(root, main) - {page_text.ALL}
    tags, todo = {}, [root]
    while todo:
        e = todo.pop()
        tags[e.hash] = e.tag
        todo += [x for x in e.below if not isinstance(x, str)]
    assert sorted(tags[x] for x in got) == ["div", "footer", "li", "nav", "ul"]


# ---------------------------------------------------------------- language model


@pytest.mark.parametrize("order", [5, 3])
def test_ppm_against_trie(spark, order):
    texts = some_texts(30)
    got = {x.doc_id: x for x in ppm.score_corpus(frame(spark, texts), order=order, block_bytes=2000, buckets=7).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    trie, counts = ppm.Trie(order), {}
    for t, h in zip(texts, held, strict=True):
        if not h:
            trie.learn((t or "").encode())
            for w in [*(t or "").encode().lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(words), n) and r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score == pytest.approx(trie.score((t or "").encode()), rel=1e-4)


def test_ppm_sums_to_one_and_adapts():
    trie = ppm.Trie(3)
    trie.learn(b"abracadabra")
    assert sum(np.exp(trie.cost(b"abr", s)) for s in range(256)) == pytest.approx(1.0)
    once, twice = ppm.Trie(4).score(b"ab" * 40, adaptive=True), ppm.Trie(4).score(b"ab" * 80, adaptive=True)
    assert twice - once > once / 4


def test_ppm_edges(spark):
    assert ppm.score_corpus(frame(spark, ["x"]).where("false")).count() == 0
    assert ppm.score_corpus(frame(spark, ["a", "a", None], [None, 4, 4])).count() == 3


# ---------------------------------------------------------------- language identification


def test_language_evidence(spark):
    r = random.Random(9)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    docs = frame(spark, [make("abcde") for _ in range(40)], lang="xx").unionByName(frame(spark, [make("vwxyz") for _ in range(40)], list(range(100, 140)), lang="yy"))
    pages = [(i, f"https://a{i % 2}.example.org/", f'<html lang="{"xx" if i % 2 else "yy"}"><p>{make("abcde" if i % 2 else "vwxyz")}</p>') for i in range(20)]
    pages += [(50, "https://a1.example.org/e", "<html><p></p>"), (51, "https://a0.example.org/e", '<html lang="yy">'), (52, None, None)]
    got = lang_id.identify(lang_id.document_rows(docs).unionByName(lang_id.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))), *lang_id.fit(docs)).collect()
    by_doc, by_page = {x.doc_id: x for x in got if x.doc_id is not None}, {x.page_id: x for x in got if x.page_id is not None}
    assert all(x.lang == ("xx" if i < 100 else "yy") for i, x in by_doc.items()) and len(by_doc) == 80 and len(by_page) == 23
    assert (by_page[50].lang, by_page[51].lang, by_page[50].text_lang) == ("xx", "yy", None) and all(0 < x.confidence <= 1.0001 for x in got)
    none = lang_id.identify(lang_id.document_rows(docs), *lang_id.fit(docs.where("false")))
    assert none.where("lang is null").count() == 80


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {x.doc_id for x in toxicity.score_texts(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    one = corpus_pipeline.clean(spark, docs, folder)
    assert {x.doc_id for x in one.collect()} == set(rows) - toxic
    two = corpus_pipeline.exact(spark, one, folder)
    seen, expect = set(), set()
    for i in sorted(set(rows) - toxic):
        key = exact_dedup.squeeze(rows[i].text.encode())
        expect |= set() if key in seen else {i}
        seen.add(key)
    assert {x.doc_id for x in two.collect()} == expect
    three = corpus_pipeline.near(spark, two, folder)
    order = sorted(expect)
    keep = {order[i] for i, (n, c) in enumerate(brute_components([rows[i].text for i in order])) if i == c or not n}
    assert {x.doc_id for x in three.collect()} == keep
    four = corpus_pipeline.mix(spark, three, folder)
    assert four.columns == docs.columns and {x.doc_id for x in four.collect()} <= keep
    assert corpus_pipeline.run(spark, folder).where("not verified").count() == 0


def test_features_do_not_depend_on_order():
    """What a featuriser has seen before leaves the features of a text as they are."""
    lexicon, texts = {"w:idiot": 2.0, "p:zorg": 1.0}, ["idiot", "i d i o t yes", "calm", "", "calm idiot", "you ZORGLES!! a1b 1d1ot", "x " * 40]
    fresh = np.vstack([toxicity.Featuriser(lexicon).text(t) for t in texts])
    f = toxicity.Featuriser(lexicon)
    assert (f.texts(texts) == fresh).all() and (f.texts(texts[::-1]) == fresh[::-1]).all()
    assert fresh[4][1] == 0.5 and f.texts([]).shape == (0, toxicity.FEATURES)


def test_scores_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join([*(r.choice(words) for _ in range(20)), *(["zorgle", "you"] if i % 3 == 0 else [])]) for i in range(120)]
    docs, labels = frame(spark, [*texts, "z" * 100_000 + " zorgle" * 5000]), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    one, two = (sorted((x.doc_id, x.score) for x in toxicity.score_texts(d, labels).collect()) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert one == two and one[120][1] > 0.5
    assert toxicity.score_texts(docs.where("false"), labels).count() == 0 and toxicity.drop_toxic(docs.where("false"), labels).count() == 0


def test_words_encoded_apart():
    """Word by word or whole, the ids are those of the tokenizers library; a description that says less is not trusted."""
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    texts = ["", None, "  a\t\nB ", "don't it's x's 'll. 's's s'", "\u00c9\u00c0 e\u0301x H\u0331 \u0130stanbul \u03a3\u0391\u03a3.", "a<|endoftext|>b c", "1st 2nd a1b, x.y.z \u00b2a \u2167.", "\u0301abc a\u0301.", "a\x00b \x1cq", "x--- --- (a) \"b\"", "\u65e5\u672c\u3001ok! \U0001f642a.", "Word, WORD. word " * 5000]
    plain = Tokenizer.from_str(spec)
    expect = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    cache = records.WordCache(spec, room=20)
    assert cache.apart and [np.frombuffer(x, dtype="<u2").tolist() for x in cache.encode(pa.array(texts))] == expect
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in cache.encode(pa.array(texts).slice(3, 4))] == expect[3:7]
    other = json.loads(spec)
    other["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True})
    cache = records.WordCache(json.dumps(other))
    assert not cache.apart and [np.frombuffer(x, dtype="<u2").tolist() for x in cache.encode(pa.array(["a b", None]))][1] == []


def test_precompiled_normaliser():
    """A model with a map of characters that also squeezes white space: ids are those of SentencePiece."""
    import sentencepiece

    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = next(dict(pieces.wire(value))[2] for key, value in pieces.wire(made) if key == 3)
    data = unigram_model() + field(3, field(1, b"nmt_nfkc") + field(2, charsmap) + field(3, 1) + field(4, 1) + field(5, 1))
    encoder, reference = pieces.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert encoder.model.charsmap == charsmap and encoder.model.squeeze and not encoder.by_stretch
    texts = ["\uff34\uff28\uff25 \uff41\uff42", "the   the", "  ab  ab ", "\ufb01 \u2460", "a\tb\n\nc", "A\u030a e\u0301", "\u65e5\u672c", "the ab " * 3000]
    for text, (ids, same, _) in zip(texts, encoder.encode(texts), strict=True):
        assert same and np.frombuffer(ids, dtype="<u4").tolist() == reference.encode(text)


def brute_identify(rows, names, table, smooth=8.0):
    """Evidence on rows (text, markup, suffix, host), one row and one number at a time."""
    import math

    n, likely = len(names), []
    for text, *_ in rows:
        body = b" " + b" ".join((text or "").encode().lower().split()) + b" "
        slots = [((((body[i] << 16) | (body[i + 1] << 8) | body[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(body) - 2)]
        total = [sum(table[s][k] for s in slots) * min(1.0, lang_id.EFFECTIVE / max(len(slots), 1)) for k in range(n)]
        likely.append([x - max(total) for x in total])
    said = [[math.exp(x) / sum(map(math.exp, row)) for x in row] for row in likely]
    add = lambda keep: [sum(s[k] for s, r in zip(said, rows, strict=True) if keep(r)) for k in range(n)]
    whole = add(lambda r: True)
    base = [(x + 1) / (sum(whole) + n) for x in whole]
    kinds = {r[1] for r in rows if r[1] is not None}
    marked = add(lambda r: r[1] is not None)
    out = []
    for own, like, (_, markup, suffix, host) in zip(said, likely, rows, strict=True):
        towards = lambda counts, prior: [(c + smooth * p) / (sum(counts) + smooth) for c, p in zip(counts, prior, strict=True)]
        less = lambda counts: [max(c - o, 0.0) for c, o in zip(counts, own, strict=True)]  # noqa: B023, E731
        prior = towards(less(add(lambda r: r[2] == suffix)), base)  # noqa: B023
        if host is not None:
            prior = towards(less(add(lambda r: (r[3], r[2]) == (host, suffix))), prior)  # noqa: B023
        trust = [math.log((a + 0.5) / (m + 0.5 * len(kinds) + 0.5)) for a, m in zip(add(lambda r: r[1] == markup), marked, strict=True)] if markup is not None else [0.0] * n  # noqa: B023
        fused = [x + math.log(p) + t for x, p, t in zip(like, prior, trust, strict=True)]
        top = max(fused)
        out.append((names[fused.index(top)], 1 / sum(math.exp(x - top) for x in fused)))
    return out


def test_language_against_brute_force(spark):
    """Every number of the fusion, with ties, missing evidence, empty and very long texts; and the edges."""
    r = random.Random(21)
    make = lambda letters, n=12: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(n))
    docs = frame(spark, [make("abcd") for _ in range(15)], lang="xx").unionByName(frame(spark, [make("cdef") for _ in range(15)], list(range(50, 65)), lang="yy"))
    names, table = lang_id.fit(docs)
    rows = [(make(r.choice(["abcd", "cdef", "ad"])), r.choice(["xx", "yy", None]), r.choice(["org", "net", ""]), r.choice(["a.org", "b.net", None])) for _ in range(40)]
    rows += [(None, None, None, None), ("", "xx", "org", "a.org"), ("", "xx", "org", "a.org"), (make("abcd", 20_000), None, "net", "b.net"), ("ab", None, None, None)]
    frame_ = spark.createDataFrame([(i, None, *x, "clash") for i, x in enumerate(rows)], "doc_id long, page_id long, text string, markup string, suffix string, host string, lang string")
    got = {x.doc_id: x for x in lang_id.identify(frame_, names, table).collect()}
    for i, (lang, confidence) in enumerate(brute_identify(rows, names, table)):
        assert got[i].lang == lang and got[i].confidence == pytest.approx(confidence, rel=1e-6)
    assert lang_id.identify(frame_.where("false"), names, table).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html lang='yy'>cdef", "clash", "z")], "page_id long, url string, html string, text string, host string")
    assert lang_id.page_rows(pages).first().asDict() == {"doc_id": None, "page_id": 1, "text": " cdef", "markup": "yy", "suffix": "org", "host": "a.org"}


def brute_pages(rows, many=page_text.MANY, share=page_text.SHARE):
    """Main texts of well-formed pages by the standard parser, plain trees and plain counts."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, page):
            super().__init__(convert_charrefs=False)
            self.root = ["", False, []]
            self.stack = [self.root]
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            named = {w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").lower().split()}
            e = [tag, tag in page_text.DROP or tag not in ("html", "body", "article", "main") and bool(named & page_text.NOT_ARTICLE), []]
            self.stack[-1][2].append(e)
            self.stack.append(e)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            self.stack[-1][2].append(data)

        def handle_entityref(self, name):
            self.stack[-1][2].append(f"&{name};")

    import html

    def key(e):
        return (e[0], tuple(" ".join(x.split()) if isinstance(x, str) else key(x) for x in e[2] if not isinstance(x, str) or x.strip()))

    def words(e):
        return sum(len(x.strip()) if isinstance(x, str) else words(x) for x in e[2])

    def every(e):
        return [e] + [y for x in e[2] if not isinstance(x, str) for y in every(x)]

    def holds(e, main):
        return e is main or any(holds(x, main) for x in e[2] if not isinstance(x, str))

    def main_of(e, gone):
        if e[1] or words(e) and key(e) in gone:
            return []
        return ([e] if e[0] == "article" else []) + [y for x in e[2] if not isinstance(x, str) for y in main_of(x, gone)]

    def choose(root, gone):
        return max(main_of(root, gone), key=words, default=root)

    def text(e, gone, prose, top=True):
        if not top and (e[1] or words(e) and key(e) in gone and not (prose and e[0] in page_text.PROSE)):
            return "\n" if e[0] in page_text.BLOCK else ""
        body = "".join(x if isinstance(x, str) else text(x, gone, prose, False) for x in (y.replace("\n", " ") if isinstance(y, str) else y for y in e[2]))
        return f"\n{body}\n" if e[0] in page_text.BLOCK or top else body

    trees = [(page_text.host_of(url), Tree(page or "").root) for _, url, page in rows]
    seen, whole = {}, {}
    for host, root in trees:
        main = choose(root, set())
        name = key(main) if main is not root else text(root, set(), False)
        whole.setdefault(host, set()).add(name)
        inside = {id(x) for x in every(main)} if main is not root else set()
        for e in every(root)[1:]:
            if words(e) and not holds(e, main) and not (id(e) in inside and e[0] in page_text.PROSE):
                seen.setdefault((host, key(e)), set()).add(name)
    out = []
    for host, root in trees:
        gone = {k for (h, k), n in seen.items() if h == host and len(n) >= many and len(n) >= share * len(whole[host])}
        main = choose(root, gone)
        lines = [" ".join(html.unescape(x).split()) for x in text(main, gone, main is not root).split("\n")]
        out.append("\n".join(x for x in lines if x))
    return out


def test_page_text_against_brute_force(spark):
    r = random.Random(31)
    some = lambda n: " ".join(r.choice(["one", "two &amp; a", "three", "four", "x&lt;y", f"n{r.randrange(10**6)}"]) for _ in range(n))
    parts = {h: [f"<div><span>{some(4)}</span><p>{some(3)}</p></div>" for _ in range(3)] for h in range(4)}
    rows = []
    for i in range(120):
        h = r.choice([0, 0, 0, 1, 2, 3])
        bits = [r.choice(parts[h]) if r.random() < 0.5 else f"<p>{some(r.randint(1, 9))}</p>" for _ in range(r.randint(0, 4))]
        body = "".join(f"<h1>{some(2)}</h1>" + "".join(f"<p>{some(r.randint(3, 30))} <b>{some(1)}</b></p>" + r.choice(["", r.choice(parts[h]), "<div class='ad'>buy</div>"]) for _ in range(r.randint(1, 4))))
        around = r.choice([lambda x: f"<article>{x}</article>", lambda x: f"<main><article>{x}</article></main>", lambda x: x])(body)
        rows.append((i, f"https://h{h}.example.org/{i}" if h < 3 else None, f"<html><body><nav><a>menu</a></nav>{''.join(bits)}{around}<footer>f</footer></body></html>"))
    rows += [(200, "https://h0.example.org/x", None), (201, "https://h0.example.org/y", ""), (7, "https://h1.example.org/7", rows[0][2]), (202, "https://h2.example.org/long", f"<body><article><p>{some(60_000)}</p></article></body>")]
    got = page_text.main_texts(spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, host string")).collect()
    assert sorted((x.page_id, x.url or "", x.text, x.n_chars) for x in got) == sorted((i, url or "", t, len(t)) for (i, url, _), t in zip(rows, brute_pages(rows), strict=True))


@pytest.mark.parametrize("run", [ppm.score_corpus, lambda d: pieces.encode_documents(d, unigram_model()), lambda d: pieces.encoded(d, unigram_model())])
def test_scorers_at_the_edges(spark, run):
    """No rows, no ids, repeated ids, null, blank and very long texts give one row each."""
    docs = frame(spark, ["the ab", None, " ", "the ab", "ab the " * 40_000], [None, 5, None, 5, 6])
    assert run(docs).count() == 5 and run(docs.where("false")).count() == 0
