"""Packing, whitening and vector codes against plain versions on small tables, and their edge cases."""

from __future__ import annotations

import collections
import math
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from compare import differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import cutting, vector_codes, whitening
from lectern.llm.vectors import integers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def padding(sizes, room):
    return sum(room - n for n in sizes if n & (n - 1))


def check_packs(rows, texts, words, room):
    """Every id of every document once, gapless sequences, checksums of the ids; returns the sizes of the sequences."""
    core = Tokenizer.from_str(words)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, mine in by_doc.items():
        ids = np.array([*core.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("room", [64, 2048])
def test_packs_whole_table(spark, words, room):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = check_packs(cutting.pack(docs, words, room=room).collect(), texts, words, room)
    assert padding(sizes, room) <= 0.002 * sum(sizes)
    assert len(sizes) <= sum(sizes) / room * 1.15 + 12


def test_packs_edges(spark, words):
    hot = [(100 + n, "one two three four five six seven") for n in range(300)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 5000, "x"), (4, "same", "x"), (5, "same", "x"), *((i, t, "x") for i, t in hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").withColumn("sequence_id", F.lit("clash"))
    sizes = check_packs(cutting.pack(docs, words, room=32).collect(), {i: t for i, t, _ in rows}, words, 32)
    assert padding(sizes, 32) <= 0.01 * sum(sizes)
    twice = cutting.pack(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string"), words).collect()
    assert sorted(str(r["doc_id"]) for r in twice if r["start"] == 0) == ["7", "7", "None"]
    empty = cutting.pack(spark.createDataFrame([], "doc_id long, text string"), words)
    assert empty.columns == [x.split()[0] for x in cutting.OUT.split(", ")] and not empty.count()


def test_knapsack_and_program():
    rng = np.random.default_rng(5)
    worth = np.full(9, -np.inf)
    worth[[2, 3, 7]] = 1.0, 1.7, 4.2
    best, last = cutting.price(worth, 20)
    # all multisets of the three lengths
    for size in range(1, 21):
        ways = [a * 1.0 + b * 1.7 + c * 4.2 for a in range(11) for b in range(7) for c in range(3) if 2 * a + 3 * b + 7 * c == size]
        assert best[size] == pytest.approx(max(ways)) if ways else best[size] == -np.inf
        if ways:
            assert sum(n * k for n, k in cutting.pattern(last, size).items()) == size
    for room, n in ((16, 40), (64, 500), (256, 5000)):
        histogram = collections.Counter(rng.integers(1, room, n).tolist())
        lengths = np.array(sorted(histogram))
        program = cutting.Program(lengths, np.array([histogram[int(k)] for k in lengths]), room)
        before = program.value()
        program.solve()
        assert program.bound() - 1e-6 <= program.value() <= before + 1e-6
        matrix = np.zeros((len(lengths), len(lengths)))
        for j, column in enumerate(program.columns):
            for k, many in program.parts(column).items():
                matrix[program.at[k], j] = many
        # the uses take every tail, and the inverse is one
        assert np.allclose(matrix @ program.uses, program.counts) and np.allclose(matrix @ program.inverse, np.eye(len(lengths)))
        assert program.uses.min() > -1e-9


def vectors_of(spark, rows, label=True):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(int(r[j]) for r in x), n) for j in range(d)]
    return np.array([[float(sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(70, 11)) @ rng.normal(size=(11, 11)) * 0.2).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(data)] + [(900, None, 1), (901, [0.0] * 10 + [math.nan], 1), (902, [0.0] * 10 + [math.inf], 1), (903, [0.0] * 10 + [None], None), (904, [1.0], 2), (905, [], 2)]
    out = whitening.whiten(vectors_of(spark, rows).repartition(5).withColumn("n", F.lit("clash"))).collect()
    x = integers(data.astype(np.float64), 1024, 100_000)
    matrix = exact_covariance(x)
    values, found = whitening.eigen(matrix)
    assert len(out) == 70 * 8 and {r["n"] for r in out} == {70} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-10
    sums = x.sum(axis=0)
    turned = (x - sums / 70) @ found / np.sqrt(values)
    sign = {}
    for r in out:
        i, k = r["vec_id"], r["component"] - 1
        assert r["deviation"] == sum((70 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert r["explained"] == pytest.approx(values[k] / np.trace(matrix), rel=1e-12)
        sign.setdefault(k, np.sign(r["whitened"] * turned[i, k]))
        assert r["whitened"] * sign[k] == pytest.approx(turned[i, k], rel=1e-9, abs=1e-9)


def test_compensated_sums_beat_plain_ones():
    rng = np.random.default_rng(4)
    x = rng.integers(99_990, 100_010, (5000, 4)) + (1 << 27)
    sums = x.sum(axis=0)
    mean = [Fraction(int(s), len(x)) for s in sums]
    exact = [[sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x) for j in range(4)] for i in range(4)]

    def off(got):
        return max(abs(Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - exact[i][j]) for i in range(4) for j in range(4))

    assert off(whitening.outer(*whitening.centred(x, sums, len(x)))) < Fraction(1, 1 << 60)
    # merging parts of tasks loses as little
    parts = [whitening.outer(*whitening.centred(x[a::7], sums, len(x))) for a in range(7)]
    merged = parts[3]
    for k in (0, 6, 2, 1, 5, 4):
        merged = whitening.add(merged, parts[k])
    assert off(merged) < Fraction(1, 1 << 60)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None, 0), (2, [], 0)])).columns == [x.split()[0] for x in whitening.OUT.split(", ")]
    # two places, one of which never changes, with repeated and null ids: one component
    got = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, 2.0], 0)])).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (1, 1), (1, 1)]
    assert sum(r["whitened"] for r in got) == pytest.approx(0) and sum(r["whitened"] ** 2 for r in got) == pytest.approx(3)


def test_many_tasks_are_merged(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(150, 3)).astype(np.float32))]
    one, many = (sorted((r["vec_id"], r["component"], r["whitened"]) for r in whitening.whiten(vectors_of(spark, rows).repartition(k)).collect()) for k in (1, 70))
    assert [x[:2] for x in one] == [x[:2] for x in many] and [x[2] for x in one] == pytest.approx([x[2] for x in many], rel=1e-12, abs=1e-12)


def test_vector_codes_against_sql(spark):
    assert differences(vector_codes.encode(spark.read.parquet(f"{FOLDER}/embeddings.parquet")), FOLDER, vector_codes.oracle()) == ""


def test_cells_find_the_nearest():
    rng = np.random.default_rng(6)
    entries = rng.integers(-900, 900, (16, 8))
    entries[9] = entries[2]
    parts = np.r_[rng.integers(-1500, 1500, (4000, 8)), entries]
    cells = vector_codes.Cells(entries)
    far = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    near, error = cells.nearest(parts)
    assert np.array_equal(near, far.argmin(axis=1)) and np.array_equal(error, far.min(axis=1))
    lower, upper = cells.bounds(parts)
    assert (lower <= far).all() and (far <= upper).all()
    # most entries are left out by their bounds alone
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.4


def test_vector_codes_edges(spark):
    assert vector_codes.encode(vectors_of(spark, [])).columns == [x.split()[0] for x in vector_codes.OUT.split(", ")]
    rows = [(5, [1.0] * 16, 1), (5, [1.0] * 16, None), (None, [0.5] * 16, None), (1, [-0.25] * 16, 7), (8, None, 1), (9, [math.nan] * 16, 1), (10, [1.0] * 15 + [None], 1), (11, [1.0], 1)]
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.encode(vectors_of(spark, rows).withColumn("code", F.lit(3))).collect()}
    assert got == {(5, "01" * 8, 0, 0), (None, "03" * 8, 0, 0), (1, "00" * 8, 0, 0)}
    # a length that is no multiple of the parts
    odd = vector_codes.encode(vectors_of(spark, [(i, [float(i), 1.0, 2.0], 0) for i in range(20)])).collect()
    assert len(odd) == 20 and all(len(r["code"]) == 6 for r in odd)


def test_many_labels_meet_by_salt(spark, monkeypatch):
    rows = [(i, [float(i % 37), float(i % 5)], i % 7 if i % 4 else None) for i in range(200)]
    plain = sorted(map(str, vector_codes.encode(vectors_of(spark, rows)).collect()))
    monkeypatch.setattr(vector_codes, "LABELS", 2)
    assert sorted(map(str, vector_codes.encode(vectors_of(spark, rows)).collect())) == plain


# ---------------------------------------------------------------- hashes, links through rows without an id, checkpoints


def complements(n):
    """Two words of 2^n letters that agree under any polynomial hash modulo a power of two."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_complementary_words_stay_apart(spark):
    from lectern.llm import near_dedup, ppm
    from lectern.llm.shingles import shingle_sets

    one, two = complements(11)
    values, bounds = shingle_sets([one.encode(), two.encode(), b"x " + one.encode()])
    assert len(set(values.tolist())) == 3
    hashes, _ = ppm.words([one.encode() + bytes([ppm.END]), two.encode() + bytes([ppm.END])])
    assert len(set(hashes.tolist())) == 3  # both words and the end
    rows = near_dedup.near_groups(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()
    assert all(r["kept"] for r in rows)


def test_rows_without_an_id_carry_links(spark):
    from lectern.llm import near_dedup

    words = [f"w{i}" for i in range(120)]
    chain = [words[:100], words[8:108], words[16:116]]
    docs = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (2, " ".join(chain[2])), (None, "quite apart from these here"), (7, "another text on its own")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (None, 1, False), (2, 1, False), (None, None, True), (7, 7, True)], key=str)
    left = near_dedup.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]) for r in left)) == ["1", "7", "None"]


def test_checkpoints_do_not_pile_up(spark):
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    from lectern.llm.common import cut, release, shared_dir

    home = Path(urlparse(shared_dir(spark)).path)

    def held():
        return sum(p.stat().st_size for p in home.rglob("*") if p.is_file())

    sizes = []
    for _ in range(4):
        before = cut(spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")))
        assert before.count() == 200_000
        del before
        for _ in range(20):
            release(spark)
            time.sleep(0.2)
        sizes.append(held())
    assert max(sizes) - min(sizes) < 1_000_000


def test_words_of_a_sentence_stay(spark):
    from lectern.llm import page_text

    quoted = "<p>A paragraph that six articles quote.</p>"
    box = '<div class="x1"><span>Read more</span> <a href="/">here</a></div>'
    pages = [(i, f"http://a.org/{i}", f'<body><div class="menu">Menu</div><article><h1>T{i}</h1><p>Own text {i}, <span class="notice">notice word</span> here.</p>{quoted}{box}<div class="notice">Old notice</div></article></body>') for i in range(6)]
    got = {r["page_id"]: r["text"] for r in page_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nOwn text {i}, notice word here.\nA paragraph that six articles quote." for i in range(6)}
