"""Substring, near, suffix and vector deduplication, and decontamination, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import DOC, words


def same(got, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_substring_dedup(docs, rows):
    from kestrel.llm.substring_dedup import remove_repeats
    out = remove_repeats(docs)
    assert set(out.columns) == set(docs.columns) | {"n_removed"}
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect(), brute.substring(pairs(rows)))
    assert sorted(r.k for r in out.select("k").where("k IS NOT NULL").collect()) == sorted(r[7] for r in rows if r[7] is not None)


def test_substring_dedup_passage_at_every_alignment(spark):
    from kestrel.llm.substring_dedup import remove_repeats
    rng = random.Random(3)
    p = words(rng, 13)
    data = [(i, words(rng, 20 + i % 8) + " " + p + " " + words(rng, 15)) for i in range(60)]
    out = remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect(), brute.substring(data))


def test_near_dedup(docs, rows):
    from kestrel.llm.near_dedup import deduplicate, near_duplicates
    out = near_duplicates(docs)
    expected = brute.near(pairs(rows))
    same(out.select("doc_id", "n_shingles", "component_id", "kept").collect(), expected)
    left = deduplicate(docs)
    assert left.columns == docs.columns
    same(left.select("doc_id").collect(), [(e[0],) for e in expected if e[3]])


@pytest.mark.parametrize("group", [4, 64])
def test_near_dedup_large_loose_group(spark, monkeypatch, group):
    """A chain of edits: few links are direct, and components are cut into chunks."""
    from kestrel.llm import near_dedup
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rng = random.Random(5)
    base = words(rng, 120).split()
    data, w = [], list(base)
    for i in range(90):
        data.append((i, " ".join(w)))
        w = list(w if i % 3 else base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"edit{i}"
    out = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    same(out.select("doc_id", "n_shingles", "component_id", "kept").collect(), brute.near(data))


def test_near_dedup_deepened_regions(spark, monkeypatch):
    """Regions of more than 8 classes are parted by further minima, the deepest parts dealt over chunks."""
    from kestrel.llm import near_dedup
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(near_dedup, "CROSS", 16)
    rng = random.Random(17)
    data = []
    for g, edits in enumerate([0, 1, 4, 9]):
        base = words(rng, 150).split()
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(["same", f"edit{i}"])
            data.append((1000 * g + i, " ".join(w)))
    out = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    same(out.select("doc_id", "n_shingles", "component_id", "kept").collect(), brute.near(data))


@pytest.mark.parametrize("cross", [100, 4096])
def test_near_dedup_pairs_far_apart_in_a_large_region(spark, monkeypatch, cross):
    """Pairs that only share a region of 3,000 unlike classes become candidates, at any distance in its order."""
    from kestrel.llm import near_dedup
    from kestrel.llm.blocks import Scratch
    monkeypatch.setattr(near_dedup, "CROSS", cross)
    rng = np.random.default_rng(3)
    m = rng.integers(0, 2**32, (3000, near_dedup.TREES * near_dedup.DEPTH), dtype=np.uint32)
    for a in range(20):  # alike in 59 of 80 minima, with one different among the first 3 of every tree but the first
        m[2999 - a] = m[a]
        m[2999 - a, 4::4] ^= 0xFFFFFFFF
        m[2999 - a, 3] ^= 0xFFFFFFFF
    m[:, :3] = 7
    data = [(i, r.astype(">u4").tobytes()) for i, r in enumerate(m)]
    scratch = Scratch(spark, "near-test")
    out = near_dedup._candidates(spark.createDataFrame(data, "node long, minima binary").repartition(4), scratch)
    got = {r.node: r.root for r in out.collect()}
    scratch.drop()
    assert got == {n: a for a in range(20) for n in (a, 2999 - a)}


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline
    rng = random.Random(12)
    a, b, c = (words(rng, 80) for _ in range(3))
    data = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, b + " end"), (3, c), (3, c + " end"), (None, c), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "s%d" % n) for n, (i, t) in enumerate(data)], "doc_id long, text string, source string")
    out = corpus_pipeline.near_dedup(spark, df.repartition(3), None)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "3", "4", "4", "5", "None"]
    assert {t[:40] for _, t in got if t} == {a[:40], b[:40], c[:40]}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination(spark, docs, rows, bound, monkeypatch):
    from kestrel.llm import decontaminate as module
    monkeypatch.setattr(module, "BROADCAST_PRINTS", bound)
    monkeypatch.setattr(module, "BROADCAST_DOCS", bound)
    from kestrel.llm.decontaminate import contamination, decontaminate
    texts = [r[1] for r in rows]
    items = [(1, texts[0][:200]), (2, texts[3]), (3, "two words"), (3, "two words"), (4, "one"), (5, None), (6, ""), (None, texts[2]),
             (10, texts[0][20:180].upper()), (7, words(random.Random(99), 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs, bench)
    got = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256), "contaminated").collect()
    expected = brute.contamination(pairs(rows), items)
    same(got, expected)
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns
    same(left.select("doc_id").collect(), [(e[0],) for e in expected if not e[5]])


@pytest.mark.parametrize("hot", [2, 10_000])
def test_suffix_dedup(spark, docs, rows, monkeypatch, hot):
    from kestrel.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    out = suffix_dedup.remove_repeats(docs)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same(got, brute.bytes_repeated(pairs(rows)))


def test_suffix_dedup_random_edits(spark, monkeypatch):
    from kestrel.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    pool = words(rng, 400)
    data = []
    for i in range(80):
        a = rng.randrange(len(pool) - 700)
        t = pool[a: a + rng.randrange(150, 700)]
        if rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "Q", words(rng, 4)]) + t[k:]
        data.append((i, words(rng, rng.randrange(1, 30)) + t + "é" * rng.randrange(3)))
    data += [(80, "ab" * 300), (81, "x" * 250), (82, "x" * 199), (83, "ba" * 120)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.bytes_repeated(data))


def test_suffix_dedup_runs_of_short_period(spark, monkeypatch):
    """Runs of one byte, of periods up to 60 and of blanks, broken, at document ends, in several documents and blocks."""
    from kestrel.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6000)
    rng = random.Random(12)
    data = []
    for i, q in enumerate([1, 1, 2, 3, 7, 16, 31, 33, 47, 48, 49, 60]):
        unit = "".join(rng.choice("abcd") for _ in range(q))
        for k, n in enumerate([199, 200, 200 + q - 1, 200 + q, 1500, 5000]):
            run = (unit * (n // q + 2))[k: n + k]
            broken = run[: n // 2] + rng.choice(["", "Q", "zz"]) + run[n // 2:]
            data.append((100 * i + k, rng.choice(["", words(rng, 20)]) + rng.choice([run, broken]) + rng.choice(["", words(rng, 30)])))
    data += [(2000, " " * 4000), (2001, "x" + " " * 210), (2002, "-" * 3000 + "=" * 3000), (2003, None), (2004, "")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.bytes_repeated(data))


def test_suffix_dedup_anchors_in_a_long_run():
    from types import SimpleNamespace

    from kestrel.llm.suffix_dedup import _anchors
    for unit in (b"a", b"ab", b" \n", b"abcdefg"):
        raw = np.frombuffer(unit * (2_000_000 // len(unit)), np.uint8)
        block = SimpleNamespace(data=raw, starts=np.array([0]), ends=np.array([len(raw)]))
        _, p, _, _, runs = _anchors(block)
        assert len(p) <= 2 and runs.tolist() == [(0, len(raw))]


def _vectors():
    rng = np.random.default_rng(4)
    data = []
    for i in range(40):
        c = rng.normal(size=16)
        for _ in range(1 + i % 4):
            data.append((c + rng.normal(size=16) * 0.15).tolist())
    data += [data[0], data[0], [2 * x for x in data[1]], None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14,
             [1.0, 2.0], [1.0, 2.1], [float("inf")] + [0.0] * 15]
    return [(i, v) for i, v in enumerate(data)]


@pytest.mark.parametrize("chunk", [8, 4096])
def test_vector_dedup(spark, monkeypatch, chunk):
    from kestrel.llm import vector_dedup
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    data = _vectors()
    df = spark.createDataFrame([(i, v, i) for i, v in data], "vec_id long, embedding array<double>, node long")
    same(vector_dedup.near_vectors(df).collect(), brute.vectors(data))


def test_vector_dedup_recall_in_deep_trees(spark, monkeypatch):
    """Leaves of 16 of 3000 vectors: the forest alone must find at least nine links in ten."""
    from kestrel.llm import vector_dedup
    monkeypatch.setattr(vector_dedup, "LEAF", 32)
    rng = np.random.default_rng(6)
    c = rng.normal(size=(1000, 24))
    x = np.concatenate([c + rng.normal(size=c.shape) * s for s in (0, 0.2, 0.3)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = ((u @ u.T) >= 0.9).sum() - len(x)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = vector_dedup.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * exact <= found <= exact


@pytest.mark.parametrize("chunk", [150, 4096])
def test_vector_dedup_large_groups(spark, monkeypatch, chunk):
    """A group of a third of the vectors, many times larger than a leaf, a smaller and a loose one: every link is found."""
    from kestrel.llm import vector_dedup
    monkeypatch.setattr(vector_dedup, "LEAF", 64)
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2100, 32))
    for at, n, s in ((0, 700, 0.27), (700, 200, 0.2), (900, 200, 0.38)):
        x[at: at + n] = x[at] + rng.normal(size=(n, 32)) * s
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(df).collect()}
    assert [found[i] for i in range(len(x))] == links.tolist()


def test_empty_tables(spark, none):
    from kestrel.llm import near_dedup, substring_dedup, suffix_dedup, vector_dedup
    from kestrel.llm.decontaminate import contamination
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words of text", "en", "s", 1, None, None, None, None, None)], DOC)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert contamination(none, bench).count() == 0
    assert [r.contaminated for r in contamination(docs, bench).collect()] == [False]
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clashing_column_names_of_the_input(docs, spark):
    """Columns named like the operators' own come back untouched."""
    from kestrel.llm.decontaminate import decontaminate
    from kestrel.llm.near_dedup import deduplicate
    taken = ["_id", "_key", "_n", "_best", "_bad_id", "_bad_key", "root", "count", "c0", "c1"]
    wide = docs.select("doc_id", *[F.lit(c).alias(c) for c in taken], "text")
    bench = spark.createDataFrame([("x", "nothing of this occurs")], "item_id string, text string")
    for out, plain in ((deduplicate(wide, single=True), deduplicate(docs.select("doc_id", "text"), single=True)),
                       (decontaminate(wide, bench), docs)):
        assert out.columns == wide.columns
        assert out.select(*taken).distinct().collect() == [tuple(taken)]
        assert out.count() == plain.count()
