"""Cross-tokenizer alignment, WARC archives and periodic runs."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kestrel.llm import periodic_runs as runs
from kestrel.llm import token_align, warc
from kestrel.llm.queries import QUERIES, vocabulary
from tests.llm import brute

SMOKE = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def key(row):
    return tuple("" if x is None else str(x) for x in row)


# --- alignment ---------------------------------------------------------------------------------

def test_alignment_equals_brute_force(docs, rows):
    out = token_align.cross_align(docs, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute.cross_align([r[:2] for r in rows], A, B), key=key)


def test_rare_pairs_are_joined_by_shuffle(docs, rows):
    got = token_align.cross_align(docs, A, B, hot_pairs=40).select("doc_id", "n_best", "count_sum")
    expected = [(r[0], r[5], r[6]) for r in brute.cross_align([r[:2] for r in rows], A, B)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("piece", [1 << 21, 200])
def test_alignment_of_odd_texts(piece, monkeypatch):
    """Whole-text encodings by the libraries, also where texts are cut into pieces."""
    monkeypatch.setattr(token_align, "PIECE_BYTES", piece)
    monkeypatch.setattr(token_align, "CACHE_SEGMENTS", 300)
    monkeypatch.setattr(token_align, "GROUP_LINKS", 6)
    rng = random.Random(3)
    signs = [*"ab e's  \n\t\x1c\x85\xa0▁᠎漢é😀.,'", "<|endoftext|>", "  ", "   ", "’", "﻿", " a", " the", " don't", "</s>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    texts += [None, "", " ", "a" * 3000, " " * 500, "= " * 300, "漢" * 700, "the end. " * 200]
    pair = token_align.Pair(A, B)
    got = [r for i in range(0, len(texts), 100) for r in token_align._rows(pair, texts[i:i + 100], True)]
    for row, (ia, ib, groups) in zip(got, brute.token_groups(texts, A, B)):
        links = [x * pair.n_b + y for ga, gb in groups for x in ga for y in gb]
        keys, counts = np.unique(np.array(links, np.int64), return_counts=True)
        assert row.numbers.tolist() == [len(ia), len(ib), len(groups), len(links)]
        assert "".join(row.text) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert row.keys.tolist() == keys.tolist() and row.weights.tolist() == counts.tolist()


def test_alignment_of_nothing(none, spark):
    assert token_align.cross_align(none, A, B).count() == 0
    ((x,), (y,), _), = brute.token_groups(["a"], A, B)
    out = token_align.align(spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string"), A, B, keep_groups=True).collect()
    assert {(r.doc_id, r.n_a, r.groups_sha256 == "", r.groups) for r in out} == {(1, 0, True, ""), (None, 1, False, f"{x}|{y}")}


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_token_align"](spark, SMOKE).collect()
    assert sorted(map(tuple, got)) == sorted(brute.cross_align([tuple(r) for r in docs], A, B))


# --- archives -----------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, payload string, top string, d long"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    page = lambda: "<p>" + " ".join(rng.choice(["été", "menu", "<b>x</b>", "漢字", "&amp;", "\r\n\r\n"]) for _ in range(rng.randint(0, 90)))
    html = [page() for _ in range(40)]
    html += [html[0]] * 30 + [html[1], html[1], None, "", None, "x" * 400_000, "WARC/1.1\r\n\r\n", "\0\0"]
    rows = [(7 * i % 101, None if i % 9 == 0 else f"http://a.test/{i} \n\té", h, "p", "t", i) for i, h in enumerate(html)]
    rows += [rows[0], (None, "u", html[0], None, None, None), (None, "u", "alone", None, None, None), (None, "v", "alone", None, None, None)]
    return spark.createDataFrame(rows, PAGE).repartition(3), rows


def test_archives_equal_brute_force(pages, spark, monkeypatch):
    df, rows = pages
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    got = warc.store_and_read(df)
    fields = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(fields, key=key) == sorted(brute.warc([(r[0], r[2]) for r in rows]), key=key)
    back = warc.restored(got).select("page_id", F.decode("payload", "UTF-8"), "url").collect()
    url = lambda u: None if u is None else warc._URL.sub(lambda m: f"%{ord(m[0]):02X}", u)
    assert sorted(map(tuple, back), key=key) == sorted(((r[0], r[2] or "", url(r[1])) for r in rows), key=key)


def test_archive_files_are_plain_zstandard(pages, spark):
    """Any reader of the format sees a dictionary frame and then one record a frame."""
    from kestrel.session import scratch_path
    df, rows = pages
    path = scratch_path(spark, "warc-test")
    dictionary = warc.train_dictionary(df)
    warc.write_archives(df, path, dictionary)
    records = 0
    for r in spark.read.format("binaryFile").load(path).where("length > 0").collect():
        kinds = [k for _, _, k in warc.frames(r.content)]
        assert kinds[-1] == "skip" and kinds[0] == ("skip" if dictionary else "data")
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        whole = zstandard.ZstdDecompressor(dict_data=known).stream_reader(r.content, read_across_frames=True).read()
        parts = list(warc.frames(r.content))
        records += sum(k == "data" for *_, k in parts)
        assert whole.startswith(b"WARC/1.1\r\n")
    assert records == len(rows)


def test_dictionary_is_trained_and_used(spark):
    rng = random.Random(2)
    vocabulary_ = [f"word{i}" for i in range(300)]
    rows = [(i, "u", "<html><head><title>t</title></head><body class='main'>" + " ".join(rng.choices(vocabulary_, k=120))) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dictionary = warc.train_dictionary(df)
    assert len(dictionary) > 1000 and dictionary == warc.train_dictionary(df.repartition(5))
    small = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(rows[0][2].encode())
    assert len(small) < len(zstandard.compress(rows[0][2].encode()))
    assert warc.store_and_read(df).count() == 300


@pytest.mark.parametrize("spoil", ["cut", "flip", "length", "version", "digest", "magic", "stray"])
def test_damaged_archives_are_refused(spoil):
    record = warc._record(1, "u", b"abc" * 50, warc.base32_sha1(b"abc" * 50), None, False, "2001-06-01T00:00:00Z")
    if spoil == "length":
        record = record[:-5] + b"\r\n\r\n"
    if spoil == "version":
        record = record.replace(b"WARC/1.1", b"WARC/0.9", 1)
    if spoil == "digest":
        record = record.replace(b"abcabc", b"abcabd", 1)
    raw = zstandard.ZstdCompressor(write_checksum=True).compress(record)
    assert spoil in ("length", "version", "digest") or len(list(warc.read_archive(raw))) == 1
    raw = {"cut": raw[:-3], "flip": raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], "magic": b"x" + raw[1:], "stray": raw + b"\n"}.get(spoil, raw)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(raw))


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGE)
    out = warc.store_and_read(empty)
    assert out.count() == 0 and out.columns[0] == "page_id"


# --- periodic runs ------------------------------------------------------------------------------

def test_runs_equal_brute_force(docs, rows):
    for plant in (True, False):
        out = runs.periodic_runs(docs, plant=plant)
        got = [tuple(r) for r in out.drop("runs", "collapsed").collect()]
        expected = [brute.periodic_row(r[0], r[1], plant) for r in rows if len(r[1] or "") < 20_000]
        long = [r for r in rows if len(r[1] or "") >= 20_000]
        got = [g for g in got if g[0] not in {r[0] for r in long}]
        assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("piece", [1 << 21, 40])
def test_runs_of_random_sequences(piece, monkeypatch):
    monkeypatch.setattr(runs, "GRID_PIECE", piece)
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(rng.choice([0, 1, 23, 24, 80, 150]))]
            for _ in range(rng.randint(0, 4)):
                part = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
                w += (part * rng.randint(2, 8))[:rng.randint(1, 150)] + [rng.randrange(5) for _ in range(rng.randint(0, 9))]
            texts.append(w)
        texts += texts[:1]  # copies share long extensions
        found = runs.runs(np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts]).astype(np.int64))
        for k, t in enumerate(texts):
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == k] == brute.periodic(t)


def test_long_extensions():
    rng = random.Random(6)
    for w in ([0] * 20_000, [rng.randrange(40) for _ in range(500)] * 40):
        assert runs.runs(np.array(w), np.array([len(w)])).tolist() == [[0, 0, len(w), 1 if not any(w) else 500]]


def test_extensions_against_comparison():
    rng = random.Random(8)
    for _ in range(60):
        w = np.array([rng.randrange(2) for _ in range(rng.randint(1, 250))] + [9])
        lce = runs.Extensions(w)
        x, y = (np.array([rng.randrange(len(w)) for _ in range(80)]) for _ in range(2))
        x, y = x[x != y], y[x != y]
        for a, b, n in zip(x.tolist(), y.tolist(), lce(x, y).tolist()):
            same = 0
            while max(a, b) + same < len(w) and w[a + same] == w[b + same]:
                same += 1
            assert n == same


def test_runs_of_nothing(none):
    assert runs.periodic_runs(none).count() == 0


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SMOKE).collect()}
    short = [r for r in docs if len(r.text or "") < 8_000]
    assert len(short) > 150 and len(got) == len(docs)
    for r in short:
        assert got[r.doc_id] == brute.periodic_row(r.doc_id, r.text)
