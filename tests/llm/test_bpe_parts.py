"""Texts cross to Python once, in parts bounded by rows and bytes."""

import pyarrow as pa

from kestrel.llm import bpe
from kestrel.llm.queries import vocabulary


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])


def test_parts_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 10)
    texts = ["abc", None, "defg", "", "x" * 50, "é" * 4, "yy", "z", None]
    got = [p.column(0).to_pylist() for p in bpe.parts(_batch(texts).slice(0))]
    assert [t for p in got for t in p] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in got)
    assert ["x" * 50] in got
    assert [p.num_rows for p in bpe.parts(_batch([""] * 1100))] == [512, 512, 76]
    assert list(bpe.parts(_batch([]))) == []
    assert [t for p in bpe.parts(_batch(texts).slice(2, 5)) for t in p.column(0).to_pylist()] == texts[2:7]


def test_text_comes_back_only_if_kept(spark):
    docs = spark.createDataFrame([(1, "one two", "en"), (2, None, None), (3, "", "de")], "doc_id long, text string, lang string")
    path = vocabulary("byte_bpe_50k.json")
    whole = bpe.encode_decode(docs, path)
    assert whole.columns == ["doc_id", "text", "lang", "token_ids", "n_tokens", "decoded"]
    assert sorted((r.doc_id, r.text, r.lang, r.decoded) for r in whole.collect()) == [
        (1, "one two", "en", "one two"), (2, None, None, ""), (3, "", "de", "")]
    narrow = bpe.encode_decode(docs, path, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "token_ids", "n_tokens", "decoded"]
    assert sorted((r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in narrow.collect()) == sorted(
        (r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in whole.collect())
    texts = bpe.encode_decode(docs.select("text"), path)
    assert texts.columns == ["text", "token_ids", "n_tokens", "decoded"] and texts.count() == 3
    assert bpe.encode_decode(docs, path, keep=[]).count() == 3
