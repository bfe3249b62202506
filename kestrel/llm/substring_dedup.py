"""Removal of passages that repeat from an earlier document (difference cover).

Every 13-word window (``window``) that also starts in a document with a
smaller id is removed from the later one.  Only windows of 7 words
(``anchor``) at positions p with p mod 7 in the difference cover {0, 1, 3} are
hashed and exchanged: for any two places of one 13-word window some shift
below 7 puts both on a cover position, so the two share an aligned anchor.
Anchors seen in two blocks are then extended to the 13-word windows around
them, and the smallest document of each such window is exchanged.  Keys are 64
bits within a bucket.

Null or empty text has no words; a text of fewer than 13 words has no window
and stays whole; a null id counts as larger than every id; rows with one id
are one document, so repeats between them don't count.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kestrel.llm import blocks as B
from kestrel.llm.hashing import gram_hashes, word_bounds, word_hashes

U64 = np.uint64
#: A difference cover modulo 7: every difference is one of two members.
PERIOD, COVER = 7, (0, 1, 3)


def _words(block: B.Block):
    """Word hashes of a block, and the first and last word index of each word's document."""
    starts, stops = word_bounds(block.data, block.ends)
    last = np.searchsorted(starts, block.ends)
    counts = np.diff(np.concatenate([[0], last]))
    return starts, stops, word_hashes(block.data, starts, stops), last, counts


def _anchors(words, last, counts, window, buckets):
    """Cover positions (word indexes) and the bucketed 32-bit key of the anchor there."""
    size = window - PERIOD + 1
    first = np.repeat(last - counts, counts)
    at = np.arange(len(words)) - first
    fits = (at + size <= np.repeat(counts, counts)) & (np.repeat(counts, counts) >= window)
    at = np.flatnonzero(fits & np.isin(at % PERIOD, COVER))
    h = gram_hashes(words, size, at, salt=1)
    return at, ((h >> U64(32)) % U64(buckets) << U64(32)) | (h & U64(0xFFFFFFFF))


def _shared(table: pa.Table) -> pa.Table:
    """In a bucket: the keys that two blocks or more sent, back to each of them."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_numpy()
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("payload")]
    values, seen = np.unique(np.concatenate(parts), return_counts=True)
    values = values[seen > 1]
    out = [(bucket, b, p[B.contains(values, p)].tobytes()) for b, p in zip(blocks.tolist(), parts)]
    return _key_table([x for x in out if x[2]])


def _key_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int64()),
                     "payload": pa.array(cols[2], pa.binary())})


_PAIR = np.dtype([("key", np.uint64), ("doc", np.int64)])


def _earlier(table: pa.Table) -> pa.Table:
    """In a bucket: to each block the windows that start in an earlier document elsewhere."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_numpy()
    parts = [np.frombuffer(x.as_py(), _PAIR) for x in table.column("payload")]
    every = np.concatenate(parts)
    keys, least = B.unique_by(every["key"], every["doc"])
    out = []
    for b, p in zip(blocks.tolist(), parts):
        late = p["key"][least[np.searchsorted(keys, p["key"])] < p["doc"]]
        if len(late):
            out.append((bucket, b, late.tobytes()))
    return _key_table(out)


def _window_keys(words, at, window, buckets):
    """The 64-bit key of the windows at some positions and their bucket (from other bits)."""
    return gram_hashes(words, window, at, salt=2), (gram_hashes(words, window, at, salt=3) % U64(buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   keep_untouched: bool = False) -> DataFrame:
    """The documents with ``text`` cut to the kept words, joined by one space, and
    the counts ``n_words`` and ``n_removed`` added.

    A text from which nothing is removed has its words joined likewise, so that
    the text column has one form, or with ``keep_untouched`` stays as it is (a
    null text becomes empty).  ``n_words``/``n_removed`` of the input are replaced.
    """
    packed = B.pack(docs, id_col, text_col, level=6)
    buckets = B.n_buckets(packed)

    def send_anchors(block):
        _, _, words, last, counts = _words(block)
        _, keys = _anchors(words, last, counts, window, buckets)
        keys = np.unique(keys)
        yield B.by_bucket(block.block, (keys >> U64(32)).astype(np.int64), keys.astype(np.uint32))

    shared = B.gather(B.scan(packed, send_anchors, B.KEYS_SCHEMA), _shared, B.KEYS_SCHEMA)

    def send_windows(block, replies):
        if replies.num_rows == 0:
            return _key_table([])
        known = np.sort(np.concatenate([
            (U64(b) << U64(32)) | np.frombuffer(p, np.uint32).astype(np.uint64)
            for b, p in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist())]))
        _, _, words, last, counts = _words(block)
        at, keys = _anchors(words, last, counts, window, buckets)
        hit = np.zeros(len(words) + 1, np.int64)
        hit[at[B.contains(known, keys)] + 1] = 1
        hit = np.cumsum(hit)
        at = _window_starts(last, counts, window)
        at = at[hit[np.minimum(at + PERIOD, len(words))] > hit[at]]
        keys, bucket = _window_keys(words, at, window, buckets)
        doc = block.ids[np.searchsorted(last, at, "right")]
        order = np.lexsort((doc, keys))
        keys, bucket, doc = keys[order], bucket[order], doc[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        rows = np.empty(int(first.sum()), _PAIR)
        rows["key"], rows["doc"] = keys[first], doc[first]
        return pa.Table.from_batches([B.by_bucket(block.block, bucket[first], rows)])

    windows = B.answer(packed, shared, send_windows, B.KEYS_SCHEMA, ["block", "ids", "ends", "texts"])
    earlier = B.gather(windows, _earlier, B.KEYS_SCHEMA)

    keep = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    schema = T.StructType(keep + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(block, replies):
        starts, stops, words, last, counts = _words(block)
        at = _window_starts(last, counts, window)
        keys = gram_hashes(words, window, at, salt=2)
        doc = block.ids[np.searchsorted(last, at, "right")]
        known, least = B.unique_by(keys, doc)
        late = least[np.searchsorted(known, keys)] < doc if len(keys) else np.zeros(0, bool)
        if replies.num_rows:
            told = {b: np.sort(np.frombuffer(p, np.uint64)) for b, p in
                    zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist())}
            every = np.sort(np.concatenate(list(told.values())))
            maybe = np.flatnonzero(B.contains(every, keys))
            bucket = _window_keys(words, at[maybe], window, buckets)[1]
            for b in np.unique(bucket).tolist():
                if b in told:
                    mine = maybe[bucket == b]
                    late[mine[B.contains(told[b], keys[mine])]] = True
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, at[late], 1)
        np.add.at(step, at[late] + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(last - counts, len(words)))
        removed[counts == 0] = 0
        texts, raw, begin = [], block.data.tobytes(), block.starts
        for k in range(len(counts)):
            if keep_untouched and not removed[k]:
                texts.append(raw[begin[k]:block.ends[k]])
                continue
            words_k = raw[begin[k]:block.ends[k]].split()
            if removed[k]:
                words_k = compress(words_k, (~gone[last[k] - counts[k]: last[k]]).tolist())
            texts.append(b" ".join(words_k))
        rest = block.rest()
        out = []
        for f in schema.fields:
            if f.name == text_col:
                out.append(pa.array(texts, pa.binary()).cast(pa.string()))
            elif f.name == "n_words":
                out.append(pa.array(counts.astype(np.int64)))
            elif f.name == "n_removed":
                out.append(pa.array(removed))
            else:
                out.append(rest.field(f.name))
        return pa.table(out, names=schema.names)

    return B.answer(packed, earlier, cut, schema)


def _window_starts(last, counts, window) -> np.ndarray:
    """Word indexes at which a whole window of one document starts."""
    n = np.maximum(counts - window + 1, 0)
    first = np.repeat(last - counts, n)
    return first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
