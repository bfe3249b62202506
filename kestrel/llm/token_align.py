"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE, B a sentence-piece BPE with byte fallback and
a leading space.  Both cover the bytes of ``space + text``, so every token is a
byte range.  Per batch, ``pandas.merge_asof`` keyed by document finds for each
token start the other side's covering token; the union of both directions is
every overlap, and overlaps with equal ends close a *group*: the smallest
stretch that both sides cut in the same places.  Every A token of a group is
linked with every B token of it.

How often an id pair is linked is a corpus statistic (documents that hold the
pair), gathered by Spark over all documents and joined back.  Of the pairs, the
most frequent ``HOT_PAIRS`` are broadcast, a fixed number of rows that answers
nearly every link where the text lies; all others are joined by shuffle.

Rows whose text is null or empty, or whose joined A or B bytes are not ``space +
text`` (a text that holds U+2581), have no tokens: zeros, ``groups`` empty and
``groups_sha256`` ''.  Each row counts as a document, also if ids or texts
repeat or the id is null.  Only the id and the text are taken from the input, so
names of other columns don't matter.  Very long texts are aligned in pieces cut
where both tokenizers always cut: before a single space between two other
characters that aren't white space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.blocks import Scratch, materialize
from kestrel.llm.bpe import PATTERN, _alphabet

#: Bytes of text aligned at once.
PIECE_BYTES = 2 << 20
#: Segments (words with what sticks to them) whose ids a task remembers.
CACHE_SEGMENTS = 200_000
#: Rows of the pair table that are broadcast, about 24 bytes each.
HOT_PAIRS = 500_000
#: Links of one group that are expanded token by token; larger ones by distinct ids.
GROUP_LINKS = 1 << 16
_CUT = re.compile("(?<=[^\\s᠎▁]) (?=[^\\s᠎▁])")


class _Numbers(dict):
    """Numbers segments in the order in which they are first asked for."""

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


class Pair:
    """Two tokenizers, and the ids of the segments met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _alphabet()
        size = self.a.get_vocab_size()
        self.a_bytes = [b""] * size
        for s, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in s)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.n_b = len(self.b_bytes)
        # the text of every token with what follows it: , | inside and after a group's A side, , ; for B
        self.text = [f"{i}{sep}" for n, seps in ((size, ",|"), (self.n_b, ",;")) for sep in seps for i in range(n)]
        # for ASCII segments the same merges by rank, in a faster library: ids must grow with the merges
        merged = [spec["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        self.by_rank = None
        if merged == sorted(set(merged)) and min(merged, default=0) >= 256 and not spec["model"].get("ignore_merges"):
            import tiktoken
            special = {t["id"] for t in spec["added_tokens"]}
            ranks = {b: i for i, b in enumerate(self.a_bytes) if b and i not in special}
            self.by_rank = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # byte-level merging without a normalizer gives back every byte, so only B's bytes need a look
        # texts are cut only if neither side can have a token across a cut
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                 and not pre.get("add_prefix_space"))
        self.cuts = plain and not any(b" " in b.lstrip(b" ") for b in self.b_bytes)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.index = _Numbers()
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.fits = np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _CUT.split(text)

    def _learn(self, new: list[str]) -> None:
        spaced = [f" {s}" for s in new]
        plain = [self.by_rank is not None and s.isascii() for s in new]
        others = iter(self.a.encode_batch([s for s, p in zip(spaced, plain) if not p], add_special_tokens=False))
        both = [[self.by_rank(s) if p else next(others).ids for s, p in zip(spaced, plain)], self.b.encode(new, num_threads=1)]
        for side, lists in enumerate(both):
            size = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size[-1]))
            start = self.ends[side][-1] if len(self.ends[side]) else 0
            self.ids[side] = np.concatenate([self.ids[side], flat])
            self.ends[side] = np.concatenate([self.ends[side], start + size])
        piece = self.b_bytes.__getitem__
        self.fits = np.concatenate([self.fits, [b"".join(map(piece, ids)) == s.encode() for ids, s in zip(both[1], spaced)]])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def _shrink(self) -> None:
        """Keep the segments met twice or more since the last time; of too many of those, none."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > CACHE_SEGMENTS // 2:
            keep = keep[:0]
        words = list(self.index)
        self.index = _Numbers((words[k], i) for i, k in enumerate(keep.tolist()))
        for side in (0, 1):
            flat, size = self._tokens(side, keep)
            self.ids[side], self.ends[side] = flat, np.cumsum(size)
        self.fits, self.used = self.fits[keep], np.zeros(len(keep), np.int64)

    def look(self, segments: list[str]) -> np.ndarray:
        """The number of each segment in the tables; new ones are encoded."""
        if len(self.index) > CACHE_SEGMENTS or len(self.ids[0]) > 16 * CACHE_SEGMENTS:
            self._shrink()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)))
        self.used += np.bincount(at, minlength=len(self.used))
        return at

    def _tokens(self, side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments back to back, and how many each has."""
        ends = self.ends[side]
        begin = np.where(at > 0, ends[at - 1], 0) if len(ends) else at
        size = ends[at] - begin if len(ends) else at
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.ids[side][place], size

    def joined(self, side: int, at: np.ndarray) -> bytes:
        return b"".join(map((self.a_bytes, self.b_bytes)[side].__getitem__, self._tokens(side, at)[0].tolist()))

    def align(self, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Align the segments ``at`` of the documents (or pieces) ``doc``, 0 .. n - 1 in order.

        Per document: (n_a, n_b, n_groups, n_links); (document, id pair) keys with
        their number of links; the groups' text, each group followed by ';'.
        """
        ids, docs, ends = [], [], []
        for side, sizes in ((0, self.a_size), (1, self.b_size)):
            flat, count = self._tokens(side, at)
            ids.append(flat.astype(np.int64))
            docs.append(np.repeat(doc, count))
            ends.append(np.cumsum(sizes[flat]))
        a, b = ids
        left = pd.DataFrame({"at": ends[0] - self.a_size[a], "doc": docs[0], "a": np.arange(len(a))})
        right = pd.DataFrame({"at": ends[1] - self.b_size[b], "doc": docs[1], "b": np.arange(len(b))})
        overlaps = [pd.merge_asof(x, y, on="at", by="doc")[["a", "b"]].to_numpy(np.int64) for x, y in ((left, right), (right, left))]
        overlaps = np.concatenate(overlaps)
        closing = overlaps[ends[0][overlaps[:, 0]] == ends[1][overlaps[:, 1]]]
        last = [np.zeros(len(a), bool), np.zeros(len(b), bool)]
        last[0][closing[:, 0]] = True
        last[1][closing[:, 1]] = True
        group = [np.cumsum(x) - x for x in last]
        n_groups = int(last[0].sum())
        size = [np.bincount(g, minlength=n_groups) for g in group]
        first = [np.cumsum(s) - s for s in size]
        group_doc = docs[0][last[0]]
        links = size[0] * size[1]

        numbers = np.stack([np.bincount(docs[0], minlength=n), np.bincount(docs[1], minlength=n),
                            np.bincount(group_doc, minlength=n),
                            np.bincount(group_doc, links, minlength=n).astype(np.int64)], axis=1).astype(np.int64)
        keys, weights = self._pairs(a, b, size, first, links, group_doc)

        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first[1][group[0]]] = a + len(self.a_bytes) * last[0]
        codes[np.arange(len(b)) + (first[0] + size[0])[group[1]]] = b + 2 * len(self.a_bytes) + self.n_b * last[1]
        stops = np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        text = self.text.__getitem__
        out = ["".join(map(text, codes[i:j].tolist())) for i, j in zip([0, *stops], stops)]
        return numbers, keys, weights, out

    def _pairs(self, a, b, size, first, links, group_doc):
        """Distinct (document, A id, B id) as one number each, and the links of each."""
        span = len(self.a_bytes) * self.n_b
        keys, weights = [], []
        small = np.flatnonzero(links <= GROUP_LINKS)
        todo = np.cumsum(links[small])
        at = 0
        while at < len(small):
            stop = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + (1 << 22))))
            g = small[at:stop]
            place = np.repeat(np.arange(len(g)), links[g])
            k = np.arange(len(place)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
            g = g[place]
            i, j = first[0][g] + k // size[1][g], first[1][g] + k % size[1][g]
            found, count = np.unique(group_doc[g] * span + a[i] * self.n_b + b[j], return_counts=True)
            keys.append(found)
            weights.append(count)
            at = stop
        for g in np.flatnonzero(links > GROUP_LINKS).tolist():
            x, nx = np.unique(a[first[0][g]:first[0][g] + size[0][g]], return_counts=True)
            y, ny = np.unique(b[first[1][g]:first[1][g] + size[1][g]], return_counts=True)
            keys.append((group_doc[g] * span + x[:, None] * self.n_b + y[None, :]).ravel())
            weights.append((nx[:, None] * ny[None, :]).ravel())
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys) == 1:
            return keys[0], weights[0]
        return added(np.concatenate(keys), np.concatenate(weights))


def added(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the weights of each."""
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights, minlength=len(keys)).astype(np.int64)


@lru_cache(maxsize=2)
def _load(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


class _Row:
    """What the pieces of one document have given so far."""

    def __init__(self, keep: bool):
        self.numbers = np.zeros(4, np.int64)
        self.digest, self.open, self.text = hashlib.sha256(), "", [] if keep else None
        self.keys, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, numbers, keys, weights, text: str) -> None:
        self.numbers += numbers
        self.digest.update(self.open.encode())
        self.digest.update(text[:-1].encode())
        if self.text is not None:
            self.text += [self.open, text[:-1]]
        self.open = text[-1:]  # the ';' counts once another piece follows
        self.keys, self.weights = (keys, weights) if not len(self.keys) else added(
            np.concatenate([self.keys, keys]), np.concatenate([self.weights, weights]))


def _rows(pair: Pair, texts: list, keep: bool):
    """A :class:`_Row` for each text, aligned in pieces of ``PIECE_BYTES``."""
    out = [_Row(keep) for _ in texts]
    pieces, size = [], 0

    def flush():
        if not pieces:
            return
        doc = np.repeat(np.arange(len(pieces)), [len(p) for _, p in pieces])
        numbers, keys, weights, text = pair.align(np.concatenate([p for _, p in pieces]), doc, len(pieces))
        span = len(pair.a_bytes) * pair.n_b
        ends = np.searchsorted(keys, np.arange(1, len(pieces) + 1) * span).tolist()
        for k, (row, _) in enumerate(pieces):
            i, j = ends[k - 1] if k else 0, ends[k]
            out[row].add(numbers[k], keys[i:j] - k * span, weights[i:j], text[k])
        pieces.clear()

    for begin in range(0, len(texts), 512):  # segments are numbered for some texts at once
        part = [(k, t) for k, t in enumerate(texts[begin:begin + 512], begin) if t]
        split = [pair.segments(t) for _, t in part]
        numbered = pair.look([s for x in split for s in x])
        done = 0
        for (row, text), segs in zip(part, split):
            at = numbered[done:done + len(segs)]
            done += len(segs)
            if not pair.fits[at].all():
                whole = f" {text}".encode()
                if pair.joined(0, at) != whole or pair.joined(1, at) != whole:
                    continue
            sizes = np.cumsum([len(s) + 1 for s in segs])
            i = 0
            while i < len(segs):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PIECE_BYTES - size, "right")))
                pieces.append((row, at[i:j]))
                size += int(sizes[j - 1] - (sizes[i - 1] if i else 0))
                i = j
                if size >= PIECE_BYTES:
                    flush()
                    size = 0
        flush()  # before the tables may shrink
        size = 0
    return out


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id_col: str = "doc_id",
          text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per document row: ``row`` (a number of its own), the id, n_a, n_b,
    n_groups, n_links, groups_sha256, ``pairs`` (A id * B's vocabulary size + B
    id, distinct and sorted) with ``links`` of each, and with ``keep_groups`` the
    groups themselves as text (`a1,a2|b1;a3|b2,b3`).  The vocabularies are paths
    that every executor can read."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    groups = ", groups string" if keep_groups else ""
    schema = (f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              f"pairs array<long>, links array<long>{groups}")

    def run(batches):
        pair, number = _load(byte_vocabulary, piece_vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = _rows(pair, part.column(1).to_pylist(), keep_groups)
                numbers = np.array([r.numbers for r in rows], np.int64).reshape(-1, 4)
                stops = np.concatenate([[0], np.cumsum([len(r.keys) for r in rows])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([getattr(r, c) for r in rows])))
                         for c in ("keys", "weights")]
                cols = [pa.array(np.arange(number, number + len(rows))), part.column(0), *map(pa.array, numbers.T.copy()),
                        pa.array([r.digest.hexdigest() if r.numbers[0] else "" for r in rows], pa.string()), *lists]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
                if keep_groups:
                    cols.append(pa.array(["".join(r.text) for r in rows], pa.string()))
                    names.append("groups")
                number += len(rows)
                yield pa.RecordBatch.from_arrays(cols, names=names)
        pair.forget()

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, best): in how many documents an id pair is linked, and
    whether no other pair of its A id is linked in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / F.lit(n_b)))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, known: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum.  ``known``: a written table of :func:`pair_counts`."""
    rows = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    if known.count() <= hot_pairs:
        found = rows.join(F.broadcast(known), "pair")
    else:
        hot = F.broadcast(known.orderBy(F.col("n_docs").desc(), "pair").limit(hot_pairs))
        rest = known.join(hot.select("pair"), "pair", "left_anti")
        found = rows.join(hot, "pair").unionByName(rows.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    return aligned.drop("pairs", "links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


def cross_align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id_col: str = "doc_id",
                text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document row the alignment's numbers with the corpus statistics."""
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary).get_piece_size()
    scratch = Scratch(docs.sparkSession, "token-align")
    try:
        aligned = scratch.keep(align(docs, byte_vocabulary, piece_vocabulary, id_col, text_col), "aligned")
        known = scratch.keep(pair_counts(aligned, n_b), "pairs")
        return materialize(scored(aligned, known, hot_pairs), "token-align-result")
    finally:
        scratch.drop()
