"""Document probability as the marginal over all subword segmentations.

The vocabulary is an existing sentencepiece file; its pieces' unigram scores
are learnt from the training documents (log10 of a piece's smoothed share of
the pieces that their words fall into).  A word's probability is the sum over
every way to cut it into pieces of the product of their probabilities, by the
forward recursion in log space over the lattice of pieces; characters outside
the vocabulary go by their byte pieces.  A text's score is the sum over its
words and one end.  A smoothed word-count score is returned beside it.

Words are counted over all documents: packed blocks send their distinct words,
once each, to hash buckets, which know every word's count and answer each block
with the counts and scores of its words in the order sent.

Words are lower-cased (A-Z) runs between ASCII white space.  A null or empty
text has the end alone.  Documents with a null id are in the held-out part.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import blocks as B
from kestrel.llm.langid import held_out

BLOCK_BYTES = 8 << 20
SMOOTHING = 0.5
#: rows of the piece counts that hold other totals
_TOKENS, _DISTINCT = -1, -2
_MARK = "▁"


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Unigram scores (log10) of the pieces, and the marginal of a word."""

    def __init__(self, path: str, counts: dict[int, int], n_docs: int):
        sp = _processor(path)
        size = sp.get_piece_size()
        total = math.log10(sum(counts.values()) + n_docs + SMOOTHING * (size + 1))
        score = [math.log10(counts.get(i, 0) + SMOOTHING) - total for i in range(size)]
        self.end = math.log10(n_docs + SMOOTHING) - total
        self.score, self.byte = {}, [0.0] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = score[i]
            elif not (sp.is_control(i) or sp.is_unknown(i) or _MARK in piece[1:]):
                self.score[piece] = score[i]
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}

    def marginal(self, word: str) -> float:
        """log10 of the sum over all segmentations of the marked word."""
        text = _MARK + word
        n, score, prefixes, power = len(text), self.score, self.prefixes, 10.0
        arrive = [[] for _ in range(n + 1)]
        arrive[0].append(0.0)
        for i in range(n):
            terms = arrive[i]
            top = max(terms)
            here = top if len(terms) == 1 else top + math.log10(sum([power ** (t - top) for t in terms]))
            arrive[i] = None
            char = text[i]
            if char not in score:
                arrive[i + 1].append(here + sum(self.byte[b] for b in char.encode()))
            j = i + 1
            while j <= n and (piece := text[i:j]) in prefixes:
                if (s := score.get(piece)) is not None:
                    arrive[j].append(here + s)
                j += 1
        terms = arrive[n]
        top = max(terms)
        return top + math.log10(sum([power ** (t - top) for t in terms]))


def _words(block: B.Block) -> list[list[bytes]]:
    raw, starts = block.data.tobytes().lower(), block.starts
    return [raw[a:b].split() for a, b in zip(starts.tolist(), block.ends.tolist())]


def _distinct(docs: list[list[bytes]], buckets: int):
    """The block's words in the order in which they are sent: by bucket, then by word."""
    words = sorted(set().union(*docs))
    bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    return [words[i] for i in order.tolist()], bucket[order]


def _merge(table: pa.Table):
    """In a bucket: every block's words, and the training count of each word."""
    unpack = zstandard.ZstdDecompressor()
    lists, total = [], {}
    for payload in table.column("payload").to_pylist():
        size = int.from_bytes(payload[:4], "little")
        counts = np.frombuffer(payload[4:4 + 8 * size], np.int64).tolist()
        words = unpack.decompress(payload[4 + 8 * size:]).split(b"\n")
        lists.append(words)
        for w, n in zip(words, counts):
            total[w] = total.get(w, 0) + n
    return lists, total


def score(docs: DataFrame, vocabulary: str, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Learns from the rows whose crc32(id as text) mod ``folds`` is not 0.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         held_out(F.col(f"`{id_col}`"), folds).alias("held_out"))
    packed = B.pack(source, block_bytes=BLOCK_BYTES)
    buckets = B.n_buckets(packed)

    def send(block):
        docs, held = _words(block), block.rest().field("held_out").to_pylist()
        words, bucket = _distinct(docs, buckets)
        count = dict.fromkeys(words, 0)
        for ws, h in zip(docs, held):
            if not h:
                for w in ws:
                    count[w] += 1
        squeeze = zstandard.ZstdCompressor(level=1)
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], bucket])))
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(words)]):
            own = words[a:b]
            counts = np.array([count[w] for w in own], np.int64).tobytes()
            rows.append((int(bucket[a]), block.block, len(own).to_bytes(4, "little") + counts + squeeze.compress(b"\n".join(own))))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "block", "payload"])

    columns = ["block", "ids", "ends", "texts", "rest"]
    sent = B.materialize(B.scan(packed, send, B.KEYS_SCHEMA, columns), "words")

    def pieces(table):
        sp = _processor(vocabulary)
        _, total = _merge(table)
        seen = [(w, n) for w, n in total.items() if n]
        count = np.zeros(sp.get_piece_size(), np.int64)
        for at in range(0, len(seen), 10_000):
            part = seen[at: at + 10_000]
            ids = sp.encode([w.decode() for w, _ in part], num_threads=1)
            flat = np.array([i for x in ids for i in x], np.int64)
            np.add.at(count, flat, np.repeat(np.array([n for _, n in part], np.int64), [len(x) for x in ids]))
        used = np.flatnonzero(count)
        return pa.table({"piece": np.append(used, [_TOKENS, _DISTINCT]).astype(np.int32),
                         "n": np.append(count[used], [sum(n for _, n in seen), len(seen)]).astype(np.int64)})

    counts = B.gather(sent, pieces, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r["piece"]: r["n"] for r in counts.collect()}  # bounded by the vocabulary
    n_docs = source.where("NOT held_out").count()
    tokens = counts.pop(_TOKENS, 0) + n_docs
    distinct = counts.pop(_DISTINCT, 0) + (n_docs > 0)
    lattice = docs.sparkSession.sparkContext.broadcast(Lattice(vocabulary, counts, n_docs))  # bounded by the vocabulary
    below = math.log10(tokens + 0.1 * (distinct + 1))

    def reply(table):
        lists, total = _merge(table)
        marginal = lattice.value.marginal
        known = {w: (n, marginal(w.decode())) for w, n in total.items()}
        bucket = table.column("bucket")[0].as_py()
        out = []
        for b, words in zip(table.column("block").to_pylist(), lists):
            pairs = [known[w] for w in words]
            out.append((bucket, b, np.array([p[0] for p in pairs], np.int64).tobytes() + np.array([p[1] for p in pairs]).tobytes()))
        cols = list(zip(*out))
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int64()),
                         "payload": pa.array(cols[2], pa.binary())})

    def finish(block, replies):
        docs = _words(block)
        words, _ = _distinct(docs, buckets)
        told = sorted(zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()))
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, np.int64, len(p) // 16) for _, p in told)])
        m = np.concatenate([np.zeros(0), *(np.frombuffer(p, np.float64, offset=len(p) // 2) for _, p in told)])
        place = {w: i for i, w in enumerate(words)}
        flat = np.array([place[w] for ws in docs for w in ws], np.int64)
        size = np.array([len(ws) for ws in docs], np.int64)
        sums = [_sums(v[flat], size) for v in ((c > 0).astype(np.float64), np.log10(c + 0.1) - below, m)]
        n = len(docs)
        rest = block.rest()
        return pa.table({
            "doc_id": rest.field("doc_id"), "held_out": rest.field("held_out"), "n_tokens": size + 1,
            "n_known": sums[0].astype(np.int64) + (n_docs > 0), "train_tokens": np.full(n, tokens, np.int64),
            "base_score": sums[1] + (math.log10(n_docs + 0.1) - below), "score": sums[2] + lattice.value.end})

    return B.answer(packed, B.gather(sent, reply, B.KEYS_SCHEMA), finish,
                    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
                    columns)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each document's run of values; documents without any have 0."""
    out = np.zeros(len(size))
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out
