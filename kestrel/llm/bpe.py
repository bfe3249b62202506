"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match over the vocabulary proposes tokens for every distinct
word.  A sequence is what the merges would give exactly when every adjacent
pair of it is what the merges give for the two together, so the proposals of a
batch are verified at once: their adjacent pairs, as integer codes, are looked
up in the table of pairs judged so far, and only pairs never met before are
judged by merging.  Words with a failing pair, and words with a proposed token
that the merges never build, undergo exact merging.

Null and empty texts have no tokens.  The strings of special tokens in a text
give their ids, as the tokenizers library does by default.  Texts are encoded
whole; the table of words of a task starts anew at ``CACHE_WORDS`` entries, taking over
what is used of the one before, which bounds memory and never changes a result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 250_000
# Bytes of text encoded at a time (a longer text alone).
PART_BYTES = 1 << 20
#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary with its merges, and the tables that verification fills."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.token = {i: b for b, i in self.ids.items()}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.ids[raw(a)], self.ids[raw(b)]] = r, self.ids[raw(a + b)]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.token |= {i: s.encode() for s, i in special.items()}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.cache: dict[str, bytes] = {}  # words used lately, and those of the time before
        self.older: dict[str, bytes] = {}
        self.whole: dict[int, bool] = {}
        self.n = max(self.token) + 1
        self.good = np.zeros(0, np.int64)
        self.bad = np.zeros(0, np.int64)
        size = np.array([len(self.token.get(i, b"")) for i in range(self.n)], np.int64)
        self.end = np.cumsum(size)
        self.size = size
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(self.n)), np.uint8)
        self.stats = {"words": 0, "failed": 0}

    def forget(self) -> None:
        """Drop what was learnt, so that an idle worker holds the vocabulary alone."""
        self.cache, self.older, self.whole = {}, {}, {}
        self.good = self.bad = np.zeros(0, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < 40:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := self.rank.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    pair = ids[left], ids[after[left]]
                    if (m := self.rank.get(pair)) is not None:
                        heapq.heappush(heap, (m[0], left, *pair, m[1]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, (1 << 60, 0)
        pairs = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            stop = min(n, at + longest)
            while (t := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(t)
            at = stop
        return out

    def _is_whole(self, t: int) -> bool:
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merge(self.token[t]) == [t]
        return known

    def _pairs_hold(self, codes: np.ndarray) -> np.ndarray:
        """Whether each adjacent pair (first * n + second) survives merging."""
        fresh = np.setdiff1d(np.setdiff1d(codes, self.good), self.bad)
        if len(fresh):
            holds = np.array([self.merge(self.token[c // self.n] + self.token[c % self.n]) == [c // self.n, c % self.n]
                              for c in fresh.tolist()], bool)
            self.good = np.union1d(self.good, fresh[holds])
            self.bad = np.union1d(self.bad, fresh[~holds])
        at = np.minimum(np.searchsorted(self.good, codes), max(len(self.good) - 1, 0))
        return self.good[at] == codes if len(self.good) else np.zeros(len(codes), bool)

    def learn(self, words) -> None:
        """Fill the table of words for some that are not in it."""
        words = list(words)
        if len(self.good) + len(self.bad) > 2 * CACHE_WORDS:
            self.good = self.bad = np.zeros(0, np.int64)
        raw = [w.encode() for w in words]
        plans = [self.propose(w) for w in raw]
        size = np.array([len(p) for p in plans], np.int64)
        flat = np.array([t for p in plans for t in p], np.int64)
        word_of = np.repeat(np.arange(len(plans)), size)
        fails = np.zeros(len(plans), bool)
        tokens = np.unique(flat)
        broken = np.array([t for t in tokens.tolist() if not self._is_whole(t)], np.int64)
        fails[word_of[np.isin(flat, broken)]] = True
        inside = word_of[1:] == word_of[:-1]
        codes = flat[:-1][inside] * self.n + flat[1:][inside]
        if len(codes):
            values, back = np.unique(codes, return_inverse=True)
            fails[word_of[1:][inside][~self._pairs_hold(values)[back]]] = True
        for k in np.flatnonzero(fails).tolist():
            plans[k] = self.merge(raw[k])
        self.stats["words"] += len(plans)
        self.stats["failed"] += int(fails.sum())
        pack = np.array([t for p in plans for t in p], "<u4").tobytes()
        at = 0
        for w, p in zip(words, plans):
            stop = at + 4 * len(p)
            self.cache[w] = pack[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,)
            split.append([(p, None) if p in self.special else (None, self.words.findall(p)) for p in parts])
        used = set()
        for parts in split:
            for _, words in parts:
                if words:
                    used.update(words)
        need = used.difference(self.cache)
        if need:
            if len(self.cache) + len(need) > CACHE_WORDS:
                self.older, self.cache = self.cache, {}
                need = used
            if known := need & self.older.keys():
                self.cache.update((w, self.older[w]) for w in known)
                need = need - known
            if need:
                self.learn(need)
        look = self.cache.__getitem__
        return [b"".join(self.special[p] if p is not None else b"".join(map(look, words)) for p, words in parts)
                for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of all tokens, special ones included, as text."""
        size = self.size[ids]
        total = int(size.sum())
        begin = self.end[ids] - size
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def parts(batch: pa.RecordBatch):
    """Consecutive slices of a batch: 512 rows, less where its first column (text) has more than
    ``PART_BYTES`` there, but one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(max(int(np.searchsorted(ends, before + PART_BYTES, "right")), at + 1), at + 512)
        yield batch.slice(at, stop - at)
        at = stop


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with ``token_ids`` (binary: little-endian unsigned 32-bit),
    ``n_tokens`` and ``decoded`` (the text the ids decode to) added; columns of
    those names in the input are replaced.  ``vocabulary``: a path that every
    executor can read.  ``keep``: the input columns to return, all by default.

    A text crosses to Python once, and back only if it is kept."""
    added = ("token_ids", "n_tokens", "decoded")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    others = [c for c in keep if c != text_col]
    source = docs.select(F.col(f"`{text_col}`").alias("t"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("r")] if others else []))
    carried = ["r"] * bool(others) + ["t"] * (text_col in keep)
    schema = ", ".join([*[f"{c} {source.schema[c].dataType.simpleString()}" for c in carried],
                        "token_ids binary", "n_tokens long", "decoded string"])

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        bpe = load(vocabulary)
        for batch in batches:
            for part in parts(batch):
                ids = bpe.encode(["" if t is None else t for t in part.column(0).to_pylist()])
                decoded = [bpe.decode(np.frombuffer(i, "<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in carried], pa.array(ids, pa.binary()),
                     pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(decoded, pa.string())],
                    names=[*carried, "token_ids", "n_tokens", "decoded"])
        bpe.forget()
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, schema)
    columns = [F.col("t").alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in keep]
    return out.select(*columns, *added)
