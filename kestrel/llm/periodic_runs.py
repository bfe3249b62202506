"""Detection of periodic runs of words by longest common extensions.

A run is a maximal stretch of words of smallest period q whose length is at
least ``max(24, 3 * q)``.  All words of a batch of documents form one sequence of
numbers, with a number of its own after each document.  Longest common extensions
(LCE) between any two places come from a difference cover: only suffixes that
start at places of the cover modulo ``PERIOD`` are sorted (by their first words,
then by doubling), with the lengths that neighbours share in a sparse table.  Two
places compare at most ``PERIOD - 1`` words until both are cover places; from
there the answer is a range minimum.

Runs are enumerated over a harmonic grid: for each period p the places 0, g, 2g, ...
of a document with g = max(2p, 24 - p).  A run of period p is a stretch of at
least g places i with word i = word i + p, so it holds a grid place; extending
there to the right and, over the reversed sequence, to the left gives the run.
The smallest period that gives a stretch is the run's.  The grids of a document
of n words have about n ln(n) / 2 places together; they are walked in bounded pieces.

A null or empty text has no words and no run.  Every row is judged by itself;
rows may repeat and ids may be null.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A difference cover: every distance modulo 21 is that of two of its numbers.
PERIOD = 21
COVER = np.array([3, 6, 7, 12, 14])
LEAST, TIMES = 24, 3
#: Words whose suffixes are sorted together, and grid places that are looked at together.
BATCH_WORDS = 200_000
GRID_PIECE = 1 << 21


def _shifts() -> np.ndarray:
    """shift[i, j]: the least d for which i + d and j + d are both cover places (modulo PERIOD)."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in range(PERIOD - 1, -1, -1):
        both = inside[np.arange(PERIOD) + d][:, None] & inside[np.arange(PERIOD) + d][None, :]
        out[both] = d
    assert (out >= 0).all()
    return out


_SHIFT = _shifts()


class Extensions:
    """LCE over one sequence of non-negative numbers whose last is unique."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.full(PERIOD + 3, -1, np.int64)]) + 1
        at = np.flatnonzero(np.isin(np.arange(self.n) % PERIOD, COVER))
        levels = self._ranks(at)
        rank = levels[-1][1]
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        self.place = np.zeros(self.n, np.int64)  # order among the sorted suffixes, by position
        self.place[at] = rank
        shared = self._neighbours(at, order, levels)
        self.table = [shared.astype(np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _ranks(self, at: np.ndarray):
        """[(length, rank of each suffix by that many words)], the last without ties."""
        w, m = self.words, len(at)
        rank, used, levels = np.zeros(m, np.int64), 0, []
        fields = 3 if int(w.max(initial=0)) < 1 << 21 else 1  # numbers that one key holds
        tied = np.arange(m)
        while used < PERIOD and len(tied):
            key = w[at[tied] + used]
            for k in range(1, fields):
                key = key << 21 | w[at[tied] + used + k]
            rank, tied = _refine(rank, tied, key)
            used += fields
        if m:
            levels.append((PERIOD, rank))
        step = PERIOD
        spot = np.full(self.n + 1, -1, np.int64)
        while len(tied):
            spot[at] = rank
            follow = at[tied] + step
            rank, tied = _refine(rank, tied, np.where(follow < self.n, spot[np.minimum(follow, self.n)], -1))
            step *= 2
            levels.append((step, rank))
        return levels or [(PERIOD, rank)]

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels) -> np.ndarray:
        """Words that each sorted suffix shares with the next one."""
        x, y = at[order[:-1]], at[order[1:]]
        total = np.zeros(len(x), np.int64)
        spot = np.full(self.n + 1, -1, np.int64)
        for length, rank in reversed(levels):
            spot[at] = rank
            i, j = np.minimum(x + total, self.n), np.minimum(y + total, self.n)
            # equal only where both are cover places that agree in so many words
            total += np.where((i < self.n) & (j < self.n) & (spot[i] == spot[j]), length, 0)
        return total + self._compare(x + total, y + total, np.full(len(x), PERIOD))

    def _compare(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from x and y on, one by one, at most ``limit``."""
        out = np.zeros(len(x), np.int64)
        live = np.flatnonzero(limit > 0)
        for k in range(PERIOD):
            i, j = np.minimum(x[live] + k, self.n), np.minimum(y[live] + k, self.n)
            live = live[(self.words[i] == self.words[j]) & (i < self.n) & (j < self.n)]
            if not len(live):
                break
            out[live] = k + 1
            live = live[limit[live] > k + 1]
        return out

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that agree from x and from y on; x and y differ."""
        shift = _SHIFT[x % PERIOD, y % PERIOD]
        out = self._compare(x, y, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            i, j = self.place[x[far] + shift[far]], self.place[y[far] + shift[far]]
            lo, hi = np.minimum(i, j), np.maximum(i, j)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level).tolist():
                s = level == k
                least[s] = np.minimum(self.table[k][lo[s]], self.table[k][hi[s] - (1 << k)])
            out[far] += least
        return out


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the tied suffixes by ``key`` as well; the suffixes that still tie.
    A rank is the number of smaller suffixes, so others keep theirs."""
    order = np.lexsort((key, rank[tied]))
    t, k = tied[order], key[order]
    r = rank[t]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
    n = np.arange(len(t))
    head = np.maximum.accumulate(np.where(new_group, n, 0))
    first = np.maximum.accumulate(np.where(fresh, n, 0))
    rank = rank.copy()
    rank[t] = r + first - head
    single = fresh & np.concatenate([fresh[1:], [True]])
    return rank, t[~single]


def runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of the documents of a batch as rows (document, start, length, period),
    ordered by document, start, period.  ``words``: numbers; ``ends``: of documents."""
    n_docs = len(ends)
    size = np.diff(np.concatenate([[0], ends]))
    top = int(words.max(initial=-1)) + 1
    # a number of its own after each document
    text = np.insert(words.astype(np.int64), ends, top + np.arange(n_docs))
    begin = np.cumsum(size + 1) - (size + 1)
    forward = backward = None
    found = []
    for doc, place, period in _grid(size):
        x = begin[doc] + place
        same = text[x] == text[x + period]
        if not same.any():
            continue
        doc, x, period = doc[same], x[same], period[same]
        if forward is None:
            forward = Extensions(text)
            backward = Extensions(np.concatenate([text[-2::-1] if len(text) > 1 else text[:0], [top + n_docs]]))
        right = forward(x, x + period)
        last = len(text) - 2  # of the text without the final separator, reversed
        left = backward(last - x, last - x - period)  # place x itself included
        stretch = right + left - 1
        keep = (stretch >= np.maximum((TIMES - 1) * period, LEAST - period))
        if keep.any():
            rows = np.stack([doc, x - left + 1 - begin[doc], stretch + period, period], axis=1)[keep]
            found.append(np.unique(rows, axis=0))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # of one stretch the smallest period counts
    first = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _grid(size: np.ndarray):
    """(document, place, period) of the grid places, in pieces: place + period lies in the document."""
    most = np.where(size >= LEAST, size // TIMES, 0)
    longest = int(most.max(initial=0))
    docs = np.flatnonzero(most)
    held, total = [], 0
    for p in range(1, longest + 1):
        docs = docs[most[docs] >= p]
        step = max((TIMES - 1) * p, LEAST - p)
        count = (size[docs] - p + step - 1) // step
        held.append((p, step, docs, count))
        total += int(count.sum())
        if total >= GRID_PIECE or p == longest:
            c = np.concatenate([h[3] for h in held])
            doc = np.repeat(np.concatenate([h[2] for h in held]), c)
            step = np.repeat(np.repeat([h[1] for h in held], [len(h[2]) for h in held]), c)
            period = np.repeat(np.repeat([h[0] for h in held], [len(h[2]) for h in held]), c)
            yield doc, (np.arange(len(doc)) - np.repeat(np.cumsum(c) - c, c)) * step, period
            held, total = [], 0


def planted(words: list, doc_id) -> list:
    """The words with a periodic end where the id's checksum asks for one; a null id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[:n - a]


def _judge(words: list, found: np.ndarray) -> tuple:
    """The result of one document from its runs (start, length, period)."""
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    best = (None,) * 4
    if len(found):
        for s, n, q in found.tolist():  # exact comparison of length / period
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        best = (*best, 1000 * best[1] // best[2])
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        words = [words[k] for k in kept.tolist()]
    return (len(found), *best, text, b" ".join(words).decode())


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
                  outputs: bool = True) -> DataFrame:
    """One row per document row: the id, ``n_runs``, the run of the greatest exponent
    (ties: first start, then smallest period; nulls without runs), ``runs_sha256``
    and ``collapsed_sha256``, and with ``outputs`` the things themselves: ``runs``, a
    line `start,length,period` each, and ``collapsed``, the words that no run repeats,
    joined by one space.  ``plant``: give documents periodic ends first (:func:`planted`).
    Words are `[^\\x20\\x09-\\x0D]+`."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {FIELDS}, runs_sha256 string, collapsed_sha256 string" + (
        ", runs string, collapsed string" if outputs else "")
    names = ["doc_id", *[c.split()[0] for c in FIELDS.split(", ")], "runs_sha256", "collapsed_sha256"] + (
        ["runs", "collapsed"] if outputs else [])

    def judged(ids, texts):
        number = _Numbers()
        ends = np.cumsum(list(map(len, texts)))
        words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
        rows = runs(words, ends)
        cut = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).tolist()
        out = [_judge(t, rows[i:j, 1:]) for t, i, j in zip(texts, cut, cut[1:])]
        cols = [ids, *[pa.array([o[k] for o in out], pa.int64()) for k in range(5)],
                *[pa.array([hashlib.sha256(o[k].encode()).hexdigest() for o in out], pa.string()) for k in (5, 6)]]
        if outputs:
            cols += [pa.array([o[k] for o in out], pa.string()) for k in (5, 6)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        for batch in batches:
            begin, texts, size = 0, [], 0
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or "").encode().split()
                if plant:
                    words = planted(words, batch.column(0)[k].as_py())
                texts.append(words)
                size += len(words)
                if size >= BATCH_WORDS or k + 1 == batch.num_rows:
                    yield judged(batch.column(0).slice(begin, len(texts)), texts)
                    begin, texts, size = k + 1, [], 0

    return source.mapInArrow(run, schema)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n
