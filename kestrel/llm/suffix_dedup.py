"""Removal of every repeat of 200 bytes, by sorting suffixes (deep-shallow).

A byte goes if a string of ``SIZE`` bytes that covers it also starts anywhere
else, in any document or in the same one.

Sorting all suffixes of a corpus is not needed to find them.  Each window of
200 bytes is held by its *anchor*, the place of the smallest 16-byte hash
among its first ``ANCHOR_GRAMS``; equal windows have their anchor at equal
offsets.  So only suffixes at anchors (one byte in 64 or so) whose next
``CORE`` bytes occur twice in the corpus are sorted, by bucket of those bytes:

* a multikey sort by 8-byte words to a shallow depth, then
* blind tries (only branching bits are looked at on the way down, one
  comparison at the leaf) for the groups that still agree.

Suffix order gives the common prefix of neighbours; the same sort of the
reversed left contexts gives common suffixes.  Windows at offset l before
their anchor are equal exactly if the suffixes agree for 200 - l bytes and the
left contexts for l, so repeats follow from the two orders.

Hot anchors, whose core is in ``HOT_BLOCKS`` blocks or more, would bring an
unbounded group to one bucket; their windows are exchanged as 64-bit keys, once
for each block, instead (same result, other route).  In a run of short period
(rulers, padding, blanks) only the first period's windows are compared; the
others equal those a period before.

Null and empty texts have no bytes.  Every row is a document of its own, rows
with one id too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import blocks as B
from kestrel.llm.hashing import _COEF, mix

SIZE = 200
GRAM, ANCHOR_GRAMS = 16, 128
CORE = SIZE - ANCHOR_GRAMS + 1
LEFT = ANCHOR_GRAMS - 1
SHALLOW_WORDS = 4
HOT_BLOCKS = 16
BLOCK_BYTES = 2 << 20
BUCKET_TEXT_BYTES = 16 << 20
_SEGMENT = 1 << 20
_ROWS = 1 << 14
MAX_PERIOD = 48
U64 = np.uint64


def _words_at_all(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one integer."""
    out = np.empty(len(data) - 7, np.uint64)
    for r in range(8):
        n = (len(data) - r) // 8
        out[r::8] = np.frombuffer(data[r: r + 8 * n].tobytes(), "<u8")[: len(out[r::8])]
    return out


def _string_hash(data: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a multiple of 8 is used, the last word overlapping) at positions."""
    total = np.zeros(len(at), np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # a view: the 8 bytes from every position on
    offsets = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    for lo in range(0, len(at), 1 << 16):
        part = at[lo: lo + (1 << 16)]
        for k, o in enumerate(offsets):
            total[lo: lo + len(part)] += words[part + o] * _COEF[(salt * 50 + k) % 500]
    return mix(total + U64(salt))


def _anchors(block: B.Block):
    """(padded bytes, anchors, first and last window start of each anchor, runs).

    In a run of short period the smallest hash comes back every period, so nearly
    every byte would be an anchor.  A window that equals the one a period before
    in its document is a repeat by itself: ``runs`` holds the bytes that such
    pairs of windows cover, and anchors with no other window are left out; the
    first period of the run stays and stands for them.
    """
    data = np.concatenate([block.data, np.zeros(SIZE + 256, np.uint8)])
    n = len(block.data)
    valid = np.zeros(n, bool)  # where a window starts
    for a, b in zip(block.starts.tolist(), block.ends.tolist()):
        if b - a >= SIZE:
            valid[a: b - SIZE + 1] = True
    found = []
    for lo in range(0, n, _SEGMENT):
        hi = min(n, lo + _SEGMENT)
        s = np.flatnonzero(valid[lo:hi])
        if not len(s):
            continue
        w = _words_at_all(data[lo: hi + ANCHOR_GRAMS + GRAM])
        h = mix(w[:-8] * _COEF[401] + w[8:] * _COEF[402])
        m = (h >> U64(32) << U64(32)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step < ANCHOR_GRAMS:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        p = (m[s] & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        found.append(np.stack([p[first], s[first], s[np.append(first[1:], len(s)) - 1]]) + lo)
    if not found:
        z = np.zeros(0, np.int64)
        return data, z, z, z, np.zeros(0, _RUN)
    p, start, stop = np.concatenate(found, 1)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))  # an anchor may have windows in two segments
    p, start, stop = p[first], start[first], stop[np.append(first[1:], len(p)) - 1]
    keep, runs = _short_periods(block, p, start, stop)
    return data, p[keep], start[keep], stop[keep], runs


def _short_periods(block: B.Block, p: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Which anchors have a window that doesn't equal the one a short period before, and
    the bytes [lo, hi) of the windows that do, and of those they equal."""
    keep, runs = np.ones(len(p), bool), []
    gap = np.diff(p)
    edge = np.concatenate([[0], np.flatnonzero(gap[1:] != gap[:-1]) + 1, [len(gap)]]) if len(gap) else np.zeros(1, np.int64)
    steady = np.flatnonzero((np.diff(edge) >= 4) & (gap[edge[:-1]] <= MAX_PERIOD)) if len(gap) else []
    docs, ends = block.starts, block.ends
    for k in steady:  # anchors a period apart
        i, j, q = int(edge[k]), int(edge[k + 1]), int(gap[edge[k]])
        doc = int(np.searchsorted(ends, start[i], "right"))
        lo = max(int(docs[doc]) + q, int(start[i]))
        hi = min(int(ends[doc]), int(stop[j]) + SIZE)
        differ = np.flatnonzero(block.data[lo:hi] != block.data[lo - q: hi - q]) + lo
        bounds = np.concatenate([[lo - 1], differ, [hi]])
        for b in np.flatnonzero(np.diff(bounds) > SIZE).tolist():
            a, z = int(bounds[b]) + 1, int(bounds[b + 1]) - SIZE  # windows a..z equal those a period before
            runs.append((a - q, z + SIZE))
            keep[i: j + 1] &= (start[i: j + 1] < a) | (stop[i: j + 1] > z)
    return keep, np.array(runs, _RUN)


def _core_keys(data, p, buckets):
    h = _string_hash(data, p, CORE, 1)
    return ((h >> U64(32)) % U64(buckets) << U64(32)) | (h & U64(0xFFFFFFFF))


_CORE = np.dtype([("key", "<u4"), ("many", "u1")])
_CONTEXT = np.dtype([("p", "<u4"), ("lmin", "u1"), ("lmax", "u1"), ("bytes", "u1", LEFT + SIZE)])
_WINDOW = np.dtype([("key", "<u8"), ("here", "u1")])
_MASK = np.dtype([("p", "<u4"), ("mask", "u1", ANCHOR_GRAMS // 8)])
_RUN = np.dtype([("lo", "<u4"), ("hi", "<u4")])


def _reply_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int64()),
                     "payload": pa.array(cols[2], pa.binary())})


def _shared_cores(table: pa.Table) -> pa.Table:
    """In a bucket: to each block its keys that other blocks have too, and whether many have them."""
    bucket = table.column("bucket")[0].as_py()
    parts = [np.frombuffer(x.as_py(), "<u4") for x in table.column("payload")]
    keys, seen = np.unique(np.concatenate(parts), return_counts=True)
    out = []
    for b, p in zip(table.column("block").to_pylist(), parts):
        n = seen[np.searchsorted(keys, p)]
        rows = np.empty(int((n > 1).sum()), _CORE)
        rows["key"], rows["many"] = p[n > 1], n[n > 1] >= HOT_BLOCKS
        if len(rows):
            out.append((bucket, b, rows.tobytes()))
    return _reply_table(out)


def blind_order(strings: list[bytes]) -> list[int]:
    """The order of equally long strings, by insertion into a blind (crit-bit) trie.

    A node is [branching bit, left, right]; on the way down only branching bits
    are looked at, and one comparison with the leaf reached finds the place.
    """
    value = [int.from_bytes(s, "big") for s in strings]
    twins: dict[int, list[int]] = {0: [0]}  # leaf (an index) -> all strings equal to it
    root: list | int = 0
    for i in range(1, len(value)):
        x, at = value[i], root
        while type(at) is list:
            at = at[1 + (x >> at[0] & 1)]
        differ = (x ^ value[at]).bit_length() - 1  # branching bit, counted from the right
        if differ < 0:
            twins[at].append(i)
            continue
        twins[i] = [i]
        side, parent, at = 0, None, root
        while type(at) is list and at[0] > differ:
            side = 1 + (x >> at[0] & 1)
            parent, at = at, at[side]
        node = [differ, at, i] if x >> differ & 1 else [differ, i, at]
        if parent is None:
            root = node
        else:
            parent[side] = node
    out, todo = [], [root]
    while todo:
        at = todo.pop()
        if type(at) is list:
            todo += [at[2], at[1]]
        else:
            out += twins[at]
    return out


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix (suffixes cut to one length)."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(min(SHALLOW_WORDS, words.shape[1])):  # shallow: multikey, one word at a time, in open groups only
        size = np.bincount(group, minlength=n)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            return order
        key = words[order[open_], d].astype(np.uint64)
        move = np.lexsort((key, group[open_]))
        order[open_] = order[open_][move]
        key, g = key[move], group[open_]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
    size = np.bincount(group)
    first = np.cumsum(size) - size
    for g in np.flatnonzero(size > 1).tolist():  # deep: what still agrees
        a = int(first[g])
        own = order[a: a + size[g]]
        order[a: a + size[g]] = own[blind_order([rows[i].tobytes() for i in own.tolist()])]
    return order


def _agreement(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before it in the order (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 8192):
        hi = min(len(order), lo + 8192)
        differ = rows[order[lo:hi]] != rows[order[lo - 1: hi - 1]]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def repeated_offsets(contexts: np.ndarray) -> np.ndarray:
    """For each context (a _CONTEXT row): which of its windows, by offset of the anchor, another one has."""
    n = len(contexts)
    right = np.ascontiguousarray(contexts["bytes"][:, LEFT:])
    left = np.ascontiguousarray(contexts["bytes"][:, LEFT - 1:: -1])
    by_right, by_left = deep_shallow(right), deep_shallow(left)
    lcp, lcs = _agreement(right, by_right), _agreement(left, by_left)
    out = np.zeros((n, ANCHOR_GRAMS), bool)
    group_r, group_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(ANCHOR_GRAMS):
        rows = np.flatnonzero((contexts["lmin"] <= offset) & (offset <= contexts["lmax"]))
        if len(rows) < 2:
            continue
        group_r[by_right] = np.cumsum(lcp < SIZE - offset)
        group_l[by_left] = np.cumsum(lcs < offset)
        key = group_r[rows] * (n + 1) + group_l[rows]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(rows), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[rows[order[twice]], offset] = True
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (binary: pairs of
    little-endian 64-bit start and stop of the removed runs), one row per row."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = B.pack(source, block_bytes=BLOCK_BYTES, level=4)
    size = packed.agg(F.sum("text_bytes")).first()[0] or 0
    buckets = int(max(48, -(-size // BUCKET_TEXT_BYTES)))
    plain = ["block", "ids", "ends", "texts"]

    def send_cores(block):
        data, p, _, _, _ = _anchors(block)
        keys = np.unique(_core_keys(data, p, buckets))
        yield B.by_bucket(block.block, (keys >> U64(32)).astype(np.int64), keys.astype("<u4"))

    shared = B.gather(B.scan(packed, send_cores, B.KEYS_SCHEMA), _shared_cores, B.KEYS_SCHEMA)

    def send_contexts(block, replies):
        data, p, first, last, runs = _anchors(block)
        keys = _core_keys(data, p, buckets)
        told = [(b, np.frombuffer(x, _CORE)) for b, x in
                zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist())]
        wide = lambda b, k: (U64(b) << U64(32)) | k.astype(np.uint64)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(wide(b, t["key"]) for b, t in told)]))
        many = np.sort(np.concatenate([np.zeros(0, np.uint64), *(wide(b, t["key"][t["many"] == 1]) for b, t in told)]))
        values, seen = np.unique(keys, return_counts=True)
        hot = B.contains(many, keys)
        use = np.flatnonzero((B.contains(known, keys) | B.contains(values[seen > 1], keys)) & ~hot)
        out = []
        squeeze = zstandard.ZstdCompressor(level=1)
        # every anchor's surroundings, as a view
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(LEFT, np.uint8), data]), LEFT + SIZE)
        place = np.arange(-LEFT, SIZE)
        use = use[np.argsort(keys[use] >> U64(32), kind="stable")]
        for part in B.pieces(keys[use] >> U64(32), _ROWS):
            u = use[part]
            rows = np.zeros(len(u), _CONTEXT)
            rows["p"], rows["lmin"], rows["lmax"], rows["bytes"] = p[u], p[u] - last[u], p[u] - first[u], around[p[u]]
            # bytes outside all of an anchor's windows say nothing; zeros pack well
            rows["bytes"][(place < -rows["lmax"].astype(np.int64)[:, None]) | (place >= SIZE - rows["lmin"].astype(np.int64)[:, None])] = 0
            out += [(b, k, squeeze.compress(x)) for b, k, x in zip(*B.by_bucket(
                block.block, (keys[u] >> U64(32)).astype(np.int64), rows).to_pydict().values())]
        if len(runs):  # back to this block
            out.append((2 * buckets + block.block % buckets, block.block, runs.tobytes()))
        hot = np.flatnonzero(hot)
        if len(hot):
            # an anchor's windows are consecutive
            k = np.concatenate([_window_keys(data, a, b + 1) for a, b in zip(first[hot].tolist(), last[hot].tolist())])
            k, seen = np.unique(k, return_counts=True)
            rows = np.empty(len(k), _WINDOW)
            rows["key"], rows["here"] = k, seen > 1
            out += zip(*B.by_bucket(block.block, buckets + (mix(k) % U64(buckets)).astype(np.int64), rows).to_pydict().values())
        return _reply_table(out)

    def find_repeats(table):
        bucket = table.column("bucket")[0].as_py()
        blocks, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        if bucket >= 2 * buckets:
            return table
        if bucket >= buckets:  # windows of hot anchors
            parts = [np.frombuffer(x, _WINDOW) for x in payloads]
            keys, seen = np.unique(np.concatenate([p["key"] for p in parts]), return_counts=True)
            found = [p["key"][(seen[np.searchsorted(keys, p["key"])] > 1) | (p["here"] == 1)] for p in parts]
        else:
            unpack = zstandard.ZstdDecompressor()
            parts = [np.frombuffer(unpack.decompress(x), _CONTEXT) for x in payloads]
            dup = repeated_offsets(np.concatenate(parts))
            found, at = [], 0
            for p in parts:
                mine = dup[at: at + len(p)]
                at += len(p)
                some = mine.any(1)
                rows = np.zeros(int(some.sum()), _MASK)
                rows["p"], rows["mask"] = p["p"][some], np.packbits(mine[some], axis=1)
                found.append(rows)
        return _reply_table([(bucket, b, f.tobytes()) for b, f in zip(blocks, found) if len(f)])

    contexts = B.answer(packed, shared, send_contexts, B.KEYS_SCHEMA, plain)
    repeats = B.gather(contexts, find_repeats, B.KEYS_SCHEMA)

    def cut(block, replies):
        n = len(block.data)
        step = np.zeros(n + 1, np.int32)
        windows = []
        for b, x in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
            if b >= 2 * buckets:
                rows = np.frombuffer(x, _RUN)
                np.add.at(step, rows["lo"], 1)
                np.add.at(step, rows["hi"], -1)
                continue
            if b >= buckets:
                windows.append(np.frombuffer(x, "<u8"))
                continue
            rows = np.frombuffer(x, _MASK)
            which, offset = np.nonzero(np.unpackbits(rows["mask"], axis=1))
            s = rows["p"][which].astype(np.int64) - offset
            np.add.at(step, s, 1)
            np.add.at(step, s + SIZE, -1)
        starts, ends = block.starts, block.ends
        if windows:
            known = np.sort(np.concatenate(windows))
            data = np.concatenate([block.data, np.zeros(SIZE + 8, np.uint8)])
            for a, b in zip(starts.tolist(), (ends - SIZE + 1).tolist()):
                for lo in range(a, b, _SEGMENT):
                    s = lo + np.flatnonzero(B.contains(known, _window_keys(data, lo, min(b, lo + _SEGMENT))))
                    np.add.at(step, s, 1)
                    np.add.at(step, s + SIZE, -1)
        gone = np.cumsum(step)[:n] > 0
        raw, kept, removed, spans = block.data, [], [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            g = gone[a:b]
            k = int(np.count_nonzero(g))
            removed.append(k)
            kept.append(raw[a:b].tobytes() if not k else raw[a:b][~g].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))) if k else np.zeros(0, np.int64)
            spans.append(edge.astype("<i8").tobytes())
        return pa.table({"doc_id": block.rest().field("doc_id"), "n_bytes": (ends - starts).astype(np.int64),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) // 16 for s in spans], pa.int64()),
                         "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.binary())})

    kind = source.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    return B.answer(packed, repeats, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans binary")


def _window_keys(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Keys of the SIZE bytes from each position in [lo, hi): stretches of 64 bytes are
    hashed once for all positions, then combined."""
    w = _words_at_all(data[lo: hi + SIZE])
    part = np.zeros(len(w) - 56, np.uint64)
    for k in range(8):
        part += w[8 * k: 8 * k + len(part)] * _COEF[100 + k]
    part = mix(part)
    n = hi - lo
    total = w[SIZE - 8: SIZE - 8 + n] * _COEF[110]
    for j in range(3):
        total += part[64 * j: 64 * j + n] * _COEF[111 + j]
    return mix(total)
