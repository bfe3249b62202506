"""Near-duplicate vectors by pivots of large groups and random-projection trees.

Trees would cut a group that is larger than a leaf again and again, so large
groups are taken out first.  Around the members of a bounded sample that have
many close ones, unit *pivots* are placed until none is left.  A vector with a
cosine of ``threshold`` or more to a pivot is *at home* there; by the triangle
inequality of angles all that it links with lies within twice that angle, and
those vectors are the pivot's *guests*.  Home vectors are compared with all home
vectors and guests of their pivot, which finds every link they have, so they
don't enter the trees.

Every tree splits the others by random directions: at each node a vector goes
left or right of the median projection, and to both sides if it lies in the
middle tenth (``SPILL``), so close vectors are rarely parted.  Split points are
fitted on a bounded sample (``FIT_ROWS`` vectors, by a hash); every vector is
routed through every tree.  Within a leaf all cosines are computed in double
precision, in blocks, and pairs of ``threshold`` or more are linked; a leaf or
pivot of more than ``CHUNK`` vectors is compared chunk by chunk in tasks of its
own, so nothing is capped.  A pair that meets in several leaves counts in the
first, one of two home vectors at the first of their pivots.

Equal vectors form one class and are compared once.  Null and zero vectors and
those with null or non-finite components link with nothing; vectors of
different lengths don't either.  Rows with one id count as different vectors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.blocks import Scratch, materialize
from kestrel.llm.components import components, spanning

TREES = 10
LEAF = 1024
SPILL = 0.1
FIT_ROWS = 50_000
FIT_BYTES = 32 << 20
CHUNK = 4096
#: leaf codes: tree * _TREE + number of the node in the tree
_TREE = 1 << 24
#: codes of pivots are _PIVOT + number
_PIVOT = 1 << 40
#: sampled vectors tried as members of a large group, and the least members seen
PROBES, SEEN = 16_384, 16


@lru_cache(maxsize=4096)
def _direction(dim: int, tree: int, node: int) -> np.ndarray:
    return np.random.default_rng([dim, tree, node]).normal(size=dim)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(sample: np.ndarray, scale: float, threshold: float) -> np.ndarray:
    """Centres of groups of LEAF / 2 or more (estimated on the sample), largest first seen."""
    need = max(SEEN, LEAF / 2 / scale)
    x = sample.astype(np.float32)
    probes = np.arange(min(PROBES, len(x)))
    near = max(threshold, 0) ** 2  # of two vectors at the threshold from a centre, on average
    degree = np.concatenate([(x[probes[at: at + 256]] @ x.T >= near).sum(1) for at in range(0, len(probes), 256)]
                            or [np.zeros(0, np.int64)])
    free, out = np.ones(len(x), bool), []
    while len(degree) and degree.max() >= need:
        at = int(np.argmax(degree))
        own = x[probes[at]]
        best = centre = own
        most = int((x[free] @ own >= threshold).sum())
        for bound in (near, threshold, threshold, threshold):
            centre = x[free & (x @ centre >= bound)].mean(0, dtype=np.float64).astype(np.float32)
            centre /= max(np.linalg.norm(centre), 1e-12)
            n = int((x[free] @ centre >= threshold).sum())
            if n <= most:
                break
            best, most = centre, n
        degree[at] = 0
        if most < need:
            continue
        out.append(best.astype(np.float64) / np.linalg.norm(best.astype(np.float64)))
        home = np.flatnonzero(free & (x @ best >= threshold))
        free[home] = False
        live = np.flatnonzero(free[probes] & (degree >= need))
        left = np.zeros_like(degree)
        for lo in range(0, len(live), 256):
            part = live[lo: lo + 256]
            left[part] = degree[part] - (x[probes[part]] @ x[home].T >= near).sum(1)
        degree = left
    return np.stack(out) if out else np.zeros((0, sample.shape[1]))


def _reach(threshold: float) -> float:
    """Least cosine to a pivot of what links with a vector at home there."""
    return float(np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold, -1, 1))))) - 1e-9


def _homes(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's home (number of a pivot or -1), and the (row, pivot) of guests."""
    if not len(pivots):
        return np.full(len(x), -1), np.zeros(0, int), np.zeros(0, int)
    cos = x @ pivots.T
    at_home = cos >= threshold
    home = np.where(at_home.any(1), at_home.argmax(1), -1)
    guest = cos >= _reach(threshold)
    guest[np.flatnonzero(home >= 0), home[home >= 0]] = False
    return home, *np.nonzero(guest)


def _grow(sample: np.ndarray, tree: int, scale: float) -> dict[int, tuple[float, float]]:
    """Split points (low, high) by node number; children of n are 2n and 2n + 1."""
    splits, todo = {}, [(1, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * scale <= LEAF or len(rows) < 32 or node >= _TREE // 2:
            continue
        p = sample[rows] @ _direction(sample.shape[1], tree, node)
        low, high = np.quantile(p, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
        left, right = rows[p <= high], rows[p >= low]
        if len(left) > 0.9 * len(rows) or len(right) > 0.9 * len(rows):
            continue  # nearly one point: more splits would only copy it
        splits[node] = float(low), float(high)
        todo += [(2 * node, left), (2 * node + 1, right)]
    return splits


def _route(x: np.ndarray, tree: int, splits: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf code) of all leaves that the rows reach."""
    rows_out, codes = [], []
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in splits:
            rows_out.append(rows)
            codes.append(np.full(len(rows), tree * _TREE + node, np.int64))
            continue
        low, high = splits[node]
        p = x[rows] @ _direction(x.shape[1], tree, node)
        todo += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
    return np.concatenate(rows_out), np.concatenate(codes)


def _forest(classes: DataFrame, trees: int, threshold: float) -> dict[int, tuple[np.ndarray, list[dict]]]:
    """Pivots and trees for every vector length, from a bounded sample of each."""
    fitted = {}
    sizes = classes.groupBy("dim").count().collect()  # one row per vector length
    for row in sizes:
        dim, n = row["dim"], row["count"]
        take = max(32, min(FIT_ROWS, FIT_BYTES // (8 * dim)))
        sample = (classes.where(F.col("dim") == dim).orderBy(F.xxhash64("v")).limit(take).select("v").collect()
                  if n > LEAF else [])
        x = _unit([bytes(r["v"]) for r in sample]) if sample else np.zeros((0, dim))
        scale = n / max(1, len(x))
        pivots = _pivots(x, scale, threshold)
        x = x[_homes(x, pivots, threshold)[0] < 0]
        fitted[dim] = pivots, [_grow(x, t, scale) for t in range(trees)] if len(x) * scale > LEAF else [{}]
    return fitted


def _pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs with cosine >= threshold, of x by itself (i < j) or with y."""
    out = []
    other = x if y is None else y
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at: at + 512] @ other.T >= threshold)
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        out.append((i, j))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _elsewhere(i, j, leaves: list[np.ndarray], code: int) -> np.ndarray:
    """Whether the two of each pair also share a leaf with a smaller code."""
    if not len(i):
        return np.zeros(0, bool)
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    mine = [leaves[r][leaves[r] < code] for r in rows.tolist()]
    codes, column = np.unique(np.concatenate(mine), return_inverse=True) if sum(map(len, mine)) else (np.zeros(0), np.zeros(0, int))
    member = np.zeros((len(rows), len(codes)), bool)
    member[np.repeat(np.arange(len(rows)), [len(m) for m in mine]), column] = True
    a, b = back[: len(i)], back[len(i):]
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 65536):
        out[at: at + 65536] = (member[a[at: at + 65536]] & member[b[at: at + 65536]]).any(1)
    return out


def _compare(code: int, rows: list[tuple], threshold: float):
    """One task's vectors (node, v, copies, home, leaves, side): spanning edges and link counts.

    Sides 0 and 1 are compared with each other; side 2 with itself.
    """
    rows.sort(key=lambda r: r[5])
    left = sum(r[5] == 0 for r in rows)
    x = _unit([r[1] for r in rows])
    if rows[0][5] == 2:
        i, j = _pairs(x, None, threshold)
    elif 0 < left < len(rows):
        i, j = _pairs(x[:left], x[left:], threshold)
        j = j + left
    else:
        return [], [], []
    if code >= _PIVOT:  # two home vectors of different pivots are guests of each other's
        home = np.array([np.iinfo(np.int64).max if r[3] is None else r[3] for r in rows], np.int64)
        fresh = home[j] >= code
    else:
        fresh = ~_elsewhere(i, j, [np.array(r[4], np.int64) for r in rows], code)
    i, j = i[fresh], j[fresh]
    nodes = np.array([r[0] for r in rows], np.int64)
    copies = np.array([r[2] for r in rows], np.float64)
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    some = np.flatnonzero(links)
    edges = spanning(nodes[i], nodes[j])
    return ([e[0] for e in edges] + nodes[some].tolist(), [e[1] for e in edges] + [None] * len(some),
            [None] * len(edges) + links[some].astype(np.int64).tolist())


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "near-vectors")
    result = materialize(_near_vectors(vectors, threshold, trees, id_col, vector_col, scratch), "near-vectors")
    scratch.drop()
    return result


def _near_vectors(vectors, threshold, trees, id_col, vector_col, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    values = F.col(f"`{vector_col}`").cast("array<double>")
    source = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), values.alias("x"))

    def valid(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                v = None if v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                out.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = scratch.keep(source.mapInArrow(valid, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, v binary"), "vectors")
    classes = (rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
               .select(F.monotonically_increasing_id().alias("node"), "v", (F.length("v") / 8).cast("int").alias("dim"),
                       "copies", "least_id"))
    classes = scratch.keep(classes, "vector-classes")
    forest = spark.sparkContext.broadcast(_forest(classes, trees, threshold))  # bounded by the fitted sample

    def route(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            lists, homes, guests = [[] for _ in raw], [None] * len(raw), [[] for _ in raw]
            size = np.array([len(r) for r in raw])
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                x = _unit([raw[k] for k in at.tolist()])
                pivots, grown = forest.value[width // 8]
                home, row, pivot = _homes(x, pivots, threshold)
                for r, h in zip(at.tolist(), home.tolist()):
                    homes[r] = _PIVOT + h if h >= 0 else None
                for r, g in zip(at[row].tolist(), pivot.tolist()):
                    guests[r].append(_PIVOT + g)
                at, x = at[home < 0], x[home < 0]
                for t, splits in enumerate(grown if len(x) else []):
                    row, code = _route(x, t, splits)
                    for r, c in zip(at[row].tolist(), code.tolist()):
                        lists[r].append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(homes, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(guests, pa.list_(pa.int64()))],
                names=["node", "v", "copies", "home", "leaves", "guests"])

    routed = scratch.keep(classes.select("node", "v", "copies").mapInArrow(
        route, "node long, v binary, copies long, home long, leaves array<long>, guests array<long>"), "routed")
    # every leaf and pivot that a row reaches, and whether as a guest
    reached = F.explode(F.concat(
        F.transform(F.when(F.col("home").isNull(), F.col("leaves")).otherwise(F.array("home")),
                    lambda c: F.struct(c.alias("leaf"), F.lit(0).alias("guest"))),
        F.transform("guests", lambda c: F.struct(c.alias("leaf"), F.lit(1).alias("guest"))))).alias("r")
    placed = routed.withColumn("dim", F.length("v")).select("*", reached).select(
        "dim", "r.*", "node", "v", "copies", "home", "leaves")
    sized = (routed.select(F.length("v").alias("dim"), reached).groupBy("dim", "r.leaf")
             .agg(F.sum(1 - F.col("r.guest")).alias("own_rows"), F.sum("r.guest").alias("guest_rows")))
    chunks = [F.ceil(F.col(c) / CHUNK).cast("int").alias(c.replace("rows", "chunks")) for c in ("own_rows", "guest_rows")]
    sized = sized.where("own_rows > 0 AND own_rows + guest_rows > 1").select("dim", "leaf", *chunks)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest") == 1, F.col("guest_chunks")).otherwise(F.col("own_chunks"))).cast("int")
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    # own chunks meet each other and every guest chunk (numbered after them); guests don't meet
    places = F.when(F.col("guest") == 1, F.transform(
        F.sequence(F.lit(0), F.col("own_chunks") - 1), lambda c: pair(c, F.col("own_chunks") + F.col("own"), 1))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("own_chunks") + F.col("guest_chunks") - 1), lambda c: F.when(
            c > F.col("own"), pair(F.col("own"), c, 0)).when(c == F.col("own"), pair(c, c, 2)).otherwise(pair(c, F.col("own"), 1))))
    tasks = (placed.join(sized, ["dim", "leaf"]).withColumn("own", own).withColumn("at", F.explode(places))
             .select(F.concat_ws("-", "dim", "leaf", "at.i", "at.j").alias("task"), "leaf", "node", "v", "copies", "home", "leaves",
                     "at.side"))

    def compare(batches):
        name, code, held = None, 0, []
        for batch in batches:
            found = [[], [], []]
            for t, leaf, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != name:
                    if len(held) > 1:
                        for a, b in zip(found, _compare(code, held, threshold)):
                            a.extend(b)
                    name, code, held = t, leaf, []
                held.append(tuple(row))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b", "links"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _compare(code, held, threshold)],
                                             names=["a", "b", "links"])

    found = scratch.keep(tasks.repartition("task").sortWithinPartitions("task")
                        .mapInArrow(compare, "a long, b long, links long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    labels = (classes.select("node", "v", "copies", "least_id").join(links, "node", "left").join(linked, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    ids = labels.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = labels.join(ids, "root").select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "component_id")
    out = rows.join(labels, "v", "left")
    own_id = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"),
                      F.col("vec_id").eqNullSafe(own_id).alias("kept"))
