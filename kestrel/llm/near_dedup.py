"""Near-duplicate documents: an LSH forest over MinHash signatures.

A document's set is its distinct word 4-shingles.  Documents with one set
form a class; everything below works on classes, so copies are never paired.

Forest: each of ``TREES`` trees puts the classes in order by its own sequence of
minima.  Classes with a longest common prefix of ``PREFIX`` minima or more
form a region, and neighbours in the order are compared by byte sketches, the
nearest first, farther ones as long as they share the region's prefix and
aren't joined yet: a pair is a candidate if the sketches agree in
``SKETCH_SHARE`` of all minima, far below what a link can show.  Depth adapts to
each region: one of more than ``REGION`` classes is parted by the next minimum,
and its parts again, up to ``PREFIX + DEEPER`` minima, until they fit in a
task; a part that never does is dealt over chunks by hash.  Then, so that depth
costs no pair, the classes outside a parted region's most common candidate
component so far are compared with all of the region, ``CROSS`` by ``CROSS``.
So nothing is capped, a large group of near copies costs one pass, and a large
region of unlike classes costs a square of sketch comparisons.

Verification: candidates only have to land linked classes in one *candidate
component*; inside it everything is compared on full sets.  Components of up to
``GROUP`` classes are compared in one task.  A larger one is cut into chunks of
that size, each compared within itself and with a few central classes; the
classes then left outside its largest verified component are compared with
all of its chunks.  So no link between different texts of a candidate
component is lost, and a large group of copies costs one pass, not a square.

Null, empty and blank texts have no set and link with nothing.  Fewer words
than a shingle make one shingle of all of them.  Rows with one id are judged
by their texts; a component's id is the smallest id in it that isn't null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.blocks import Scratch, materialize
from kestrel.llm.components import Forest, components, spanning
from kestrel.llm.hashing import LOWER, gram_hashes, groups, mix, text_bytes, word_bounds, word_hashes

U64 = np.uint64
TREES, DEPTH, PREFIX, DEEPER = 20, 4, 3, 5
REGION, CROSS = 512, 4096
SKETCH_SHARE = 0.55
GROUP = 64
HUBS = 4
_MULTIPLIERS = np.random.default_rng(71).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray, shingle: int):
    """Distinct shingle hashes of documents, sorted within each, and their counts."""
    data = LOWER[data]
    starts, stops = word_bounds(data, ends)
    words = word_hashes(data, starts, stops)
    last = np.searchsorted(starts, ends)
    counts = np.diff(np.concatenate([[0], last]))
    n = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(last - counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(doc), np.uint64)
    whole = np.repeat(counts >= shingle, n)
    out[whole] = gram_hashes(words, shingle, first[whole], salt=5)
    for size in range(1, shingle):
        part = np.repeat(counts == size, n)
        if part.any():
            out[part] = gram_hashes(words, size, first[part], salt=5 + size)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.bincount(doc[keep], minlength=len(counts)).astype(np.int64)


def _signatures(sets: np.ndarray, counts: np.ndarray):
    """Per document: a 128-bit key of its set and its minima (big-endian)."""
    full = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    keys, minima = [None] * len(counts), [None] * len(counts)
    if len(full):
        a = np.add.reduceat(mix(sets ^ U64(0x1234567)), first)
        b = np.add.reduceat(mix(sets ^ U64(0xABCDEF01)), first) ^ counts[full].astype(np.uint64)
        least = np.empty((len(full), TREES * DEPTH), ">u4")
        for j, m in enumerate(_MULTIPLIERS):
            least[:, j] = np.minimum.reduceat(sets * m, first) >> U64(32)
        both = np.stack([a, b], 1)
        for i, k in enumerate(full.tolist()):
            keys[k], minima[k] = both[i].tobytes(), least[i].tobytes()
    return keys, minima


def _sets_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, scratch: Scratch) -> DataFrame:
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_row_key(id_col, text_col),
                         F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            data, ends = text_bytes(batch.column(3))
            for i, j in groups(ends, 1 << 20):
                lo = int(ends[i - 1]) if i else 0
                sets, counts = shingle_sets(data[lo: int(ends[j - 1])], ends[i:j] - lo, shingle)
                keys, minima = _signatures(sets, counts)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts), pa.array(keys, pa.binary()),
                     pa.array(minima, pa.binary())], names=["doc_id", "k", "h", "n_shingles", "cls", "minima"])

    return scratch.keep(source.mapInArrow(
        run, "doc_id long, k string, h long, n_shingles long, cls binary, minima binary"), "sets")


def _row_key(id_col: str, text_col: str):
    """What finds a row's text again."""
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")).alias("k"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")


def _sketch(minima: bytes) -> np.ndarray:
    return np.frombuffer(minima, np.uint8)[3::4]


def _region_keys(minima: np.ndarray, tree: int) -> np.ndarray:
    """A hash of a tree's first minima."""
    part = np.ascontiguousarray(minima[:, tree * DEPTH * 4:(tree * DEPTH + PREFIX) * 4]).view(">u4").astype(np.uint64)
    key = np.full(len(minima), tree + 1, np.uint64)
    for j in range(PREFIX):
        key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, j])
    return key.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _region_names(batches):
    for batch in batches:
        if batch.num_rows:
            minima = _matrix(batch.column(0))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(_region_keys(minima, t))], names=["region"])


def _tree_rows(batches):
    """Every class in every tree: its region, and the minima by which the region is in order."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        minima = _matrix(batch.column(1))
        sketches = pa.array([r.tobytes() for r in np.ascontiguousarray(minima[:, 3::4])], pa.binary())
        for t in range(TREES):
            places = (t * DEPTH + PREFIX + np.arange(DEEPER)) % (TREES * DEPTH)  # on into the next trees' minima
            order = np.ascontiguousarray(minima.reshape(len(minima), -1, 4)[:, places])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_region_keys(minima, t)), pa.array([r.tobytes() for r in order], pa.binary()), batch.column(0), sketches],
                names=["region", "order", "node", "sketch"])


def _region_edges(batches):
    """Over rows (part, chunk, node, sketch) gathered by part and chunk and in the tree's
    order: edges between neighbours of each, from the nearest to the farthest."""
    forest = Forest()

    def edges(key, node, sketch):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        group = np.cumsum(new)
        root = np.array([forest.root(x) for x in node.tolist()], np.int64)
        at, step, out = np.arange(len(node)), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(node)]
            at = at[group[at + step] == group[at]]
            apart = at[root[at] != root[at + step]]
            alike = apart[(sketch[apart] == sketch[apart + step]).mean(1) >= SKETCH_SHARE] if len(apart) else apart
            if len(alike):
                out += [(a, b) for a, b in zip(node[alike].tolist(), node[alike + step].tolist()) if forest.join(a, b)]
                root = np.array([forest.root(x) for x in root.tolist()], np.int64)
        if len(forest.up) > 2_000_000:
            forest.up.clear()
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])] if out else []

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = (np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), batch.column(2).to_numpy(),
               _matrix(batch.column(3)))
        if held is not None:  # the group that the batch before ended in
            now = tuple(np.concatenate([a, b]) for a, b in zip(held, now))
        key = now[0]
        last = np.flatnonzero((key != key[-1]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = tuple(c[cut:] for c in now)
        yield from edges(*(c[:cut] for c in now))
    if held is not None:
        yield from edges(*held)


def _cross_edges(batches):
    """Over rows (task, node, root, sketch, side) gathered by task: edges from side 0 to side 1
    between different roots."""
    def edges(rows):
        sides = [[r for r in rows if r[3] == s] for s in (0, 1)]
        if not all(sides):
            return []
        (n, r, s), (m, q, z) = ((np.array([x[0] for x in part]), np.array([x[1] for x in part]),
                                 np.frombuffer(b"".join(x[2] for x in part), np.uint8).reshape(len(part), -1)) for part in sides)
        found = []
        for at in range(0, len(n), 64):
            alike = (s[at: at + 64, None] == z[None]).mean(2) >= SKETCH_SHARE
            i, j = np.nonzero(alike & (r[at: at + 64, None] != q[None]))
            found += spanning(n[i + at], m[j])
        return found

    name, rows = None, []
    for batch in batches:
        found = []
        for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if t != name:
                found += edges(rows)
                name, rows = t, []
            rows.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
    if found := edges(rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): candidate components of classes (node, minima)."""
    names = classes.select("minima").mapInArrow(_region_names, "region long")
    large = scratch.keep(names.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > REGION), "large-regions")
    rows = classes.select("node", "minima").mapInArrow(_tree_rows, "region long, order binary, node long, sketch binary")
    some = not large.isEmpty()
    dealt = rows.join(large, "region", "left_anti") if some else rows
    dealt = dealt.select(F.col("region").alias("part"), F.lit(0).cast("long").alias("chunk"), "order", "node", "sketch")
    if some:
        crowd = scratch.keep(rows.join(large, "region"), "large-region-rows")
        dealt = dealt.unionByName(_parted(crowd, scratch))
    dealt = dealt.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "order").drop("order")
    edges = scratch.keep(dealt.mapInArrow(_region_edges, "a long, b long"), "candidates")
    near = components(edges, scratch)
    if not some:
        return near
    inside = (crowd.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .select("region", "size", "node", "root", "sketch"))
    inside = scratch.keep(inside, "large-region-roots")
    most = (inside.groupBy("region", "root").count().groupBy("region")
            .agg(F.max(F.struct("count", "root")).getField("root").alias("main"), F.sum("count").alias("all"),
                 F.max("count").alias("inner")).where(F.col("all") > F.col("inner"))
            .select("region", "main", F.ceil((F.col("all") - F.col("inner")) / CROSS).alias("n"),
                    F.ceil(F.col("all") / CROSS).alias("m")))
    most = scratch.keep(most, "region-rest")
    if most.isEmpty():
        return near
    inside = inside.join(most, "region")
    name = F.concat_ws("-", "region", "i", "j").alias("task")
    left = (inside.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(name, "node", "root", "sketch", F.lit(0).alias("side")))
    right = (inside.withColumn("j", F.pmod(F.xxhash64("node"), F.col("m")))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(name, "node", "root", "sketch", F.lit(1).alias("side")))
    cross = left.unionByName(right).repartition("task").sortWithinPartitions("task").mapInArrow(_cross_edges, "a long, b long")
    return components(edges.unionByName(scratch.keep(cross, "cross-candidates")), scratch)


def _parted(crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of large regions by part: the shortest prefix that at most ``REGION`` classes
    share, or the longest one, dealt over chunks, where more do."""
    levels = range(1, DEEPER + 1)
    keys = [F.xxhash64("region", F.substring("order", 1, 4 * d)) for d in levels]
    sizes = (crowd.select(F.posexplode(F.array(*keys)).alias("level", "key")).groupBy("level", "key")
             .agg(F.count("*").alias("n")).where(F.col("n") > REGION))
    sizes = scratch.keep(sizes, "large-parts")
    rows = crowd.select("region", "order", "node", "sketch", *[k.alias(f"k{d}") for d, k in zip(levels, keys)])
    part = F.col(f"k{DEEPER}")
    for d in reversed(levels):
        rows = rows.join(sizes.where(F.col("level") == d - 1).select(F.col("key").alias(f"k{d}"), F.col("n").alias(f"n{d}")), f"k{d}", "left")
        part = F.when(F.col(f"n{d}").isNull(), F.col(f"k{d}")).otherwise(part)
    chunk = F.pmod(F.xxhash64("node", "region"), F.ceil(F.col(f"n{DEEPER}") / REGION))
    return rows.select(part.alias("part"), F.coalesce(chunk, F.lit(0)).cast("long").alias("chunk"), "order", "node", "sketch")


def _linked(nodes, sides, texts, shingle: int, percent: int):
    """Links (as a spanning forest) among the texts of one task, on full sets.

    Side 0: compared with every other text; side 1: with those of side 0 only.
    """
    raw = [t.encode() for t in texts]
    sets, counts = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), shingle)
    sides = np.array(sides)
    left = np.flatnonzero(sides == 0)
    doc = np.repeat(np.arange(len(raw)), counts)
    values, column, seen = np.unique(sets, return_inverse=True, return_counts=True)
    rank = np.cumsum(seen > 1) - 1  # a shingle of one text adds to no intersection
    use = seen[column] > 1
    column, doc = rank[column[use]], doc[use]
    width = int(rank[-1]) + 1 if len(rank) else 0
    both = np.zeros((len(left), len(raw)), np.float32)
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for lo in range(0, width, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        m = np.zeros((len(raw), min(2048, width - lo)), np.float32)
        m[doc[a:b], column[a:b] - lo] = 1
        both += m[left] @ m.T
    both = both.astype(np.int64)
    x, y = np.nonzero(100 * both >= percent * (counts[left][:, None] + counts[None, :] - both))
    x = left[x]
    apart = x != y
    nodes = np.array(nodes)
    return spanning(nodes[x[apart]], nodes[y[apart]])


def _verify(tasks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges among each task's texts: rows (task, node, side, text) are gathered by
    task and gone through one task after the other."""
    def run(batches):
        name, rows = None, {}
        for batch in batches:
            found = []
            for t, n, s, x in zip(*(c.to_pylist() for c in batch.columns)):
                if t != name:
                    found += _linked_rows(rows)
                    name, rows = t, {}
                rows[n] = min(s, rows[n][0]) if n in rows else s, x
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
        if found := _linked_rows(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    def _linked_rows(rows):
        if len(rows) < 2:
            return []
        return _linked(list(rows), [v[0] for v in rows.values()], [v[1] for v in rows.values()], shingle, percent)

    ordered = tasks.select("task", "node", "side", "text").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "a long, b long")


def _hubs(large: DataFrame, scratch: Scratch) -> DataFrame:
    """A few central classes of each large component: those whose sketches agree
    most with the most common values of some of its classes."""
    some = (large.withColumn("_n", F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("node"))))
            .where("_n <= 256"))

    def common(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.frombuffer(s, np.uint8) for s in pdf["sketch"]])
        typical = bytes(int(np.bincount(m[:, j]).argmax()) for j in range(m.shape[1]))
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "typical": [typical]})

    typical = scratch.keep(some.groupBy("comp").applyInPandas(common, "comp long, typical binary"), "typical")

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b)])

    close = large.join(typical, "comp").select("comp", "node", agree("sketch", "typical").alias("s"))
    best = Window.partitionBy("comp").orderBy(F.desc("s"), "node")
    return close.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= HUBS).select("comp", F.col("node"))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, root (its component's number): one row per document row."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    result = materialize(_near_duplicates(docs, shingle, percent, id_col, text_col, scratch), "near-duplicates")
    scratch.drop()
    return result


def _near_duplicates(docs, shingle, percent, id_col, text_col, scratch: Scratch) -> DataFrame:
    sets = _sets_table(docs, id_col, text_col, shingle, scratch)
    classes = (sets.where("n_shingles > 0").groupBy("cls")
               .agg(F.first("minima").alias("minima"), F.min(F.struct("k", "h")).alias("row"), F.min("doc_id").alias("least_id")))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), "cls", "minima",
                                         "row.k", "row.h", "least_id"), "classes")

    near = _candidates(classes, scratch)
    near = near.select("node", F.col("root").alias("comp"))
    # sizes, like the other small tables below, are written first: a join then knows how small they are
    # and needs no exchange by component, where one large component would fill one task
    sized = near.join(scratch.keep(near.groupBy("comp").agg(F.count("*").alias("size")), "sizes"), "comp")
    texts = docs.select(*_row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    found = (sized.join(classes.select("node", "k", "h", "minima"), "node").join(texts, ["k", "h"])
             .select("comp", "size", "node", "minima", "text").dropDuplicates(["node"]))
    found = scratch.keep(found, "candidate-texts")

    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP))
    name = lambda *parts: F.concat_ws("-", *parts)
    plain = found.select(name("comp", F.when(F.col("size") <= GROUP, 0).otherwise(chunk)).alias("task"), "node",
                         F.lit(0).alias("side"), "text")
    large = found.where(F.col("size") > GROUP)
    if large.isEmpty():
        edges = scratch.keep(_verify(plain, shingle, percent), "links")
    else:
        sketch = F.udf(lambda m: _sketch(m).tobytes(), "binary")
        hubs = scratch.keep(_hubs(large.select("comp", "node", sketch("minima").alias("sketch")), scratch), "hubs")
        spread = (large.join(hubs.select("node"), "node", "left_semi")
                  .select("node", "text", "comp", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / GROUP) - 1)).alias("c"))
                  .select(name("comp", "c").alias("task"), "node", F.lit(0).alias("side"), "text"))
        edges = scratch.keep(_verify(plain.unionByName(spread), shingle, percent), "links")
        # what is outside the largest verified component of its candidate component, against everyone in it
        part = components(edges, scratch)
        inside = (large.select("comp", "size", "node", "text").join(part, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")))
        most = (inside.groupBy("comp", "root").count().groupBy("comp")
                .agg(F.max(F.struct("count", "root")).getField("root").alias("main")))
        most = scratch.keep(most, "main-parts")
        rest = inside.join(most, "comp").where("root <> main")
        n = F.ceil(F.col("rest_size") / GROUP)
        counts = scratch.keep(rest.groupBy("comp").agg(F.count("*").alias("rest_size")), "rest-sizes")
        rest = rest.join(counts, "comp").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), n))
        every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / GROUP) - 1)).alias("j")
        left = (rest.select("comp", "i", "node", "text", every)
                .select(name("comp", "i", "j").alias("task"), "node", F.lit(0).alias("side"), "text"))
        right = (large.join(counts, "comp").select("comp", chunk.alias("j"), "node", "text",
                                                   F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
                 .select(name("comp", "i", "j").alias("task"), "node", F.lit(1).alias("side"), "text"))
        edges = edges.unionByName(scratch.keep(_verify(left.unionByName(right), shingle, percent), "links"))

    linked = components(edges, scratch)
    labels = classes.select("node", "cls", "least_id").join(linked, "node", "left")
    labels = labels.select("cls", F.coalesce("root", "node").alias("root"), "least_id")
    ids = labels.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = labels.select("cls", "root").join(ids, "root").select("cls", "root", "component_id")
    out = sets.select("doc_id", "h", "n_shingles", "cls").join(labels, "cls", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("h").alias("text_key"), "n_shingles", own.alias("component_id"),
                      F.col("doc_id").eqNullSafe(own).alias("kept"), "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", single: bool = False, **options) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns.

    Rows of a component that share that id, or all have none, all stay; with
    ``single`` one of them does: that of the smallest text hash, then of the
    smallest row hash.  Documents without a word have no component and stay.
    """
    rows = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "root", "kept")
    columns = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # names of the input can't clash with those below
    doc_id, text = docs[f"c{columns.index(id_col)}"], docs[f"c{columns.index(text_col)}"]
    same = doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key"))
    gone = rows.where("NOT kept").select("_id", "_key")
    if not single:
        return docs.join(gone.distinct(), same, "left_anti").toDF(*columns)
    # a kept row's id is that of its component, so a component's kept rows are one group
    kept = rows.where("kept AND root IS NOT NULL")
    best = kept.groupBy("root").agg(F.min("_key").alias("_best"))
    gone = gone.unionByName(kept.join(best, "root").where("_key <> _best").select("_id", "_key"))
    left = docs.join(gone.distinct(), same, "left_anti")
    repeated = kept.groupBy("_id", "_key").count().where("count > 1").select("_id", "_key")
    if repeated.isEmpty():
        return left.toDF(*columns)
    first = Window.partitionBy(doc_id, text).orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    once = left.join(repeated, same, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return left.join(repeated, same, "left_anti").unionByName(once).toDF(*columns)
