"""Documents packed into blocks, and exchanges between blocks and key buckets.

Finding repeats over a corpus needs a shuffle of hashes.  One row per hash
costs far more than the hash itself, so documents are first packed into
blocks of about 2 MB of text (a map-only job, written once).  A block sends
one row per key bucket with its own distinct keys as a packed array; a bucket
sees every key once per block at most, however many documents hold it, and
answers each block with one row.  Spark shuffles both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.hashing import groups, text_bytes
from kestrel.session import scratch_path

BLOCK_BYTES = 2 << 20
#: Text bytes whose keys share a bucket; buckets grow in number, not in size.
BUCKET_TEXT_BYTES = 64 << 20
#: A document without an id sorts after all others.
NO_ID = np.iinfo(np.int64).max

SCHEMA = "block long, text_bytes long, ids binary, ends binary, texts binary, rest binary"
KEYS_SCHEMA = "bucket int, block long, payload binary"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables of one operator call in a folder of their own, dropped together
    once its result is written."""

    def __init__(self, spark, name: str):
        self.spark, self.root, self.number = spark, scratch_path(spark, f"llm-{name}"), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}-{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def un_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
         level: int = 3) -> DataFrame:
    """Blocks of whole documents with all their columns, written once.

    A null text is packed as empty; a null id as :data:`NO_ID`; the original
    columns, apart from the text, travel unchanged.  ``level``: of compression.
    """
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"),
                         F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for i, j in groups(ends, block_bytes):
                lo, hi = (int(ends[i - 1]) if i else 0), int(ends[j - 1])
                others = pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i)], ["r"])
                out.append(((task << 32) | number, hi - lo, ids[i:j].tobytes(), (ends[i:j] - lo).tobytes(),
                            squeeze.compress(data[lo:hi].tobytes()), squeeze.compress(ipc(others))))
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int64()] + [pa.binary()] * 4)],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return materialize(source.mapInArrow(run, SCHEMA), "blocks")


class Block:
    """One unpacked block: ``ids``, ``data`` (bytes of all texts), ``ends``."""

    def __init__(self, table):
        self.block = table.column("block")[0].as_py()
        self.ids = np.frombuffer(table.column("ids")[0].as_py(), np.int64)
        self.ends = np.frombuffer(table.column("ends")[0].as_py(), np.int64)
        raw = zstandard.ZstdDecompressor().decompress(table.column("texts")[0].as_py())
        self.data = np.frombuffer(raw, np.uint8)
        self._rest = table.column("rest")[0] if "rest" in table.schema.names else None

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def rows(self) -> list[dict]:
        """The original columns other than the text, row by row."""
        return un_ipc(zstandard.ZstdDecompressor().decompress(self._rest.as_py())).column("r").to_pylist()

    def rest(self) -> pa.StructArray:
        return un_ipc(zstandard.ZstdDecompressor().decompress(self._rest.as_py())).column("r").combine_chunks()


def n_buckets(blocks: DataFrame) -> int:
    size = blocks.agg(F.sum("text_bytes")).first()[0] or 0
    return int(max(48, -(-size // BUCKET_TEXT_BYTES)))


def by_bucket(block: int, bucket: np.ndarray, records: np.ndarray, kind: int | None = None) -> pa.RecordBatch:
    """Rows for a block: for every bucket the packed ``records`` that fall in it."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    stop = np.append(cut[1:], len(bucket))
    cols = [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), block, np.int64)),
            pa.array([records[a:b].tobytes() for a, b in zip(cut, stop)], pa.binary())]
    names = ["bucket", "block", "payload"]
    if kind is not None:
        cols.append(pa.array(np.full(len(cut), kind, np.int32)))
        names.append("kind")
    return pa.RecordBatch.from_arrays(cols, names)


def pieces(bucket: np.ndarray, rows: int):
    """Slices of sorted ``bucket`` numbers of about ``rows`` values that don't cut a bucket."""
    at = 0
    while at < len(bucket):
        stop = at + rows
        stop = int(np.searchsorted(bucket, bucket[stop], "left")) if stop < len(bucket) else len(bucket)
        if stop <= at:
            stop = int(np.searchsorted(bucket, bucket[at], "right"))
        yield slice(at, stop)
        at = stop


def scan(blocks: DataFrame, fn, schema: str, columns: list[str] = ("block", "ids", "ends", "texts")) -> DataFrame:
    """``fn(Block) -> iterable of RecordBatch`` over every block, map-only."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from fn(Block(batch.slice(k, 1)))
    return blocks.select(*columns).mapInArrow(run, schema)


def gather(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(table) -> table`` once per bucket with the rows of all blocks."""
    return rows.groupBy("bucket").applyInArrow(fn, schema)


def answer(blocks: DataFrame, replies: DataFrame, fn, schema: str,
           columns: list[str] = ("block", "ids", "ends", "texts", "rest")) -> DataFrame:
    """``fn(Block, replies table) -> table`` per block; the replies may be none."""
    empty = pa.schema(_arrow_fields(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return empty.empty_table()
        return fn(Block(left), right)
    return blocks.select(*columns).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _arrow_fields(schema):
    from pyspark.sql.pandas.types import to_arrow_type
    if isinstance(schema, str):
        schema = _parse(schema)
    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]


def _parse(ddl: str):
    simple = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(),
              "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(p.split()[0], simple[p.split()[1]]) for p in ddl.split(", ")])


def unique_by(key: np.ndarray, value: np.ndarray):
    """Sorted distinct keys and the smallest value of each."""
    if not len(key):
        return key, value
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return key[first], value[first]


def contains(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership of each wanted value in a sorted array of hashes.  For many
    values a table over their low bits sorts out most before the exact search."""
    if not len(sorted_keys) or not len(wanted):
        return np.zeros(len(wanted), bool)
    if len(wanted) > 50_000 and wanted.dtype.itemsize == 8 and len(sorted_keys) < 1 << 20:
        low = np.uint64((1 << 22) - 1)
        table = np.zeros(1 << 22, bool)
        table[sorted_keys & low] = True
        out = table[wanted & low]
        out[out] = _search(sorted_keys, wanted[out])
        return out
    return _search(sorted_keys, wanted)


def _search(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return sorted_keys[at] == wanted
