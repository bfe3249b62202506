"""CSV records with line breaks inside quotes, read from splits.

A file is cut into splits at line ends, and a split can't see whether it starts
inside a quoted cell.  So there are two scans.  The first reduces each split to
one row: for both states it may start in ("outside" or "inside" a quoted cell),
the state at its end and the number of records that end in it; a content digest of its lines; and
whether they are UTF-8.  A running combination of these rows over the splits of
a file gives each split its true state and the number of records before it.  The
second scan cuts the records; a record that crosses a split's border is handed
on in fragments, which are joined by record number.

A quote counts where a cell starts with it, "" inside quotes is one quote, and a
quote within an unquoted cell is text, as in Python's ``csv``.  Lines end with LF or CR
LF; blank lines outside quotes are no records.  Line breaks inside cells stay
as they are.

The digest of a file is that of its lines and size: the SHA-256 values of
the lines are the coefficients of a polynomial at a fixed place, modulo a prime of 256
bits.  Splits' values combine in file order, so the digest doesn't depend on how
a file is split, and swapped lines change it.
"""

from __future__ import annotations

import csv
import hashlib
import sys
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import materialize

#: Splits whose states (about 100 bytes each) are broadcast; beyond, lines are joined by shuffle.
BROADCAST_SPLITS = 50_000
#: Bytes of whole splits that one quoted cell may cover; more means that its quote is never closed.
MAX_CELL_BYTES = 256 << 20
PRIME = 2**256 - 189
PLACE = int.from_bytes(hashlib.sha256(b"place of the line polynomial").digest(), "big")

_SPLITS = ("file_path string, start long, size long, n_lines long, out_end boolean, in_end boolean, out_records long, "
           "in_records long, utf8 boolean, digest binary, head binary")


class UnclosedQuote(ValueError):
    """A quoted cell covers whole splits beyond MAX_CELL_BYTES."""


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, given the state it starts in."""
    at = 0
    if not inside:
        if line[:1] == b'"':
            at = 1
        else:
            at = line.find(b',"') + 2
            if at < 2:
                return False
    while True:
        at = line.find(b'"', at)  # the closing quote, unless doubled
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at += 2
            continue
        at = line.find(b',"', at + 1) + 2
        if at < 2:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _stretches(batch: pa.RecordBatch):
    """(file, start, first row, end) of each stretch of rows of one split."""
    n = batch.num_rows
    if not n:
        return
    start = batch.column(1).to_numpy()
    file = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
    cut = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
    for i, j in pairwise([0, *cut.tolist(), n]):
        yield batch.column(0)[i].as_py(), int(start[i]), i, j


def _quoted(values: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(values, b'"').to_numpy(zero_copy_only=False)).tolist()


def _blank(values: pa.Array) -> np.ndarray:
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
    blank = sizes == 0
    for k in np.flatnonzero(sizes == 1).tolist():
        blank[k] = values[k].as_py() == b"\r"
    return blank


class _Split:
    """What the first scan knows of a split so far."""

    def __init__(self, file: str, start: int, size: int, digest: bool = True):
        self.key, self.hashed = (file, start, size), digest
        self.end, self.records = [False, True], [0, 0]
        self.n, self.utf8, self.digest = 0, True, 0
        self.head, self.head_open = [], start == 0  # lines of the file's first record

    def add(self, values: pa.Array) -> None:
        filled = np.concatenate([[0], np.cumsum(~_blank(values))])
        quoted = _quoted(values)
        lines = {k: values[k].as_py() for k in quoted}
        for s in (0, 1):
            at, inside, n = 0, self.end[s], self.records[s]
            for k in quoted:
                if not inside:
                    n += int(filled[k] - filled[at])
                inside = ends_inside(lines[k], inside)
                n += not inside
                at = k + 1
            if not inside:
                n += int(filled[-1] - filled[at])
            self.end[s], self.records[s] = inside, n
        self.n += len(values)
        for line in values if self.head_open else ():
            line = line.as_py()
            if not self.head and line in (b"", b"\r"):
                continue
            inside = ends_inside(line, bool(self.head))
            self.head.append(line)
            if not inside:
                self.head_open = False
                break
        if self.utf8:
            try:
                values.cast(pa.string())
            except pa.ArrowInvalid:
                self.utf8 = False
        if not self.hashed:
            return
        digest, sha = self.digest, hashlib.sha256
        for line in values.to_pylist():
            digest = (digest * PLACE + int.from_bytes(sha(line).digest(), "big")) % PRIME
        self.digest = digest

    def row(self) -> tuple:
        return (*self.key, self.n, *self.end, *self.records, self.utf8, self.digest.to_bytes(32, "big") if self.hashed else None,
                b"\n".join(self.head) if self.head and not self.head_open else None)


def splits(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """One row per split of the files under ``path``, written: its place, what it
    does from either state, and with that ``inside`` (the state it starts in) and
    ``before`` (the records that end before it).  Without ``digest`` lines aren't
    hashed, and :func:`digests` can't be had from the rows."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(),
             pa.binary()]
    names = [c.split()[0] for c in _SPLITS.split(", ")]

    def run(batches):
        split, done = None, []
        for batch in batches:
            for file, start, i, j in _stretches(batch):
                if split is None or split.key[:2] != (file, start):
                    if split is not None:
                        done.append(split.row())
                    split = _Split(file, start, batch.column(2)[i].as_py(), digest)
                split.add(batch.column(3).slice(i, j - i))
        if split is not None:
            done.append(split.row())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)

    return materialize(_states(materialize(_lines(spark, path).mapInArrow(run, _SPLITS), "csv-splits")), "csv-states")


def _states(table: DataFrame) -> DataFrame:
    """Running combination: a split sets the state (both ends equal), keeps it or
    turns it, so the state before a split is what the last split that set it left,
    turned as often as splits since then turned it."""
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("out_end") == F.col("in_end")
    turns = F.when(~sets & F.col("out_end"), 1).otherwise(0)
    out = table.withColumn("_turned", F.sum(turns).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(sets, F.struct(F.col("out_end").alias("end"), F.col("_turned").alias("turned"))), ignorenulls=True).over(before)
    out = out.withColumn("_last", last).withColumn("_before", F.coalesce(F.last("_turned").over(before), F.lit(0)))
    odd = (F.col("_before") - F.coalesce(F.col("_last.turned"), F.lit(0))) % 2 == 1
    out = out.withColumn("inside", F.coalesce(F.col("_last.end"), F.lit(False)) != odd)
    records = F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records"))
    return (out.withColumn("n_records", records).withColumn("before", F.coalesce(F.sum("n_records").over(before), F.lit(0)))
            .drop("_turned", "_last", "_before"))


def file_counts(table: DataFrame) -> DataFrame:
    """(file_path, n_records) from the rows of :func:`splits`; a record that the file's end cuts off counts."""
    end = F.when(F.col("inside"), F.col("in_end")).otherwise(F.col("out_end"))
    return table.groupBy("file_path").agg((F.sum("n_records") + F.max_by(end, "start").cast("long")).alias("n_records"))


def digests(table: DataFrame) -> DataFrame:
    """(file_path, file_size, n_lines, utf8, file_hash) from the rows of :func:`splits`."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        value = 0
        pdf = pdf.sort_values("start")
        for n, digest in zip(pdf["n_lines"], pdf["digest"]):
            value = (value * pow(PLACE, int(n), PRIME) + int.from_bytes(digest, "big")) % PRIME
        size, lines = int(pdf["size"].iloc[0]), int(pdf["n_lines"].sum())
        text = f"{size}|{lines}|{value:064x}"
        return pd.DataFrame([[pdf["file_path"].iloc[0], size, lines, bool(pdf["utf8"].all()), hashlib.sha256(text.encode()).hexdigest()]],
                            columns=["file_path", "file_size", "n_lines", "utf8", "file_hash"])
    return table.groupBy("file_path").applyInPandas(
        fold, "file_path string, file_size long, n_lines long, utf8 boolean, file_hash string")


def _parse(texts: list[str], file: str, first: int) -> list[list[str]]:
    """The cells of records, by Python's csv."""
    csv.field_size_limit(sys.maxsize)
    try:
        rows = list(csv.reader(texts))
    except csv.Error as e:
        raise ValueError(f"{file}, from record {first} on: {e}") from None
    if len(rows) != len(texts):
        raise ValueError(f"{file}, from record {first} on: {len(texts)} records give {len(rows)} rows")
    return rows


_RECORDS = "file_path string, record_no long, cells array<string>, start long, fragment binary"


def _crossing(table: DataFrame) -> bool:
    """Whether any record crosses a split's border (a split starts or ends inside a quoted cell)."""
    return bool(table.where("CASE WHEN inside THEN true ELSE out_end END").limit(1).count())


def records(spark: SparkSession, path: str, encoding: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """(file_path, record_no, cells): the records of the CSV files under ``path``,
    numbered from 1 in each file, the header included.  ``encoding``: of all files;
    None: UTF-8 for a file that is valid UTF-8, else Latin-1.  ``table``: of
    :func:`splits`, if at hand.  They are written first only where a record crosses
    a split's border."""
    table = splits(spark, path, digest=False) if table is None else table
    own = Window.partitionBy("file_path")
    length = F.coalesce(F.lead("start").over(own.orderBy("start")), F.col("size")) - F.col("start")
    covered = (table.withColumn("_length", length).where("inside AND in_end AND n_records = 0")
               .groupBy("file_path").agg(F.sum("_length").alias("n")).where(F.col("n") > MAX_CELL_BYTES))
    for r in covered.limit(1).collect():
        raise UnclosedQuote(f"{r['file_path']}: a quoted cell covers more than {MAX_CELL_BYTES} bytes")
    states = table.select("file_path", "start", "inside", "before", F.min("utf8").over(own).alias("utf8"))
    lines = _lines(spark, path).select("file_path", "start", "value")
    if table.count() <= BROADCAST_SPLITS:
        joined = lines.join(F.broadcast(states), ["file_path", "start"], "left")
    else:
        joined = (lines.withColumn("_pos", F.monotonically_increasing_id()).join(states, ["file_path", "start"], "left")
                  .sortWithinPartitions("file_path", "start", "_pos"))
    joined = joined.select("file_path", "start", "value", "inside", "before", "utf8")

    def run(batches):
        reader = None
        for batch in batches:
            for file, start, i, j in _stretches(batch):
                if reader is None or (reader.file, reader.start) != (file, start):
                    if reader is not None:
                        yield from reader.rest()
                    utf8 = batch.column(5)[i].as_py()
                    if utf8 is None:  # the splits' borders moved since the first scan
                        raise ValueError(f"{file}: no state of the split at {start}")
                    reader = _Reader(file, start, batch.column(3)[i].as_py(), batch.column(4)[i].as_py(),
                                     encoding or ("utf-8" if utf8 else "latin-1"))
                yield from reader.read(batch.column(2).slice(i, j - i))
        if reader is not None:
            yield from reader.rest()

    found = joined.mapInArrow(run, _RECORDS)
    if not _crossing(table):
        return found.select("file_path", "record_no", "cells")
    # fragments are few (two for a record that crosses a border) and read from a written table
    found = materialize(found, "csv-records")
    parts = (found.where("fragment IS NOT NULL").groupBy("file_path", "record_no")
             .agg(F.sort_array(F.collect_list(F.struct("start", "fragment"))).alias("parts"), F.first("cells").alias("coding"))
             .select("file_path", "record_no", "coding", "parts.fragment"))

    def join(batches):
        for batch in batches:
            rows = []
            for file, number, coding, parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((file, number, _parse([b"\n".join(parts_).decode(coding[0])], file, number)[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.list_(pa.string())))], names=["file_path", "record_no", "cells"])

    whole = found.where("fragment IS NULL").select("file_path", "record_no", "cells")
    return whole.unionByName(parts.mapInArrow(join, "file_path string, record_no long, cells array<string>"))


class _Reader:
    """Records of one split from its true state on."""

    def __init__(self, file: str, start: int, inside: bool, before: int, encoding: str):
        self.file, self.start, self.inside, self.number, self.encoding = file, start, inside, before, encoding
        self.open: list[bytes] = []  # lines of a record that hasn't ended
        self.first = inside  # the record began in an earlier split

    def _batch(self, numbers, cells, fragments):
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string())),
             pa.array([self.start] * n, pa.int64()), pa.array(fragments, pa.binary())],
            names=[c.split()[0] for c in _RECORDS.split(", ")])

    def _fragment(self):
        raw, self.open = b"\n".join(self.open), []
        return self._batch([self.number + 1], [[self.encoding]], [raw])

    def read(self, values: pa.Array):
        for at in range(0, len(values), 4096):
            part = values.slice(at, 4096)
            lines, quoted, blank = part.to_pylist(), set(_quoted(part)), _blank(part)
            whole, numbers = [], []
            for k, line in enumerate(lines):
                if not self.inside and blank[k]:
                    continue
                was = self.inside
                if k in quoted:
                    self.inside = ends_inside(line, was)
                if was or self.inside:
                    self.open.append(line)
                    if self.inside:
                        continue
                    if self.first:
                        yield self._fragment()
                        self.first = False
                        self.number += 1
                        continue
                    line, self.open = b"\n".join(self.open), []
                self.number += 1
                numbers.append(self.number)
                whole.append(line.decode(self.encoding))
            if whole:
                yield self._batch(numbers, _parse(whole, self.file, numbers[0]), [None] * len(whole))

    def rest(self):
        if self.open or self.first:
            yield self._fragment()


def header_of(records_: DataFrame) -> list[str]:
    """The names in the first file's header (one row)."""
    first = records_.where("record_no = 1").orderBy("file_path").limit(1).collect()
    return list(first[0]["cells"]) if first else []


def table_of(records_: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Records as rows: ``_file``, ``_row`` (from 1, without the header) and a text column for
    each name of ``header`` (of a repeated name the last cell), by default the first
    file's; the others' must be the same.  A short record's last cells are null;
    cells beyond the header go, as does the header of every file."""
    header = header_of(records_) if header is None else header
    place = {name: k for k, name in enumerate(header)}
    cells = [F.get("cells", F.lit(k)).alias(name) for name, k in place.items()]
    return records_.where("record_no > 1").select(F.col("file_path").alias("_file"), (F.col("record_no") - 1).alias("_row"), *cells)


def rows_of(spark: SparkSession, path: str, encoding: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """:func:`table_of` the records of the CSV files under ``path``.  Where no record
    crosses a border the header comes from the first scan, so the records aren't cut twice."""
    table = splits(spark, path, digest=False) if table is None else table
    found = records(spark, path, encoding, table)
    coded = table.withColumn("utf8", F.min("utf8").over(Window.partitionBy("file_path")))
    first = coded.where("before = 0 AND n_records > 0").orderBy("file_path", "start").limit(1).select("file_path", "utf8", "head").collect()
    if any(r["head"] is None for r in first) or _crossing(table):
        return table_of(found)
    header = [_parse([r["head"].decode(encoding or ("utf-8" if r["utf8"] else "latin-1"))], r["file_path"], 1)[0] for r in first]
    return table_of(found, header[0] if header else [])


def read_rows(spark: SparkSession, path: str, encoding: str | None = None, number: str = "row_number") -> DataFrame:
    """The rows of header CSV files with ``number``, from 1 over all files in path order."""
    table = splits(spark, path, digest=False)
    out = rows_of(spark, path, encoding, table)
    files = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = file_counts(table).select(F.col("file_path").alias("_file"), F.coalesce(F.sum(
        F.greatest(F.col("n_records") - 1, F.lit(0))).over(files), F.lit(0)).alias("_before"))
    names = [F.col(f"`{c}`") for c in out.columns if c not in ("_file", "_row")]
    return out.join(offsets, "_file").select((F.col("_before") + F.col("_row")).alias(number), *names)
