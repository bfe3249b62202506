"""Sinks: CSV / JSON writes, append, insert-if-absent, get-or-create,
versioned soft delete, prediction log, batch-run bookkeeping.

Tables here are append-only Parquet folders.  Updates (soft delete,
``updated_at``) append a newer version of the row; readers keep the newest
version per key, so no file is ever rewritten in place and a failed job
leaves the previous state readable.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.latest import keep_latest


# Rows of one compressed CSV file: such a file can't be cut into splits.
CSV_FILE_ROWS = 500_000


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8", compression: str | None = None) -> None:
    """Header CSV without an index column; a quote inside a cell is doubled.
    ``compression``: a codec; the files then hold ``CSV_FILE_ROWS`` rows at most."""
    out = df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", encoding)
    if compression:
        out = out.option("compression", compression).option("maxRecordsPerFile", CSV_FILE_ROWS)
    out.csv(path)


def sink_json_report(df: DataFrame, path: str) -> None:
    """Small report rows (one struct per row) as JSON lines."""
    df.write.mode("overwrite").json(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing was written yet.

    Only a missing path counts as empty; damaged files and any other storage
    error surface.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _stored_rows(spark: SparkSession, path: str) -> int:
    """Row count of a Parquet table from file footers (no data is read)."""
    df = _stored(spark, path)
    return 0 if df is None else df.count()


def sink_append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Append; returns the number of rows written (footer counts before and
    after; one writer per table is assumed).  ``Observation`` is avoided on
    purpose: once used, the session cannot serialise MLlib models."""
    spark = df.sparkSession
    before = _stored_rows(spark, path)
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return _stored_rows(spark, path) - before


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    df = _stored(spark, path)
    return spark.createDataFrame([], like.schema) if df is None else df


def sink_insert_if_absent(df: DataFrame, path: str, keys: list[str],
                          order: list[str] | None = None) -> int:
    """Insert rows whose natural key is not stored yet; in-batch duplicates
    keep the first row under ``order`` (min_by, partial aggregation)."""
    spark = df.sparkSession
    from kestrel.operators.relational import dedupe_first
    batch = df
    if order is not None and len(keys) == 1:
        batch = dedupe_first(df, keys[0], order).select(*df.columns)
    else:
        batch = df.dropDuplicates(keys)
    stored = _read_or_empty(spark, path, df).select(*keys).distinct()
    new = batch.join(stored, keys, "left_anti")
    return sink_append(new, path)


def sink_get_or_create(codes: DataFrame, path: str, code_col: str, id_col: str) -> DataFrame:
    """Look codes up; create the missing ones with a deterministic surrogate
    key (SHA-256 of the code); return (code, id) for every input code."""
    spark = codes.sparkSession
    wanted = codes.select(code_col).distinct()
    stored = _read_or_empty(spark, path, wanted.withColumn(id_col, F.lit("")))
    missing = wanted.join(stored.select(code_col), code_col, "left_anti") \
                    .withColumn(id_col, F.sha2(F.col(code_col).cast("string"), 256))
    sink_append(missing, path)
    return wanted.join(spark.read.parquet(path).select(code_col, id_col), code_col, "left")


def current_version(df: DataFrame, keys: list[str], ts: str = "updated_at") -> DataFrame:
    """Newest version of each row (append-only table)."""
    return keep_latest(df, keys, [F.col(ts).desc()])


def sink_soft_delete(spark: SparkSession, path: str, keys: list[str], where, as_of: datetime) -> int:
    """Append a new version with is_active = false (and updated_at = as_of)
    for the current rows matching ``where``."""
    cur = current_version(spark.read.parquet(path), keys)
    upd = cur.where(where).withColumns({"is_active": F.lit(False),
                                        "updated_at": F.lit(as_of).cast("timestamp")})
    return sink_append(upd, path)


def sink_touch_updated_at(df: DataFrame, as_of: datetime) -> DataFrame:
    """What the update trigger does: every rewritten row gets updated_at."""
    return df.withColumn("updated_at", F.lit(as_of).cast("timestamp"))


def prediction_log_rows(df: DataFrame, user_email_col: str, prediction_type: str, inputs: list[str],
                        output_cols: list[str], defaulted: list[str], as_of: datetime) -> DataFrame:
    """Prediction log rows: inputs and outputs as JSON text, used and
    defaulted columns, creation time."""
    return df.select(
        F.col(user_email_col).cast("string").alias("user_email"),
        F.lit(prediction_type).alias("prediction_type"),
        F.to_json(F.struct(*inputs)).alias("input_summary"),
        F.to_json(F.struct(*output_cols)).alias("prediction_output"),
        F.array(*[F.lit(c) for c in inputs]).alias("columns_used"),
        F.array(*[F.lit(c) for c in defaulted]).cast("array<string>").alias("columns_defaulted"),
        F.lit(as_of).cast("timestamp").alias("created_at"))


def etl_batch_run(spark: SparkSession, pipeline: str, source: str, started: datetime, finished: datetime,
                  rows_read: int, rows_inserted: int, rows_rejected: int) -> DataFrame:
    """One batch-run row; status from the counters; finish >= start holds."""
    status = "success" if rows_rejected == 0 else ("partial" if rows_inserted > 0 else "failed")
    return spark.createDataFrame(
        [(pipeline, source, started, max(finished, started), status, rows_read, rows_inserted, rows_rejected)],
        "pipeline_name string, source_name string, started_at timestamp, finished_at timestamp, "
        "status string, rows_read long, rows_inserted long, rows_rejected long")
