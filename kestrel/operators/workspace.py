"""Per-user workspace datasets: upload, type detection, validation, records.

Storage layout (all Parquet under one workspace root):
  records/   user_email=<u>/dataset_id=<d>/  (row_number, payload JSON text)
  datasets/  one metadata row per dataset (type, columns, missing, active)
Records are written before metadata, so a failed load never shows up as
a dataset.  Every read is filtered by the tenant (partition pruning on
``user_email``) and owner-checked with a semi-join on the metadata.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel import schemas as S
from kestrel.functions import columns as C
from kestrel.sources.csv_records import read_rows

METADATA_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("user_email", T.StringType(), False),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("dataset_type", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("missing_columns", T.ArrayType(T.StringType())),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])


# --- schema detection / validation as DataFrame operations ---------------------------------

def schema_catalogue(spark: SparkSession) -> DataFrame:
    """(dataset_type, ordinal, expected columns, defaults as JSON) for the 3 upload schemas."""
    import json
    rows = [(t, i, list(sch.keys()), json.dumps(sch)) for i, (t, sch) in enumerate(S.UPLOAD_SCHEMAS.items())]
    return spark.createDataFrame(rows, "dataset_type string, ordinal int, expected array<string>, "
                                       "defaults string")


def detect_dataset_types(headers: DataFrame) -> DataFrame:
    """headers(dataset_id, columns array<string>) -> (dataset_id, dataset_type, score).

    Case-insensitive, trimmed match; score = matched / expected; the first
    schema with the strictly best score wins; below 0.3 -> 'general'.
    """
    cat = F.broadcast(schema_catalogue(headers.sparkSession))  # 3 rows
    norm = F.array_distinct(F.transform("columns", lambda c: F.lower(F.trim(c))))
    exp = F.transform("expected", lambda c: F.lower(c))
    scored = (headers.select("dataset_id", norm.alias("_cols")).crossJoin(cat)
              .select("dataset_id", "dataset_type", "ordinal",
                      (F.size(F.array_intersect("_cols", exp)) / F.size(exp)).alias("score")))
    best = scored.groupBy("dataset_id").agg(
        F.min_by(F.struct("dataset_type", "score"), F.struct((-F.col("score")).alias("s"), "ordinal"))
        .alias("b"))
    return best.select("dataset_id",
                       F.when(F.col("b.score") < S.DETECTION_THRESHOLD, F.lit("general"))
                        .otherwise(F.col("b.dataset_type")).alias("dataset_type"),
                       F.col("b.score").alias("score"))


def validate_schemas(headers: DataFrame) -> DataFrame:
    """Present / missing / extra columns (case-sensitive, trimmed, sorted) and
    the defaults to apply, per dataset; type from detection unless given."""
    typed = headers if "dataset_type" in headers.columns else \
        headers.join(detect_dataset_types(headers).select("dataset_id", "dataset_type"), "dataset_id")
    cat = F.broadcast(schema_catalogue(headers.sparkSession).drop("ordinal"))
    j = typed.join(cat, "dataset_type", "left")
    actual = F.array_distinct(F.transform("columns", lambda c: F.trim(c)))
    expected = F.coalesce(F.col("expected"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(expected, actual))
    return j.select(
        "dataset_id", "dataset_type",
        F.array_sort(F.array_intersect(actual, expected)).alias("columns_present"),
        missing.alias("columns_missing"),
        F.array_sort(F.array_except(actual, expected)).alias("columns_extra"),
        F.lit(True).alias("is_usable"))


# --- cells, payloads -------------------------------------------------------------------

def float_of_cell(c: Column) -> Column:
    """The number that a cell with a '.' holds, else null."""
    v = c.cast("string")
    return F.when(v.contains("."), C.parse_number(v))


def infer_cell_json(c: Column, as_float: Column | None = None) -> Column:
    """One CSV cell as a JSON fragment: text with '.' -> float, else int,
    else the text itself (as a JSON string).  ``as_float``: :func:`float_of_cell`,
    if it is a column already."""
    v = c.cast("string")
    as_float = float_of_cell(v) if as_float is None else as_float
    as_int = v.try_cast("long")
    quoted = F.btrim(F.to_json(F.array(v)), F.lit("[]"))  # ["..."]: the quotes end the trim
    finite = ~F.isnan(as_float) & (F.abs(as_float) != F.lit(float("inf")))
    return (F.when(v.isNull(), F.lit("null"))
            .when(v.contains(".") & as_float.isNotNull() & finite, as_float.cast("string"))
            .when(~v.contains(".") & v.rlike(r"^\s*[+-]?\d+\s*$") & as_int.isNotNull(), as_int.cast("string"))
            .otherwise(quoted))


def payload_build(columns: list[str], floats: dict[str, str] | None = None) -> Column:
    """JSON object text from typed cell fragments, in header order.  ``floats``:
    the columns that hold their :func:`float_of_cell`."""
    parts = [F.lit("{")]
    for i, c in enumerate(columns):
        number = F.col(floats[c]) if floats and c in floats else None
        parts.append(F.lit(("," if i else "") + json.dumps(c) + ":"))
        parts.append(infer_cell_json(F.col(f"`{c}`"), number))
    parts.append(F.lit("}"))
    return F.concat(*parts)


def with_payload(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the payload of the columns; a cell is parsed once, in a projection
    of its own, as branches of one expression would each parse it again."""
    prefix = "_float"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    floats = {c: f"{prefix}{i}" for i, c in enumerate(columns)}
    parsed = df.select(*keep, *[F.col(f"`{c}`") for c in columns if c not in keep],
                       *[float_of_cell(F.col(f"`{c}`")).alias(n) for c, n in floats.items()])
    return parsed.select(*keep, payload_build(columns, floats).alias("payload"))


def payload_get(payload: Column, field: str, as_type: str = "string") -> Column:
    """Typed field access on the JSON payload (VARIANT path lookup)."""
    return F.try_variant_get(F.try_parse_json(payload), F.lit(f"$['{field}']"), as_type)


def adapt_rows(df: DataFrame, missing: list[str], dataset_type: str) -> DataFrame:
    """Add defaults for the columns missing from the header."""
    defaults = S.UPLOAD_SCHEMAS.get(dataset_type, {})
    return df.withColumns({c: F.lit(defaults[c]).cast("string") for c in missing if c in defaults})


# --- ingest / read / delete -----------------------------------------------------------

def read_upload(spark: SparkSession, path: str, number: str = "row_number") -> DataFrame:
    """Header CSV, every cell as text, with row numbers in file order; line breaks
    inside quotes belong to their cell.  UTF-8 unless the file is not valid
    UTF-8, then Latin-1 (decided per file from its bytes, on the executors)."""
    return read_rows(spark, path, number=number)


def workspace_ingest(spark: SparkSession, root: str, path: str, user_email: str, dataset_name: str,
                     file_name: str, dataset_type: str | None = None,
                     dataset_id: str | None = None, now: datetime | None = None,
                     fill_defaults: bool = True) -> dict:
    """CSV -> detect -> validate -> defaults -> records, then metadata.

    Returns the schema report.  The header (a list of names) is the only
    thing inspected on the driver; rows never leave the executors.

    ``fill_defaults=True`` is the source order: defaults are written into
    the records at upload, which hides alias columns from the serving
    normalisers (a filled 50.0 is truthy).  With ``False`` the records keep
    only the uploaded cells and the normalisers' own defaults apply after
    alias resolution.
    """
    dataset_id = dataset_id or uuid.uuid4().hex
    now = now or datetime(2001, 6, 1)
    numbered = read_upload(spark, path, "row_number")
    columns = numbered.columns[1:]
    headers = spark.createDataFrame([(dataset_id, columns)], "dataset_id string, columns array<string>")
    if dataset_type:
        headers = headers.withColumn("dataset_type", F.lit(dataset_type))
    report = validate_schemas(headers).first()  # one row of metadata
    missing = list(report["columns_missing"])
    to_fill = missing if fill_defaults else []
    adapted = adapt_rows(numbered, to_fill, report["dataset_type"])
    all_cols = columns + [c for c in to_fill if c in S.UPLOAD_SCHEMAS.get(report["dataset_type"], {})]
    records = (with_payload(adapted, all_cols, ["row_number"])
               .select(F.lit(dataset_id).alias("dataset_id"), F.lit(user_email).alias("user_email"),
                       F.col("row_number").cast("long"), "payload"))
    records.write.mode("append").option("compression", "zstd").partitionBy("user_email", "dataset_id").parquet(f"{root}/records")
    # footer count of this dataset's partition only (partition pruning, no data read)
    n = spark.read.parquet(f"{root}/records").where(
        (F.col("user_email") == user_email) & (F.col("dataset_id") == dataset_id)).count()
    meta = spark.createDataFrame([(dataset_id, user_email, dataset_name, report["dataset_type"], file_name,
                                   n, columns, missing, True, now, now)], METADATA_SCHEMA)
    meta.write.mode("append").parquet(f"{root}/datasets")
    return {"dataset_id": dataset_id, "dataset_type": report["dataset_type"], "row_count": n,
            "columns_present": list(report["columns_present"]), "columns_missing": missing,
            "columns_extra": list(report["columns_extra"]),
            "defaults_applied": {c: S.UPLOAD_SCHEMAS.get(report["dataset_type"], {})[c] for c in missing},
            "is_usable": True}


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """Current metadata: the newest version of each dataset row."""
    from kestrel.operators.latest import keep_latest
    meta = spark.read.parquet(f"{root}/datasets")
    return keep_latest(meta, ["dataset_id"], [F.col("updated_at").desc()])


def tenant_filter(df: DataFrame, user_email: str) -> DataFrame:
    return df.where(F.col("user_email") == user_email)


def workspace_list(spark: SparkSession, root: str, user_email: str) -> DataFrame:
    meta = tenant_filter(datasets(spark, root), user_email)
    return meta.where(F.col("is_active")).orderBy(F.col("created_at").desc(), F.col("dataset_id"))


def owned_records(spark: SparkSession, root: str, user_email: str, dataset_id: str) -> DataFrame:
    """Records of one dataset, readable only when the user owns it (semi-join)."""
    rec = spark.read.parquet(f"{root}/records").where(
        (F.col("user_email") == user_email) & (F.col("dataset_id") == dataset_id))
    owner = tenant_filter(datasets(spark, root), user_email).where(F.col("is_active"))
    return rec.join(owner.select("dataset_id", "user_email"), ["dataset_id", "user_email"], "left_semi")


def scan_dataset_rows(spark: SparkSession, root: str, user_email: str, dataset_id: str) -> DataFrame:
    return owned_records(spark, root, user_email, dataset_id).orderBy("row_number")


def workspace_preview(spark: SparkSession, root: str, user_email: str, dataset_id: str,
                      n: int = 10) -> DataFrame:
    """First n rows by row number (1 <= n <= 100); no sort needed."""
    n = max(1, min(int(n), 100))
    return owned_records(spark, root, user_email, dataset_id).where(F.col("row_number") <= n)


def workspace_delete(spark: SparkSession, root: str, user_email: str, dataset_id: str,
                     now: datetime | None = None) -> None:
    """Soft delete: append a newer metadata version with is_active = false
    (updated_at touched); readers keep the newest version per dataset."""
    now = now or datetime(2001, 6, 2)
    cur = datasets(spark, root).where((F.col("dataset_id") == dataset_id) & (F.col("user_email") == user_email))
    cur.withColumns({"is_active": F.lit(False), "updated_at": F.lit(now).cast("timestamp")}) \
       .write.mode("append").parquet(f"{root}/datasets")


# --- normalisers of user rows ------------------------------------------------------------

def _field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$['{name}']")


def alias_coalesce_supplier(records: DataFrame) -> DataFrame:
    """First truthy alias per field; scores as float with default 80."""
    p = F.col("payload")
    a = S.SUPPLIER_ALIASES
    pick = lambda k: C.first_truthy(*[_field(p, n) for n in a[k]])
    out = {"supplier_name": F.coalesce(pick("supplier_name"), F.lit("Unknown Supplier"))}
    for k in ["quality_score", "delivery_score", "cost_score", "reliability_score", "overall_score"]:
        out[k] = C.safe_float(pick(k), 80.0)
    out["risk_tier"] = F.coalesce(pick("risk_tier"), F.lit("Low Risk"))
    return records.select("row_number", *[v.alias(k) for k, v in out.items()])


def alias_coalesce_inventory(records: DataFrame) -> DataFrame:
    """SKU rows: ints via float, demand default 20, cost default 10, then the
    serving-layer risk flag and revenue at risk."""
    p = F.col("payload")
    a = S.INVENTORY_ALIASES
    pick = lambda k: C.first_truthy(*[_field(p, n) for n in a[k]])
    df = records.select(
        "row_number",
        F.coalesce(pick("sku"), F.lit("Unknown SKU")).alias("sku"),
        F.coalesce(pick("product_type"), F.lit("Unknown")).alias("product_type"),
        F.coalesce(pick("supplier_name"), F.lit("Unknown Supplier")).alias("supplier_name"),
        C.safe_int(pick("stock_levels"), 0).alias("stock_levels"),
        C.safe_int(pick("reorder_point"), 0).alias("reorder_point"),
        C.safe_int(pick("safety_stock"), 0).alias("safety_stock"),
        C.safe_int(pick("reorder_qty"), 0).alias("reorder_qty"),
        C.safe_float(pick("avg_daily_demand"), 20.0).alias("avg_daily_demand"),
        C.safe_float(pick("unit_cost"), 10.0).alias("unit_cost"))
    risk = F.col("stock_levels") < F.col("reorder_point")
    return df.withColumns({
        "stockout_risk": risk.cast("long"),
        "revenue_at_risk": F.when(risk, C.round_half_even(
            (F.col("reorder_point") - F.col("stock_levels")) * (F.col("unit_cost") * F.lit(1.5)), 2))
        .otherwise(F.lit(0.0))})


def shipment_rows(records: DataFrame, columns: list[str]) -> DataFrame:
    """Flatten shipment payloads into text columns (header known from metadata)."""
    return records.select("row_number", *[_field(F.col("payload"), c).alias(c) for c in columns])
