"""Workspace (multi-tenant upload) queries and source / sink round trips.

Uploads are derived from the test tables (order items, optimiser rows,
supplier scorecard), written as CSV files into the shared checkpoint
folder, and ingested with the workspace job.  One workspace per
(session, scale-factor folder) is built once and reused by the read-only
queries; mutating queries build their own copy.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.operators import kpis, scoring
from kestrel.operators import workspace as W
from kestrel.plans.oracle_views import r, with_views
from kestrel.plans.q_scoring import _SCORES, _INV, _with_opt
from kestrel.plans.registry import register
from kestrel.session import scratch_path
from kestrel.sources import csv_records
from kestrel.sources import files as FS
from kestrel.sources import sinks as SK

USER_A = "analyst@acme.test"
USER_B = "planner@acme.test"
SHIP_COLS = ["order_key", "shipping_mode", "days_for_shipment_scheduled", "days_for_shipping_real", "sales",
             "benefit_per_order", "late_delivery_flag", "category_name", "market", "order_region",
             "customer_segment"]

_CACHE: dict = {}


def _uploads(ctx, base: str) -> dict[str, str]:
    o = ctx.orders_clean()
    ship = o.select(F.col("`Line Key`").alias("order_key"), "shipping_mode",
                    F.col("scheduled_shipping_days").alias("days_for_shipment_scheduled"),
                    F.col("actual_shipping_days").alias("days_for_shipping_real"), "sales", "benefit_per_order",
                    "late_delivery_flag", "category_name", "market", "order_region", "customer_segment")
    opt = scoring.optimize_inventory(ctx.skus())
    inv = opt.select("sku", "product_type", "supplier_name", "stock_levels", "products_sold", "lead_time_days",
                     "reorder_point", F.col("avg_daily_demand").alias("Daily Demand"),
                     (F.col("product_price") * F.lit(0.6)).alias("Unit Cost"))
    sup = scoring.score_suppliers(ctx.skus()).select(
        "supplier_name", F.col("quality_score").alias("Quality Score"), "delivery_score", "cost_score",
        "reliability_score", "overall_score", "risk_tier")
    paths = {}
    for name, df, key in [("shipments", ship, "order_key"), ("inventory", inv, "sku"),
                          ("suppliers", sup, "supplier_name")]:
        paths[name] = f"{base}/{name}.csv"
        SK.sink_csv(df.orderBy(key), paths[name], compression="lz4")  # range-partitioned sort: part files in key order
    return paths


def workspace(ctx, fresh: bool = False) -> tuple[str, dict]:
    key = (ctx.spark.sparkContext.applicationId, ctx._scope)
    if not fresh and key in _CACHE:
        return _CACHE[key]
    base = scratch_path(ctx.spark, "workspace")
    up = _uploads(ctx, base)
    root = f"{base}/store"
    ids = {}
    for name, path in up.items():
        ids[name] = name + "-ds"
        W.workspace_ingest(ctx.spark, root, path, USER_A, name.title(), f"{name}.csv", dataset_id=ids[name])
    W.workspace_ingest(ctx.spark, root, up["inventory"], USER_B, "Other", "inventory.csv", dataset_id="b-inv-ds")
    out = (root, ids)
    if not fresh:
        _CACHE[key] = out
    return out


def _records(ctx, name: str, user: str = USER_A):
    root, ids = workspace(ctx)
    return W.owned_records(ctx.spark, root, user, ids[name])


# --- ingest / detection / validation ---------------------------------------------------------

_INGEST_SQL = with_views(["orders_f", "skus_f"], """
SELECT 'Shipments' AS dataset_name, 'shipment' AS dataset_type, (SELECT COUNT(*) FROM orders_f) AS row_count,
  'order_item_discount,order_item_discount_rate,order_item_profit_ratio,order_item_quantity,order_item_total,'
  || 'sales_per_customer' AS missing_columns
UNION ALL SELECT 'Inventory', 'inventory', (SELECT COUNT(*) FROM skus_f),
  'avg_daily_demand,reorder_qty,revenue_at_risk,safety_stock,std_daily_demand,stockout_risk'
UNION ALL SELECT 'Suppliers', 'supplier', (SELECT COUNT(DISTINCT supplier_name) FROM skus_f), 'quality_score'""")


@register("workspace_ingest", _INGEST_SQL)
def q_workspace_ingest(ctx):
    root, _ = workspace(ctx)
    meta = W.workspace_list(ctx.spark, root, USER_A)
    return meta.select("dataset_name", "dataset_type", "row_count",
                       F.array_join("missing_columns", ",").alias("missing_columns"))


@register("detect_dataset_type", with_views(["orders_f"], """
SELECT 'Shipments' AS dataset_name, 'shipment' AS dataset_type FROM (SELECT COUNT(*) FROM orders_f)
UNION ALL SELECT 'Inventory', 'inventory' UNION ALL SELECT 'Suppliers', 'supplier'"""))
def q_detect_dataset_type(ctx):
    root, _ = workspace(ctx)
    spark = ctx.spark
    meta = W.workspace_list(spark, root, USER_A).select("dataset_id", "dataset_name", "columns")
    det = W.detect_dataset_types(meta.select("dataset_id", "columns"))
    return meta.join(det, "dataset_id").select("dataset_name", "dataset_type")


@register("validate_schema", with_views([], """
SELECT 'Inventory' AS dataset_name, 'lead_time_days,product_type,products_sold,reorder_point,sku,stock_levels,'
  || 'supplier_name' AS columns_present, 'Daily Demand,Unit Cost' AS columns_extra
UNION ALL SELECT 'Shipments', 'benefit_per_order,category_name,customer_segment,days_for_shipment_scheduled,'
  || 'days_for_shipping_real,market,order_region,sales,shipping_mode', 'late_delivery_flag,order_key'
UNION ALL SELECT 'Suppliers', 'cost_score,delivery_score,overall_score,reliability_score,risk_tier,supplier_name',
  'Quality Score'
FROM (SELECT COUNT(*) FROM lineitem)"""))
def q_validate_schema(ctx):
    root, _ = workspace(ctx)
    meta = W.workspace_list(ctx.spark, root, USER_A).select("dataset_id", "dataset_name", "columns")
    v = W.validate_schemas(meta.select("dataset_id", "columns"))
    return meta.join(v, "dataset_id").select("dataset_name",
                                             F.array_join("columns_present", ",").alias("columns_present"),
                                             F.array_join("columns_extra", ",").alias("columns_extra"))


@register("adapt_rows", with_views(["orders_f"], """
SELECT COUNT(*) AS n_rows, CAST(SUM(1) AS DOUBLE) AS quantity_sum, COUNT(*) * 0.1 AS profit_ratio_sum
FROM orders_f"""))
def q_adapt_rows(ctx):
    """Defaults injected for absent columns, read back from the payloads."""
    rec = _records(ctx, "shipments")
    q = C.safe_float(F.get_json_object("payload", "$.order_item_quantity"))
    pr = C.safe_float(F.get_json_object("payload", "$.order_item_profit_ratio"))
    return rec.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(q).alias("quantity_sum"),
                   C.round_half_up(F.sum(pr.cast("decimal(38,9)")), 4).alias("profit_ratio_sum"))


@register("infer_cell_type", with_views(["orders_f"], """
SELECT COUNT(*) FILTER (WHERE TRUE) AS sales_numbers, COUNT(*) AS late_integers, COUNT(*) AS mode_texts
FROM orders_f"""))
def q_infer_cell_type(ctx):
    rec = _records(ctx, "shipments")
    js = lambda f: F.get_json_object("payload", f"$.{f}")
    is_num = lambda f: js(f).rlike(r"^-?[0-9.eE+-]+$") & ~F.col("payload").contains(f'"{f}":"')
    return rec.agg(F.count_if(is_num("sales") & js("sales").contains(".")).alias("sales_numbers"),
                   F.count_if(is_num("late_delivery_flag") & ~js("late_delivery_flag").contains("."))
                   .alias("late_integers"),
                   F.count_if(F.col("payload").contains('"shipping_mode":"')).alias("mode_texts"))


# --- per-user views ---------------------------------------------------------------------------

def _ship_kpi_sql() -> str:
    from kestrel.plans.q_kpis import _shipment_sql
    return _shipment_sql([])


@register("workspace_kpis", _ship_kpi_sql())
def q_workspace_kpis(ctx):
    rows = W.shipment_rows(_records(ctx, "shipments"), SHIP_COLS)
    return kpis.agg_shipment_kpis(rows)


@register("find_column_alias", _ship_kpi_sql())
def q_find_column_alias(ctx):
    """KPI columns resolved by alias ('late', 'total', 'profit' ...)."""
    rows = W.shipment_rows(_records(ctx, "shipments"), SHIP_COLS).withColumnsRenamed(
        {"late_delivery_flag": "Late", "benefit_per_order": "PROFIT"})
    return kpis.agg_shipment_kpis(rows)


_INV_VIEW_SQL = with_views(["skus_f"], "").rstrip() + f""",
{_INV}
SELECT sku, s AS stock_levels, p AS reorder_point, CAST(s < p AS BIGINT) AS stockout_risk,
  CASE WHEN s < p THEN CAST(ROUND_EVEN(CAST((p - s) * (c * 1.5) AS DECIMAL(38,9)), 2) AS DOUBLE) ELSE 0.0 END
    AS revenue_at_risk,
  CASE WHEN COALESCE(avg_daily_demand, 0) = 0 THEN 20.0 ELSE avg_daily_demand END AS avg_daily_demand
FROM (SELECT sku, avg_daily_demand, CAST(TRUNC(stock_levels) AS BIGINT) AS s,
        CAST(TRUNC(reorder_point) AS BIGINT) AS p,
        CASE WHEN COALESCE(product_price * 0.6, 0) = 0 THEN 10.0 ELSE product_price * 0.6 END AS c FROM opt)"""


@register("workspace_inventory_view", _INV_VIEW_SQL)
def q_workspace_inventory_view(ctx):
    v = W.alias_coalesce_inventory(_records(ctx, "inventory"))
    return v.select("sku", "stock_levels", "reorder_point", "stockout_risk", "revenue_at_risk",
                    "avg_daily_demand")


@register("alias_coalesce_inventory", with_views(["skus_f"], "").rstrip() + f""",
{_INV}
SELECT COUNT(*) FILTER (WHERE s < p) AS skus_at_stockout_risk, COUNT(*) AS total_skus
FROM (SELECT CAST(TRUNC(stock_levels) AS BIGINT) AS s, CAST(TRUNC(reorder_point) AS BIGINT) AS p FROM opt)""")
def q_alias_coalesce_inventory(ctx):
    v = W.alias_coalesce_inventory(_records(ctx, "inventory"))
    return kpis.agg_inventory_kpis(v).select("skus_at_stockout_risk", "total_skus")


_SUP_VIEW_SQL = with_views(["skus_f"], "").rstrip() + f""",
{_SCORES}
SELECT supplier_name, 50.0 AS quality_score,
  {r('CASE WHEN delivery_score = 0 THEN 80.0 ELSE delivery_score END', 4)} AS delivery_score,
  {r('CASE WHEN overall_score = 0 THEN 80.0 ELSE overall_score END', 4)} AS overall_score, risk_tier FROM tiered"""


@register("workspace_supplier_view", _SUP_VIEW_SQL)
def q_workspace_supplier_view(ctx):
    v = W.alias_coalesce_supplier(_records(ctx, "suppliers"))
    return v.select("supplier_name", "quality_score", C.round_half_up("delivery_score", 4).alias("delivery_score"),
                    C.round_half_up("overall_score", 4).alias("overall_score"), "risk_tier")


@register("alias_coalesce_supplier", _SUP_VIEW_SQL)
def q_alias_coalesce_supplier(ctx):
    return q_workspace_supplier_view(ctx)


@register("workspace_list", with_views(["orders_f", "skus_f"], """
SELECT 'Inventory' AS dataset_name, (SELECT COUNT(*) FROM skus_f) AS row_count
UNION ALL SELECT 'Shipments', (SELECT COUNT(*) FROM orders_f)
UNION ALL SELECT 'Suppliers', (SELECT COUNT(DISTINCT supplier_name) FROM skus_f)"""))
def q_workspace_list(ctx):
    root, _ = workspace(ctx)
    return W.workspace_list(ctx.spark, root, USER_A).select("dataset_name", "row_count")


@register("tenant_filter", with_views(["skus_f"], """
SELECT 'Other' AS dataset_name, COUNT(*) AS row_count FROM skus_f"""))
def q_tenant_filter(ctx):
    root, _ = workspace(ctx)
    return W.workspace_list(ctx.spark, root, USER_B).select("dataset_name", "row_count")


@register("filter_active_datasets", with_views(["orders_f", "skus_f"], """
SELECT 'Inventory' AS dataset_name UNION ALL SELECT 'Shipments' FROM (SELECT COUNT(*) FROM orders_f)"""))
def q_filter_active_datasets(ctx):
    root, ids = workspace(ctx, fresh=True)
    W.workspace_delete(ctx.spark, root, USER_A, ids["suppliers"])
    return W.workspace_list(ctx.spark, root, USER_A).select("dataset_name")


@register("workspace_delete", with_views(["skus_f"], """
SELECT 'Suppliers' AS dataset_name, FALSE AS is_active, (SELECT COUNT(DISTINCT supplier_name) FROM skus_f)
  AS row_count"""))
def q_workspace_delete(ctx):
    root, ids = workspace(ctx, fresh=True)
    W.workspace_delete(ctx.spark, root, USER_A, ids["suppliers"])
    meta = W.datasets(ctx.spark, root)
    return meta.where(F.col("dataset_id") == ids["suppliers"]).select("dataset_name", "is_active", "row_count")


@register("workspace_preview", with_views(["orders_f"], """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY line_key) AS BIGINT) AS row_number, line_key AS order_key, sales
FROM orders_f ORDER BY line_key LIMIT 10"""))
def q_workspace_preview(ctx):
    root, ids = workspace(ctx)
    p = W.workspace_preview(ctx.spark, root, USER_A, ids["shipments"], 10)
    return p.select("row_number", F.get_json_object("payload", "$.order_key").alias("order_key"),
                    F.get_json_object("payload", "$.sales").cast("double").alias("sales"))


@register("limit_preview", with_views(["skus_f"], """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY sku) AS BIGINT) AS row_number, sku FROM skus_f ORDER BY sku LIMIT 100"""))
def q_limit_preview(ctx):
    root, ids = workspace(ctx)
    p = W.workspace_preview(ctx.spark, root, USER_A, ids["inventory"], 500)  # capped at 100
    return p.select("row_number", F.get_json_object("payload", "$.sku").alias("sku"))


@register("scan_dataset_rows", with_views(["skus_f"], """
SELECT COUNT(*) AS n_rows, CAST(MIN(rn) AS BIGINT) AS first_row, CAST(MAX(rn) AS BIGINT) AS last_row,
  CAST(SUM(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first_rows,
  MIN(CASE WHEN rn = 1 THEN sku END) AS first_sku
FROM (SELECT sku, ROW_NUMBER() OVER (ORDER BY sku) AS rn FROM skus_f)"""))
def q_scan_dataset_rows(ctx):
    root, ids = workspace(ctx)
    rows = W.scan_dataset_rows(ctx.spark, root, USER_A, ids["inventory"])
    sku = F.get_json_object("payload", "$.sku")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row"),
                    F.max("row_number").alias("last_row"),
                    F.sum((F.col("row_number") == 1).cast("long")).alias("first_rows"),
                    F.min(F.when(F.col("row_number") == 1, sku)).alias("first_sku"))


_NOTES_SQL = with_views(["skus_f"], """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY sku) AS BIGINT) AS row_number, sku,
  sku || ' "' || COALESCE(product_type, '') || '",' || chr(10) || '"' || chr(10) || COALESCE(supplier_name, '') AS note FROM skus_f""")


def _notes(ctx) -> str:
    """A CSV file of every SKU with cells that hold quotes, commas and line breaks."""
    path = scratch_path(ctx.spark, "notes")
    text = F.concat(F.col("sku"), F.lit(' "'), F.coalesce("product_type", F.lit("")), F.lit('",\n"\n'), F.coalesce("supplier_name", F.lit("")))
    SK.sink_csv(ctx.skus().select("sku", text.alias("note"), F.lit("x").alias("last")).orderBy("sku"), path)
    return path


@register("scan_csv_records", _NOTES_SQL)
def q_scan_csv_records(ctx):
    """Records with line breaks inside quotes, numbered in file order, cell by cell."""
    return csv_records.read_rows(ctx.spark, _notes(ctx)).where("last = 'x'").select("row_number", "sku", "note")


@register("workspace_ingest_cells", _NOTES_SQL)
def q_workspace_ingest_cells(ctx):
    """The same file through an upload: each stored record's cells."""
    root = scratch_path(ctx.spark, "workspace-cells")
    W.workspace_ingest(ctx.spark, root, _notes(ctx), USER_A, "Notes", "notes.csv", dataset_id="notes-ds")
    cell = lambda c: F.get_json_object("payload", f"$.{c}").alias(c)
    return W.owned_records(ctx.spark, root, USER_A, "notes-ds").select("row_number", cell("sku"), cell("note"))


@register("raw_landing_cells", _NOTES_SQL)
def q_raw_landing_cells(ctx):
    """The same file landed: each record's cells, numbered over its files."""
    root, path = scratch_path(ctx.spark, "landed"), _notes(ctx)
    FS.land_files(ctx.spark, f"{path}/*.csv", "notes", root)
    cell = lambda c: F.get_json_object("payload", f"$.{c}").alias(c)
    stored = ctx.spark.read.parquet(f"{root}/raw_source_records").select("file_path", F.col("row_number").alias("n"), cell("sku"), cell("note"))
    files = ctx.spark.read.parquet(f"{root}/raw_source_files")
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("file_path", F.coalesce(F.sum("row_count").over(before), F.lit(0)).alias("before"))
    return stored.join(offsets, "file_path").select((F.col("n") + F.col("before")).alias("row_number"), "sku", "note")


@register("scan_dataset_rows_numbers", with_views(["skus_f"], """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT rn) AS distinct_rows, CAST(MAX(rn) AS BIGINT) AS last_row
FROM (SELECT ROW_NUMBER() OVER (ORDER BY sku) AS rn FROM skus_f)"""))
def q_scan_dataset_rows_numbers(ctx):
    root, ids = workspace(ctx)
    rows = W.owned_records(ctx.spark, root, USER_A, ids["inventory"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_number").alias("distinct_rows"),
                    F.max("row_number").alias("last_row"))


@register("join_owner_check", with_views(["skus_f"], """
SELECT 'owner' AS reader, COUNT(*) AS visible_rows FROM skus_f
UNION ALL SELECT 'other', 0 FROM (SELECT 1)"""))
def q_join_owner_check(ctx):
    root, ids = workspace(ctx)
    own = W.owned_records(ctx.spark, root, USER_A, ids["inventory"]).agg(F.count(F.lit(1)).alias("visible_rows"))
    other = W.owned_records(ctx.spark, root, USER_B, ids["inventory"]).agg(F.count(F.lit(1)).alias("visible_rows"))
    return own.select(F.lit("owner").alias("reader"), "visible_rows").unionByName(
        other.select(F.lit("other").alias("reader"), "visible_rows"))


@register("source_select_with_fallback", _with_opt("""
SELECT 'user_inventory' AS source, COUNT(*) AS total_skus FROM opt
UNION ALL SELECT 'production_fallback', COUNT(*) FROM opt"""))
def q_source_select_with_fallback(ctx):
    """Inventory rows from the user's dataset when its type is inventory,
    else from the production optimiser (here: a supplier dataset asked as
    inventory falls back)."""
    root, ids = workspace(ctx)
    meta = W.datasets(ctx.spark, root)

    def resolve(dataset_id):
        t = meta.where(F.col("dataset_id") == dataset_id).select("dataset_type").first()  # one metadata row
        if t is not None and t["dataset_type"] == "inventory":
            return "user_inventory", W.alias_coalesce_inventory(_records(ctx, "inventory"))
        return "production_fallback", scoring.optimize_inventory(ctx.skus())

    out = None
    for ds in [ids["inventory"], ids["suppliers"]]:
        name, df = resolve(ds)
        part = df.agg(F.count(F.lit(1)).alias("total_skus")).select(F.lit(name).alias("source"), "total_skus")
        out = part if out is None else out.unionByName(part)
    return out


@register("payload_extract", with_views(["orders_f"], """
SELECT shipping_mode, CAST(SUM(late_delivery_flag) AS BIGINT) AS late FROM orders_f GROUP BY 1"""))
def q_payload_extract(ctx):
    rec = _records(ctx, "shipments")
    return rec.groupBy(W.payload_get(F.col("payload"), "shipping_mode").alias("shipping_mode")).agg(
        F.sum(W.payload_get(F.col("payload"), "late_delivery_flag", "bigint")).alias("late"))


# --- sources / sinks round trips ---------------------------------------------------------------

def _ship_mode_sql() -> str:
    from kestrel.plans.q_kpis import _shipment_sql
    return _shipment_sql(["shipping_mode"])


@register("scan_csv_latin1", _ship_mode_sql())
def q_scan_csv_latin1(ctx):
    path = scratch_path(ctx.spark, "raw-orders")
    raw = ctx.raw_orders()
    SK.sink_csv(raw, path, encoding="ISO-8859-1", compression="lz4")
    back = FS.scan_csv_latin1(ctx.spark, path, raw.columns)
    from kestrel.operators import etl
    return kpis.agg_shipment_kpis(etl.clean_orders(back)[1], ["shipping_mode"])


@register("sink_csv", _ship_mode_sql())
def q_sink_csv(ctx):
    path = scratch_path(ctx.spark, "features")
    feats = ctx.orders()
    SK.sink_csv(feats, path)
    back = FS.scan_csv_typed(ctx.spark, path, feats.schema, timestamps=["order_date", "shipping_date"],
                             fmt="yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return kpis.agg_shipment_kpis(back, ["shipping_mode"])


@register("scan_csv_inferred", _ship_mode_sql())
def q_scan_csv_inferred(ctx):
    path = scratch_path(ctx.spark, "clean")
    clean = ctx.orders_clean()
    SK.sink_csv(clean, path, compression="gzip")
    back = FS.scan_csv_typed(ctx.spark, path, clean.schema, timestamps=["order_date", "shipping_date"],
                             fmt="yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return kpis.agg_shipment_kpis(back, ["shipping_mode"])


@register("scan_csv_pruned", _ship_kpi_sql())
def q_scan_csv_pruned(ctx):
    path = scratch_path(ctx.spark, "features")
    feats = ctx.orders()
    SK.sink_csv(feats, path)
    back = FS.scan_csv_pruned(ctx.spark, path, ["late_delivery_flag", "sales", "benefit_per_order"], feats.schema)
    return kpis.agg_shipment_kpis(back)


@register("scan_csv_encoding_fallback", with_views(["skus_f"], """
SELECT 'ISO-8859-1' AS encoding, COUNT(*) AS n_rows FROM skus_f"""))
def q_scan_csv_encoding_fallback(ctx):
    """Supplier locations get an accented suffix and the file is written in
    Latin-1; detection falls back to Latin-1 and the text reads back intact."""
    path = scratch_path(ctx.spark, "latin1")
    raw = ctx.raw_skus().withColumn("Location", F.concat(F.col("Location"), F.lit(" Sào")))
    SK.sink_csv(raw, path, encoding="ISO-8859-1")
    enc = FS.detect_encoding(ctx.spark, path)
    back = csv_records.rows_of(ctx.spark, path, enc)
    ok = back.where(F.col("Location").endswith(" Sào"))
    return ok.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(enc).alias("encoding"), "n_rows")


@register("raw_landing", with_views(["skus_f"], """
SELECT COUNT(*) AS read, COUNT(*) AS first_inserted, CAST(0 AS BIGINT) AS first_rejected, CAST(0 AS BIGINT) AS second_inserted,
  COUNT(*) AS second_rejected, COUNT(*) AS stored_rows, COUNT(DISTINCT sku) AS stored_skus FROM skus_f"""))
def q_raw_landing(ctx):
    """Land the files twice: the second time every row is rejected."""
    path, root = scratch_path(ctx.spark, "landing"), scratch_path(ctx.spark, "landed")
    SK.sink_csv(ctx.raw_skus(), path)
    a = FS.land_files(ctx.spark, f"{path}/*.csv", "skus", root)
    b = FS.land_files(ctx.spark, f"{path}/*.csv", "skus", root)
    stored = ctx.spark.read.parquet(f"{root}/raw_source_records")
    return stored.agg(F.count_distinct("file_id", "row_number").alias("stored_rows"),
                      F.count_distinct(F.get_json_object("payload", "$.SKU")).alias("stored_skus")).select(
        *[F.lit(int(v)).cast("long").alias(k) for k, v in (("read", a["read"]), ("first_inserted", a["inserted"]),
          ("first_rejected", a["rejected"]), ("second_inserted", b["inserted"]), ("second_rejected", b["rejected"]))],
        "stored_rows", "stored_skus")


@register("sink_insert_if_absent", with_views(["skus_f"], """
SELECT COUNT(*) - COUNT(*) FILTER (WHERE p_partkey % 2 = 0) AS inserted, COUNT(*) AS stored FROM skus_f"""))
def q_sink_insert_if_absent(ctx):
    path = scratch_path(ctx.spark, "products")
    prods = scoring.seed_products(ctx.skus())
    even = prods.where(F.substring("sku", 4, 10).cast("long") % 2 == 0)
    SK.sink_append(even, path)
    inserted = SK.sink_insert_if_absent(prods, path, ["sku"], order=["product_name"])
    stored = ctx.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"))
    return stored.select(F.lit(inserted).cast("long").alias("inserted"), "stored")


@register("sink_get_or_create", with_views(["dim_suppliers"], """
SELECT COUNT(*) AS codes, COUNT(*) AS with_id, COUNT(DISTINCT supplier_code) AS distinct_ids FROM dim_suppliers"""))
def q_sink_get_or_create(ctx):
    path = scratch_path(ctx.spark, "supplier-codes")
    codes = ctx.wh.dim_suppliers().select("supplier_code")
    SK.sink_get_or_create(codes.where(F.col("supplier_code").endswith("1")), path, "supplier_code", "supplier_id")
    res = SK.sink_get_or_create(codes, path, "supplier_code", "supplier_id")
    return res.agg(F.count(F.lit(1)).alias("codes"), F.count("supplier_id").alias("with_id"),
                   F.count_distinct("supplier_id").alias("distinct_ids"))


@register("sink_append_batched", with_views(["orders_f"], "SELECT COUNT(*) AS rows FROM orders_f"))
def q_sink_append_batched(ctx):
    path = scratch_path(ctx.spark, "append")
    feats = ctx.orders().select("order_id", "shipping_mode", "sales")
    SK.sink_append(feats.where(F.col("shipping_mode") == "Standard Class"), path, ["shipping_mode"])
    SK.sink_append(feats.where(F.col("shipping_mode") != "Standard Class"), path, ["shipping_mode"])
    return ctx.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


@register("sink_soft_delete", with_views(["dim_suppliers"], """
SELECT COUNT(*) FILTER (WHERE region <> 'EUROPE') AS active, COUNT(*) FILTER (WHERE region = 'EUROPE') AS inactive
FROM dim_suppliers"""))
def q_sink_soft_delete(ctx):
    from datetime import datetime
    path = scratch_path(ctx.spark, "suppliers")
    s = ctx.wh.dim_suppliers().withColumns({"is_active": F.lit(True),
                                            "updated_at": F.lit(datetime(2001, 1, 1)).cast("timestamp")})
    SK.sink_append(s, path)
    SK.sink_soft_delete(ctx.spark, path, ["supplier_id"], F.col("region") == "EUROPE", datetime(2001, 6, 1))
    cur = SK.current_version(ctx.spark.read.parquet(path), ["supplier_id"])
    return cur.agg(F.count_if(F.col("is_active")).alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


@register("sink_touch_updated_at", with_views(["dim_suppliers"], """
SELECT COUNT(*) AS touched, '2001-06-01 00:00:00' AS updated_at FROM dim_suppliers WHERE region = 'EUROPE'"""))
def q_sink_touch_updated_at(ctx):
    from datetime import datetime
    s = ctx.wh.dim_suppliers().where(F.col("region") == "EUROPE")
    t = SK.sink_touch_updated_at(s, datetime(2001, 6, 1))
    return t.groupBy("updated_at").agg(F.count(F.lit(1)).alias("touched"))


@register("sink_prediction_log", with_views(["orders_f"], """
SELECT shipping_mode, COUNT(*) AS logged FROM orders_f GROUP BY 1"""))
def q_sink_prediction_log(ctx):
    from datetime import datetime
    from kestrel.operators import ml
    path = scratch_path(ctx.spark, "predlog")
    scored = ml.rule_score_delay(ctx.orders())
    rows = SK.prediction_log_rows(scored.withColumn("user_email", F.lit(USER_A)), "user_email", "delay",
                                  ["shipping_mode", "sales", "scheduled_shipping_days"],
                                  ["predicted_label", "late_probability"], [], datetime(2001, 6, 1))
    SK.sink_append(rows, path)
    back = ctx.spark.read.parquet(path)
    mode = F.get_json_object("input_summary", "$.shipping_mode")
    return back.groupBy(mode.alias("shipping_mode")).agg(F.count(F.lit(1)).alias("logged"))


@register("sink_json_report", with_views(["skus_f"], "").rstrip() + f""",
{_INV}
SELECT COUNT(*) AS skus_analyzed, CAST(SUM(stockout_risk) AS BIGINT) AS at_stockout_risk FROM opt""")
def q_sink_json_report(ctx):
    path = scratch_path(ctx.spark, "report")
    m = scoring.agg_inventory_metrics(scoring.optimize_inventory(ctx.skus()))
    SK.sink_json_report(m, path)
    back = ctx.spark.read.json(path)
    return back.select(F.col("skus_analyzed").cast("long"), F.col("at_stockout_risk").cast("long"))


@register("etl_batch_run", with_views(["skus_f"], """
SELECT CAST(1 AS BIGINT) AS run, 'success' AS status, n AS rows_read, n AS rows_inserted, CAST(0 AS BIGINT) AS rows_rejected, TRUE AS finished_after_start
FROM (SELECT COUNT(*) FILTER (WHERE CAST(SUBSTR(sku, 4) AS BIGINT) % 2 = 0) AS n FROM skus_f)
UNION ALL SELECT 2, 'partial', COUNT(*), COUNT(*) FILTER (WHERE CAST(SUBSTR(sku, 4) AS BIGINT) % 2 <> 0),
  COUNT(*) FILTER (WHERE CAST(SUBSTR(sku, 4) AS BIGINT) % 2 = 0), TRUE FROM skus_f"""))
def q_etl_batch_run(ctx):
    """Two landing runs, of half of the SKUs and then of all their files:
    the second rejects what the first has landed."""
    return batch_runs(ctx)[0]


def batch_runs(ctx):
    """(batch run rows, folder of the landed tables)."""
    src, root = scratch_path(ctx.spark, "landing"), scratch_path(ctx.spark, "landed")
    even = F.substring("SKU", 4, 18).cast("long") % 2 == 0
    SK.sink_csv(ctx.raw_skus().where(even), f"{src}/a")
    SK.sink_csv(ctx.raw_skus().where(~even), f"{src}/b")
    out = None
    for i, path in enumerate([f"{src}/a/*.csv", f"{src}/*/*.csv"]):
        n = FS.land_files(ctx.spark, path, "skus", root)
        run = SK.etl_batch_run(ctx.spark, "landing", "skus", datetime(2001, 6, 1), datetime(2001, 6, 1, 0, 5), n["read"],
                               n["inserted"], n["rejected"])
        run = run.select(F.lit(i + 1).alias("run"), "status", "rows_read", "rows_inserted", "rows_rejected",
                         (F.col("finished_at") >= F.col("started_at")).alias("finished_after_start"))
        out = run if out is None else out.unionByName(run)
    return out, root
