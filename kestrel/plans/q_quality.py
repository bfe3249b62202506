"""Data-quality rule queries over the warehouse tables and raw files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.operators import etl
from kestrel.operators import quality as Q
from kestrel.plans.oracle_views import with_views
from kestrel.plans.registry import register

# the oracle's view of each stored table
_VIEW = {"fact_purchase_orders": "b_po", "fact_inventory_snapshots": "b_inv", "fact_sales_demand": "b_dem",
         "fact_shipments": "b_ship", "supplier_performance_scores": "b_score", "demand_forecasts": "b_fc",
         "shipment_delay_predictions": "b_pred", "inventory_recommendations": "b_rec", "business_recommendations": "b_br",
         "dim_products": "dim_products", "dim_suppliers": "dim_suppliers", "dim_locations": "dim_locations",
         "dim_carriers": "dim_carriers"}


def _df(ctx, table: str) -> DataFrame:
    return getattr(ctx.wh, table)()


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _views(tables) -> list[str]:
    return list(dict.fromkeys(_VIEW[t] for t in tables))


def _counts_sql(checks: dict) -> str:
    parts = [f"SELECT '{table}' AS table_name, '{name}' AS rule_name, "
             f"'{'warning' if name == 'below_reorder_point' else 'error'}' AS severity, "
             f"COUNT(*) - COUNT(*) FILTER (WHERE ({pred}) IS NOT FALSE) AS violations FROM {_VIEW[table]}"
             for table, rules in checks.items() for name, pred in rules.items()]
    return with_views(_views(checks), "\nUNION ALL\n".join(parts))


@register("dq_range_checks", _counts_sql(Q.RANGE_CHECKS))
def q_dq_range_checks(ctx):
    return _union([Q.violation_counts(_df(ctx, t), t, Q.sql_rules(c)) for t, c in Q.RANGE_CHECKS.items()])


@register("dq_cross_column", _counts_sql(Q.CROSS_CHECKS))
def q_dq_cross_column(ctx):
    return _union([Q.violation_counts(_df(ctx, t), t, Q.sql_rules(c)) for t, c in Q.CROSS_CHECKS.items()])


@register("dq_issue_rows", with_views(["b_inv"], """
SELECT 'fact_inventory_snapshots' AS table_name, snapshot_id AS row_identifier, 'below_reorder_point' AS issue_type,
  'warning' AS severity, 'batch-1' AS batch_id,
  'fact_inventory_snapshots row ' || snapshot_id || ' violates below_reorder_point' AS issue_description,
  '2001-06-01 00:00:00' AS created_at, CAST(on_hand_quantity AS BIGINT) AS payload_on_hand
FROM b_inv WHERE NOT COALESCE(available_quantity > reorder_point, TRUE)"""))
def q_dq_issue_rows(ctx):
    """Issues of one table, appended to the issue table and read back."""
    from kestrel.session import scratch_path
    from kestrel.sources.sinks import sink_insert_if_absent
    table = "fact_inventory_snapshots"
    path = scratch_path(ctx.spark, "data_quality_issues")
    issues = Q.quality_issues(_df(ctx, table), table, F.col("snapshot_id"), Q.table_rules(table), "batch-1", ctx.as_of)
    sink_insert_if_absent(issues, path, ["issue_id"])
    return ctx.spark.read.parquet(path).select(
        "table_name", "row_identifier", "issue_type", "severity", "batch_id", "issue_description", "created_at",
        F.get_json_object("raw_payload", "$.on_hand_quantity").cast("double").cast("long").alias("payload_on_hand"))


@register("dq_unique", with_views(_views(Q.UNIQUE_KEYS), "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS duplicated_keys FROM "
    f"(SELECT 1 FROM {_VIEW[t]} GROUP BY {', '.join(k)} HAVING COUNT(*) > 1)" for t, k in Q.UNIQUE_KEYS.items())))
def q_dq_unique(ctx):
    return _union([Q.unique_violations(_df(ctx, t), t, keys, "unique").groupBy().agg(
        F.count(F.lit(1)).alias("duplicated_keys")).select(F.lit(t).alias("table_name"), "duplicated_keys")
        for t, keys in Q.UNIQUE_KEYS.items()])


def _enum_sql() -> str:
    parts = []
    for t, cols in Q.ENUM_COLUMNS.items():
        for c, e in cols.items():
            values = ", ".join(f"'{v}'" for v in S.ENUMS[e])
            parts.append(f"SELECT '{t}' AS table_name, '{c}_in_{e}' AS rule_name, "
                         f"COUNT(*) FILTER (WHERE {c} NOT IN ({values})) AS violations FROM {_VIEW[t]}")
    return with_views(_views(Q.ENUM_COLUMNS), "\nUNION ALL\n".join(parts))


@register("dq_enum", _enum_sql())
def q_dq_enum(ctx):
    return _union([Q.violation_counts(_df(ctx, t), t, Q.enum_rules(cols)).select("table_name", "rule_name", "violations")
                   for t, cols in Q.ENUM_COLUMNS.items()])


@register("dq_not_null", with_views(_views(Q.REQUIRED), "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}_not_null' AS rule_name, COUNT(*) - COUNT({c}) AS violations FROM {_VIEW[t]}"
    for t, cols in Q.REQUIRED.items() for c in cols)))
def q_dq_not_null(ctx):
    return _union([Q.violation_counts(_df(ctx, t), t, Q.not_null_rules(cols)).select("table_name", "rule_name", "violations")
                   for t, cols in Q.REQUIRED.items()])


def _fk_tables(keys: dict) -> list[str]:
    return [*keys, *(p for fks in keys.values() for _, p, _ in fks)]


@register("dq_foreign_keys", with_views(_views(_fk_tables(Q.FOREIGN_KEYS)), "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{fk}_references_{pk}' AS rule_name, COUNT(*) AS orphans FROM {_VIEW[t]} c "
    f"WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_VIEW[parent]} p WHERE p.{pk} = c.{fk})"
    for t, fks in Q.FOREIGN_KEYS.items() for fk, parent, pk in fks)))
def q_dq_foreign_keys(ctx):
    out = []
    for t, fks in Q.FOREIGN_KEYS.items():
        for fk, parent, pk in fks:
            v = Q.fk_violations(_df(ctx, t), t, fk, _df(ctx, parent), pk, fk)
            out.append(v.groupBy().agg(F.count(F.lit(1)).alias("orphans")).select(
                F.lit(t).alias("table_name"), F.lit(f"{fk}_references_{pk}").alias("rule_name"), "orphans"))
    return _union(out)


@register("join_fk_check", with_views(["b_po", "dim_suppliers"], """
SELECT s.supplier_code, COUNT(*) AS orders, CAST(SUM(ordered_quantity) AS BIGINT) AS ordered
FROM b_po LEFT JOIN dim_suppliers s ON s.supplier_id = b_po.supplier_id GROUP BY 1"""))
def q_join_fk_check(ctx):
    """Orders joined to their supplier; orphans would stand under a null code."""
    po = _df(ctx, "fact_purchase_orders").join(_df(ctx, "dim_suppliers").select("supplier_id", "supplier_code"), "supplier_id", "left")
    return po.groupBy("supplier_code").agg(F.count(F.lit(1)).alias("orders"),
                                           F.sum("ordered_quantity").cast("long").alias("ordered"))


@register("dq_report_orders", with_views(["orders_f"], """
SELECT COUNT(*) AS rows, CAST(54 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS duplicate_rows,
  COUNT(*) AS product_description_nulls, COUNT(*) FILTER (WHERE order_id % 5 = 0) AS order_zipcode_nulls,
  COUNT(*) FILTER (WHERE late_delivery_flag = 1) AS late_delivery_count FROM orders_f"""))
def q_dq_report_orders(ctx):
    return etl.dq_report_orders(etl.normalize_na_tokens(ctx.raw_orders()))


@register("dq_report_skus", with_views(["skus_f"], """
SELECT COUNT(*) AS rows, CAST(24 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS duplicate_rows,
  COUNT(*) FILTER (WHERE defect_rate_raw > 1) AS defect_rate_out_of_range_count,
  COUNT(*) FILTER (WHERE inspection_result = 'Pending') AS pending_inspection_count FROM skus_f"""))
def q_dq_report_skus(ctx):
    return etl.dq_report_skus(etl.normalize_na_tokens(ctx.raw_skus()))


@register("dq_catalog_check")
def q_dq_catalog_check(ctx):
    """Publish the warehouse as session views, then check the catalogue."""
    from kestrel.plans.warehouse_views import publish
    publish(ctx)
    return Q.catalog_check(ctx.spark, S.WAREHOUSE_TABLES + S.BI_VIEWS)
