"""Declarative data-quality rules that emit violation rows or counts.

A rule is a boolean Column that must hold; as in SQL CHECK constraints a
null result passes.  Row rules are evaluated in one projection per table
(no shuffle); uniqueness rules are one aggregation; foreign keys are
anti-joins.  Violations follow the data-quality issue table shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import schemas as S


@dataclass(frozen=True)
class Rule:
    name: str
    check: Column
    severity: str = "error"


def _failed(rule: Rule) -> Column:
    return ~F.coalesce(rule.check, F.lit(True))


def violations(df: DataFrame, table: str, key: Column, rules: list[Rule]) -> DataFrame:
    """One issue row per (row, failed rule)."""
    hits = F.array(*[F.when(_failed(r), F.struct(F.lit(r.name).alias("rule_name"),
                                                 F.lit(r.severity).alias("severity")))
                     for r in rules])
    return (df.select(key.cast("string").alias("record_key"),
                      F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("v"))
            .select(F.lit(table).alias("table_name"), "record_key", "v.rule_name", "v.severity"))


def violation_counts(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """(table, rule, severity, violations) for every rule, zeros included."""
    agg = df.agg(*[F.count_if(_failed(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    cells = [F.struct(F.lit(table).alias("table_name"), F.lit(r.name).alias("rule_name"),
                      F.lit(r.severity).alias("severity"), F.col(f"r{i}").cast("long").alias("violations"))
             for i, r in enumerate(rules)]
    return agg.select(F.inline(F.array(*cells)))


def unique_violations(df: DataFrame, table: str, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once (partial counts before the shuffle)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.select(F.lit(table).alias("table_name"),
                      F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("record_key"),
                      F.lit(rule).alias("rule_name"), F.lit("error").alias("severity"))


def enum_rules(columns: dict[str, str]) -> list[Rule]:
    """column -> enum name; value must be in the domain."""
    return [Rule(f"{c}_in_{e}", F.col(c).isin(*S.ENUMS[e])) for c, e in columns.items()]


def not_null_rules(columns: list[str]) -> list[Rule]:
    return [Rule(f"{c}_not_null", F.col(c).isNotNull()) for c in columns]


def fk_violations(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str,
                  key: str) -> DataFrame:
    """Child rows whose (non-null) foreign key has no parent row."""
    orphans = (child.where(F.col(fk).isNotNull())
               .join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti"))
    return orphans.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_key"),
                          F.lit(f"{fk}_references_{pk}").alias("rule_name"), F.lit("error").alias("severity"))


# --- rule sets of the warehouse tables -----------------------------------------------------
# The constraints of the stored tables, each as the SQL predicate that must hold.

_SCORES = ["delivery_score", "quality_score", "cost_score", "reliability_score", "overall_score"]

RANGE_CHECKS = {
    "dim_products": {"unit_cost_non_negative": "unit_cost >= 0", "unit_price_non_negative": "unit_price >= 0"},
    "dim_suppliers": {"lead_time_non_negative": "default_lead_time_days >= 0"},
    "fact_purchase_orders": {"ordered_quantity_positive": "ordered_quantity > 0",
                             "received_quantity_non_negative": "received_quantity >= 0",
                             "defect_quantity_non_negative": "defect_quantity >= 0",
                             "unit_cost_non_negative": "unit_cost >= 0"},
    "fact_inventory_snapshots": {"on_hand_non_negative": "on_hand_quantity >= 0",
                                 "reserved_non_negative": "reserved_quantity >= 0",
                                 "reorder_point_non_negative": "reorder_point >= 0",
                                 "safety_stock_non_negative": "safety_stock >= 0",
                                 "unit_cost_snapshot_non_negative": "unit_cost >= 0"},
    "fact_sales_demand": {"demanded_non_negative": "quantity_demanded >= 0", "sold_non_negative": "quantity_sold >= 0",
                          "lost_non_negative": "lost_sales_quantity >= 0", "revenue_non_negative": "revenue >= 0"},
    "fact_shipments": {"shipped_positive": "shipped_quantity > 0", "delivered_non_negative": "delivered_quantity >= 0",
                       "freight_non_negative": "freight_cost >= 0", "distance_non_negative": "distance_km >= 0"},
    "supplier_performance_scores": {f"{s}_between_0_100": f"{s} BETWEEN 0 AND 100" for s in _SCORES},
    "demand_forecasts": {"horizon_positive": "forecast_horizon_days > 0", "predicted_non_negative": "predicted_quantity >= 0"},
    "shipment_delay_predictions": {"probability_between_0_1": "predicted_delay_probability BETWEEN 0 AND 1",
                                   "delay_days_non_negative": "predicted_delay_days >= 0"},
    "inventory_recommendations": {"current_stock_non_negative": "current_stock >= 0",
                                  "forecasted_demand_non_negative": "forecasted_demand >= 0",
                                  "reorder_point_non_negative": "reorder_point >= 0",
                                  "recommended_order_non_negative": "recommended_order_quantity >= 0",
                                  "safety_stock_non_negative": "safety_stock >= 0"},
}

CROSS_CHECKS = {
    "fact_purchase_orders": {
        "dates_valid": "expected_delivery_date >= order_date AND "
                       "(actual_delivery_date IS NULL OR actual_delivery_date >= order_date)",
        "received_le_ordered": "received_quantity <= ordered_quantity",
        "defects_le_received": "defect_quantity <= received_quantity"},
    "fact_inventory_snapshots": {"reserved_le_on_hand": "reserved_quantity <= on_hand_quantity",
                                 "below_reorder_point": "available_quantity > reorder_point"},
    "fact_sales_demand": {"sold_plus_lost_le_demanded": "quantity_sold + lost_sales_quantity <= quantity_demanded"},
    "fact_shipments": {"delivered_le_shipped": "delivered_quantity <= shipped_quantity",
                       "expected_after_ship": "expected_delivery_date >= ship_date",
                       "actual_after_ship": "actual_delivery_date >= ship_date"},
}
WARNINGS = {"below_reorder_point"}

UNIQUE_KEYS = {
    "dim_locations": ["location_code"], "dim_products": ["sku"], "dim_suppliers": ["supplier_code"],
    "dim_carriers": ["carrier_code"], "fact_purchase_orders": ["po_number"], "fact_shipments": ["shipment_number"],
    "fact_inventory_snapshots": ["snapshot_date", "product_id", "location_id"],
    "fact_sales_demand": ["demand_date", "product_id", "location_id"],
    "demand_forecasts": ["product_id", "location_id", "forecast_date", "forecast_horizon_days"],
    "shipment_delay_predictions": ["shipment_id"],
    "inventory_recommendations": ["product_id", "location_id", "recommendation_date"],
}

ENUM_COLUMNS = {
    "dim_locations": {"location_type": "location_type"}, "dim_carriers": {"transport_mode": "transport_mode"},
    "fact_purchase_orders": {"status": "purchase_order_status"}, "fact_shipments": {"status": "shipment_status"},
    "shipment_delay_predictions": {"risk_level": "risk_level"}, "supplier_performance_scores": {"risk_tier": "risk_level"},
    "inventory_recommendations": {"priority": "risk_level", "status": "recommendation_status"},
    "business_recommendations": {"recommendation_type": "recommendation_type", "severity": "risk_level",
                                 "status": "recommendation_status"},
}

REQUIRED = {
    "dim_locations": ["location_code", "location_name", "location_type"],
    "dim_products": ["sku", "product_name", "unit_cost", "unit_price"],
    "dim_suppliers": ["supplier_code", "supplier_name", "country"],
    "dim_carriers": ["carrier_code", "carrier_name", "transport_mode"],
    "fact_purchase_orders": ["po_number", "supplier_id", "product_id", "order_date", "expected_delivery_date",
                             "ordered_quantity", "received_quantity", "unit_cost", "status", "defect_quantity"],
    "fact_sales_demand": ["demand_date", "product_id", "location_id", "quantity_demanded", "quantity_sold",
                          "lost_sales_quantity", "revenue"],
    "fact_inventory_snapshots": ["snapshot_date", "product_id", "location_id", "on_hand_quantity", "reserved_quantity",
                                 "reorder_point", "safety_stock", "unit_cost"],
    "fact_shipments": ["shipment_number", "product_id", "destination_location_id", "ship_date", "expected_delivery_date",
                       "shipped_quantity", "delivered_quantity", "freight_cost", "status"],
    "demand_forecasts": ["product_id", "location_id", "forecast_date", "forecast_horizon_days", "predicted_quantity"],
    "shipment_delay_predictions": ["shipment_id", "predicted_delay_probability", "risk_level"],
    "supplier_performance_scores": ["supplier_id", "score_date", *_SCORES, "risk_tier"],
    "inventory_recommendations": ["product_id", "location_id", "recommendation_date", "current_stock", "forecasted_demand",
                                  "reorder_point", "recommended_order_quantity", "safety_stock", "priority", "status"],
    "business_recommendations": ["recommendation_type", "severity", "status"],
}

# child table -> (foreign key column, parent table, parent key)
FOREIGN_KEYS = {
    "fact_purchase_orders": [("supplier_id", "dim_suppliers", "supplier_id"), ("product_id", "dim_products", "product_id")],
    "fact_sales_demand": [("product_id", "dim_products", "product_id"), ("location_id", "dim_locations", "location_id")],
    "fact_inventory_snapshots": [("product_id", "dim_products", "product_id"), ("location_id", "dim_locations", "location_id")],
    "fact_shipments": [("carrier_id", "dim_carriers", "carrier_id"), ("supplier_id", "dim_suppliers", "supplier_id"),
                       ("product_id", "dim_products", "product_id"), ("source_location_id", "dim_locations", "location_id"),
                       ("destination_location_id", "dim_locations", "location_id")],
    "demand_forecasts": [("product_id", "dim_products", "product_id"), ("location_id", "dim_locations", "location_id")],
    "shipment_delay_predictions": [("shipment_id", "fact_shipments", "shipment_id")],
    "supplier_performance_scores": [("supplier_id", "dim_suppliers", "supplier_id")],
    "inventory_recommendations": [("product_id", "dim_products", "product_id"), ("location_id", "dim_locations", "location_id")],
    "business_recommendations": [("inventory_recommendation_id", "inventory_recommendations", "inventory_recommendation_id"),
                                 ("product_id", "dim_products", "product_id"), ("location_id", "dim_locations", "location_id")],
}


def sql_rules(checks: dict[str, str]) -> list[Rule]:
    return [Rule(name, F.expr(text), "warning" if name in WARNINGS else "error") for name, text in checks.items()]


def table_rules(table: str) -> list[Rule]:
    """Every row rule of a stored table."""
    return [*sql_rules(RANGE_CHECKS.get(table, {})), *sql_rules(CROSS_CHECKS.get(table, {})),
            *enum_rules(ENUM_COLUMNS.get(table, {})), *not_null_rules(REQUIRED.get(table, []))]


def quality_issues(df: DataFrame, table: str, key: Column, rules: list[Rule], batch_id: str, as_of) -> DataFrame:
    """Violations in the full shape of the data-quality issue table: batch,
    issue type and description, severity, the row as JSON, and times."""
    hits = F.array(*[F.when(_failed(r), F.struct(F.lit(r.name).alias("rule_name"),
                                                 F.lit(r.severity).alias("severity"))) for r in rules])
    found = df.select(key.cast("string").alias("row_identifier"), F.to_json(F.struct(*df.columns)).alias("raw_payload"),
                      F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("v"))
    at = F.lit(as_of).cast("timestamp")
    return found.select(
        F.sha2(F.concat_ws("|", F.lit(batch_id), F.lit(table), "row_identifier", "v.rule_name"), 256).alias("issue_id"),
        F.lit(batch_id).alias("batch_id"), F.lit(table).alias("table_name"), "row_identifier", F.col("v.severity").alias("severity"),
        F.col("v.rule_name").alias("issue_type"),
        F.concat(F.lit(f"{table} row "), F.coalesce("row_identifier", F.lit("?")), F.lit(" violates "), F.col("v.rule_name"))
        .alias("issue_description"), "raw_payload", at.alias("created_at"), at.alias("updated_at"))


def catalog_check(spark: SparkSession, expected: list[str]) -> DataFrame:
    """Expected tables / views against the session catalogue (metadata only)."""
    present = {t.name for t in spark.catalog.listTables()}
    rows = [(name, name in present) for name in expected]
    return spark.createDataFrame(rows, "name string, present boolean")
