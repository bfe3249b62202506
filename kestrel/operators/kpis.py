"""Shipment, inventory and supplier KPI aggregates.

Money is summed as DECIMAL(38,9) so the totals are exact and independent
of partitioning / summation order; rounding is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.functions import columns as C


def dsum(c) -> Column:
    """Exact sum of a double column (order independent)."""
    return F.sum(C.col(c).cast("decimal(38,9)"))


def _ratio_pct(num: Column, den: Column, scale: int = 2) -> Column:
    """Python ``round``: ties go to the even digit."""
    return F.bround(F.try_divide(num.cast("decimal(38,9)") * 100, den.cast("decimal(38,9)")), scale)


def find_column_alias(df: DataFrame, aliases: list[str]) -> str | None:
    """First column whose lower-case name is one of ``aliases`` (plan time)."""
    wanted = [a.lower() for a in aliases]
    for c in df.columns:
        if c.lower() in wanted:
            return c
    return None


def agg_shipment_kpis(df: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """orders, late, on-time %, sales, profit and margin % (global or grouped).

    Columns are resolved through the alias lists, so the same operator runs
    over the feature table and over user datasets with other headers.
    """
    late_c = find_column_alias(df, S.KPI_LATE_ALIASES)
    sales_c = find_column_alias(df, S.KPI_SALES_ALIASES)
    profit_c = find_column_alias(df, S.KPI_PROFIT_ALIASES)
    late = C.safe_float(F.col(late_c)) if late_c else F.lit(0.0)
    sales = C.safe_float(F.col(sales_c)) if sales_c else F.lit(0.0)
    profit = C.safe_float(F.col(profit_c)) if profit_c else F.lit(0.0)
    aggs = [F.count(F.lit(1)).alias("total_orders"),
            dsum(late).alias("_late"),
            F.bround(dsum(sales), 2).alias("_sales"),
            F.bround(dsum(profit), 2).alias("_profit")]
    g = df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)
    late_n = F.col("_late").cast("long")
    on_time = F.when(F.col("total_orders") > 0,
                     _ratio_pct(F.col("total_orders") - late_n, F.col("total_orders"))).otherwise(F.lit(100))
    margin = F.coalesce(_ratio_pct(F.col("_profit"), F.nullif(F.col("_sales"), F.lit(0))), F.lit(0))
    return g.select(*(group_by or []),
                    F.col("total_orders").cast("long").alias("total_orders"),
                    late_n.alias("late_shipments"),
                    on_time.cast("double").alias("on_time_delivery_rate_pct"),
                    F.col("_sales").cast("double").alias("total_sales"),
                    F.col("_profit").cast("double").alias("total_profit"),
                    margin.cast("double").alias("avg_profit_margin_pct"))


def agg_inventory_kpis(inv: DataFrame) -> DataFrame:
    """SKUs at stockout risk, SKU count, revenue at risk."""
    return inv.agg(
        F.count_if(C.safe_int("stockout_risk") == 1).cast("long").alias("skus_at_stockout_risk"),
        F.count(F.lit(1)).cast("long").alias("total_skus"),
        F.coalesce(F.bround(dsum(C.safe_float("revenue_at_risk")), 2), F.lit(0)).cast("double")
         .alias("revenue_at_risk"))


def agg_supplier_kpis(suppliers: DataFrame) -> DataFrame:
    """Supplier count and high-risk count (tier lower-cased)."""
    tier = F.lower(F.coalesce(F.col("risk_tier").cast("string"), F.lit("")))
    return suppliers.agg(
        F.count_if(tier.isin(*C.HIGH_RISK_TIERS)).cast("long").alias("high_risk_suppliers"),
        F.count(F.lit(1)).cast("long").alias("total_suppliers"))


def executive_kpis(orders: DataFrame, inventory: DataFrame, suppliers: DataFrame) -> DataFrame:
    """11-field KPI row: three global aggregates joined as one-row sides."""
    return (agg_shipment_kpis(orders)
            .crossJoin(F.broadcast(agg_inventory_kpis(inventory)))
            .crossJoin(F.broadcast(agg_supplier_kpis(suppliers)))
            .select("total_orders", "on_time_delivery_rate_pct", "late_shipments", "total_sales",
                    "total_profit", "avg_profit_margin_pct", "skus_at_stockout_risk", "total_skus",
                    "revenue_at_risk", "high_risk_suppliers", "total_suppliers"))


def regional_kpis(orders: DataFrame) -> DataFrame:
    """Shipment KPIs per market and order region (real grouping)."""
    return agg_shipment_kpis(orders, ["market", "order_region"])
