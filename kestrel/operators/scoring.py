"""Supplier scorecard, inventory optimiser and what-if re-scoring.

Global statistics (min/max for normalisation, the lead-time median) are
one-row aggregates joined back as a broadcast side: no data row ever goes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import columns as C

# Scorecard weights and optimiser constants.
SCORE_WEIGHTS = {"quality": 0.30, "delivery": 0.25, "cost": 0.25, "reliability": 0.20}
SERVICE_Z = 1.65
DEMAND_PERIOD_DAYS = 30
DEMAND_CV = 0.3
WHATIF_DEMAND_CV = 0.22
WHATIF_DEFAULT_LEAD = 10
WHATIF_DEFAULT_DEMAND = 20.0
DEFAULT_UNIT_COST = 10.0
PRICE_MARKUP = 1.5


def agg_supplier_profile(skus: DataFrame) -> DataFrame:
    """11 named aggregates per supplier (sample std; one-row group -> 0)."""
    return (skus.where(F.col("supplier_name").isNotNull())
            .groupBy("supplier_name").agg(
                F.count("sku").alias("total_skus"),
                F.avg("quality_pass_flag").alias("pass_rate"),
                F.avg("quality_fail_flag").alias("fail_rate"),
                F.avg("defect_rate_raw").alias("avg_defect"),
                F.avg("lead_time_gap_days").alias("avg_lead_time_gap"),
                F.coalesce(F.stddev_samp("lead_time_gap_days"), F.lit(0.0)).alias("lead_time_std"),
                F.avg("manufacturing_cost_per_unit").alias("avg_mfg_cost"),
                F.avg("shipping_cost_per_unit").alias("avg_ship_cost"),
                F.avg("sell_through_rate").alias("avg_sell_through"),
                F.avg("stock_levels").alias("avg_stock"),
                F.avg("products_sold").alias("avg_sold")))


def minmax_normalize(df: DataFrame, columns: dict[str, tuple[Column, bool]]) -> DataFrame:
    """0-100 scaling of each expression over the whole frame.

    ``columns`` maps output name -> (expression, invert).  A constant
    column (max == min) scores 50.  min/max come from one global aggregate
    that is broadcast back (partial aggregation, no collect).
    """
    base = df.withColumns({f"_x_{k}": e for k, (e, _) in columns.items()})
    stats = base.agg(*[F.min(f"_x_{k}").alias(f"_mn_{k}") for k in columns],
                     *[F.max(f"_x_{k}").alias(f"_mx_{k}") for k in columns])
    joined = base.crossJoin(F.broadcast(stats))
    out = {}
    for k, (_, invert) in columns.items():
        x, mn, mx = F.col(f"_x_{k}"), F.col(f"_mn_{k}"), F.col(f"_mx_{k}")
        normed = (x - mn) / (mx - mn) * F.lit(100.0)
        if invert:
            normed = F.lit(100.0) - normed
        out[k] = F.when(mx - mn == 0, F.lit(50.0)).otherwise(normed)
    drop = [c for k in columns for c in (f"_x_{k}", f"_mn_{k}", f"_mx_{k}")]
    return joined.withColumns(out).drop(*drop)


def score_suppliers(skus: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Weighted composite supplier score with right-closed risk tiers."""
    prof = agg_supplier_profile(skus)
    n = minmax_normalize(prof, {
        "_pass": (F.col("pass_rate"), False),
        "_defect": (F.col("avg_defect"), True),
        "delivery_score": (F.col("avg_lead_time_gap"), True),
        "cost_score": (F.col("avg_mfg_cost") + F.col("avg_ship_cost"), True),
        "reliability_score": (F.col("lead_time_std"), True),
    })
    n = n.withColumn("quality_score", F.col("_pass") * F.lit(0.6) + F.col("_defect") * F.lit(0.4)).drop(
        "_pass", "_defect")
    overall = (F.col("quality_score") * F.lit(weights["quality"])
               + F.col("delivery_score") * F.lit(weights["delivery"])
               + F.col("cost_score") * F.lit(weights["cost"])
               + F.col("reliability_score") * F.lit(weights["reliability"]))
    n = n.withColumn("overall_score", C.round_half_even(overall, 2))
    return n.withColumn("risk_tier", C.risk_tier_cut("overall_score"))


def sort_suppliers(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("overall_score").desc(), F.col("supplier_name"))


def agg_tier_counts(scores: DataFrame) -> DataFrame:
    t = F.col("risk_tier")
    return scores.agg(F.count(F.lit(1)).alias("suppliers_scored"),
                      F.count_if(t == "Low Risk").alias("low_risk_count"),
                      F.count_if(t == "Medium Risk").alias("medium_risk_count"),
                      F.count_if(t == "High Risk").alias("high_risk_count"))


def rescore_suppliers(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """What-if: overall = sum(score_i * w_i) / sum(w); weight sum 0 -> unchanged.

    Missing / zero component scores read as 0 (``parseFloat(x || 0)``).
    """
    total = sum(weights.values())
    if total == 0:
        return scores
    comp = lambda c: F.coalesce(C.col(c).cast("double"), F.lit(0.0))
    computed = ((comp("quality_score") * F.lit(float(weights["quality"]))
                 + comp("delivery_score") * F.lit(float(weights["delivery"]))
                 + comp("cost_score") * F.lit(float(weights["cost"]))
                 + comp("reliability_score") * F.lit(float(weights["reliability"])))
                / F.lit(float(total)))
    return (scores.withColumn("overall_score", computed)
            .withColumn("risk_tier", C.risk_tier_whatif("overall_score")))


def supplier_metric_unpivot(scores: DataFrame) -> DataFrame:
    """One row per (supplier, metric) with the score rounded like Math.round."""
    metrics = {"quality_score": "Quality", "delivery_score": "Delivery",
               "cost_score": "Cost", "reliability_score": "Reliability"}
    long = scores.select("supplier_name", *[F.col(c).cast("double").alias(m) for c, m in metrics.items()]
                         ).unpivot("supplier_name", list(metrics.values()), "metric", "raw")
    return long.select("supplier_name", "metric", C.js_round("raw").cast("long").alias("score"))


# --- inventory ------------------------------------------------------------------

def optimize_inventory(skus: DataFrame, z: float = SERVICE_Z, period_days: int = DEMAND_PERIOD_DAYS,
                       cv: float = DEMAND_CV) -> DataFrame:
    """Safety stock, reorder point, days of stock, risk flag, reorder
    quantity and revenue at risk per SKU (pandas half-even rounding)."""
    inv = skus.select("sku", "product_type", "supplier_name", "stock_levels", "products_sold",
                      "source_lead_time_days", "availability", "revenue_generated", "product_price")
    # exact median of the lead time from distributed ranks (one small row)
    from kestrel.operators.ranks import median
    med = median(inv, "source_lead_time_days").select(F.col("median").alias("_med_lead"))
    inv = inv.crossJoin(F.broadcast(med))
    avg_d = F.col("products_sold") / F.lit(float(period_days))
    inv = inv.withColumns({
        "avg_daily_demand": avg_d,
        "std_daily_demand": avg_d * F.lit(cv),
        "lead_time_days": F.coalesce(F.col("source_lead_time_days"), F.col("_med_lead")),
    }).drop("_med_lead")
    inv = inv.withColumn("safety_stock", C.round_half_even(
        F.lit(z) * F.col("std_daily_demand") * F.sqrt("lead_time_days"), 1))
    inv = inv.withColumn("reorder_point", C.round_half_even(
        F.col("avg_daily_demand") * F.col("lead_time_days") + F.col("safety_stock"), 1))
    inv = inv.withColumn("days_of_inventory", F.when(
        F.col("avg_daily_demand") > 0,
        C.round_half_even(F.col("stock_levels") / F.col("avg_daily_demand"), 1)))
    inv = inv.withColumn("stockout_risk",
                         F.coalesce(F.col("stock_levels") < F.col("reorder_point"), F.lit(False)).cast("long"))
    gap = F.col("reorder_point") - F.col("stock_levels") + F.col("safety_stock")
    inv = inv.withColumn("reorder_qty", F.when(
        F.col("stockout_risk") == 1, C.round_half_even(F.greatest(gap, F.lit(0.0)), 0)).otherwise(F.lit(0.0)))
    return inv.withColumn("revenue_at_risk", F.when(
        F.col("stockout_risk") == 1,
        C.round_half_even(F.col("reorder_qty") * F.col("product_price"), 2)).otherwise(F.lit(0.0)))


def agg_inventory_metrics(inv: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    at = F.sum("stockout_risk")
    return inv.agg(
        n.alias("skus_analyzed"), at.cast("long").alias("at_stockout_risk"),
        F.bround(at.cast("decimal(38,9)") * 100 / n, 1).cast("double").alias("stockout_risk_pct"),
        F.bround(F.sum(F.col("revenue_at_risk").cast("decimal(38,9)")), 2).cast("double")
         .alias("total_revenue_at_risk"),
        F.bround(F.avg(F.col("safety_stock").cast("decimal(38,9)")), 1).cast("double").alias("avg_safety_stock"),
        F.bround(F.avg(F.col("reorder_point").cast("decimal(38,9)")), 1).cast("double").alias("avg_reorder_point"),
        F.bround(F.avg(F.col("days_of_inventory").cast("decimal(38,9)")), 1).cast("double")
         .alias("avg_days_of_inventory"))


def agg_risk_by_type(inv: DataFrame) -> DataFrame:
    return inv.groupBy("product_type").agg(
        F.bround(F.sum(F.col("stockout_risk")).cast("decimal(38,9)") * 100 / F.count("stockout_risk"), 4)
         .cast("double").alias("stockout_risk_pct"))


def reoptimize_service_level(inv: DataFrame, service_level: int = 95,
                             cv: float = WHATIF_DEMAND_CV) -> DataFrame:
    """What-if at 90/95/99 % service: integer (Math.round) stock figures.

    ``x || default`` semantics: zero or missing lead time / demand / cost
    take the default; lead time and stock are truncated like parseInt.
    """
    z = C.z_for_service_level(F.lit(service_level))
    or_default = lambda c, d: F.when(F.coalesce(C.col(c).cast("double"), F.lit(0.0)) == 0, F.lit(d)
                                     ).otherwise(C.col(c).cast("double"))
    lead = F.floor(or_default("lead_time_days", float(WHATIF_DEFAULT_LEAD)))
    demand = or_default("avg_daily_demand", WHATIF_DEFAULT_DEMAND)
    stock = F.floor(or_default("stock_levels", 0.0)) if "stock_levels" in inv.columns else F.lit(0)
    unit_cost = or_default("unit_cost", DEFAULT_UNIT_COST) if "unit_cost" in inv.columns \
        else F.lit(DEFAULT_UNIT_COST)
    out = inv.withColumns({"_lead": lead, "_demand": demand, "_stock": stock,
                           "_price": unit_cost * F.lit(PRICE_MARKUP)})
    out = out.withColumn("safety_stock", C.js_round(
        z * (F.col("_demand") * F.lit(cv)) * F.sqrt("_lead")).cast("long"))
    out = out.withColumn("reorder_point", C.js_round(
        F.col("_demand") * F.col("_lead") + F.col("safety_stock")).cast("long"))
    risk = F.col("_stock") < F.col("reorder_point")
    out = out.withColumn("stockout_risk", risk.cast("long"))
    out = out.withColumn("revenue_at_risk", F.when(
        risk, C.js_round((F.col("reorder_point") - F.col("_stock")) * F.col("_price"))).otherwise(F.lit(0))
        .cast("long"))
    return out.drop("_lead", "_demand", "_stock", "_price")


def stockout_risk_recompute(rows: DataFrame) -> DataFrame:
    """Serving-layer flag and revenue at risk from stored rows."""
    stock = C.safe_int("stock_levels", 0)
    rop = C.safe_int("reorder_point", 0)
    cost = C.safe_float("unit_cost", DEFAULT_UNIT_COST) if "unit_cost" in rows.columns \
        else F.lit(DEFAULT_UNIT_COST)
    risk = stock < rop
    return rows.withColumns({
        "stockout_risk": risk.cast("long"),
        "revenue_at_risk": F.when(risk, C.round_half_even((rop - stock) * (cost * F.lit(PRICE_MARKUP)), 2))
                            .otherwise(F.lit(0.0)),
    })


def inventory_pie(inv: DataFrame) -> DataFrame:
    """At-risk vs safe counts (two rows; no artificial floor)."""
    agg = inv.agg(F.count_if(C.safe_int("stockout_risk") == 1).alias("at_risk"),
                  F.count(F.lit(1)).alias("total"))
    return agg.select(F.inline(F.array(
        F.struct(F.lit("At Risk").alias("name"), F.col("at_risk").cast("long").alias("value")),
        F.struct(F.lit("Safe").alias("name"), (F.col("total") - F.col("at_risk")).cast("long").alias("value")))))


def stock_vs_demand_points(inv: DataFrame) -> DataFrame:
    return inv.select(F.col("sku").alias("name"),
                      F.coalesce(F.col("avg_daily_demand").cast("double"), F.lit(0.0)).alias("demand"),
                      F.coalesce(F.col("stock_levels").cast("double"), F.lit(0.0)).alias("stock"),
                      (C.safe_int("stockout_risk") == 1).alias("is_risk"))


# --- seeding rows for the warehouse ----------------------------------------------

def seed_recommendations(inv: DataFrame, location_id, recommendation_date) -> DataFrame:
    """Optimiser rows -> inventory recommendation rows."""
    risk = F.col("stockout_risk") == 1
    return inv.select(
        F.col("sku"),
        F.lit(location_id).alias("location_id"),
        F.lit(recommendation_date).cast("date").alias("recommendation_date"),
        F.col("stock_levels").cast("long").alias("current_stock"),
        (F.col("avg_daily_demand") * F.lit(30.0)).alias("forecasted_demand"),
        F.col("reorder_point").cast("long").alias("reorder_point"),
        F.col("reorder_qty").cast("long").alias("recommended_order_quantity"),
        F.col("safety_stock").cast("long").alias("safety_stock"),
        F.when(risk, "high").otherwise("low").alias("priority"),
        F.lit("open").alias("status"),
        C.rationale_text("stock_levels", "reorder_point", "stockout_risk").alias("rationale"))


def seed_suppliers(scores: DataFrame) -> DataFrame:
    """Supplier dimension rows from scored suppliers (code = slug of name)."""
    return scores.select(
        C.slug_code("supplier_name").alias("supplier_code"), "supplier_name",
        C.country_from_name("supplier_name").alias("country"),
        C.region_from_name("supplier_name").alias("region"),
        F.lit(10).alias("default_lead_time_days"), F.lit("active").alias("contract_status"))


def seed_supplier_scores(scores: DataFrame, score_date) -> DataFrame:
    return scores.select(
        C.slug_code("supplier_name").alias("supplier_code"),
        F.lit(score_date).cast("date").alias("score_date"),
        *[F.col(c).cast("double").alias(c) for c in
          ["quality_score", "delivery_score", "cost_score", "reliability_score", "overall_score"]],
        C.normalize_risk_tier("risk_tier").alias("risk_tier"))


def seed_products(skus: DataFrame) -> DataFrame:
    """Product rows from SKUs: one per SKU (first by SKU order), cost defaults."""
    cost = F.col("unit_cost").cast("double") if "unit_cost" in skus.columns else F.lit(DEFAULT_UNIT_COST)
    price = cost * F.lit(PRICE_MARKUP) if "unit_cost" in skus.columns else F.lit(15.0)
    rows = skus.select(F.col("sku").cast("string").alias("sku"), "product_type",
                       cost.alias("unit_cost"), price.alias("unit_price"))
    first = rows.groupBy("sku").agg(F.min_by(F.struct("product_type", "unit_cost", "unit_price"),
                                             F.col("product_type")).alias("r"))
    return first.select(
        "sku", F.format_string("%s (SKU: %s)", F.col("r.product_type"), F.col("sku")).alias("product_name"),
        F.col("r.product_type").alias("category"), F.col("r.unit_cost").alias("unit_cost"),
        F.col("r.unit_price").alias("unit_price"), F.lit(True).alias("is_active"))

