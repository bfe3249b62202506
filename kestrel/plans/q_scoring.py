"""Scorecard, inventory optimiser, what-if and KPI-composition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.operators import kpis, scoring, seeding
from kestrel.plans.oracle_views import r, with_views
from kestrel.plans.registry import register
from kestrel.session import scratch_path


def _re(expr: str, scale: int) -> str:
    """pandas-style half-even rounding through DECIMAL(38,9)."""
    return f"CAST(ROUND_EVEN(CAST({expr} AS DECIMAL(38,9)), {scale}) AS DOUBLE)"


_PROFILE = """prof AS (
  SELECT supplier_name, COUNT(sku) AS total_skus, AVG(quality_pass_flag) AS pass_rate,
    AVG(quality_fail_flag) AS fail_rate, AVG(defect_rate_raw) AS avg_defect,
    AVG(lead_time_gap_days) AS avg_lead_time_gap,
    COALESCE(STDDEV_SAMP(lead_time_gap_days), 0.0) AS lead_time_std,
    AVG(manufacturing_cost_per_unit) AS avg_mfg_cost, AVG(shipping_cost_per_unit) AS avg_ship_cost,
    AVG(sell_through_rate) AS avg_sell_through, AVG(stock_levels) AS avg_stock, AVG(products_sold) AS avg_sold
  FROM skus_f WHERE supplier_name IS NOT NULL GROUP BY supplier_name)"""


def _norm(x: str, invert: bool) -> str:
    n = f"({x} - MIN({x}) OVER ()) / (MAX({x}) OVER () - MIN({x}) OVER ()) * 100.0"
    if invert:
        n = f"100.0 - {n}"
    return f"CASE WHEN MAX({x}) OVER () - MIN({x}) OVER () = 0 THEN 50.0 ELSE {n} END"


_SCORES = f"""{_PROFILE},
normed AS (
  SELECT *, {_norm('pass_rate', False)} * 0.6 + {_norm('avg_defect', True)} * 0.4 AS quality_score,
    {_norm('avg_lead_time_gap', True)} AS delivery_score,
    {_norm('(avg_mfg_cost + avg_ship_cost)', True)} AS cost_score,
    {_norm('lead_time_std', True)} AS reliability_score
  FROM prof),
scored AS (
  SELECT *, {_re('quality_score * 0.30 + delivery_score * 0.25 + cost_score * 0.25 + reliability_score * 0.20', 2)}
    AS overall_score FROM normed),
tiered AS (
  SELECT *, CASE WHEN overall_score > -1 AND overall_score <= 40 THEN 'High Risk'
                 WHEN overall_score > 40 AND overall_score <= 70 THEN 'Medium Risk'
                 WHEN overall_score > 70 AND overall_score <= 101 THEN 'Low Risk' END AS risk_tier
  FROM scored)"""


def _with_scores(body: str) -> str:
    return with_views(["skus_f"], "").rstrip() + f",\n{_SCORES}\n{body}"


_SCORE_COLS = ["quality_score", "delivery_score", "cost_score", "reliability_score"]


@register("agg_supplier_profile", with_views(["skus_f"], "") + f""",
{_PROFILE}
SELECT supplier_name, total_skus, {r('pass_rate', 6)} AS pass_rate, {r('avg_defect', 6)} AS avg_defect,
  {r('lead_time_std', 6)} AS lead_time_std, {r('avg_mfg_cost', 6)} AS avg_mfg_cost,
  {r('avg_sold', 6)} AS avg_sold FROM prof""")
def q_agg_supplier_profile(ctx):
    p = scoring.agg_supplier_profile(ctx.skus())
    return p.select("supplier_name", F.col("total_skus").cast("long").alias("total_skus"),
                    *[C.round_half_up(c, 6).alias(c) for c in
                      ["pass_rate", "avg_defect", "lead_time_std", "avg_mfg_cost", "avg_sold"]])


@register("score_suppliers", _with_scores(f"""
SELECT supplier_name, total_skus, {', '.join(r(c, 4) + ' AS ' + c for c in _SCORE_COLS)},
  overall_score, risk_tier FROM tiered"""))
def q_score_suppliers(ctx):
    s = scoring.score_suppliers(ctx.skus())
    return s.select("supplier_name", F.col("total_skus").cast("long").alias("total_skus"),
                    *[C.round_half_up(c, 4).alias(c) for c in _SCORE_COLS], "overall_score", "risk_tier")


@register("minmax_normalize", _with_scores(f"""
SELECT supplier_name, {r(_norm('lead_time_std', True), 4)} AS reliability_score,
  {r(_norm('avg_sold', False), 4)} AS sold_score FROM prof"""))
def q_minmax_normalize(ctx):
    n = scoring.minmax_normalize(scoring.agg_supplier_profile(ctx.skus()), {
        "reliability_score": (F.col("lead_time_std"), True), "sold_score": (F.col("avg_sold"), False)})
    return n.select("supplier_name", C.round_half_up("reliability_score", 4).alias("reliability_score"),
                    C.round_half_up("sold_score", 4).alias("sold_score"))


@register("sort_suppliers", _with_scores("""
SELECT supplier_name, overall_score, CAST(ROW_NUMBER() OVER (ORDER BY overall_score DESC, supplier_name)
  AS BIGINT) AS position FROM tiered"""))
def q_sort_suppliers(ctx):
    from kestrel.operators.latest import rank_leaderboard
    s = scoring.score_suppliers(ctx.skus()).select("supplier_name", "overall_score")
    return rank_leaderboard(s, "overall_score", "position")


@register("rank_leaderboard", _with_scores("""
SELECT supplier_name, overall_score, CAST(ROW_NUMBER() OVER (ORDER BY overall_score DESC, supplier_name)
  AS BIGINT) AS rank FROM tiered"""))
def q_rank_leaderboard(ctx):
    from kestrel.operators.latest import rank_leaderboard
    s = scoring.score_suppliers(ctx.skus()).select("supplier_name", "overall_score")
    return rank_leaderboard(s, "overall_score", "rank")


@register("agg_tier_counts", _with_scores("""
SELECT COUNT(*) AS suppliers_scored, COUNT(*) FILTER (WHERE risk_tier = 'Low Risk') AS low_risk_count,
  COUNT(*) FILTER (WHERE risk_tier = 'Medium Risk') AS medium_risk_count,
  COUNT(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk_count FROM tiered"""))
def q_agg_tier_counts(ctx):
    return scoring.agg_tier_counts(scoring.score_suppliers(ctx.skus()))


_RESCORE_W = {"quality": 0.1, "delivery": 0.5, "cost": 0.2, "reliability": 0.4}


@register("rescore_suppliers", _with_scores(f"""
SELECT supplier_name, {r('s', 4)} AS overall_score,
  CASE WHEN s >= 70 THEN 'Low Risk' WHEN s < 40 THEN 'High Risk' ELSE 'Medium Risk' END AS risk_tier
FROM (SELECT supplier_name, (quality_score * 0.1 + delivery_score * 0.5 + cost_score * 0.2
      + reliability_score * 0.4) / 1.2 AS s FROM tiered)"""))
def q_rescore_suppliers(ctx):
    s = scoring.rescore_suppliers(scoring.score_suppliers(ctx.skus()), _RESCORE_W)
    return s.select("supplier_name", C.round_half_up("overall_score", 4).alias("overall_score"), "risk_tier")


@register("supplier_metric_unpivot", _with_scores("""
SELECT supplier_name, metric, CAST(FLOOR(raw + 0.5) AS BIGINT) AS score FROM (
  SELECT supplier_name, 'Quality' AS metric, quality_score AS raw FROM tiered
  UNION ALL SELECT supplier_name, 'Delivery', delivery_score FROM tiered
  UNION ALL SELECT supplier_name, 'Cost', cost_score FROM tiered
  UNION ALL SELECT supplier_name, 'Reliability', reliability_score FROM tiered)"""))
def q_supplier_metric_unpivot(ctx):
    return scoring.supplier_metric_unpivot(scoring.score_suppliers(ctx.skus()))


# --- inventory ----------------------------------------------------------------------

_INV = """inv AS (
  SELECT *, CASE WHEN stockout_risk = 1 THEN {rq} ELSE 0.0 END AS reorder_qty FROM (
  SELECT *, CAST(COALESCE(stock_levels < reorder_point, FALSE) AS BIGINT) AS stockout_risk,
    CASE WHEN avg_daily_demand > 0 THEN {doi} END AS days_of_inventory FROM (
  SELECT *, {rop} AS reorder_point FROM (
  SELECT *, {ss} AS safety_stock FROM (
  SELECT sku, product_type, supplier_name, stock_levels, products_sold, source_lead_time_days, availability,
    revenue_generated, product_price, products_sold / 30.0 AS avg_daily_demand,
    products_sold / 30.0 * 0.3 AS std_daily_demand,
    COALESCE(source_lead_time_days, MEDIAN(source_lead_time_days) OVER ()) AS lead_time_days
  FROM skus_f))))),
opt AS (SELECT *, CASE WHEN stockout_risk = 1 THEN {rar} ELSE 0.0 END AS revenue_at_risk FROM inv)""".format(
    ss=_re("1.65 * std_daily_demand * SQRT(lead_time_days)", 1),
    rop=_re("avg_daily_demand * lead_time_days + safety_stock", 1),
    doi=_re("stock_levels / avg_daily_demand", 1),
    rq=_re("GREATEST(reorder_point - stock_levels + safety_stock, 0.0)", 0),
    rar=_re("reorder_qty * product_price", 2))


def _with_opt(body: str) -> str:
    return with_views(["skus_f"], "").rstrip() + f",\n{_INV}\n{body}"


def _opt(ctx):
    return scoring.optimize_inventory(ctx.skus())


@register("optimize_inventory", _with_opt(f"""
SELECT sku, {r('avg_daily_demand', 6)} AS avg_daily_demand, lead_time_days, safety_stock, reorder_point,
  days_of_inventory, stockout_risk, reorder_qty, revenue_at_risk FROM opt"""))
def q_optimize_inventory(ctx):
    return _opt(ctx).select("sku", C.round_half_up("avg_daily_demand", 6).alias("avg_daily_demand"),
                            "lead_time_days", "safety_stock", "reorder_point", "days_of_inventory",
                            "stockout_risk", "reorder_qty", "revenue_at_risk")


@register("agg_inventory_metrics", _with_opt("""
SELECT COUNT(*) AS skus_analyzed, CAST(SUM(stockout_risk) AS BIGINT) AS at_stockout_risk,
  CAST(ROUND_EVEN(CAST(SUM(stockout_risk) AS DECIMAL(38,9)) * 100 / COUNT(*), 1) AS DOUBLE) AS stockout_risk_pct,
  CAST(ROUND_EVEN(SUM(CAST(revenue_at_risk AS DECIMAL(38,9))), 2) AS DOUBLE) AS total_revenue_at_risk,
  CAST(ROUND_EVEN(SUM(CAST(safety_stock AS DECIMAL(38,9))) / COUNT(safety_stock), 1) AS DOUBLE) AS avg_safety_stock,
  CAST(ROUND_EVEN(SUM(CAST(reorder_point AS DECIMAL(38,9))) / COUNT(reorder_point), 1) AS DOUBLE) AS avg_reorder_point,
  CAST(ROUND_EVEN(SUM(CAST(days_of_inventory AS DECIMAL(38,9))) / COUNT(days_of_inventory), 1) AS DOUBLE)
    AS avg_days_of_inventory
FROM opt"""))
def q_agg_inventory_metrics(ctx):
    return scoring.agg_inventory_metrics(_opt(ctx))


@register("agg_risk_by_type", _with_opt("""
SELECT product_type, CAST(ROUND_EVEN(CAST(SUM(stockout_risk) AS DECIMAL(38,9)) * 100 / COUNT(stockout_risk), 4)
  AS DOUBLE) AS stockout_risk_pct FROM opt GROUP BY product_type"""))
def q_agg_risk_by_type(ctx):
    return scoring.agg_risk_by_type(_opt(ctx))


@register("filter_at_risk", _with_opt("SELECT sku, reorder_qty, revenue_at_risk FROM opt WHERE stockout_risk = 1"))
def q_filter_at_risk(ctx):
    return _opt(ctx).where(F.col("stockout_risk") == 1).select("sku", "reorder_qty", "revenue_at_risk")


def _whatif_sql(level_z: float) -> str:
    lead = "FLOOR(CASE WHEN COALESCE(lead_time_days, 0) = 0 THEN 10.0 ELSE lead_time_days END)"
    dem = "CASE WHEN COALESCE(avg_daily_demand, 0) = 0 THEN 20.0 ELSE avg_daily_demand END"
    stock = "FLOOR(CASE WHEN COALESCE(stock_levels, 0) = 0 THEN 0.0 ELSE stock_levels END)"
    return _with_opt(f"""
SELECT sku, safety_stock, reorder_point, CAST(_stock < reorder_point AS BIGINT) AS stockout_risk,
  CAST(CASE WHEN _stock < reorder_point THEN FLOOR((reorder_point - _stock) * 15.0 + 0.5) ELSE 0 END AS BIGINT)
    AS revenue_at_risk
FROM (SELECT *, CAST(FLOOR(_demand * _lead + safety_stock + 0.5) AS BIGINT) AS reorder_point FROM (
  SELECT sku, _lead, _demand, _stock,
    CAST(FLOOR({level_z} * (_demand * 0.22) * SQRT(_lead) + 0.5) AS BIGINT) AS safety_stock
  FROM (SELECT sku, {lead} AS _lead, {dem} AS _demand, {stock} AS _stock FROM opt)))""")


@register("reoptimize_service_level", _whatif_sql(2.33))
def q_reoptimize_service_level(ctx):
    w = scoring.reoptimize_service_level(_opt(ctx), 99)
    return w.select("sku", "safety_stock", "reorder_point", "stockout_risk", "revenue_at_risk")


@register("z_for_service_level", _whatif_sql(1.28))
def q_z_for_service_level(ctx):
    w = scoring.reoptimize_service_level(_opt(ctx), 90)
    return w.select("sku", "safety_stock", "reorder_point", "stockout_risk", "revenue_at_risk")


@register("stockout_risk_recompute", _with_opt(f"""
SELECT sku, CAST(s < p AS BIGINT) AS stockout_risk,
  CASE WHEN s < p THEN {_re('(p - s) * (10.0 * 1.5)', 2)} ELSE 0.0 END AS revenue_at_risk
FROM (SELECT sku, CAST(TRUNC(stock_levels) AS BIGINT) AS s, CAST(TRUNC(reorder_point) AS BIGINT) AS p FROM opt)"""))
def q_stockout_risk_recompute(ctx):
    rows = _opt(ctx).select("sku", "stock_levels", "reorder_point")
    return scoring.stockout_risk_recompute(rows).select("sku", "stockout_risk", "revenue_at_risk")


@register("agg_inventory_kpis", _with_opt("""
SELECT COUNT(*) FILTER (WHERE stockout_risk = 1) AS skus_at_stockout_risk, COUNT(*) AS total_skus,
  CAST(COALESCE(ROUND_EVEN(SUM(CAST(revenue_at_risk AS DECIMAL(38,9))), 2), 0) AS DOUBLE) AS revenue_at_risk FROM opt"""))
def q_agg_inventory_kpis(ctx):
    return kpis.agg_inventory_kpis(_opt(ctx))


@register("inventory_pie", _with_opt("""
SELECT 'At Risk' AS name, COUNT(*) FILTER (WHERE stockout_risk = 1) AS value FROM opt
UNION ALL SELECT 'Safe', COUNT(*) - COUNT(*) FILTER (WHERE stockout_risk = 1) FROM opt"""))
def q_inventory_pie(ctx):
    return scoring.inventory_pie(_opt(ctx))


@register("stock_vs_demand_points", _with_opt("""
SELECT sku AS name, COALESCE(avg_daily_demand, 0.0) AS demand, COALESCE(stock_levels, 0.0) AS stock,
  stockout_risk = 1 AS is_risk FROM opt"""))
def q_stock_vs_demand_points(ctx):
    return scoring.stock_vs_demand_points(_opt(ctx))


@register("agg_supplier_kpis", _with_scores("""
SELECT COUNT(*) FILTER (WHERE LOWER(COALESCE(risk_tier, '')) IN ('high', 'high risk', 'critical'))
  AS high_risk_suppliers, COUNT(*) AS total_suppliers FROM tiered"""))
def q_agg_supplier_kpis(ctx):
    return kpis.agg_supplier_kpis(scoring.score_suppliers(ctx.skus()))


@register("seed_recommendations", _with_opt(f"""
SELECT sku, CAST(TRUNC(stock_levels) AS BIGINT) AS current_stock, avg_daily_demand * 30.0 AS forecasted_demand,
  CAST(TRUNC(reorder_point) AS BIGINT) AS reorder_point,
  CAST(TRUNC(reorder_qty) AS BIGINT) AS recommended_order_quantity,
  CASE WHEN stockout_risk = 1 THEN 'high' ELSE 'low' END AS priority,
  'Current stock ' || CAST(stock_levels AS VARCHAR) || ' is '
    || CASE WHEN stockout_risk = 1 THEN 'below' ELSE 'above' END || ' reorder point '
    || CAST(reorder_point AS VARCHAR) || '.' AS rationale
FROM opt"""))
def q_seed_recommendations(ctx):
    rec = scoring.seed_recommendations(_opt(ctx), 0, ctx.as_of)
    return rec.select("sku", "current_stock", "forecasted_demand", "reorder_point",
                      "recommended_order_quantity", "priority", "rationale")


@register("seed_suppliers_scores", _with_scores("""
SELECT LOWER(REPLACE(supplier_name, ' ', '_')) AS supplier_code, supplier_name,
  CASE WHEN supplier_name LIKE '%1%' OR supplier_name LIKE '%3%' THEN 'USA' ELSE 'Germany' END AS country,
  CASE WHEN LOWER(SPLIT_PART(TRIM(risk_tier), ' ', 1)) IN ('low','medium','high','critical')
       THEN LOWER(SPLIT_PART(TRIM(risk_tier), ' ', 1)) ELSE 'medium' END AS risk_level
FROM tiered"""))
def q_seed_suppliers_scores(ctx):
    """The stored rows after the seed job ran twice."""
    root = scratch_path(ctx.spark, "seed-suppliers")
    scores = scoring.score_suppliers(ctx.skus())
    for _ in range(2):
        seeding.seed_suppliers_and_scores(scores, root, ctx.as_of, "supplier_scorer-1.0")
    cards = ctx.spark.read.parquet(f"{root}/supplier_performance_scores").select("supplier_id", F.col("risk_tier").alias("risk_level"))
    return (ctx.spark.read.parquet(f"{root}/dim_suppliers").join(cards, "supplier_id")
            .select("supplier_code", "supplier_name", "country", "risk_level"))


@register("seed_products_recommendations", _with_opt("""
SELECT sku, product_type || ' (SKU: ' || sku || ')' AS product_name, CAST(TRUNC(stock_levels) AS BIGINT) AS current_stock,
  CASE WHEN stockout_risk = 1 THEN 'high' ELSE 'low' END AS priority FROM opt"""))
def q_seed_products_recommendations(ctx):
    """The stored rows after the seed job ran twice."""
    root = scratch_path(ctx.spark, "seed-products")
    for _ in range(2):
        seeding.seed_products_and_recommendations(ctx.skus(), _opt(ctx), root, "central", ctx.as_of, "inventory_optimizer-1.0")
    recs = ctx.spark.read.parquet(f"{root}/inventory_recommendations").select("product_id", "current_stock", "priority")
    return (ctx.spark.read.parquet(f"{root}/dim_products").join(recs, "product_id")
            .select("sku", "product_name", "current_stock", "priority"))


@register("seed_products", with_views(["skus_f"], """
SELECT sku, product_type || ' (SKU: ' || sku || ')' AS product_name, product_type AS category,
  10.0 AS unit_cost, 15.0 AS unit_price FROM skus_f"""))
def q_seed_products(ctx):
    return scoring.seed_products(ctx.skus()).select("sku", "product_name", "category", "unit_cost", "unit_price")


@register("executive_kpis", with_views(["orders_f", "skus_f"], "").rstrip() + f""",
{_SCORES},
{_INV},
k1 AS (SELECT COUNT(*) AS total_orders,
    CAST(SUM(CAST(late_delivery_flag AS DECIMAL(38,9))) AS BIGINT) AS late_shipments,
    ROUND_EVEN(SUM(CAST(sales AS DECIMAL(38,9))), 2) AS s, ROUND_EVEN(SUM(CAST(benefit_per_order AS DECIMAL(38,9))), 2) AS p
  FROM orders_f),
k2 AS (SELECT COUNT(*) FILTER (WHERE stockout_risk = 1) AS skus_at_stockout_risk, COUNT(*) AS total_skus,
    CAST(COALESCE(ROUND_EVEN(SUM(CAST(revenue_at_risk AS DECIMAL(38,9))), 2), 0) AS DOUBLE) AS revenue_at_risk
  FROM opt),
k3 AS (SELECT COUNT(*) FILTER (WHERE LOWER(COALESCE(risk_tier, '')) IN ('high', 'high risk', 'critical'))
    AS high_risk_suppliers, COUNT(*) AS total_suppliers FROM tiered)
SELECT total_orders,
  CAST(ROUND_EVEN(CAST(total_orders - late_shipments AS DECIMAL(38,9)) * 100 / CAST(total_orders AS DECIMAL(38,9)), 2)
       AS DOUBLE) AS on_time_delivery_rate_pct, late_shipments,
  CAST(s AS DOUBLE) AS total_sales, CAST(p AS DOUBLE) AS total_profit,
  CAST(COALESCE(ROUND_EVEN(CAST(p AS DECIMAL(38,9)) * 100 / NULLIF(CAST(s AS DECIMAL(38,9)), 0), 2), 0) AS DOUBLE)
    AS avg_profit_margin_pct,
  skus_at_stockout_risk, total_skus, revenue_at_risk, high_risk_suppliers, total_suppliers
FROM k1 CROSS JOIN k2 CROSS JOIN k3""")
def q_executive_kpis(ctx):
    """Shipment KPIs + optimiser KPIs + supplier-scorecard KPIs in one row."""
    return kpis.executive_kpis(ctx.orders(), _opt(ctx), scoring.score_suppliers(ctx.skus()))
