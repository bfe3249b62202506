"""One query per projection / scalar-function family (§2.2, §2.4), each run
over whole stored tables and summarised so the oracle compares exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.functions import columns as C
from kestrel.operators import etl, ml, relational as R, scoring
from kestrel.operators import latest as L
from kestrel.plans.oracle_views import r, with_views
from kestrel.plans.q_scoring import _with_opt, _with_scores
from kestrel.plans.registry import register

def _count():
    return F.count(F.lit(1))


def _sum_r(c, k=4):
    return C.round_half_up(F.sum(C.col(c).cast("decimal(38,9)")), k)


def _ssum(expr: str, k: int = 4) -> str:
    return f"CAST(ROUND(SUM(CAST({expr} AS DECIMAL(38,9))), {k}) AS DOUBLE)"


# --- §2.1 / §2.2 --------------------------------------------------------------------------------

@register("scan_table", with_views(["dim_suppliers"], "SELECT region, COUNT(*) AS n FROM dim_suppliers GROUP BY 1"))
def q_scan_table(ctx):
    return ctx.wh.dim_suppliers().groupBy("region").agg(_count().alias("n"))


@register("rename_columns", with_views(["skus_f"], """
SELECT product_type, COUNT(*) AS n, COUNT(inspection_result) AS inspected FROM skus_f GROUP BY 1"""))
def q_rename_columns(ctx):
    df = etl.rename_columns(ctx.raw_skus(), S.SKUS_COLUMN_MAP)
    return df.groupBy("product_type").agg(_count().alias("n"), F.count("inspection_result").alias("inspected"))


@register("drop_sensitive", with_views(["orders_f"], """
SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS pii_columns_left FROM orders_f"""))
def q_drop_sensitive(ctx):
    clean = ctx.orders_clean()
    left = len([c for c in S.SENSITIVE_ORDER_COLUMNS if c in clean.columns])
    return clean.agg(_count().alias("n_rows")).withColumn("pii_columns_left", F.lit(left).cast("long"))


@register("project_features_orders", with_views(["orders_f"], f"""
SELECT shipping_mode, COUNT(*) AS n, CAST(SUM(late_delivery_flag) AS BIGINT) AS late,
  {_ssum('sales', 2)} AS sales, {_ssum('discount_rate_pct', 4)} AS discount_pct FROM orders_f GROUP BY 1"""))
def q_project_features_orders(ctx):
    f = ctx.orders()
    assert f.columns == S.ORDERS_FEATURES
    return f.groupBy("shipping_mode").agg(_count().alias("n"), F.sum("late_delivery_flag").alias("late"),
                                          _sum_r("sales", 2).alias("sales"), _sum_r("discount_rate_pct").alias(
                                              "discount_pct"))


@register("project_features_skus", with_views(["skus_f"], f"""
SELECT inspection_result, COUNT(*) AS n, {_ssum('sell_through_rate', 6)} AS sell_through,
  {_ssum('manufacturing_cost_per_unit', 6)} AS mfg_unit_cost FROM skus_f GROUP BY 1"""))
def q_project_features_skus(ctx):
    f = ctx.skus()
    assert f.columns == S.SKUS_FEATURES
    return f.groupBy("inspection_result").agg(_count().alias("n"), _sum_r("sell_through_rate", 6).alias("sell_through"),
                                              _sum_r("manufacturing_cost_per_unit", 6).alias("mfg_unit_cost"))


@register("coerce_numeric", with_views(["orders_f"], f"""
SELECT COUNT(*) AS profit_ratio_nulls, {_ssum('sales', 2)} AS sales, {_ssum('order_item_quantity', 0)} AS quantity
FROM orders_f"""))
def q_coerce_numeric(ctx):
    c = ctx.orders_clean()
    return c.agg(F.count_if(F.col("order_item_profit_ratio").isNull()).alias("profit_ratio_nulls"),
                 _sum_r("sales", 2).alias("sales"), _sum_r("order_item_quantity", 0).alias("quantity"))


@register("flatten_embedded", with_views(["b_rec", "dim_products"], f"""
SELECT COALESCE(p.category, 'Unknown') AS product_type, COUNT(*) AS n,
  {_ssum('COALESCE(CAST(p.unit_cost AS DOUBLE), 10.0)', 2)} AS unit_cost_sum
FROM b_rec r LEFT JOIN dim_products p ON p.product_id = r.product_id GROUP BY 1"""))
def q_flatten_embedded(ctx):
    dim = ctx.wh.dim_products().select("product_id", "sku", F.col("category").alias("product_type"),
                                       F.col("unit_cost").cast("double").alias("unit_cost"))
    flat = R.join_embedded(ctx.wh.inventory_recommendations(), dim, "product_id",
                           {"sku": "Unknown SKU", "product_type": "Unknown", "unit_cost": 10.0})
    return flat.groupBy("product_type").agg(_count().alias("n"), _sum_r("unit_cost", 2).alias("unit_cost_sum"))


@register("project_column_mapping", with_views(["b_rec"], f"""
SELECT priority, CAST(SUM(current_stock) AS BIGINT) AS stock_levels,
  CAST(SUM(recommended_order_quantity) AS BIGINT) AS reorder_qty,
  {_ssum('CAST(ROUND_EVEN(CAST(CAST(forecasted_demand AS DOUBLE) / 30.0 AS DECIMAL(38,9)), 2) AS DOUBLE)', 2)}
    AS avg_daily_demand FROM b_rec GROUP BY 1"""))
def q_project_column_mapping(ctx):
    r_ = ctx.wh.inventory_recommendations()
    m = r_.withColumnsRenamed({"current_stock": "stock_levels", "recommended_order_quantity": "reorder_qty"}) \
          .withColumn("avg_daily_demand", C.monthly_to_daily("forecasted_demand"))
    return m.groupBy("priority").agg(F.sum("stock_levels").cast("long").alias("stock_levels"),
                                     F.sum("reorder_qty").cast("long").alias("reorder_qty"),
                                     _sum_r("avg_daily_demand", 2).alias("avg_daily_demand"))


@register("payload_build", with_views(["orders_f"], """
SELECT COUNT(*) AS payloads, COUNT(*) AS with_sales, COUNT(*) AS with_defaults FROM orders_f"""))
def q_payload_build(ctx):
    from kestrel.plans.q_workspace import _records
    rec = _records(ctx, "shipments")
    return rec.agg(_count().alias("payloads"), F.count_if(F.col("payload").contains('"sales":')).alias("with_sales"),
                   F.count_if(F.col("payload").contains('"order_item_total":100.0')).alias("with_defaults"))


@register("production_catalog", with_views(["orders_f", "skus_f", "b_inv"], """
SELECT 'order_items' AS dataset, COUNT(*) AS row_count FROM orders_f
UNION ALL SELECT 'skus', COUNT(*) FROM skus_f
UNION ALL SELECT 'suppliers', COUNT(DISTINCT supplier_name) FROM skus_f
UNION ALL SELECT 'inventory_snapshots', COUNT(*) FROM b_inv"""))
def q_production_catalog(ctx):
    parts = [("order_items", ctx.orders()), ("skus", ctx.skus()),
             ("suppliers", scoring.score_suppliers(ctx.skus())), ("inventory_snapshots",
                                                                 ctx.wh.fact_inventory_snapshots())]
    out = None
    for name, df in parts:
        p = df.agg(_count().alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        out = p if out is None else out.unionByName(p)
    return out


# --- §2.4 scalar families over the clean order items ------------------------------------------------

@register("clean_strings", with_views(["orders_f"], """
SELECT COUNT(*) FILTER (WHERE customer_id % 10 = 0) AS blank_zip_nulls, COUNT(DISTINCT shipping_mode) AS modes
FROM orders_f"""))
def q_clean_strings(ctx):
    c = ctx.orders_clean()
    return c.agg(F.count_if(F.col("customer_zipcode").isNull()).alias("blank_zip_nulls"),
                 F.count_distinct("shipping_mode").alias("modes"))


@register("to_int_string", with_views(["orders_f"], """
SELECT COUNT(DISTINCT z) AS distinct_zips, MIN(z) AS min_zip, MAX(z) AS max_zip FROM
  (SELECT CASE WHEN order_id % 5 = 0 THEN NULL
               ELSE CAST(CAST(10000 + order_id % 90000 AS BIGINT) AS VARCHAR) END AS z FROM orders_f)"""))
def q_to_int_string(ctx):
    c = ctx.orders_clean()
    return c.agg(F.count_distinct("order_zipcode").alias("distinct_zips"), F.min("order_zipcode").alias("min_zip"),
                 F.max("order_zipcode").alias("max_zip"))


@register("parse_datetime", with_views(["orders_f"], """
SELECT CAST(MIN(order_day) AS VARCHAR) AS first_order, CAST(MAX(shipping_day) AS VARCHAR) AS last_ship,
  CAST(0 AS BIGINT) AS unparsed FROM orders_f"""))
def q_parse_datetime(ctx):
    c = ctx.orders_clean()
    return c.agg(F.to_date(F.min("order_date")).alias("first_order"), F.to_date(F.max("shipping_date")).alias(
        "last_ship"), F.count_if(F.col("order_date").isNull()).alias("unparsed"))


@register("safe_ratio", with_views(["orders_f"], f"""
SELECT COUNT(*) - COUNT(profit_margin_pct) AS missing, {_ssum('profit_margin_pct', 4)} AS margin_sum FROM orders_f"""))
def q_safe_ratio(ctx):
    c = ctx.orders_clean()
    return c.agg((_count() - F.count("profit_margin_pct")).alias("missing"), _sum_r("profit_margin_pct").alias("margin_sum"))


@register("date_part_month", with_views(["orders_f"], """
SELECT CAST(month(order_day) AS BIGINT) AS order_month, COUNT(*) AS n FROM orders_f GROUP BY 1"""))
def q_date_part_month(ctx):
    return ctx.orders_clean().groupBy("order_month").agg(_count().alias("n"))


@register("date_part_weekday", with_views(["orders_f"], """
SELECT dayname(shipping_day) AS shipping_weekday, COUNT(*) AS n FROM orders_f GROUP BY 1"""))
def q_date_part_weekday(ctx):
    return ctx.orders_clean().groupBy("shipping_weekday").agg(_count().alias("n"))


@register("missing_indicator", with_views(["orders_f"], """
SELECT COUNT(*) FILTER (WHERE order_id % 5 = 0) AS order_zip_missing,
  COUNT(*) FILTER (WHERE customer_id % 10 = 0) AS customer_zip_missing FROM orders_f"""))
def q_missing_indicator(ctx):
    c = ctx.orders_clean()
    return c.agg(F.sum("order_zipcode_missing").alias("order_zip_missing"),
                 F.sum("customer_zipcode_missing").alias("customer_zip_missing"))


@register("delivery_delay", with_views(["orders_f"], """
SELECT CAST(SUM(delivery_delay_days) AS DOUBLE) AS delay_sum, CAST(SUM(shipping_ahead_days) AS DOUBLE) AS ahead_sum,
  COUNT(*) FILTER (WHERE delivery_delay_days > 0) AS delayed FROM orders_f"""))
def q_delivery_delay(ctx):
    c = ctx.orders_clean()
    return c.agg(F.sum("delivery_delay_days").alias("delay_sum"), F.sum("shipping_ahead_days").alias("ahead_sum"),
                 F.count_if(F.col("delivery_delay_days") > 0).alias("delayed"))


@register("late_flag", with_views(["orders_f"], """
SELECT late_delivery_flag, COUNT(*) AS n FROM orders_f GROUP BY 1"""))
def q_late_flag(ctx):
    return ctx.orders_clean().groupBy("late_delivery_flag").agg(_count().alias("n"))


@register("profit_margin", with_views(["orders_f"], f"""
SELECT market, {r('AVG(profit_margin_pct)', 4)} AS mean_margin FROM orders_f GROUP BY 1"""))
def q_profit_margin(ctx):
    return ctx.orders_clean().groupBy("market").agg(C.round_half_up(F.avg("profit_margin_pct"), 4).alias(
        "mean_margin"))


@register("profit_flag", with_views(["orders_f"], """
SELECT CAST(COALESCE(benefit_per_order > 0, FALSE) AS BIGINT) AS is_profitable_flag, COUNT(*) AS n
FROM orders_f GROUP BY 1"""))
def q_profit_flag(ctx):
    return ctx.orders_clean().groupBy("is_profitable_flag").agg(_count().alias("n"))


@register("discount_pct", with_views(["orders_f"], f"""
SELECT {_ssum('discount_rate_pct', 4)} AS discount_pct_sum, MAX(discount_rate_pct) AS max_pct FROM orders_f"""))
def q_discount_pct(ctx):
    c = ctx.orders_clean()
    return c.agg(_sum_r("discount_rate_pct").alias("discount_pct_sum"), F.max("discount_rate_pct").alias("max_pct"))


@register("sku_ratios", with_views(["skus_f"], f"""
SELECT {_ssum('inventory_gap', 2)} AS inventory_gap, {_ssum('sell_through_rate', 6)} AS sell_through,
  {_ssum('CASE WHEN products_sold <> 0 THEN revenue_generated / products_sold END', 4)} AS revenue_per_unit,
  {_ssum('shipping_cost_per_unit', 6)} AS ship_unit, {_ssum('manufacturing_cost_per_unit', 6)} AS mfg_unit,
  {_ssum('lead_time_gap_days', 0)} AS lead_gap,
  {_ssum('CASE WHEN availability <> 0 THEN products_sold / availability END', 4)} AS supply_pressure FROM skus_f"""))
def q_sku_ratios(ctx):
    c = ctx.skus_clean()
    return c.agg(_sum_r("inventory_gap", 2).alias("inventory_gap"), _sum_r("sell_through_rate", 6).alias(
        "sell_through"), _sum_r("revenue_per_unit_sold").alias("revenue_per_unit"),
        _sum_r("shipping_cost_per_unit", 6).alias("ship_unit"), _sum_r("manufacturing_cost_per_unit", 6).alias(
            "mfg_unit"), _sum_r("lead_time_gap_days", 0).alias("lead_gap"),
        _sum_r("supply_pressure_index").alias("supply_pressure"))


@register("quality_flags", with_views(["skus_f"], """
SELECT CAST(SUM(quality_pass_flag) AS BIGINT) AS passed, CAST(SUM(quality_fail_flag) AS BIGINT) AS failed,
  CAST(SUM(defect_rate_out_of_range_flag) AS BIGINT) AS out_of_range FROM skus_f"""))
def q_quality_flags(ctx):
    c = ctx.skus_clean()
    return c.agg(F.sum("quality_pass_flag").alias("passed"), F.sum("quality_fail_flag").alias("failed"),
                 F.sum("defect_rate_out_of_range_flag").alias("out_of_range"))


@register("safe_float", with_views(["skus_f"], f"""
SELECT {_ssum('product_price', 2)} AS price_sum, {_ssum('COALESCE(defect_rate_raw, 0.0)', 4)} AS defect_sum FROM skus_f"""))
def q_safe_float(ctx):
    raw = ctx.raw_skus()
    return raw.agg(_sum_r(C.safe_float("Price"), 2).alias("price_sum"),
                   _sum_r(C.safe_float("`Defect rates`", 0.0)).alias("defect_sum"))


@register("safe_int", with_views(["skus_f"], """
SELECT CAST(SUM(CAST(TRUNC(stock_levels) AS BIGINT)) AS BIGINT) AS stock_sum,
  CAST(SUM(CAST(TRUNC(products_sold) AS BIGINT)) AS BIGINT) AS sold_sum FROM skus_f"""))
def q_safe_int(ctx):
    raw = ctx.raw_skus()
    return raw.agg(F.sum(C.safe_int("`Stock levels`")).alias("stock_sum"),
                   F.sum(C.safe_int("`Number of products sold`")).alias("sold_sum"))


@register("slug_code", with_views(["dim_suppliers"], """
SELECT COUNT(DISTINCT LOWER(REPLACE(supplier_name, ' ', '_'))) AS codes,
  MIN(LOWER(REPLACE(supplier_name, ' ', '_'))) AS first_code FROM dim_suppliers"""))
def q_slug_code(ctx):
    s = ctx.wh.dim_suppliers().select(C.slug_code("supplier_name").alias("c"))
    return s.agg(F.count_distinct("c").alias("codes"), F.min("c").alias("first_code"))


@register("normalize_risk_tier", _with_scores("""
SELECT CASE WHEN LOWER(SPLIT_PART(TRIM(risk_tier), ' ', 1)) IN ('low','medium','high','critical')
            THEN LOWER(SPLIT_PART(TRIM(risk_tier), ' ', 1)) ELSE 'medium' END AS risk_level, COUNT(*) AS n
FROM tiered GROUP BY 1"""))
def q_normalize_risk_tier(ctx):
    s = scoring.score_suppliers(ctx.skus())
    return s.groupBy(C.normalize_risk_tier("risk_tier").alias("risk_level")).agg(_count().alias("n"))


@register("resolve_model_type", with_views(["skus_f"], """
SELECT 'supplier_scorer' AS model_name, 'supplier_scoring' AS model_type
UNION ALL SELECT 'inventory_optimizer', 'inventory_optimization'
UNION ALL SELECT 'delay_rules', 'delay_prediction' FROM (SELECT COUNT(*) FROM skus_f)"""))
def q_resolve_model_type(ctx):
    from kestrel.plans.q_ml import _registry
    reg = _registry(ctx)
    return reg.select("model_name", C.resolve_model_type("model_name").alias("model_type"))


@register("price_from_cost", with_views(["dim_products"], f"""
SELECT {_ssum('CAST(unit_cost AS DOUBLE) * 1.5', 2)} AS price_sum FROM dim_products"""))
def q_price_from_cost(ctx):
    p = ctx.wh.dim_products()
    return p.agg(_sum_r(C.price_from_cost("unit_cost"), 2).alias("price_sum"))


@register("text_concat_replace", with_views(["skus_f"], """
SELECT COUNT(DISTINCT product_type || ' (SKU: ' || sku || ')') AS names,
  COUNT(DISTINCT REPLACE(supplier_name, '#', '')) AS suppliers FROM skus_f"""))
def q_text_concat_replace(ctx):
    s = ctx.skus()
    return s.agg(F.count_distinct(F.format_string("%s (SKU: %s)", "product_type", "sku")).alias("names"),
                 F.count_distinct(F.replace(F.col("supplier_name"), F.lit("#"), F.lit(""))).alias("suppliers"))


@register("rationale_text", _with_opt("""
SELECT COUNT(*) FILTER (WHERE stockout_risk = 1) AS below, COUNT(*) FILTER (WHERE stockout_risk <> 1) AS above
FROM opt"""))
def q_rationale_text(ctx):
    rec = scoring.seed_recommendations(scoring.optimize_inventory(ctx.skus()), 0, ctx.as_of)
    return rec.agg(F.count_if(F.col("rationale").contains(" is below ")).alias("below"),
                   F.count_if(F.col("rationale").contains(" is above ")).alias("above"))


@register("country_region_from_name", with_views(["dim_suppliers"], """
SELECT CASE WHEN supplier_name LIKE '%1%' OR supplier_name LIKE '%3%' THEN 'USA' ELSE 'Germany' END AS country,
  CASE WHEN supplier_name LIKE '%1%' OR supplier_name LIKE '%3%' THEN 'Americas' ELSE 'Europe' END AS region,
  COUNT(*) AS n FROM dim_suppliers GROUP BY 1, 2"""))
def q_country_region_from_name(ctx):
    s = ctx.wh.dim_suppliers()
    return s.groupBy(C.country_from_name("supplier_name").alias("country"),
                     C.region_from_name("supplier_name").alias("region")).agg(_count().alias("n"))


@register("monthly_to_daily", with_views(["b_rec"], f"""
SELECT {_ssum('CAST(ROUND_EVEN(CAST(CAST(forecasted_demand AS DOUBLE) / 30.0 AS DECIMAL(38,9)), 2) AS DOUBLE)', 2)}
  AS daily_sum FROM b_rec"""))
def q_monthly_to_daily(ctx):
    r_ = ctx.wh.inventory_recommendations()
    return r_.agg(_sum_r(C.monthly_to_daily("forecasted_demand"), 2).alias("daily_sum"))


@register("date_diff_floor0", with_views(["b_ship"], """
SELECT CAST(SUM(delay_days) AS BIGINT) AS delay_sum, COUNT(*) - COUNT(delay_days) AS undelivered,
  MIN(delay_days) AS min_delay FROM b_ship"""))
def q_date_diff_floor0(ctx):
    s = ctx.wh.fact_shipments()
    return s.agg(F.sum("delay_days").cast("long").alias("delay_sum"), (_count() - F.count("delay_days")).alias(
        "undelivered"), F.min("delay_days").cast("long").alias("min_delay"))


@register("is_delayed", with_views(["b_ship"], """
SELECT CAST(is_delayed AS VARCHAR) AS is_delayed, COUNT(*) AS n FROM b_ship GROUP BY 1"""))
def q_is_delayed(ctx):
    return ctx.wh.fact_shipments().groupBy(F.col("is_delayed").cast("string").alias("is_delayed")).agg(
        _count().alias("n"))


@register("available_qty", with_views(["b_inv"], """
SELECT CAST(SUM(available_quantity) AS BIGINT) AS available, CAST(SUM(reserved_quantity) AS BIGINT) AS reserved
FROM b_inv"""))
def q_available_qty(ctx):
    i = ctx.wh.fact_inventory_snapshots()
    return i.agg(F.sum("available_quantity").cast("long").alias("available"),
                 F.sum("reserved_quantity").cast("long").alias("reserved"))


@register("inventory_value", with_views(["b_inv"], """
SELECT location_id, CAST(SUM(inventory_value) AS DOUBLE) AS value FROM b_inv GROUP BY 1"""))
def q_inventory_value(ctx):
    return ctx.wh.fact_inventory_snapshots().groupBy("location_id").agg(F.sum("inventory_value").alias("value"))


@register("coalesce_nullif_pct", with_views(["b_po"], """
SELECT status, CAST(COALESCE(ROUND(CAST(SUM(defect_quantity) AS DECIMAL(38,6)) * 100
  / NULLIF(CAST(SUM(received_quantity) AS DECIMAL(38,6)), 0), 2), 0) AS DOUBLE) AS defect_pct
FROM b_po GROUP BY 1"""))
def q_coalesce_nullif_pct(ctx):
    g = ctx.wh.fact_purchase_orders().groupBy("status").agg(F.sum("defect_quantity").alias("d"),
                                                             F.sum("received_quantity").alias("r"))
    return g.select("status", C.pct_or_zero("d", "r").alias("defect_pct"))


@register("case_below_reorder", with_views(["b_inv"], """
SELECT CASE WHEN available_quantity <= reorder_point THEN TRUE ELSE FALSE END AS below_reorder_point, COUNT(*) AS n
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id, location_id
  ORDER BY snapshot_date DESC, snapshot_id DESC) rn FROM b_inv) WHERE rn = 1) GROUP BY 1"""))
def q_case_below_reorder(ctx):
    inv = L.latest_inventory(ctx.wh.fact_inventory_snapshots())
    return inv.groupBy(C.below_or_at("available_quantity", "reorder_point").alias("below_reorder_point")).agg(
        _count().alias("n"))


@register("cast_enum_text", with_views(["b_ship"], "SELECT CAST(status AS VARCHAR) AS status, COUNT(*) AS n "
                                                  "FROM b_ship GROUP BY 1"))
def q_cast_enum_text(ctx):
    return ctx.wh.fact_shipments().groupBy(F.col("status").cast("string").alias("status")).agg(_count().alias("n"))


@register("effect_size_label", with_views(["orders_f"], "\nUNION ALL\n".join(f"""
SELECT '{a}' AS x, '{b}' AS y, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small'
  WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM (
  SELECT SQRT((SUM(o * o / e) - MAX(n)) / (MAX(n) * (LEAST(MAX(r), MAX(k)) - 1))) AS v FROM
  (SELECT CAST(o AS DOUBLE) AS o, r_tot * c_tot / n AS e, n, r, k FROM
    (SELECT {a}, {b}, COUNT(*) AS o FROM orders_f GROUP BY 1, 2) ct
    JOIN (SELECT {a}, COUNT(*) AS r_tot FROM orders_f GROUP BY 1) USING ({a})
    JOIN (SELECT {b}, COUNT(*) AS c_tot FROM orders_f GROUP BY 1) USING ({b})
    CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT {a}) AS r, COUNT(DISTINCT {b}) AS k FROM orders_f)))"""
    for a, b in [("shipping_mode", "market"), ("category_name", "order_region"), ("shipping_mode", "order_status")])))
def q_effect_size_label(ctx):
    from kestrel.operators import stats as ST
    out = None
    for a, b in [("shipping_mode", "market"), ("category_name", "order_region"), ("shipping_mode", "order_status")]:
        c = ST.chi_square_independence(ctx.orders(), a, b).select(
            F.lit(a).alias("x"), F.lit(b).alias("y"), F.col("effect_size_interpretation").alias("effect"))
        out = c if out is None else out.unionByName(c)
    return out


@register("risk_tier_cut", _with_scores("SELECT risk_tier, COUNT(*) AS n FROM tiered GROUP BY 1"))
def q_risk_tier_cut(ctx):
    return scoring.score_suppliers(ctx.skus()).groupBy("risk_tier").agg(_count().alias("n"))


@register("risk_tier_whatif", _with_scores("""
SELECT CASE WHEN overall_score >= 70 THEN 'Low Risk' WHEN overall_score < 40 THEN 'High Risk'
  ELSE 'Medium Risk' END AS tier, COUNT(*) AS n FROM tiered GROUP BY 1"""))
def q_risk_tier_whatif(ctx):
    s = scoring.score_suppliers(ctx.skus())
    return s.groupBy(C.risk_tier_whatif("overall_score").alias("tier")).agg(_count().alias("n"))


@register("round_result", with_views(["orders_f"], f"""
SELECT COUNT(DISTINCT CAST(ROUND_EVEN(CAST(
  CASE WHEN scheduled_shipping_days <= 2 THEN 0.75 + LEAST(sales / 10000.0, 0.20)
       WHEN scheduled_shipping_days >= 5 THEN 0.12 ELSE 0.38 END AS DECIMAL(38,9)), 4) AS DOUBLE)) AS probabilities
FROM orders_f"""))
def q_round_result(ctx):
    return ml.rule_score_delay(ctx.orders()).agg(F.count_distinct("late_probability").alias("probabilities"))


@register("agg_value_counts", with_views(["skus_f"], """
SELECT inspection_result, COUNT(*) AS count FROM skus_f GROUP BY 1"""))
def q_agg_value_counts(ctx):
    return R.agg_value_counts(ctx.skus(), "inspection_result")


@register("agg_condition_counts", with_views(["orders_f", "skus_f"], """
SELECT (SELECT COUNT(*) FILTER (WHERE late_delivery_flag = 1) FROM orders_f) AS late_count,
  (SELECT COUNT(*) FILTER (WHERE defect_rate_raw > 1) FROM skus_f) AS defect_out_of_range,
  (SELECT COUNT(*) FILTER (WHERE inspection_result = 'Pending') FROM skus_f) AS pending"""))
def q_agg_condition_counts(ctx):
    o = etl.dq_report_orders(etl.normalize_na_tokens(ctx.raw_orders())).select(
        F.col("late_delivery_count").alias("late_count"))
    s = etl.dq_report_skus(etl.normalize_na_tokens(ctx.raw_skus())).select(
        F.col("defect_rate_out_of_range_count").alias("defect_out_of_range"),
        F.col("pending_inspection_count").alias("pending"))
    return o.crossJoin(s)


@register("list_datasets", with_views(["orders_f", "skus_f"], """
SELECT 'Inventory' AS dataset_name, 'inventory' AS dataset_type
UNION ALL SELECT 'Shipments', 'shipment' UNION ALL SELECT 'Suppliers', 'supplier' FROM (SELECT COUNT(*) FROM skus_f)"""))
def q_list_datasets(ctx):
    from kestrel.operators import workspace as W
    from kestrel.plans.q_workspace import USER_A, workspace
    root, _ = workspace(ctx)
    return W.workspace_list(ctx.spark, root, USER_A).select("dataset_name", "dataset_type")


@register("sort_columns", with_views(["orders_f"], """
SELECT 'Shipments' AS dataset_name, 'order_item_discount,order_item_discount_rate,order_item_profit_ratio,'
  || 'order_item_quantity,order_item_total,sales_per_customer' AS columns_missing
UNION ALL SELECT 'Inventory', 'avg_daily_demand,reorder_qty,revenue_at_risk,safety_stock,std_daily_demand,stockout_risk'
UNION ALL SELECT 'Suppliers', 'quality_score' FROM (SELECT COUNT(*) FROM orders_f)"""))
def q_sort_columns(ctx):
    from kestrel.operators import workspace as W
    from kestrel.plans.q_workspace import USER_A, workspace
    root, _ = workspace(ctx)
    meta = W.workspace_list(ctx.spark, root, USER_A).select("dataset_id", "dataset_name", "columns")
    v = W.validate_schemas(meta.select("dataset_id", "columns"))
    return meta.join(v, "dataset_id").select("dataset_name", F.array_join("columns_missing", ",").alias(
        "columns_missing"))


def _report_sql() -> str:
    """Long form of the checked single queries; p-values have no SQL form."""
    from kestrel.plans.registry import _ORACLE
    long = []

    def part(section: str, query: str, name: str, measures: list[str]) -> None:
        for m in measures:
            long.append(f"SELECT '{section}' AS section, {name} AS item, '{m}' AS measure, CAST({m} AS DOUBLE) AS value "
                        f"FROM ({_ORACLE[query]}) q")
    part("welch_t_test", "welch_t_test", "''", ["on_time_n", "late_n", "on_time_mean", "late_mean", "on_time_std", "late_std",
                                              "t_statistic", "df"])
    part("chi_square", "chi_square_independence", "''", ["chi2_statistic", "degrees_of_freedom", "n", "cramers_v"])
    part("group_stats", "agg_group_stats", "inspection_result", ["n", "mean", "median", "std"])
    part("pearson_orders", "pearson_matrix", "x || '|' || y", ["r"])
    part("pearson_skus", "corr_matrix_long", "x || '|' || y", ["r"])
    part("spearman_skus", "spearman_matrix", "x || '|' || y", ["r"])
    part("highlights_orders", "corr_highlights", "pair", ["r"])
    long.append("SELECT 'contingency', shipping_mode || '|' || CAST(late_delivery_flag AS VARCHAR), 'n', CAST(n AS DOUBLE) FROM ("
                + with_views(["orders_f"], "SELECT shipping_mode, late_delivery_flag, COUNT(*) AS n FROM orders_f GROUP BY 1, 2") + ") q")
    long.append("SELECT 'rows', name, 'n', CAST(n AS DOUBLE) FROM (" + with_views(["orders_f", "skus_f"], """
SELECT 'orders' AS name, COUNT(*) AS n FROM orders_f UNION ALL SELECT 'skus', COUNT(*) FROM skus_f""") + ") q")
    return "\nUNION ALL\n".join(long)


@register("stats_report", _report_sql())
def q_stats_report(ctx):
    """The whole analysis as one JSON report (tests with p-values, group
    statistics, contingency, correlation matrices, highlights, row counts),
    written and read back; the p-values stay in the file."""
    from kestrel.operators import stats as ST
    from kestrel.plans import q_stats as Q
    from kestrel.session import scratch_path
    from kestrel.sources.sinks import sink_json_report

    def rows(section: str, df, item, measures: list[str]):
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(cells))

    pair = F.concat_ws("|", "x", "y")
    none = F.lit("")
    welch = Q.q_welch_t_test(ctx)
    chi = ST.chi_square_independence(ctx.orders(), "shipping_mode", "late_delivery_flag")
    kruskal = ST.kruskal_wallis(ctx.skus(), "defect_rate_raw", "inspection_result", Q.INSPECTION_LEVELS)
    r4 = lambda df, cols: df.withColumns({c: C.round_half_up(c, 4) for c in cols})
    parts = [
        rows("welch_t_test", welch, none, ["on_time_n", "late_n", "on_time_mean", "late_mean", "on_time_std", "late_std",
                                          "t_statistic", "df"]),
        rows("welch_t_test", Q.q_welch_t_test_report(ctx), none, ["p_value"]),
        rows("chi_square", r4(chi, ["chi2_statistic", "cramers_v"]), none, ["chi2_statistic", "degrees_of_freedom", "n", "cramers_v",
                                                                           "p_value"]),
        rows("kruskal_wallis", kruskal, none, ["p_value"]),
        rows("group_stats", Q.q_agg_group_stats(ctx), F.col("inspection_result"), ["n", "mean", "median", "std"]),
        rows("pearson_orders", Q.q_pearson_matrix(ctx), pair, ["r"]),
        rows("pearson_skus", Q.q_corr_matrix_long(ctx), pair, ["r"]),
        rows("spearman_skus", Q.q_spearman_matrix(ctx), pair, ["r"]),
        rows("highlights_orders", Q.q_corr_highlights(ctx), F.col("pair"), ["r"]),
        rows("contingency", ctx.orders().groupBy("shipping_mode", "late_delivery_flag").agg(_count().alias("n")),
             F.concat_ws("|", "shipping_mode", F.col("late_delivery_flag").cast("string")), ["n"]),
        rows("rows", ctx.orders().agg(_count().alias("n")), F.lit("orders"), ["n"]),
        rows("rows", ctx.skus().agg(_count().alias("n")), F.lit("skus"), ["n"]),
    ]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    path = scratch_path(ctx.spark, "stats-report")
    sink_json_report(report, path)
    back = ctx.spark.read.schema("section string, item string, measure string, value double").json(path)
    return back.where("measure <> 'p_value'")


@register("model_save")
def q_model_save(ctx):
    from kestrel.plans.q_ml import q_model_save_load
    return q_model_save_load(ctx)


@register("model_load")
def q_model_load(ctx):
    from kestrel.plans.q_ml import _delay_model
    from kestrel.session import scratch_path
    model, test = _delay_model(ctx)
    path = scratch_path(ctx.spark, "model-load")
    ml.model_save(model, path)
    back = ml.model_load(path)
    return ml.score_delay_batch(back, test).groupBy("predicted_label").agg(_count().alias("n"))

