"""Filters, joins, aggregations and sorts over the bridge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.operators import latest as L
from kestrel.operators import relational as R
from kestrel.operators import scoring
from kestrel.plans import views as V
from kestrel.plans.oracle_views import AS_OF, r, with_views
from kestrel.plans.q_scoring import _with_opt, _with_scores
from kestrel.plans.registry import register

# --- filters ------------------------------------------------------------------------


@register("lookup_supplier", _with_scores("""
SELECT supplier_name, overall_score FROM tiered WHERE LOWER(supplier_name) = LOWER('SUPPLIER#000000007')
ORDER BY overall_score DESC, supplier_name LIMIT 1"""))
def q_lookup_supplier(ctx):
    s = scoring.score_suppliers(ctx.skus()).select("supplier_name", "overall_score")
    return R.lookup_ci(s, "supplier_name", "SUPPLIER#000000007",
                       [F.col("overall_score").desc(), F.col("supplier_name")])


@register("lookup_sku", _with_opt("""
SELECT sku, reorder_point, stockout_risk FROM opt WHERE LOWER(sku) = LOWER('sku17') ORDER BY sku LIMIT 1"""))
def q_lookup_sku(ctx):
    o = scoring.optimize_inventory(ctx.skus()).select("sku", "reorder_point", "stockout_risk")
    return R.lookup_ci(o, "sku", "sku17", [F.col("sku")])


@register("filter_not_null_target", with_views(["skus_f"], """
SELECT inspection_result, COUNT(*) AS n FROM skus_f WHERE defect_rate_raw IS NOT NULL GROUP BY inspection_result"""))
def q_filter_not_null_target(ctx):
    return (R.filter_not_null(ctx.skus(), "defect_rate_raw")
            .groupBy("inspection_result").agg(F.count(F.lit(1)).alias("n")))


@register("filter_group_value", with_views(["orders_f"], f"""
SELECT late_delivery_flag, COUNT(profit_margin_pct) AS n,
  {r('AVG(profit_margin_pct)', 6)} AS mean_margin
FROM orders_f WHERE late_delivery_flag IN (0, 1) AND profit_margin_pct IS NOT NULL GROUP BY late_delivery_flag"""))
def q_filter_group_value(ctx):
    o = ctx.orders().where(F.col("late_delivery_flag").isin(0, 1) & F.col("profit_margin_pct").isNotNull())
    return o.groupBy("late_delivery_flag").agg(
        F.count("profit_margin_pct").alias("n"),
        C.round_half_up(F.avg("profit_margin_pct"), 6).alias("mean_margin"))


@register("filter_future_forecast", with_views(["b_fc"], f"""
SELECT forecast_horizon_days, COUNT(*) AS n FROM b_fc WHERE forecast_date >= {AS_OF} GROUP BY 1"""))
def q_filter_future_forecast(ctx):
    fc = ctx.wh.demand_forecasts()
    return (fc.where(F.col("forecast_date") >= F.lit(ctx.as_of))
            .groupBy("forecast_horizon_days").agg(F.count(F.lit(1)).alias("n")))


@register("filter_in_list", with_views(["b_br"], """
SELECT severity, COUNT(*) AS n FROM b_br WHERE status IN ('open', 'accepted') AND severity IN ('high', 'critical')
GROUP BY severity"""))
def q_filter_in_list(ctx):
    br = R.filter_in_list(ctx.wh.business_recommendations(), "status", ["open", "accepted"])
    return (R.filter_in_list(br, "severity", ["high", "critical"])
            .groupBy("severity").agg(F.count(F.lit(1)).alias("n")))


@register("filter_null_tests", with_views(["b_ship"], """
SELECT COUNT(*) FILTER (WHERE is_delayed IS TRUE) AS delayed, COUNT(*) FILTER (WHERE delay_days IS NOT NULL)
  AS with_delay, COUNT(*) FILTER (WHERE actual_delivery_date IS NULL) AS undelivered FROM b_ship"""))
def q_filter_null_tests(ctx):
    sh = ctx.wh.fact_shipments()
    return sh.agg(F.count_if(F.col("is_delayed") == F.lit(True)).alias("delayed"),
                  F.count_if(F.col("delay_days").isNotNull()).alias("with_delay"),
                  F.count_if(F.col("actual_delivery_date").isNull()).alias("undelivered"))


@register("filter_high_risk_supplier", _with_scores("""
SELECT supplier_name, risk_tier FROM tiered
WHERE LOWER(COALESCE(risk_tier, '')) IN ('high', 'high risk', 'critical')"""))
def q_filter_high_risk_supplier(ctx):
    return R.filter_high_risk_supplier(scoring.score_suppliers(ctx.skus())).select("supplier_name", "risk_tier")


@register("filter_supplier_region", with_views(["dim_suppliers"], """
SELECT supplier_code, supplier_name FROM dim_suppliers WHERE region = 'EUROPE'"""))
def q_filter_supplier_region(ctx):
    return ctx.wh.dim_suppliers().where(F.col("region") == "EUROPE").select("supplier_code", "supplier_name")


@register("filter_nonzero_actual", with_views(["orders_f"], """
SELECT COUNT(*) AS nonzero_rows FROM orders_f WHERE sales <> 0"""))
def q_filter_nonzero_actual(ctx):
    return ctx.orders().where(F.col("sales") != 0).agg(F.count(F.lit(1)).alias("nonzero_rows"))


# --- joins -----------------------------------------------------------------------------

_LATEST_INV = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id, location_id
   ORDER BY snapshot_date DESC, snapshot_id DESC) rn FROM b_inv) WHERE rn = 1)"""


@register("join_inner_dims", with_views(["b_inv", "dim_products", "dim_locations"], f"""
SELECT l.region, p.category, COUNT(*) AS positions, CAST(SUM(inv.inventory_value) AS DOUBLE) AS value
FROM {_LATEST_INV} inv JOIN dim_products p ON p.product_id = inv.product_id
JOIN dim_locations l ON l.location_id = inv.location_id GROUP BY l.region, p.category"""))
def q_join_inner_dims(ctx):
    inv = L.latest_inventory(ctx.wh.fact_inventory_snapshots())
    j = inv.join(ctx.wh.dim_products(), "product_id").join(ctx.wh.dim_locations(), "location_id")
    return j.groupBy("region", "category").agg(F.count(F.lit(1)).alias("positions"),
                                               F.sum("inventory_value").alias("value"))


@register("join_left_latest", with_views(["b_inv", "b_fc", "b_rec"], f"""
SELECT COUNT(*) AS positions, COUNT(fc.product_id) AS with_forecast, COUNT(rec.product_id) AS with_recommendation
FROM {_LATEST_INV} inv
LEFT JOIN (SELECT DISTINCT product_id, location_id FROM b_fc WHERE forecast_date >= {AS_OF}) fc
  ON fc.product_id = inv.product_id AND fc.location_id = inv.location_id
LEFT JOIN (SELECT DISTINCT product_id, location_id FROM b_rec) rec
  ON rec.product_id = inv.product_id AND rec.location_id = inv.location_id"""))
def q_join_left_latest(ctx):
    d = V.bi_inventory_dashboard(ctx.wh)
    return d.agg(F.count(F.lit(1)).alias("positions"), F.count("forecast_date").alias("with_forecast"),
                 F.count("recommendation_status").alias("with_recommendation"))


@register("join_supplier_summary", with_views(["b_po", "dim_suppliers"], """
SELECT s.region, COUNT(*) AS suppliers, CAST(COALESCE(SUM(pos.n), 0) AS BIGINT) AS purchase_orders
FROM dim_suppliers s LEFT JOIN (SELECT supplier_id, COUNT(*) AS n FROM b_po GROUP BY 1) pos
  ON pos.supplier_id = s.supplier_id GROUP BY s.region"""))
def q_join_supplier_summary(ctx):
    pos = V.po_summary(ctx.wh.fact_purchase_orders())
    j = ctx.wh.dim_suppliers().join(pos, "supplier_id", "left")
    return j.groupBy("region").agg(F.count(F.lit(1)).alias("suppliers"),
                                   F.coalesce(F.sum("total_purchase_orders"), F.lit(0)).alias("purchase_orders"))


@register("join_role_playing", with_views(["b_ship", "dim_locations"], """
SELECT src.region AS source_region, dst.region AS destination_region, COUNT(*) AS shipments
FROM b_ship sh LEFT JOIN dim_locations src ON src.location_id = sh.source_location_id
JOIN dim_locations dst ON dst.location_id = sh.destination_location_id GROUP BY 1, 2"""))
def q_join_role_playing(ctx):
    locs = ctx.wh.dim_locations()
    src = locs.select(F.col("location_id").alias("source_location_id"),
                                  F.col("region").alias("source_region"))
    dst = locs.select(F.col("location_id").alias("destination_location_id"),
                                  F.col("region").alias("destination_region"))
    j = ctx.wh.fact_shipments().join(src, "source_location_id", "left").join(dst, "destination_location_id")
    return j.groupBy("source_region", "destination_region").agg(F.count(F.lit(1)).alias("shipments"))


@register("join_cross_scalar", with_views(["b_ship", "b_dem"], """
SELECT s.n AS shipments, d.units AS demand_units FROM (SELECT COUNT(*) AS n FROM b_ship) s
CROSS JOIN (SELECT CAST(SUM(quantity_demanded) AS BIGINT) AS units FROM b_dem) d"""))
def q_join_cross_scalar(ctx):
    s = ctx.wh.fact_shipments().agg(F.count(F.lit(1)).alias("shipments"))
    d = ctx.wh.fact_sales_demand().agg(F.sum("quantity_demanded").cast("long").alias("demand_units"))
    return s.crossJoin(d)  # two one-row sides: broadcast nested loop


@register("join_recommendation_product", with_views(["b_rec", "dim_products"], """
SELECT p.category, r.priority, COUNT(*) AS n FROM b_rec r JOIN dim_products p ON p.product_id = r.product_id
GROUP BY 1, 2"""))
def q_join_recommendation_product(ctx):
    j = ctx.wh.inventory_recommendations().join(ctx.wh.dim_products(), "product_id")
    return j.groupBy("category", "priority").agg(F.count(F.lit(1)).alias("n"))


@register("join_embedded_supplier", with_views(["b_score", "dim_suppliers"], """
SELECT COALESCE(s.supplier_name, 'Unknown Supplier') AS supplier_name, COALESCE(s.region, 'Unknown') AS region,
  COUNT(*) AS scores
FROM b_score sc LEFT JOIN dim_suppliers s ON s.supplier_id = sc.supplier_id GROUP BY 1, 2"""))
def q_join_embedded_supplier(ctx):
    dim = ctx.wh.dim_suppliers().select("supplier_id", "supplier_name", "region")
    j = R.join_embedded(ctx.wh.supplier_performance_scores(), dim, "supplier_id",
                        {"supplier_name": "Unknown Supplier", "region": "Unknown"})
    return j.groupBy("supplier_name", "region").agg(F.count(F.lit(1)).alias("scores"))


@register("join_embedded_product", with_views(["b_rec", "dim_products"], """
SELECT COALESCE(p.category, 'Unknown') AS product_type, COUNT(*) AS recommendations,
  CAST(SUM(COALESCE(p.unit_cost, 10.0)) AS DOUBLE) AS unit_cost_sum
FROM b_rec r LEFT JOIN dim_products p ON p.product_id = r.product_id GROUP BY 1"""))
def q_join_embedded_product(ctx):
    dim = ctx.wh.dim_products().select("product_id", F.col("category").alias("product_type"), "unit_cost")
    j = R.join_embedded(ctx.wh.inventory_recommendations(), dim, "product_id",
                        {"product_type": "Unknown"})
    return j.groupBy("product_type").agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.sum(F.coalesce(F.col("unit_cost"), F.lit(10.0).cast("decimal(12,2)"))).alias("unit_cost_sum"))


@register("join_map_lookup", with_views(["b_rec", "dim_products", "skus_f"], """
SELECT COALESCE(m.supplier_name, 'Unknown Supplier') AS supplier_name, COUNT(*) AS recommendations,
  CAST(SUM(COALESCE(CAST(TRUNC(m.source_lead_time_days) AS BIGINT), 10)) AS BIGINT) AS lead_days
FROM b_rec r JOIN dim_products p ON p.product_id = r.product_id
LEFT JOIN skus_f m ON m.sku = p.sku GROUP BY 1"""))
def q_join_map_lookup(ctx):
    mapping = ctx.skus().select("sku", "supplier_name",
                                F.col("source_lead_time_days").cast("long").alias("lead_time_days"))
    recs = ctx.wh.inventory_recommendations().join(ctx.wh.dim_products().select("product_id", "sku"), "product_id")
    j = R.join_map_lookup(recs, mapping, "sku", {"supplier_name": "Unknown Supplier", "lead_time_days": 10})
    return j.groupBy("supplier_name").agg(F.count(F.lit(1)).alias("recommendations"),
                                          F.sum("lead_time_days").alias("lead_days"))


@register("join_anti_new_rows", with_views(["skus_f", "dim_products"], """
SELECT s.sku FROM skus_f s WHERE NOT EXISTS (
  SELECT 1 FROM dim_products p WHERE p.sku = s.sku AND p.product_id % 2 = 0)"""))
def q_join_anti_new_rows(ctx):
    stored = ctx.wh.dim_products().where(F.col("product_id") % 2 == 0)
    return R.join_anti_new_rows(ctx.skus().select("sku"), stored, ["sku"])


# --- aggregations -----------------------------------------------------------------------


@register("agg_count_filter", with_views(["b_ship"], """
SELECT carrier_id, COUNT(*) AS shipments, COUNT(*) FILTER (WHERE is_delayed IS TRUE) AS delayed
FROM b_ship GROUP BY carrier_id"""))
def q_agg_count_filter(ctx):
    return ctx.wh.fact_shipments().groupBy("carrier_id").agg(
        F.count(F.lit(1)).alias("shipments"), F.count_if(F.col("is_delayed") == F.lit(True)).alias("delayed"))


@register("agg_sum_coalesce", with_views(["b_dem"], """
SELECT location_id, CAST(COALESCE(SUM(quantity_demanded), 0) AS BIGINT) AS demand,
  CAST(COALESCE(SUM(lost_sales_quantity), 0) AS BIGINT) AS lost, CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS revenue
FROM b_dem GROUP BY location_id"""))
def q_agg_sum_coalesce(ctx):
    return ctx.wh.fact_sales_demand().groupBy("location_id").agg(
        F.coalesce(F.sum("quantity_demanded"), F.lit(0)).cast("long").alias("demand"),
        F.coalesce(F.sum("lost_sales_quantity"), F.lit(0)).cast("long").alias("lost"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"))


@register("agg_avg_filter", with_views(["b_ship"], """
SELECT carrier_id, CAST(ROUND(COALESCE(CAST(SUM(delay_days) AS DECIMAL(38,9)) / COUNT(delay_days), 0), 2) AS DOUBLE)
  AS average_delay_days FROM b_ship GROUP BY carrier_id"""))
def q_agg_avg_filter(ctx):
    return ctx.wh.fact_shipments().groupBy("carrier_id").agg(
        F.round(F.coalesce(F.avg(F.col("delay_days").cast("decimal(20,6)")), F.lit(0)), 2)
        .cast("double").alias("average_delay_days"))


@register("agg_po_by_supplier", with_views(["b_po"], """
SELECT supplier_id, COUNT(*) AS total_purchase_orders,
  COUNT(*) FILTER (WHERE status IN ('received', 'closed')) AS completed_purchase_orders,
  CAST(SUM(ordered_quantity) AS BIGINT) AS ordered_units, CAST(SUM(received_quantity) AS BIGINT) AS received_units,
  CAST(SUM(defect_quantity) AS BIGINT) AS defect_units,
  COUNT(*) FILTER (WHERE actual_delivery_date IS NOT NULL AND actual_delivery_date <= expected_delivery_date)
    AS on_time_purchase_orders FROM b_po GROUP BY supplier_id"""))
def q_agg_po_by_supplier(ctx):
    return V.po_summary(ctx.wh.fact_purchase_orders())


for _col in ["shipping_mode", "market", "category_name", "customer_segment"]:
    register(f"agg_value_counts_{_col}", with_views(["orders_f"], f"""
SELECT {_col}, COUNT(*) AS count FROM orders_f GROUP BY {_col}"""))(
        lambda ctx, c=_col: R.agg_value_counts(ctx.orders(), c))


@register("agg_value_counts_product_type", with_views(["skus_f"], """
SELECT product_type, COUNT(*) AS count FROM skus_f GROUP BY product_type"""))
def q_agg_value_counts_product_type(ctx):
    return R.agg_value_counts(ctx.skus(), "product_type")


@register("topk_categories", with_views(["orders_f"], """
SELECT order_region, COUNT(*) AS count FROM orders_f GROUP BY order_region ORDER BY count DESC, order_region
LIMIT 10"""))
def q_topk_categories(ctx):
    return R.topk_categories(ctx.orders(), "order_region", 10)


@register("reindex_categories", with_views(["skus_f"], """
SELECT l.inspection_result, CAST(l.level_order AS BIGINT) AS level_order, COALESCE(c.count, 0) AS count
FROM (VALUES ('Pass', 0), ('Fail', 1), ('Pending', 2), ('Unknown', 3)) l(inspection_result, level_order)
LEFT JOIN (SELECT inspection_result, COUNT(*) AS count FROM skus_f GROUP BY 1) c
  ON c.inspection_result = l.inspection_result"""))
def q_reindex_categories(ctx):
    return R.reindex_categories(R.agg_value_counts(ctx.skus(), "inspection_result"), "inspection_result",
                                ["Pass", "Fail", "Pending", "Unknown"])


@register("agg_crosstab", with_views(["orders_f"], """
SELECT shipping_mode, COUNT(*) FILTER (WHERE late_delivery_flag = 0) AS "0",
  COUNT(*) FILTER (WHERE late_delivery_flag = 1) AS "1" FROM orders_f GROUP BY shipping_mode"""))
def q_agg_crosstab(ctx):
    return R.agg_crosstab(ctx.orders(), "shipping_mode", "late_delivery_flag", [0, 1])


@register("agg_crosstab_rownorm", with_views(["orders_f"], f"""
SELECT shipping_mode, late_delivery_flag, {r('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY shipping_mode)', 9)}
  AS share FROM (SELECT shipping_mode, late_delivery_flag, COUNT(*) AS n FROM orders_f GROUP BY 1, 2)"""))
def q_agg_crosstab_rownorm(ctx):
    x = R.agg_crosstab_rownorm(ctx.orders(), "shipping_mode", "late_delivery_flag")
    return x.withColumn("share", C.round_half_up("share", 9))


@register("agg_shipping_mode_delay", with_views(["orders_f"], f"""
SELECT shipping_mode, {r('AVG(late_delivery_flag) * 100', 4)} AS delay_rate_pct,
  {r('AVG(delivery_delay_days)', 4)} AS mean_delay_days FROM orders_f GROUP BY shipping_mode"""))
def q_agg_shipping_mode_delay(ctx):
    return ctx.orders().groupBy("shipping_mode").agg(
        C.round_half_up(F.avg("late_delivery_flag") * 100, 4).alias("delay_rate_pct"),
        C.round_half_up(F.avg("delivery_delay_days"), 4).alias("mean_delay_days"))


@register("agg_duplicate_rows", with_views(["skus_f"], """
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT *, COUNT(*) AS n FROM (SELECT * FROM skus_f UNION ALL SELECT * FROM skus_f WHERE stock_levels > 50) GROUP BY ALL)"""))
def q_agg_duplicate_rows(ctx):
    """Whole rows; well stocked SKUs are there twice, so there is something to find."""
    skus = ctx.skus()
    return R.agg_duplicate_rows(skus.unionByName(skus.where("stock_levels > 50")))


@register("agg_null_counts", with_views(["skus_f"], """
SELECT COUNT(*) FILTER (WHERE defect_rate_raw IS NULL) AS defect_rate_raw_nulls,
  COUNT(*) FILTER (WHERE shipping_cost_per_unit IS NULL) AS shipping_cost_per_unit_nulls,
  COUNT(*) FILTER (WHERE supply_pressure_missing IS NULL) AS supply_pressure_missing_nulls FROM
  (SELECT *, CASE WHEN availability <> 0 THEN products_sold / availability END AS supply_pressure_missing FROM skus_f)"""))
def q_agg_null_counts(ctx):
    df = ctx.skus_clean().withColumnRenamed("supply_pressure_index", "supply_pressure_missing")
    return R.agg_null_counts(df, ["defect_rate_raw", "shipping_cost_per_unit", "supply_pressure_missing"])


@register("agg_minmax", with_views(["orders_f"], """
SELECT MIN(benefit_per_order) AS min, MAX(benefit_per_order) AS max FROM orders_f"""))
def q_agg_minmax(ctx):
    return R.agg_minmax(ctx.orders(), "benefit_per_order")


@register("agg_class_balance", with_views(["orders_f"], f"""
SELECT late_delivery_flag, COUNT(*) AS n, {r('CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()', 9)} AS share
FROM orders_f GROUP BY 1"""))
def q_agg_class_balance(ctx):
    b = R.agg_class_balance(ctx.orders(), "late_delivery_flag")
    return b.withColumn("share", C.round_half_up("share", 9))


@register("agg_target_stats", with_views(["orders_f"], f"""
SELECT {r('AVG(sales)', 4)} AS mean, {r('STDDEV_SAMP(sales)', 4)} AS std FROM orders_f"""))
def q_agg_target_stats(ctx):
    s = R.agg_target_stats(ctx.orders(), "sales")
    return s.select(C.round_half_up("mean", 4).alias("mean"), C.round_half_up("std", 4).alias("std"))


@register("agg_histogram", with_views(["orders_f"], """
SELECT LEAST(CAST(FLOOR(15 * (sales - mn) / (mx - mn)) AS BIGINT) + 1, 15) AS bin, COUNT(*) AS count
FROM orders_f CROSS JOIN (SELECT MIN(sales) AS mn, MAX(sales) AS mx FROM orders_f) m
WHERE sales IS NOT NULL GROUP BY 1"""))
def q_agg_histogram(ctx):
    return R.agg_histogram(ctx.orders(), "sales", 15)


# --- sorts, dedupe, sampling -------------------------------------------------------------


@register("dedupe_in_batch", with_views(["skus_f"], """
SELECT product_type, MIN(sku) AS first_sku, COUNT(*) AS n FROM skus_f GROUP BY product_type"""))
def q_dedupe_in_batch(ctx):
    s = ctx.skus().select("product_type", "sku")
    cnt = s.groupBy("product_type").agg(F.count(F.lit(1)).alias("n"))
    first = R.dedupe_first(s, "product_type", ["sku"]).withColumnRenamed("sku", "first_sku")
    return first.join(cnt, "product_type")


_HASH = "CAST('0x' || SUBSTR(MD5(CAST(line_key AS VARCHAR) || '|42'), 1, 15) AS BIGINT)"


@register("sample_scatter", with_views(["orders_f"], f"""
SELECT sales, benefit_per_order, line_key FROM orders_f ORDER BY {_HASH}, line_key LIMIT 2000"""))
def q_sample_scatter(ctx):
    o = ctx.orders_clean().select("sales", "benefit_per_order", "Line Key")
    return R.sample_rows(o, F.col("`Line Key`"), 2000).select("sales", "benefit_per_order", F.col("Line Key").alias("line_key"))


@register("split_train_test", with_views(["orders_f"], f"""
SELECT line_key FROM orders_f QUALIFY ROW_NUMBER() OVER (ORDER BY {_HASH}, line_key) <= CEIL(0.2 * COUNT(*) OVER ())"""))
def q_split_train_test(ctx):
    """The keys of the test rows."""
    o = ctx.orders_clean().select(F.col("Line Key").alias("line_key"), "sales")
    return R.split_train_test(o, F.col("line_key")).where("is_test").select("line_key")


@register("split_stratified", with_views(["orders_f"], f"""
SELECT f.late_delivery_flag, line_key
FROM (SELECT late_delivery_flag, line_key, ROW_NUMBER() OVER (PARTITION BY late_delivery_flag ORDER BY {_HASH}, line_key) AS rn FROM orders_f) f
JOIN (SELECT late_delivery_flag, n * t // a + CASE WHEN ROW_NUMBER() OVER (ORDER BY n * t % a DESC, CAST(late_delivery_flag AS VARCHAR)) <=
        t - SUM(n * t // a) OVER () THEN 1 ELSE 0 END AS want
      FROM (SELECT late_delivery_flag, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS a, CAST(CEIL(0.2 * SUM(COUNT(*)) OVER ()) AS BIGINT) AS t
            FROM orders_f GROUP BY 1)) w ON w.late_delivery_flag = f.late_delivery_flag
WHERE rn <= want"""))
def q_split_stratified(ctx):
    """The keys of the test rows: each class has its rounded share."""
    o = ctx.orders_clean().select(F.col("Line Key").alias("line_key"), "late_delivery_flag")
    return R.split_stratified(o, F.col("line_key"), "late_delivery_flag").where("is_test").select("late_delivery_flag", "line_key")


@register("history_recent", """
SELECT event_id, user_id, event_type, CAST(ts AS VARCHAR) AS ts FROM events WHERE user_id = 7
ORDER BY ts DESC, event_id DESC LIMIT 200""")
def q_history_recent(ctx):
    ev = ctx.t.events.where(F.col("user_id") == 7).select("event_id", "user_id", "event_type", "ts")
    return ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200)
