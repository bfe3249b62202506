"""BI views and the keep-latest / join operators they are built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import latest as L
from kestrel.plans import views as V
from kestrel.plans.oracle_views import AS_OF, with_views
from kestrel.plans.registry import register

_LATEST_INV = """(select * from (select *, row_number() over (partition by product_id, location_id
   order by snapshot_date desc, snapshot_id desc) rn from b_inv) where rn = 1)"""
_NEAREST_FC = f"""(select * from (select *, row_number() over (partition by product_id, location_id
   order by forecast_date, created_at desc, forecast_horizon_days) rn from b_fc
   where forecast_date >= {AS_OF}) where rn = 1)"""
_LATEST_REC = """(select * from (select *, row_number() over (partition by product_id, location_id
   order by recommendation_date desc, created_at desc, inventory_recommendation_id desc) rn
   from b_rec) where rn = 1)"""
_LATEST_SCORE = """(select * from (select *, row_number() over (partition by supplier_id
   order by score_date desc, created_at desc) rn from b_score) where rn = 1)"""
_LATEST_PRED = """(select * from (select *, row_number() over (partition by shipment_id
   order by created_at desc, predicted_delay_probability desc) rn from b_pred) where rn = 1)"""


def _pct(num: str, den: str) -> str:
    return (f"CAST(COALESCE(ROUND(CAST({num} AS DECIMAL(38,6)) * 100 / NULLIF(CAST({den} AS DECIMAL(38,6)), 0), 2), 0)"
            " AS DOUBLE)")


@register("bi_executive_kpis", with_views(["b_ship", "b_dem", "b_inv", "b_br"], f"""
SELECT d.total_demand_units, d.total_sold_units, d.total_lost_sales_units,
  CAST(d.total_revenue AS DOUBLE) AS total_revenue,
  s.total_shipments, s.delayed_shipments,
  {_pct('s.delayed_shipments', 's.total_shipments')} AS shipment_delay_rate_pct,
  CAST(ROUND(COALESCE(s.avg_delay, 0), 2) AS DOUBLE) AS average_delay_days,
  i.inventory_positions, CAST(i.inventory_value AS DOUBLE) AS inventory_value, i.reorder_risk_positions,
  r.open_recommendations, r.high_priority_recommendations, '2001-06-01 00:00:00' AS refreshed_at
FROM (SELECT COUNT(*) AS total_shipments,
             COUNT(*) FILTER (WHERE is_delayed IS TRUE) AS delayed_shipments,
             CAST(SUM(delay_days) AS DECIMAL(38,9)) / COUNT(delay_days) AS avg_delay FROM b_ship) s
CROSS JOIN (SELECT CAST(COALESCE(SUM(quantity_demanded), 0) AS BIGINT) AS total_demand_units,
                   CAST(COALESCE(SUM(quantity_sold), 0) AS BIGINT) AS total_sold_units,
                   CAST(COALESCE(SUM(lost_sales_quantity), 0) AS BIGINT) AS total_lost_sales_units,
                   COALESCE(SUM(revenue), 0) AS total_revenue FROM b_dem) d
CROSS JOIN (SELECT COUNT(*) AS inventory_positions, COALESCE(SUM(inventory_value), 0) AS inventory_value,
                   COUNT(*) FILTER (WHERE available_quantity <= reorder_point) AS reorder_risk_positions
            FROM {_LATEST_INV}) i
CROSS JOIN (SELECT COUNT(*) FILTER (WHERE status = 'open') AS open_recommendations,
                   COUNT(*) FILTER (WHERE status = 'open' AND severity IN ('high', 'critical'))
                     AS high_priority_recommendations FROM b_br) r"""))
def q_bi_executive_kpis(ctx):
    return V.bi_executive_kpis(ctx.wh)


@register("bi_inventory_dashboard", with_views(["b_inv", "b_fc", "b_rec", "dim_products", "dim_locations"], f"""
SELECT CAST(inv.snapshot_date AS VARCHAR) AS snapshot_date, p.sku, p.product_name, p.category,
  l.location_code, l.location_name, l.region,
  CAST(inv.on_hand_quantity AS BIGINT) AS on_hand_quantity, CAST(inv.reserved_quantity AS BIGINT) AS reserved_quantity,
  CAST(inv.available_quantity AS BIGINT) AS available_quantity, CAST(inv.reorder_point AS BIGINT) AS reorder_point,
  CAST(inv.safety_stock AS BIGINT) AS safety_stock, CAST(inv.inventory_value AS DOUBLE) AS inventory_value,
  CASE WHEN inv.available_quantity <= inv.reorder_point THEN TRUE ELSE FALSE END AS below_reorder_point,
  CAST(fc.forecast_date AS VARCHAR) AS forecast_date, CAST(fc.forecast_horizon_days AS DOUBLE) AS forecast_horizon_days,
  CAST(fc.predicted_quantity AS DOUBLE) AS predicted_quantity,
  CAST(rec.recommended_order_quantity AS DOUBLE) AS recommended_order_quantity,
  rec.priority AS recommendation_priority, rec.status AS recommendation_status
FROM {_LATEST_INV} inv
JOIN dim_products p ON p.product_id = inv.product_id
JOIN dim_locations l ON l.location_id = inv.location_id
LEFT JOIN {_NEAREST_FC} fc ON fc.product_id = inv.product_id AND fc.location_id = inv.location_id
LEFT JOIN {_LATEST_REC} rec ON rec.product_id = inv.product_id AND rec.location_id = inv.location_id"""))
def q_bi_inventory_dashboard(ctx):
    # outer-joined integer columns are compared as double (nullable)
    return V.bi_inventory_dashboard(ctx.wh).withColumns({
        "forecast_horizon_days": F.col("forecast_horizon_days").cast("double"),
        "recommended_order_quantity": F.col("recommended_order_quantity").cast("double")})


@register("bi_supplier_dashboard", with_views(["b_po", "b_score", "dim_suppliers"], f"""
SELECT s.supplier_code, s.supplier_name, s.country, s.region,
  CAST(s.default_lead_time_days AS BIGINT) AS default_lead_time_days,
  CAST(COALESCE(pos.total_purchase_orders, 0) AS BIGINT) AS total_purchase_orders,
  CAST(COALESCE(pos.completed_purchase_orders, 0) AS BIGINT) AS completed_purchase_orders,
  CAST(COALESCE(pos.ordered_units, 0) AS BIGINT) AS ordered_units,
  CAST(COALESCE(pos.received_units, 0) AS BIGINT) AS received_units,
  CAST(COALESCE(pos.defect_units, 0) AS BIGINT) AS defect_units,
  {_pct('pos.on_time_purchase_orders', 'pos.completed_purchase_orders')} AS supplier_on_time_rate_pct,
  {_pct('pos.defect_units', 'pos.received_units')} AS defect_rate_pct,
  CAST(ls.score_date AS VARCHAR) AS score_date, CAST(ls.delivery_score AS DOUBLE) AS delivery_score,
  CAST(ls.quality_score AS DOUBLE) AS quality_score, CAST(ls.cost_score AS DOUBLE) AS cost_score,
  CAST(ls.reliability_score AS DOUBLE) AS reliability_score, CAST(ls.overall_score AS DOUBLE) AS overall_score,
  ls.risk_tier
FROM dim_suppliers s
LEFT JOIN (SELECT supplier_id, COUNT(*) AS total_purchase_orders,
     COUNT(*) FILTER (WHERE status IN ('received', 'closed')) AS completed_purchase_orders,
     COALESCE(SUM(ordered_quantity), 0) AS ordered_units, COALESCE(SUM(received_quantity), 0) AS received_units,
     COALESCE(SUM(defect_quantity), 0) AS defect_units,
     COUNT(*) FILTER (WHERE actual_delivery_date IS NOT NULL AND actual_delivery_date <= expected_delivery_date)
       AS on_time_purchase_orders
   FROM b_po GROUP BY supplier_id) pos ON pos.supplier_id = s.supplier_id
LEFT JOIN {_LATEST_SCORE} ls ON ls.supplier_id = s.supplier_id"""))
def q_bi_supplier_dashboard(ctx):
    return V.bi_supplier_dashboard(ctx.wh)


@register("bi_logistics_dashboard", with_views(["b_ship", "b_pred", "dim_products", "dim_carriers",
                                                "dim_locations", "dim_suppliers"], f"""
SELECT sh.shipment_number, CAST(sh.ship_date AS VARCHAR) AS ship_date,
  CAST(sh.expected_delivery_date AS VARCHAR) AS expected_delivery_date,
  CAST(sh.actual_delivery_date AS VARCHAR) AS actual_delivery_date, sh.status,
  CAST(sh.shipped_quantity AS BIGINT) AS shipped_quantity, CAST(sh.delivered_quantity AS BIGINT) AS delivered_quantity,
  CAST(sh.freight_cost AS DOUBLE) AS freight_cost, CAST(sh.distance_km AS DOUBLE) AS distance_km,
  CAST(sh.delay_days AS DOUBLE) AS delay_days, CAST(sh.is_delayed AS VARCHAR) AS is_delayed, p.sku, p.product_name,
  c.carrier_code, c.carrier_name, c.transport_mode,
  src.location_code AS source_location_code, src.location_name AS source_location_name,
  dest.location_code AS destination_location_code, dest.location_name AS destination_location_name,
  s.supplier_code, s.supplier_name,
  CAST(ldp.predicted_delay_probability AS DOUBLE) AS predicted_delay_probability,
  CAST(ldp.predicted_delay_days AS DOUBLE) AS predicted_delay_days,
  ldp.risk_level AS predicted_delay_risk_level,
  CAST(ldp.created_at AS VARCHAR) AS prediction_created_at
FROM b_ship sh
JOIN dim_products p ON p.product_id = sh.product_id
LEFT JOIN dim_carriers c ON c.carrier_id = sh.carrier_id
LEFT JOIN dim_locations src ON src.location_id = sh.source_location_id
JOIN dim_locations dest ON dest.location_id = sh.destination_location_id
LEFT JOIN dim_suppliers s ON s.supplier_id = sh.supplier_id
LEFT JOIN {_LATEST_PRED} ldp ON ldp.shipment_id = sh.shipment_id"""))
def q_bi_logistics_dashboard(ctx):
    # outer-derived nullable columns compared in portable types
    return V.bi_logistics_dashboard(ctx.wh).withColumns({
        "delay_days": F.col("delay_days").cast("double"), "is_delayed": F.col("is_delayed").cast("string")})


@register("bi_inventory_recommendations", with_views(["b_rec", "dim_products"], """
SELECT p.sku, p.product_name, CAST(r.current_stock AS BIGINT) AS current_stock,
  CAST(r.reorder_point AS BIGINT) AS reorder_point,
  CAST(r.recommended_order_quantity AS BIGINT) AS recommended_order_quantity,
  CAST(r.safety_stock AS BIGINT) AS safety_stock, r.priority, r.status
FROM b_rec r JOIN dim_products p ON p.product_id = r.product_id"""))
def q_bi_inventory_recommendations(ctx):
    return V.bi_inventory_recommendations(ctx.wh)


# --- keep-latest operators on their own ----------------------------------------

@register("latest_inventory", with_views(["b_inv"], f"""
SELECT product_id, location_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date,
  CAST(available_quantity AS BIGINT) AS available_quantity, CAST(inventory_value AS DOUBLE) AS inventory_value
FROM {_LATEST_INV}"""))
def q_latest_inventory(ctx):
    return L.latest_inventory(ctx.wh.fact_inventory_snapshots()).select(
        "product_id", "location_id", "snapshot_date", "available_quantity", "inventory_value")


@register("nearest_forecast", with_views(["b_fc"], f"""
SELECT product_id, location_id, CAST(forecast_date AS VARCHAR) AS forecast_date,
  CAST(forecast_horizon_days AS BIGINT) AS forecast_horizon_days FROM {_NEAREST_FC}"""))
def q_nearest_forecast(ctx):
    return L.nearest_forecast(ctx.wh.demand_forecasts(), ctx.as_of).select(
        "product_id", "location_id", "forecast_date", "forecast_horizon_days")


@register("latest_inventory_rec", with_views(["b_rec"], f"""
SELECT product_id, location_id, CAST(recommendation_date AS VARCHAR) AS recommendation_date,
  CAST(recommended_order_quantity AS BIGINT) AS recommended_order_quantity, priority FROM {_LATEST_REC}"""))
def q_latest_inventory_rec(ctx):
    return L.latest_inventory_rec(ctx.wh.inventory_recommendations()).select(
        "product_id", "location_id", "recommendation_date", "recommended_order_quantity", "priority")


@register("latest_supplier_score", with_views(["b_score"], f"""
SELECT supplier_id, CAST(score_date AS VARCHAR) AS score_date, CAST(overall_score AS DOUBLE) AS overall_score,
  risk_tier FROM {_LATEST_SCORE}"""))
def q_latest_supplier_score(ctx):
    return L.latest_supplier_score(ctx.wh.supplier_performance_scores()).select(
        "supplier_id", "score_date", "overall_score", "risk_tier")


@register("latest_delay_prediction", with_views(["b_pred"], f"""
SELECT shipment_id, CAST(predicted_delay_probability AS DOUBLE) AS predicted_delay_probability,
  risk_level, CAST(created_at AS VARCHAR) AS created_at FROM {_LATEST_PRED}"""))
def q_latest_delay_prediction(ctx):
    return L.latest_delay_prediction(ctx.wh.shipment_delay_predictions()).select(
        "shipment_id", "predicted_delay_probability", "risk_level", "created_at")


@register("row_number_in_source", """
SELECT CAST(row_number() OVER () AS BIGINT) AS rn, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem""")
def q_row_number_in_source(ctx):
    """Every row with its number in file order."""
    from kestrel.sources.files import number_rows_in_file_order
    return number_rows_in_file_order(ctx.t.lineitem, "rn").select("rn", "l_orderkey", "l_linenumber")
