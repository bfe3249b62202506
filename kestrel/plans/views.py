"""The five BI views as DataFrame plans.

Shape of every view: aggregate or keep-latest first (so joins see one row
per key), then joins.  Dimension sides with a schema-bounded size
(locations = nations, carriers = 5 codes) are broadcast; product and
supplier dimensions grow with the data, so AQE picks the strategy from
runtime sizes.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.operators import latest as L
from kestrel.plans.bridge import Warehouse


def bi_executive_kpis(wh: Warehouse, as_of: date | None = None) -> DataFrame:
    """One row; ``refreshed_at`` is the explicit report time."""
    sh = wh.fact_shipments().agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.count_if(F.col("is_delayed") == F.lit(True)).alias("delayed_shipments"),
        F.avg(F.col("delay_days").cast("decimal(20,6)")).alias("avg_delay"))
    dem = wh.fact_sales_demand().agg(
        F.coalesce(F.sum("quantity_demanded"), F.lit(0)).cast("long").alias("total_demand_units"),
        F.coalesce(F.sum("quantity_sold"), F.lit(0)).cast("long").alias("total_sold_units"),
        F.coalesce(F.sum("lost_sales_quantity"), F.lit(0)).cast("long").alias("total_lost_sales_units"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"))
    inv = L.latest_inventory(wh.fact_inventory_snapshots()).agg(
        F.count(F.lit(1)).alias("inventory_positions"),
        F.coalesce(F.sum("inventory_value"), F.lit(0)).alias("inventory_value"),
        F.count_if(F.col("available_quantity") <= F.col("reorder_point")).alias("reorder_risk_positions"))
    rec = wh.business_recommendations().agg(
        F.count_if(F.col("status") == "open").alias("open_recommendations"),
        F.count_if((F.col("status") == "open") & F.col("severity").isin("high", "critical"))
         .alias("high_priority_recommendations"))
    one = sh.crossJoin(dem).crossJoin(inv).crossJoin(rec)  # four one-row sides
    return one.select(
        "total_demand_units", "total_sold_units", "total_lost_sales_units",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("total_shipments").cast("long").alias("total_shipments"),
        F.col("delayed_shipments").cast("long").alias("delayed_shipments"),
        C.pct_or_zero("delayed_shipments", "total_shipments").alias("shipment_delay_rate_pct"),
        F.round(F.coalesce(F.col("avg_delay"), F.lit(0)), 2).cast("double").alias("average_delay_days"),
        F.col("inventory_positions").cast("long").alias("inventory_positions"),
        F.col("inventory_value").cast("double").alias("inventory_value"),
        F.col("reorder_risk_positions").cast("long").alias("reorder_risk_positions"),
        F.col("open_recommendations").cast("long").alias("open_recommendations"),
        F.col("high_priority_recommendations").cast("long").alias("high_priority_recommendations"),
        F.lit(as_of or wh.as_of).cast("timestamp").alias("refreshed_at"))


def bi_inventory_dashboard(wh: Warehouse, as_of: date | None = None) -> DataFrame:
    as_of = as_of or wh.as_of
    inv = L.latest_inventory(wh.fact_inventory_snapshots())
    fc = L.nearest_forecast(wh.demand_forecasts(), as_of).select(
        "product_id", "location_id", "forecast_date", "forecast_horizon_days", "predicted_quantity")
    rec = L.latest_inventory_rec(wh.inventory_recommendations()).select(
        "product_id", "location_id", "recommended_order_quantity",
        F.col("priority").alias("recommendation_priority"),
        F.col("status").alias("recommendation_status"))
    p = wh.dim_products().select("product_id", "sku", "product_name", "category")
    loc = wh.dim_locations().select("location_id", "location_code", "location_name", "region")
    key = ["product_id", "location_id"]
    return (inv.join(p, "product_id").join(loc, "location_id")
            .join(fc, key, "left").join(rec, key, "left")
            .select("snapshot_date", "sku", "product_name", "category", "location_code",
                    "location_name", "region", "on_hand_quantity", "reserved_quantity",
                    "available_quantity", "reorder_point", "safety_stock", "inventory_value",
                    C.below_or_at("available_quantity", "reorder_point").alias("below_reorder_point"),
                    "forecast_date", "forecast_horizon_days", "predicted_quantity",
                    "recommended_order_quantity", "recommendation_priority", "recommendation_status"))


def po_summary(po: DataFrame) -> DataFrame:
    """Purchase-order performance per supplier (partial aggregation map-side)."""
    return po.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_purchase_orders"),
        F.count_if(F.col("status").isin("received", "closed")).alias("completed_purchase_orders"),
        F.coalesce(F.sum("ordered_quantity"), F.lit(0)).alias("ordered_units"),
        F.coalesce(F.sum("received_quantity"), F.lit(0)).alias("received_units"),
        F.coalesce(F.sum("defect_quantity"), F.lit(0)).alias("defect_units"),
        F.count_if(F.col("actual_delivery_date").isNotNull()
                   & (F.col("actual_delivery_date") <= F.col("expected_delivery_date")))
         .alias("on_time_purchase_orders"))


def bi_supplier_dashboard(wh: Warehouse) -> DataFrame:
    pos = po_summary(wh.fact_purchase_orders())
    score = L.latest_supplier_score(wh.supplier_performance_scores()).select(
        "supplier_id", "score_date", "delivery_score", "quality_score", "cost_score",
        "reliability_score", "overall_score", "risk_tier")
    s = wh.dim_suppliers()
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (s.join(pos, "supplier_id", "left").join(score, "supplier_id", "left")
            .select("supplier_code", "supplier_name", "country", "region", "default_lead_time_days",
                    z("total_purchase_orders"), z("completed_purchase_orders"), z("ordered_units"),
                    z("received_units"), z("defect_units"),
                    C.pct_or_zero("on_time_purchase_orders", "completed_purchase_orders")
                     .alias("supplier_on_time_rate_pct"),
                    C.pct_or_zero("defect_units", "received_units").alias("defect_rate_pct"),
                    "score_date", "delivery_score", "quality_score", "cost_score",
                    "reliability_score", "overall_score", "risk_tier"))


def bi_logistics_dashboard(wh: Warehouse) -> DataFrame:
    sh = wh.fact_shipments()
    pred = L.latest_delay_prediction(wh.shipment_delay_predictions()).select(
        "shipment_id", "predicted_delay_probability", "predicted_delay_days",
        F.col("risk_level").alias("predicted_delay_risk_level"),
        F.col("created_at").alias("prediction_created_at"))
    p = wh.dim_products().select("product_id", "sku", "product_name")
    car = F.broadcast(wh.dim_carriers().select("carrier_id", "carrier_code", "carrier_name", "transport_mode"))
    locs = wh.dim_locations()
    src = locs.select(F.col("location_id").alias("source_location_id"),
                                  F.col("location_code").alias("source_location_code"),
                                  F.col("location_name").alias("source_location_name"))
    dst = locs.select(F.col("location_id").alias("destination_location_id"),
                                  F.col("location_code").alias("destination_location_code"),
                                  F.col("location_name").alias("destination_location_name"))
    sup = wh.dim_suppliers().select("supplier_id", "supplier_code", "supplier_name")
    return (sh.join(p, "product_id")
            .join(car, "carrier_id", "left")
            .join(src, "source_location_id", "left")
            .join(dst, "destination_location_id")
            .join(sup, "supplier_id", "left")
            .join(pred, "shipment_id", "left")
            .select("shipment_number", "ship_date", "expected_delivery_date", "actual_delivery_date",
                    "status", "shipped_quantity", "delivered_quantity", "freight_cost", "distance_km",
                    "delay_days", "is_delayed", "sku", "product_name", "carrier_code", "carrier_name",
                    "transport_mode", "source_location_code", "source_location_name",
                    "destination_location_code", "destination_location_name", "supplier_code",
                    "supplier_name", "predicted_delay_probability", "predicted_delay_days",
                    "predicted_delay_risk_level", "prediction_created_at"))


def bi_inventory_recommendations(wh: Warehouse) -> DataFrame:
    r = wh.inventory_recommendations()
    p = wh.dim_products().select("product_id", "sku", "product_name")
    return r.join(p, "product_id").select(
        "sku", "product_name", "current_stock", "reorder_point", "recommended_order_quantity",
        "safety_stock", "priority", "status")
