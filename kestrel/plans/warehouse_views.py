"""Publish the warehouse tables and BI views as session views (by name)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.plans import bridge
from kestrel.plans import views as V


def publish(ctx) -> list[str]:
    from kestrel.operators import quality as Q
    from kestrel.plans.q_ml import _registry
    from kestrel.plans.q_workspace import batch_runs
    wh = ctx.wh
    runs, landed = batch_runs(ctx)
    inv = "fact_inventory_snapshots"
    tables = {
        "etl_batch_runs": runs,
        "raw_source_files": ctx.spark.read.parquet(f"{landed}/raw_source_files"),
        "raw_source_records": ctx.spark.read.parquet(f"{landed}/raw_source_records"),
        "data_quality_issues": Q.quality_issues(wh.fact_inventory_snapshots(), inv, F.col("snapshot_id"), Q.table_rules(inv),
                                                "batch-1", ctx.as_of),
        "model_registry": _registry(ctx),
        "dim_locations": wh.dim_locations(), "dim_products": wh.dim_products(),
        "dim_suppliers": wh.dim_suppliers(), "dim_carriers": wh.dim_carriers(),
        "supplier_products": bridge.supplier_products(ctx.t),
        "fact_purchase_orders": wh.fact_purchase_orders(),
        "fact_customer_orders": bridge.fact_customer_orders(ctx.t),
        "fact_sales_demand": wh.fact_sales_demand(),
        "fact_inventory_snapshots": wh.fact_inventory_snapshots(),
        "fact_shipments": wh.fact_shipments(), "demand_forecasts": wh.demand_forecasts(),
        "shipment_delay_predictions": wh.shipment_delay_predictions(),
        "supplier_performance_scores": wh.supplier_performance_scores(),
        "inventory_recommendations": wh.inventory_recommendations(),
        "business_recommendations": wh.business_recommendations(),
        "bi_executive_kpis": V.bi_executive_kpis(wh), "bi_inventory_dashboard": V.bi_inventory_dashboard(wh),
        "bi_supplier_dashboard": V.bi_supplier_dashboard(wh),
        "bi_logistics_dashboard": V.bi_logistics_dashboard(wh),
        "bi_inventory_recommendations": V.bi_inventory_recommendations(wh),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)  # lazy: only the plan is registered
    return list(tables)
