"""The SQL smoke fixture (one row per table, dates relative to as_of)."""
from datetime import date, timedelta

from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.plans import views as V
from kestrel.plans.bridge import Warehouse

AS_OF = date(2026, 6, 11)


class SmokeWarehouse(Warehouse):
    def __init__(self, spark):
        self.spark = spark
        self.as_of = AS_OF

    def _df(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def fact_shipments(self):
        d = lambda n: AS_OF + timedelta(days=n)
        df = self._df([("SH1", "SH1", 1, 1, 2, 1, 1, d(-5), d(-2), d(-1), 10, 10, "delivered")],
                      "shipment_id string, shipment_number string, carrier_id int, source_location_id int, "
                      "destination_location_id int, supplier_id int, product_id int, ship_date date, "
                      "expected_delivery_date date, actual_delivery_date date, shipped_quantity int, "
                      "delivered_quantity int, status string")
        df = df.withColumns({"freight_cost": F.lit(12.5).cast("decimal(12,2)"),
                             "distance_km": F.lit(100).cast("decimal(10,2)")})
        return (df.withColumn("delay_days", C.date_diff_floor0("actual_delivery_date", "expected_delivery_date"))
                  .withColumn("is_delayed", C.is_delayed("actual_delivery_date", "expected_delivery_date")))

    def fact_sales_demand(self):
        return self._df([(AS_OF, 1, 2, 30, 25, 5)], "demand_date date, product_id int, location_id int, "
                        "quantity_demanded int, quantity_sold int, lost_sales_quantity int") \
            .withColumn("revenue", F.lit(375).cast("decimal(14,2)"))

    def fact_inventory_snapshots(self):
        return self._df([("I1", 1, 2, AS_OF, 80, 10, 70, 50, 20)],
                        "snapshot_id string, product_id int, location_id int, snapshot_date date, "
                        "on_hand_quantity int, reserved_quantity int, available_quantity int, reorder_point int, "
                        "safety_stock int").withColumn("inventory_value", F.lit(800).cast("decimal(14,2)"))

    def business_recommendations(self):
        return self._df([("B1", "open", "medium")], "business_recommendation_id string, status string, "
                        "severity string")


def test_executive_kpis_smoke(spark):
    r = V.bi_executive_kpis(SmokeWarehouse(spark)).first().asDict()
    assert r.pop("refreshed_at").isoformat() == "2026-06-11T00:00:00"
    assert r == {"total_demand_units": 30, "total_sold_units": 25, "total_lost_sales_units": 5,
                 "total_revenue": 375.0, "total_shipments": 1, "delayed_shipments": 1,
                 "shipment_delay_rate_pct": 100.0, "average_delay_days": 1.0, "inventory_positions": 1,
                 "inventory_value": 800.0, "reorder_risk_positions": 0, "open_recommendations": 1,
                 "high_priority_recommendations": 0}
