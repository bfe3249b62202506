from pyspark.sql import functions as F

from kestrel.operators import scoring


def test_optimize_inventory_hand_case(spark):
    skus = spark.createDataFrame(
        [("S1", "t", "sup", 100.0, 300.0, 4.0, 10.0, 0.0, 20.0),
         ("S2", "t", "sup", 500.0, 300.0, None, 10.0, 0.0, 20.0),
         ("S3", "t", "sup", 50.0, 0.0, 9.0, 10.0, 0.0, 20.0)],
        "sku string, product_type string, supplier_name string, stock_levels double, products_sold double, "
        "source_lead_time_days double, availability double, revenue_generated double, product_price double")
    r = {x["sku"]: x.asDict() for x in scoring.optimize_inventory(skus).collect()}
    # daily 10, std 3, lead 4 -> safety round(1.65*3*2, 1) = 9.9, ROP = 40 + 9.9 = 49.9
    assert r["S1"]["safety_stock"] == 9.9 and r["S1"]["reorder_point"] == 49.9
    assert r["S1"]["stockout_risk"] == 0 and r["S1"]["days_of_inventory"] == 10.0
    # missing lead time takes the median (6.5)
    assert r["S2"]["lead_time_days"] == 6.5
    assert r["S3"]["days_of_inventory"] is None and r["S3"]["stockout_risk"] == 0


def test_minmax_constant_and_inversion(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, c double")
    out = scoring.minmax_normalize(df, {"na": (F.col("a"), True), "nc": (F.col("c"), False)}).orderBy("a").collect()
    assert [r["na"] for r in out] == [100.0, 50.0, 0.0] and {r["nc"] for r in out} == {50.0}


def test_rescore_zero_weights_unchanged(spark):
    df = spark.createDataFrame([("s", 10.0, 20.0, 30.0, 40.0, 55.0, "Medium Risk")],
                               "supplier_name string, quality_score double, delivery_score double, cost_score double, "
                               "reliability_score double, overall_score double, risk_tier string")
    same = scoring.rescore_suppliers(df, {"quality": 0, "delivery": 0, "cost": 0, "reliability": 0})
    assert same.first()["overall_score"] == 55.0
    w = scoring.rescore_suppliers(df, {"quality": 1, "delivery": 1, "cost": 1, "reliability": 1}).first()
    assert w["overall_score"] == 25.0 and w["risk_tier"] == "High Risk"


def test_whatif_service_levels(spark):
    inv = spark.createDataFrame([("a", 0.0, 10.0, 0.0)], "sku string, lead_time_days double, "
                                "avg_daily_demand double, stock_levels double")
    r = scoring.reoptimize_service_level(inv, 99).first()
    # lead 0 -> 10 (falsy default); ss = round(2.33 * 2.2 * sqrt(10)) = 16; rop = 100 + 16
    assert r["safety_stock"] == 16 and r["reorder_point"] == 116 and r["revenue_at_risk"] == 1740
