from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.operators import etl


def test_clean_orders_inline(spark):
    cols = list(S.ORDERS_COLUMN_MAP)
    base = {c: None for c in cols}
    r1 = dict(base, **{"Days for shipping (real)": "5", "Days for shipment (scheduled)": "2",
                       "Benefit per order": "10", "Sales": "200", "Late_delivery_risk": "1",
                       "Order Item Discount Rate": "0.25", "order date (DateOrders)": "1/31/2018 22:56",
                       "shipping date (DateOrders)": "2/3/2018 22:56", "Customer Zipcode": "725.0",
                       "Order Zipcode": " nan ", "Customer Email": "x@y", "Shipping Mode": " Standard Class "})
    r2 = dict(base, **{"Sales": "0", "Benefit per order": "-3", "Late_delivery_risk": "abc",
                       "Days for shipping (real)": "n/a"})
    raw = spark.createDataFrame([tuple(r1[c] for c in cols), tuple(r2[c] for c in cols)],
                                ", ".join(f"`{c}` string" for c in cols))
    clean, feats = etl.clean_orders(raw)
    assert feats.columns == S.ORDERS_FEATURES
    assert "customer_email" not in clean.columns
    a, b = [r.asDict() for r in clean.orderBy("sales", ascending=False).collect()]
    assert a["delivery_delay_days"] == 3.0 and a["shipping_ahead_days"] == -3.0
    assert a["late_delivery_flag"] == 1 and a["profit_margin_pct"] == 5.0 and a["discount_rate_pct"] == 25.0
    assert a["order_weekday"] == "Wednesday" and a["shipping_month"] == 2
    assert a["customer_zipcode"] == "725" and a["order_zipcode"] is None and a["order_zipcode_missing"] == 1
    assert a["shipping_mode"] == "Standard Class"
    assert b["profit_margin_pct"] is None          # zero sales -> missing ratio
    assert b["late_delivery_flag"] == 0            # unparseable -> missing -> 0
    assert b["is_profitable_flag"] == 0 and b["actual_shipping_days"] is None


def test_clean_skus_inline(spark):
    cols = list(S.SKUS_COLUMN_MAP)
    row = {c: None for c in cols}
    row.update({"SKU": "SKU1", "Availability": "0", "Number of products sold": "10", "Stock levels": "0",
                "Revenue generated": "50", "Shipping costs": "4", "Order quantities": "2",
                "Manufacturing costs": "9", "Production volumes": "3", "Lead times": "7", "Lead time": "2",
                "Inspection results": "Pass", "Defect rates": "1.5"})
    raw = spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"`{c}` string" for c in cols))
    clean, feats = etl.clean_skus(raw)
    r = clean.first().asDict()
    assert feats.columns == S.SKUS_FEATURES
    assert r["sell_through_rate"] is None and r["supply_pressure_index"] is None
    assert r["revenue_per_unit_sold"] == 5.0 and r["shipping_cost_per_unit"] == 2.0
    assert r["manufacturing_cost_per_unit"] == 3.0 and r["lead_time_gap_days"] == 5.0
    assert r["quality_pass_flag"] == 1 and r["quality_fail_flag"] == 0 and r["defect_rate_out_of_range_flag"] == 1


def test_duplicates_null_safe(spark):
    from kestrel.operators.relational import agg_duplicate_rows
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (None, "a")], "a int, b string")
    assert agg_duplicate_rows(df).first()[0] == 2


def test_typed_numbers_skip_text(spark):
    """Numbers of a numeric column are the same doubles, without text and pattern in between."""
    values = [1.5, -0.0, 1e300, 4.9e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v, None if v is None else str(v), 7 + i) for i, v in enumerate(values)], "d double, t string, n long")
    typed, text = etl.coerce_numeric(df, ["d", "t", "n", "absent"]), etl.coerce_numeric(df.withColumn("d", F.col("d").cast("string")), ["d"])
    assert [repr(r["d"]) for r in typed.collect()] == [repr(r["d"]) for r in text.collect()] == [repr(r["t"]) for r in typed.collect()]
    assert typed.collect()[0]["n"] == 7.0 and typed.schema["n"].dataType.typeName() == "double"
    assert "RLIKE" not in etl.coerce_numeric(df, ["d", "n"])._jdf.queryExecution().optimizedPlan().toString()
    zips = spark.createDataFrame([(0.5,), (1.5,), (-2.5,), (725.0,), (None,)], "z double")
    assert [r["z"] for r in etl.zipcodes_to_text(zips, ["z"]).collect()] == ["0", "2", "-2", "725", None]


def test_wide_projection_is_cut(spark, ctx):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
