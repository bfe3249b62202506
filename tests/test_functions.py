from pyspark.sql import functions as F

from kestrel.functions import columns as C


def one(spark, expr, value, dtype="double"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_rounding_families(spark):
    assert one(spark, lambda c: C.round_half_even(c, 0), 2.5) == 2.0
    assert one(spark, lambda c: C.round_half_even(c, 1), 0.25) == 0.2
    assert one(spark, lambda c: C.round_half_even(c, 1), 0.35) == 0.4
    assert one(spark, lambda c: C.round_half_up(c, 2), 1.005) == 1.01
    assert one(spark, lambda c: C.round_half_up(c, 0), -2.5) == -3.0
    assert one(spark, C.js_round, 2.5) == 3
    assert one(spark, C.js_round, -2.5) == -2


def test_clean_string_tokens(spark):
    for raw, want in [("  a ", "a"), ("", None), (" nan ", None), ("None", None), ("NaN", "NaN"), (None, None)]:
        assert one(spark, C.clean_string, raw, "string") == want


def test_safe_ratio_and_flags(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(C.safe_ratio("a", "b", 100.0)).collect()]
    assert got == [None, None, 150.0]
    assert one(spark, C.positive_flag, None) == 0           # missing compares false -> 0
    assert one(spark, lambda c: C.equals_flag(c, "Pass"), None, "string") is None  # stays missing


def test_tiers_and_levels(spark):
    cut = lambda v: one(spark, C.risk_tier_cut, v)
    assert [cut(v) for v in [-1.0, -0.5, 40.0, 40.01, 70.0, 70.5, 101.0, 101.5]] == [
        None, "High Risk", "High Risk", "Medium Risk", "Medium Risk", "Low Risk", "Low Risk", None]
    what = lambda v: one(spark, C.risk_tier_whatif, v)
    assert [what(v) for v in [39.99, 40.0, 69.99, 70.0]] == ["High Risk", "Medium Risk", "Medium Risk", "Low Risk"]
    z = lambda v: one(spark, C.z_for_service_level, v, "int")
    assert [z(90), z(95), z(99), z(80)] == [1.28, 1.65, 2.33, 1.65]


def test_text_rules(spark):
    assert one(spark, C.normalize_risk_tier, "  High Risk", "string") == "high"
    assert one(spark, C.normalize_risk_tier, "Severe", "string") == "medium"
    assert one(spark, C.resolve_model_type, "Supplier Delay Scorer", "string") == "delay_prediction"
    assert one(spark, C.resolve_model_type, "inventory_optimizer", "string") == "inventory_optimization"
    assert one(spark, C.resolve_model_type, "x", "string") == "recommendation"
    assert one(spark, C.slug_code, "Supplier 1", "string") == "supplier_1"
    assert one(spark, C.effect_size_label, 0.4571) == "medium"


def test_truthiness(spark):
    df = spark.createDataFrame([("0.0", "7"), ("", "7"), (None, "7"), ("3", "7")], "a string, b string")
    got = [r[0] for r in df.select(C.first_truthy("a", "b", default="d")).collect()]
    assert got == ["7", "7", "7", "3"]


def test_dates(spark):
    df = spark.createDataFrame([("2001-01-05", "2001-01-02"), (None, "2001-01-02"), ("2001-01-01", "2001-01-02")],
                               "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = [tuple(r) for r in df.select(C.date_diff_floor0("a", "b"), C.is_delayed("a", "b")).collect()]
    assert got == [(3, True), (None, None), (0, False)]
    ts = spark.createDataFrame([("3/7/2018 14:05",), ("bad",)], "s string").select(C.parse_datetime("s").alias("t"))
    rows = ts.select(C.weekday_name("t"), C.month_number("t")).collect()
    assert tuple(rows[0]) == ("Wednesday", 3) and tuple(rows[1]) == (None, None)
