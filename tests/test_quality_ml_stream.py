from pyspark.sql import functions as F

from kestrel.operators import ml
from kestrel.operators import quality as Q


def test_rules_null_passes(spark):
    df = spark.createDataFrame([("a", 5, 3), ("b", 2, 4), ("c", None, 1)], "k string, ordered int, received int")
    rules = [Q.Rule("received_le_ordered", F.col("received") <= F.col("ordered"))]
    v = Q.violations(df, "t", F.col("k"), rules).collect()
    assert [(r["record_key"], r["rule_name"]) for r in v] == [("b", "received_le_ordered")]
    c = Q.violation_counts(df, "t", rules).first()
    assert c["violations"] == 1


def test_rule_scorers(spark):
    df = spark.createDataFrame([(1.0, 500.0, 10.0, 5.0), (5.0, 2000.0, 0.0, -200.0), (None, None, None, None)],
                               "scheduled_shipping_days double, sales double, discount_rate_pct double, "
                               "benefit_per_order double")
    d = ml.rule_score_delay(df).collect()
    assert [r["predicted_label"] for r in d] == [1, 1, 0]
    assert [r["late_probability"] for r in d] == [0.8, 0.12, 0.38]
    s = [r["predicted_sales"] for r in ml.rule_score_demand(df).collect()]
    assert s == [187.5, 15.0, 210.0]


def test_forest_sanity(ctx):
    df = ctx.orders_clean().withColumnRenamed("Line Key", "row_key")
    model, test = ml.train_delay_classifier(df, num_trees=10, max_depth=6)
    scored = ml.score_delay_batch(model, test)
    m = ml.eval_classifier(scored, "label", "predicted_label", prob="probability").first()
    base = test.agg(F.avg("label")).first()[0]
    assert m["roc_auc"] > 0.5 and m["accuracy"] > min(base, 1 - base) - 0.05
    p = scored.agg(F.min("late_probability"), F.max("late_probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_stream_equals_batch(ctx):
    from kestrel.streaming import monitoring as M
    from kestrel.streaming import streams as S
    sink = S.stream_inference_volume(ctx.spark, ctx.t.sf_dir)
    stream = {tuple(r) for r in S.read_volume(ctx.spark, sink).select("day", "prediction_type", "requests").collect()}
    batch = {tuple(r) for r in M.inference_volume_daily(ctx.t.events).collect()}
    assert stream == batch
