"""Exact splits, rank-sum AUC and label codes against plain Python."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ml, relational


def test_stratified_shares_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 50 + ["b"] * 7 + ["c", None])) for i in range(3001)]
    df = spark.createDataFrame(rows, "k long, label string")
    out = relational.split_stratified(df, F.col("k"), "label").collect()
    test = collections.Counter(r.label for r in out if r.is_test)
    n = collections.Counter(l for _, l in rows)
    total = math.ceil(0.2 * len(rows))
    want = {l: c * total // len(rows) for l, c in n.items()}
    for l in sorted(n, key=lambda l: (-(n[l] * total % len(rows)), l or ""))[:total - sum(want.values())]:
        want[l] += 1
    assert len(out) == len(rows) and sum(test.values()) == total
    assert test == {l: c for l, c in want.items() if c}
    again = relational.split_stratified(df.repartition(9), F.col("k"), "label").collect()
    assert {(r.k, r.is_test) for r in out} == {(r.k, r.is_test) for r in again}


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1000])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(f"key{i}",) for i in range(n)], "k string")
    assert relational.split_train_test(df, F.col("k"), 0.3).where("is_test").count() == math.ceil(0.3 * n)


def test_keys_of_one_hash_range(spark, monkeypatch):
    """All rows in one range and sub-range: the numbering alone decides."""
    monkeypatch.setattr(relational, "order_hash", lambda key, seed=42: F.lit(5).cast("long"))
    df = spark.createDataFrame([(i,) for i in range(50)], "k long")
    assert sorted(r.k for r in relational.split_train_test(df, F.col("k")).where("is_test").collect()) == list(range(10))


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.25, 0.5, 0.5, 0.75, 1.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    exact = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ml.roc_auc(df, "y", "p").first()[0] == pytest.approx(exact, abs=5.1e-5)
    assert ml.roc_auc(df.where("y = 1"), "y", "p").first()[0] is None
    one = ml.roc_auc(spark.createDataFrame([(0, 0.2), (1, 0.9), (None, 0.5)], "y int, p double"), "y", "p").first()[0]
    assert one == 1.0


def test_label_codes(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("é", "y"), ("b", "Z")], "u string, v string")
    codes = ml.label_codes(df, ["u", "v"])
    assert sorted(map(tuple, codes.collect())) == [("u", "a", 0, 1), ("u", "b", 1, 2), ("u", "é", 2, 1), ("v", "Z", 0, 1), ("v", "x", 1, 2), ("v", "y", 2, 1)]
    more = spark.createDataFrame([("b", "new")], "u string, v string")
    assert [tuple(r) for r in ml.with_codes(more, codes, ["u", "v"]).collect()] == [("b", "new", 1, None)]


def test_sales_model_sees_every_row(ctx, spark):
    """Cells hold all rows' weight and sales, and the forest is about as good as one on the rows themselves."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from kestrel import schemas as S
    from kestrel.plans.q_ml import _model_input
    df = _model_input(ctx)
    cats, nums = S.DELAY_CATEGORICALS, S.DEMAND_NUMERICS
    rows = ml.encode_input(df, cats, nums).withColumn("label", F.col("sales").cast("double")).where("label IS NOT NULL")
    for bins, few in ((32, False), (2, True)):
        cells = ml.binned_cells(rows, cats if not few else cats[:1], nums, ml.binning(rows, nums, bins))
        total = cells.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label")), F.count(F.lit(1))).first()
        exact = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        assert total[0] == exact[0] and total[1] == pytest.approx(exact[1]) and (not few or total[2] <= 40)
    model, test = ml.train_sales_regressor(df, num_trees=8, max_depth=8)
    ours = ml.eval_regressor(model.transform(test), "label", "prediction").first()
    train = relational.split_train_test(rows, F.col("row_key"), 0.2, ml.SEED).where("NOT is_test")
    plain = Pipeline(stages=[ml.encode_categoricals(cats), VectorAssembler(inputCols=[f"{c}_idx" for c in cats] + nums, outputCol="features"),
                             RandomForestRegressor(labelCol="label", numTrees=8, maxDepth=8, seed=42, minInstancesPerNode=5)]).fit(train)
    other = ml.eval_regressor(plain.transform(test), "label", "prediction").first()
    assert ours.rmse < 1.03 * other.rmse and ours.r2 > other.r2 - 0.03


def test_classes_of_cells(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("a", 1.1, 0.0, 2.0), ("a", 1.0, 1.0, 3.0)], "c string, x double, label double, weight double")
    cells = ml.binned_cells(rows, ["c"], ["x"], ml.binning(rows, ["x"], 2), classes=True)
    assert cells.agg(F.sum("weight")).first()[0] == 7.0 and cells.select("label").distinct().count() == 2
