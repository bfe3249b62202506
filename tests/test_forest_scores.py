import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.operators import forest, ml

COLUMNS = ["rawPrediction", "probability", "prediction", "late_probability", "on_time_probability", "predicted_label"]


def _rows(spark, n, salt, null_share=0.0):
    """Rows with few categories, numbers on a coarse grid (thresholds are met exactly) and some nulls."""
    rng = np.random.default_rng(salt)
    rows = []
    for k in range(n):
        cats = [f"{c[:2]}{rng.integers(0, 3 + j)}" for j, c in enumerate(S.DELAY_CATEGORICALS)]
        nums = [float(rng.integers(-20, 20)) / 2 for _ in S.DELAY_NUMERICS]
        late = int(nums[0] + (cats[0] == "sh1") * 8 + rng.normal() * 3 > 2)
        cells = [None if rng.random() < null_share else v for v in cats + nums]
        rows.append((f"r{salt}-{k}", *cells, late))
    return spark.createDataFrame(rows, ", ".join(["row_key string", *[f"{c} string" for c in S.DELAY_CATEGORICALS],
                                                  *[f"{c} double" for c in S.DELAY_NUMERICS], f"{S.DELAY_TARGET} long"]))


@pytest.fixture(scope="module")
def model(spark):
    return ml.train_delay_classifier(_rows(spark, 500, 1), num_trees=5, max_depth=6)[0]


def _collected(scored):
    arrays = [vector_to_array(c).alias(c) if c in ("rawPrediction", "probability") else F.col(c) for c in COLUMNS]
    return {r.row_key: r[1:] for r in scored.select("row_key", *arrays).collect()}


def _as_mllib(model, df):
    out = model.transform(ml.encode_input(df, S.DELAY_CATEGORICALS, S.DELAY_NUMERICS))
    p = vector_to_array("probability")
    return out.withColumns({"predicted_label": F.col("prediction").cast("long"), "late_probability": F.bround(p[1], 4),
                            "on_time_probability": F.bround(p[0], 4)})


def test_batch_walk_scores_as_mllib(spark, model, tmp_path):
    known = _rows(spark, 300, 2)
    odd = _rows(spark, 200, 3, null_share=0.3).withColumn("market", F.when(F.rand(5) < 0.3, "never seen").otherwise(F.col("market")))
    odd = odd.localCheckpoint()
    ml.model_save(model, str(tmp_path / "m"))
    for rows in (known, odd, odd.unionByName(odd.withColumn("row_key", F.concat("row_key", F.lit("b")))), known.limit(0)):
        want = _collected(_as_mllib(model, rows))
        for m in (model, ml.model_load(str(tmp_path / "m"))):
            scored = ml.score_delay_batch(m, rows)
            assert _collected(scored) == want
    assert len({v[3] for v in _collected(ml.score_delay_batch(model, known)).values()}) > 20


def test_rows_do_not_walk_one_by_one(spark, model):
    plan = ml.score_delay_batch(model, _rows(spark, 10, 4)).select("late_probability")._jdf.queryExecution().optimizedPlan().toString()
    assert "votes(" in plan and "features" not in plan


def test_a_larger_forest_is_left_to_mllib(spark, model, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "MAX_STEPS", 10)
    ml.model_save(model, str(tmp_path / "m"))
    rows, back = _rows(spark, 50, 5), ml.model_load(str(tmp_path / "m"))
    assert _collected(ml.score_delay_batch(back, rows)) == _collected(_as_mllib(model, rows))
    assert forest.steps(spark, back.stages[-1]) is None
