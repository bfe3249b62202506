import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kestrel.functions.special import chi2_sf, t_two_sided_p
from kestrel.operators import ranks as RK
from kestrel.operators import stats as ST

# Published contingency table (shipping mode x late flag) and results.
TABLE = {("First Class", 0): 1301, ("Same Day", 0): 5283, ("Second Class", 0): 8229, ("Standard Class", 0): 66729,
         ("First Class", 1): 26513, ("Same Day", 1): 4454, ("Second Class", 1): 26987, ("Standard Class", 1): 41023}


def test_chi_square_golden(spark):
    counts = spark.createDataFrame([(m, f, n) for (m, f), n in TABLE.items()], "mode string, flag int, n int")
    rows = counts.select("mode", "flag", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_"))
    res = ST.chi_square_independence(rows, "mode", "flag").first()
    assert round(res["chi2_statistic"], 4) == 37716.0425
    assert res["degrees_of_freedom"] == 3 and round(res["cramers_v"], 4) == 0.4571
    assert res["p_value"] < 1e-300 and res["effect_size_interpretation"] == "medium"


def test_welch_golden_from_summary():
    m1, s1, n1, m2, s2, n2 = 10.9532, 41.7889, 81542, 10.7332, 42.2809, 98977
    se = s1 ** 2 / n1 + s2 ** 2 / n2
    t = (m1 - m2) / math.sqrt(se)
    df = se ** 2 / ((s1 ** 2 / n1) ** 2 / (n1 - 1) + (s2 ** 2 / n2) ** 2 / (n2 - 1))
    assert abs(t - 1.1071) < 1e-3
    assert abs(t_two_sided_p(t, df) - 0.268235) < 1e-3


def test_kruskal_tail_golden():
    assert abs(chi2_sf(2.1288, 2) - 0.344938) < 1e-5
    assert abs(chi2_sf(3.84146, 1) - 0.05) < 1e-5
    assert abs(t_two_sided_p(2.0, 10) - 0.0733880) < 1e-6


def test_yates_2x2(spark):
    rows = [("a", 1)] * 12 + [("a", 0)] * 5 + [("b", 1)] * 3 + [("b", 0)] * 9
    df = spark.createDataFrame(rows, "g string, y int")
    got = ST.chi_square_independence(df, "g", "y").first()["chi2_statistic"]
    o = np.array([[5, 12], [9, 3]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    corr = o + np.sign(e - o) * np.minimum(0.5, np.abs(e - o))
    assert abs(got - ((corr - e) ** 2 / e).sum()) < 1e-9


def test_ranks_match_pandas_average(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5, 7.0, None]) for _ in range(400)]
    grp = [rnd.choice(["x", "y"]) for _ in vals]
    df = spark.createDataFrame(list(zip(grp, vals)), "g string, v double").repartition(7)
    got = {(r["g"], r["v"]): r["avg_rank"] for r in RK.value_ranks(df, "v", ["g"], partitions=5).collect()}
    pdf = pd.DataFrame({"g": grp, "v": vals}).dropna()
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    for (g, v), r in pdf.groupby(["g", "v"])["r"].first().items():
        assert abs(got[(g, v)] - r) < 1e-9


def test_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(501)] + [0.5] * 40
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    q = RK.quantiles(df, "v", [0.25, 0.5, 0.75]).first()
    want = np.percentile(vals, [25, 50, 75])
    assert np.allclose([q["p25"], q["median"], q["p75"]], want, atol=1e-12)


def test_spearman_matches_pandas(spark):
    rnd = random.Random(1)
    a = [rnd.randint(0, 20) * 1.0 for _ in range(300)]
    b = [x + rnd.randint(-5, 5) if rnd.random() > 0.1 else None for x in a]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = {(r["x"], r["y"]): r["r"] for r in ST.spearman_long(df, ["a", "b"]).collect()}
    want = pd.DataFrame({"a": a, "b": b}).corr(method="spearman").loc["a", "b"]
    assert abs(got[("a", "b")] - want) < 1e-9
