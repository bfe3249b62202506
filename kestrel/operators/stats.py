"""Hypothesis tests and correlations as aggregate plans.

Each test reduces the data to a handful of sufficient statistics with one
(partial) aggregation; statistics and degrees of freedom are column
expressions; p-values are evaluated on the single aggregated row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.functions.special import chi2_pvalue, t_pvalue
from kestrel.operators import ranks as RK
from kestrel.session import materialize


def welch_t_test(df: DataFrame, value: str, flag: str, a=0, b=1) -> DataFrame:
    """Two-sample t-test with unequal variances, group ``a`` minus group ``b``."""
    d = df.where(F.col(value).isNotNull() & F.col(flag).isin(a, b))
    s = d.agg(*[x for v, tag in [(a, "a"), (b, "b")] for x in (
        F.count_if(F.col(flag) == v).alias(f"n_{tag}"),
        F.avg(F.when(F.col(flag) == v, F.col(value))).alias(f"mean_{tag}"),
        F.var_samp(F.when(F.col(flag) == v, F.col(value))).alias(f"var_{tag}"))])
    se_a, se_b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se_a + se_b)
    dof = (se_a + se_b) ** 2 / (se_a ** 2 / (F.col("n_a") - 1) + se_b ** 2 / (F.col("n_b") - 1))
    out = s.withColumns({"t_statistic": t, "df": dof})
    out = out.withColumn("p_value", t_pvalue(F.col("t_statistic"), F.col("df")))
    return out.select(
        F.col("n_a").cast("long").alias("on_time_n"), F.col("n_b").cast("long").alias("late_n"),
        "mean_a", "mean_b", F.sqrt("var_a").alias("std_a"), F.sqrt("var_b").alias("std_b"),
        "t_statistic", "df", "p_value", (F.col("p_value") < 0.05).alias("significant_at_005"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()) \
             .groupBy(row, col).agg(F.count(F.lit(1)).alias("o"))


def chi_square_independence(df: DataFrame, row: str, col: str, correction: bool = True) -> DataFrame:
    """Pearson chi-square of independence from long-form counts.

    chi2 = sum(o^2 / e) - n over observed cells (absent cells have o = 0), so
    no dense grid is materialised.  With one degree of freedom (2 x 2) the
    continuity correction moves each of the four cells half a unit toward
    its expected count, never past it; then the 2 x 2 grid is completed.
    """
    # the cell counts feed six small branches: written once (one pass over the input)
    ct = materialize(contingency(df, row, col), "contingency")
    rows = ct.groupBy(row).agg(F.sum("o").alias("r_tot"))
    cols = ct.groupBy(col).agg(F.sum("o").alias("c_tot"))
    tot = ct.agg(F.sum("o").alias("n"))
    dims = (rows.agg(F.count(F.lit(1)).alias("r"))
            .crossJoin(cols.agg(F.count(F.lit(1)).alias("k"))).crossJoin(tot))
    # dense grid only when it is 2 x 2 (dof = 1): both sides are filtered to
    # the 2-level case before the cross join, so it never exceeds 4 cells
    two = (F.col("r") == 2) & (F.col("k") == 2)
    rows2 = rows.crossJoin(F.broadcast(dims)).where(two)
    cols2 = cols.crossJoin(F.broadcast(dims.select(F.col("r").alias("_r"), F.col("k").alias("_k")))) \
                .where((F.col("_r") == 2) & (F.col("_k") == 2)).drop("_r", "_k")
    grid = rows2.crossJoin(cols2).join(ct, [row, col], "left")
    e = F.col("r_tot") * F.col("c_tot") / F.col("n")
    o = F.coalesce(F.col("o"), F.lit(0)).cast("double")
    diff = e - o
    o_corr = o + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff)) if correction else o
    small = grid.agg(F.sum((o_corr - e) ** 2 / e).alias("chi2_2x2"))
    sparse = (ct.join(rows, row).join(cols, col).crossJoin(F.broadcast(tot))
              .agg(F.sum(F.col("o").cast("double") ** 2 / e).alias("_s")))
    res = dims.crossJoin(small).crossJoin(sparse)
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    chi2 = F.when(dof == 1, F.col("chi2_2x2")).otherwise(F.col("_s") - F.col("n"))
    res = res.withColumns({"chi2_statistic": chi2, "degrees_of_freedom": dof.cast("long")})
    res = res.withColumn("p_value", chi2_pvalue(F.col("chi2_statistic"), F.col("degrees_of_freedom")))
    v = F.sqrt(F.col("chi2_statistic") / (F.col("n") * (F.least("r", "k") - 1)))
    return res.select("chi2_statistic", "degrees_of_freedom", "p_value",
                      F.col("n").cast("long").alias("n"), v.alias("cramers_v"),
                      (F.col("p_value") < 0.05).alias("significant_at_005"),
                      C.effect_size_label(v).alias("effect_size_interpretation"))


def kruskal_wallis(df: DataFrame, value: str, group: str, levels: list[str]) -> DataFrame:
    """H statistic with tie correction, p on k - 1 degrees of freedom.

    One pass over the input: distinct (group, value) counts (partial
    aggregation), kept for the two small branches that use them.
    """
    dv = materialize(df.where(F.col(group).isin(*levels) & F.col(value).isNotNull())
                     .groupBy(group, value).agg(F.count(F.lit(1)).alias("c")), "group-values")
    vr = RK.value_ranks(dv, value, weight="c")  # pooled ranks of distinct values
    ties = vr.agg(F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt")).alias("tie_sum"),
                  F.max("n").alias("N"))
    per = (dv.join(vr.select(value, "avg_rank"), value)
           .groupBy(group).agg(F.sum(F.col("c") * F.col("avg_rank")).alias("R"), F.sum("c").alias("n_i")))
    s = per.agg(F.sum(F.col("R") ** 2 / F.col("n_i")).alias("sr"), F.count(F.lit(1)).alias("k"))
    res = s.crossJoin(ties)
    N = F.col("N").cast("double")
    h = (F.lit(12.0) / (N * (N + 1)) * F.col("sr") - 3 * (N + 1)) / (1 - F.col("tie_sum") / (N ** 3 - N))
    res = res.withColumns({"h_statistic": h, "dof": (F.col("k") - 1).cast("long")})
    res = res.withColumn("p_value", chi2_pvalue(F.col("h_statistic"), F.col("dof")))
    return res.select("h_statistic", "dof", "p_value", F.col("N").cast("long").alias("n"),
                      (F.col("p_value") < 0.05).alias("significant_at_005"))


def agg_group_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean, exact median and sample std per group."""
    d = df.where(F.col(value).isNotNull())
    base = d.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                F.stddev_samp(value).alias("std"))
    return base.join(RK.median(d, value, [group]), group)


def agg_boxplot(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers (most extreme points within 1.5 IQR) and outliers.

    The distinct values with their counts, which the quartiles need anyway,
    also give whiskers and outliers, so the rows are read once.
    """
    vr = materialize(RK.value_ranks(df, value, [group]), "boxplot-values")
    q = RK.quantiles_of(vr, value, [0.25, 0.5, 0.75], [group])
    lim = q.select(group, (F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))).alias("_lo"),
                   (F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))).alias("_hi"))
    j = vr.select(group, value, "cnt").join(lim, group)
    inside = (F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))
    w = j.groupBy(group).agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"),
                             F.max(F.when(inside, F.col(value))).alias("whisker_high"),
                             F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).cast("long").alias("outliers"))
    return q.join(w, group)


def pearson_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for all pairs in one aggregation pass."""
    pairs = list(combinations(cols, 2))
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("r"))
             for a, b in pairs]
    cells += [F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"{a}__{b}").alias("r"))
              for a, b in pairs]
    cells += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in cols]
    return agg.select(F.inline(F.array(*cells)))


def spearman_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Spearman rho per pair: average ranks over the pair's complete rows,
    then Pearson r of the ranks (pandas pairwise-complete semantics).

    A pair's ranks depend on its complete rows only.  The rows are grouped by
    their null pattern; where no row has a null (or, in general, for a pair
    whose columns miss together) the ranks of a column are the same in all its
    pairs.  So every column is ranked once for each distinct set of patterns
    it is needed with, and the distinct rows of values, with their counts,
    meet their ranks by a join that the adaptive skew split can cut.
    """
    pairs = list(combinations(cols, 2))
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "x string, y string, r double")
    if not pairs:
        return diag
    values = [F.col(c).cast("double").alias(c) for c in cols]
    pattern = sum(F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(cols))
    rows = materialize(df.select(*values).groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))
                       .withColumn("_p", pattern), "value-rows")
    patterns = [r["_p"] for r in rows.select("_p").distinct().collect()]  # 2 ** columns at most
    # for each pair the patterns in which both columns are there; one ranking per (column, set of patterns)
    sets = {(a, b): tuple(sorted(p for p in patterns if p >> cols.index(a) & 1 and p >> cols.index(b) & 1)) for a, b in pairs}
    needed = sorted({(c, s) for (a, b), s in sets.items() for c in (a, b)})
    code = {k: i for i, k in enumerate(needed)}
    stacked = F.array(*[F.when(F.col("_p").isin(*s) if s else F.lit(False),
                               F.struct(F.lit(code[c, s]).alias("key"), F.col(c).alias("v"))) for c, s in needed])
    stacked = (rows.select(F.explode(F.filter(stacked, lambda c: c.isNotNull())).alias("c"), "w")
               .select("c.*", "w").groupBy("key", "v").agg(F.sum("w").alias("w")))
    ranks = RK.value_ranks(stacked, "v", ["key"], weight="w")
    # average ranks have mean (n + 1) / 2: centred exactly, so the sums have no cancellation
    ranks = materialize(ranks.select("key", "v", (F.col("avg_rank") - (F.col("n") + 1) / 2.0).alias("rk")), "value-ranks")
    j = rows
    for (c, s), i in code.items():
        one = ranks.where(F.col("key") == i).select(F.col("v").alias(c), F.col("rk").alias(f"_r{i}"))
        j = j.join(one, c, "left")
    w = F.col("w").cast("double")
    aggs = []
    for k, (a, b) in enumerate(pairs):
        s = sets[a, b]
        here = F.col("_p").isin(*s) if s else F.lit(False)
        ra, rb = (F.col(f"_r{code[c, s]}") for c in (a, b))
        aggs += [F.sum(F.when(here, w * x * y)).alias(f"_{n}{k}") for n, x, y in (("aa", ra, ra), ("bb", rb, rb), ("ab", ra, rb))]
    m = j.agg(*aggs)
    cells = []
    for k, (a, b) in enumerate(pairs):
        r = F.try_divide(F.col(f"_ab{k}"), F.sqrt(F.col(f"_aa{k}") * F.col(f"_bb{k}")))
        cells += [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("r")) for x, y in ((a, b), (b, a))]
    return m.select(F.inline(F.array(*cells))).unionByName(diag)


def corr_highlights(long: DataFrame, pairs: list[tuple[str, str]], suffix: str = "") -> DataFrame:
    names = F.concat(F.col("x"), F.lit("_vs_"), F.col("y"), F.lit(suffix))
    wanted = F.lit(False)
    for a, b in pairs:
        wanted = wanted | ((F.col("x") == a) & (F.col("y") == b))
    return long.where(wanted).select(names.alias("pair"), C.round_half_up("r", 4).alias("r"))


def round_col(c: str, k: int = 4) -> Column:
    return C.round_half_up(c, k).alias(c)
