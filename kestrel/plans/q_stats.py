"""Statistics queries: tests, correlations, group statistics, quantiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.operators import ranks as RK
from kestrel.operators import stats as ST
from kestrel.plans.oracle_views import r, with_views
from kestrel.plans.registry import register

D1_CORR = ["sales", "benefit_per_order", "order_item_discount_rate", "order_item_quantity",
           "delivery_delay_days", "profit_margin_pct"]
D2_CORR = ["stock_levels", "products_sold", "revenue_generated", "shipping_cost", "lead_time_gap_days"]
INSPECTION_LEVELS = ["Pass", "Fail", "Pending"]


def _rr(c: str, k: int) -> str:
    return f"{r(c, k)} AS {c}"


@register("welch_t_test", with_views(["orders_f"], f"""
SELECT on_time_n, late_n, {r('mean_a', 4)} AS on_time_mean, {r('mean_b', 4)} AS late_mean,
  {r('SQRT(var_a)', 4)} AS on_time_std, {r('SQRT(var_b)', 4)} AS late_std,
  {r('(mean_a - mean_b) / SQRT(var_a / on_time_n + var_b / late_n)', 4)} AS t_statistic,
  {r('POW(var_a / on_time_n + var_b / late_n, 2) / (POW(var_a / on_time_n, 2) / (on_time_n - 1) + POW(var_b / late_n, 2) / (late_n - 1))', 2)} AS df
FROM (SELECT COUNT(*) FILTER (WHERE late_delivery_flag = 0) AS on_time_n,
             COUNT(*) FILTER (WHERE late_delivery_flag = 1) AS late_n,
             AVG(profit_margin_pct) FILTER (WHERE late_delivery_flag = 0) AS mean_a,
             AVG(profit_margin_pct) FILTER (WHERE late_delivery_flag = 1) AS mean_b,
             VAR_SAMP(profit_margin_pct) FILTER (WHERE late_delivery_flag = 0) AS var_a,
             VAR_SAMP(profit_margin_pct) FILTER (WHERE late_delivery_flag = 1) AS var_b
      FROM orders_f WHERE profit_margin_pct IS NOT NULL AND late_delivery_flag IN (0, 1))"""))
def q_welch_t_test(ctx):
    w = ST.welch_t_test(ctx.orders(), "profit_margin_pct", "late_delivery_flag")
    return w.select("on_time_n", "late_n", C.round_half_up("mean_a", 4).alias("on_time_mean"),
                    C.round_half_up("mean_b", 4).alias("late_mean"),
                    C.round_half_up("std_a", 4).alias("on_time_std"), C.round_half_up("std_b", 4).alias("late_std"),
                    C.round_half_up("t_statistic", 4).alias("t_statistic"), C.round_half_up("df", 2).alias("df"))


@register("welch_t_test_report")
def q_welch_t_test_report(ctx):
    """Full test row including the p-value (tail evaluated on one row)."""
    return ST.welch_t_test(ctx.orders(), "profit_margin_pct", "late_delivery_flag")


_CHI = with_views(["orders_f"], f"""
SELECT chi2_statistic, degrees_of_freedom, n, {r('SQRT(chi2 / (n * (LEAST(r, k) - 1)))', 4)} AS cramers_v,
  CASE WHEN SQRT(chi2 / (n * (LEAST(r, k) - 1))) < 0.1 THEN 'negligible'
       WHEN SQRT(chi2 / (n * (LEAST(r, k) - 1))) < 0.3 THEN 'small'
       WHEN SQRT(chi2 / (n * (LEAST(r, k) - 1))) < 0.5 THEN 'medium' ELSE 'large' END AS effect_size_interpretation
FROM (SELECT {r('SUM(o * o / e) - MAX(n)', 4)} AS chi2_statistic, SUM(o * o / e) - MAX(n) AS chi2,
        CAST((MAX(r) - 1) * (MAX(k) - 1) AS BIGINT) AS degrees_of_freedom, MAX(n) AS n, MAX(r) AS r, MAX(k) AS k
      FROM (SELECT CAST(o AS DOUBLE) AS o, r_tot * c_tot / n AS e, n, r, k FROM
        (SELECT shipping_mode, late_delivery_flag, COUNT(*) AS o FROM orders_f GROUP BY 1, 2) ct
        JOIN (SELECT shipping_mode, COUNT(*) AS r_tot FROM orders_f GROUP BY 1) USING (shipping_mode)
        JOIN (SELECT late_delivery_flag, COUNT(*) AS c_tot FROM orders_f GROUP BY 1) USING (late_delivery_flag)
        CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT shipping_mode) AS r,
                           COUNT(DISTINCT late_delivery_flag) AS k FROM orders_f)))""")


@register("chi_square_independence", _CHI)
def q_chi_square_independence(ctx):
    c = ST.chi_square_independence(ctx.orders(), "shipping_mode", "late_delivery_flag")
    return c.select(C.round_half_up("chi2_statistic", 4).alias("chi2_statistic"), "degrees_of_freedom", "n",
                    C.round_half_up("cramers_v", 4).alias("cramers_v"), "effect_size_interpretation")


@register("cramers_v", with_views(["orders_f"], f"""
SELECT {r('SQRT((SUM(o * o / e) - MAX(n)) / (MAX(n) * (LEAST(MAX(r), MAX(k)) - 1)))', 4)} AS cramers_v FROM
  (SELECT CAST(o AS DOUBLE) AS o, r_tot * c_tot / n AS e, n, r, k FROM
    (SELECT category_name, customer_segment, COUNT(*) AS o FROM orders_f GROUP BY 1, 2) ct
    JOIN (SELECT category_name, COUNT(*) AS r_tot FROM orders_f GROUP BY 1) USING (category_name)
    JOIN (SELECT customer_segment, COUNT(*) AS c_tot FROM orders_f GROUP BY 1) USING (customer_segment)
    CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT category_name) AS r,
                       COUNT(DISTINCT customer_segment) AS k FROM orders_f))"""))
def q_cramers_v(ctx):
    c = ST.chi_square_independence(ctx.orders(), "category_name", "customer_segment")
    return c.select(C.round_half_up("cramers_v", 4).alias("cramers_v"))


@register("chi_square_report")
def q_chi_square_report(ctx):
    return ST.chi_square_independence(ctx.orders(), "shipping_mode", "late_delivery_flag")


@register("agg_contingency_2x2_yates")
def q_agg_contingency_2x2_yates(ctx):
    """2 x 2 table (profitable x late): exercises the continuity correction."""
    o = ctx.orders_clean().select("is_profitable_flag", "late_delivery_flag")
    return ST.chi_square_independence(o, "is_profitable_flag", "late_delivery_flag")


_AVG_RANK = ("(RANK() OVER (ORDER BY {v}) + COUNT(*) OVER (PARTITION BY {v}) - 1 + RANK() OVER (ORDER BY {v}))"
             " / 2.0")


@register("kruskal_wallis", with_views(["skus_f"], f"""
SELECT {r('(12.0 / (N * (N + 1)) * sr - 3 * (N + 1)) / (1 - tie_sum / (POW(N, 3) - N))', 4)} AS h_statistic,
  CAST(k - 1 AS BIGINT) AS dof, CAST(N AS BIGINT) AS n
FROM (SELECT SUM(R * R / n_i) AS sr, COUNT(*) AS k FROM
        (SELECT inspection_result, SUM(rk) AS R, COUNT(*) AS n_i FROM
          (SELECT inspection_result, {_AVG_RANK.format(v='defect_rate_raw')} AS rk FROM skus_f
           WHERE inspection_result IN ('Pass', 'Fail', 'Pending') AND defect_rate_raw IS NOT NULL)
         GROUP BY 1)) s
CROSS JOIN (SELECT SUM(POW(c, 3) - c) AS tie_sum, SUM(c) AS N FROM
  (SELECT defect_rate_raw, CAST(COUNT(*) AS DOUBLE) AS c FROM skus_f
   WHERE inspection_result IN ('Pass', 'Fail', 'Pending') AND defect_rate_raw IS NOT NULL GROUP BY 1)) t"""))
def q_kruskal_wallis(ctx):
    k = ST.kruskal_wallis(ctx.skus(), "defect_rate_raw", "inspection_result", INSPECTION_LEVELS)
    return k.select(C.round_half_up("h_statistic", 4).alias("h_statistic"), "dof", "n")


@register("kruskal_wallis_report")
def q_kruskal_wallis_report(ctx):
    return ST.kruskal_wallis(ctx.skus(), "defect_rate_raw", "inspection_result", INSPECTION_LEVELS)


@register("rank_average_ties", with_views(["orders_f"], f"""
SELECT order_item_quantity AS value, CAST(COUNT(*) AS BIGINT) AS cnt, {r('MIN(rk)', 4)} AS avg_rank FROM
  (SELECT order_item_quantity, {_AVG_RANK.format(v='order_item_quantity')} AS rk FROM orders_f) GROUP BY 1"""))
def q_rank_average_ties(ctx):
    vr = RK.value_ranks(ctx.orders_clean(), "order_item_quantity")
    return vr.select(F.col("order_item_quantity").alias("value"), "cnt",
                     C.round_half_up("avg_rank", 4).alias("avg_rank"))


def _pearson_sql() -> str:
    cells = []
    for a, b in combinations(D1_CORR, 2):
        cells.append(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'CORR({a}, {b})', 4)} AS r FROM orders_f")
        cells.append(f"SELECT '{b}' AS x, '{a}' AS y, {r(f'CORR({a}, {b})', 4)} AS r FROM orders_f")
    cells += [f"SELECT '{c}' AS x, '{c}' AS y, 1.0 AS r" for c in D1_CORR]
    return with_views(["orders_f"], "\nUNION ALL\n".join(cells))


@register("pearson_matrix", _pearson_sql())
def q_pearson_matrix(ctx):
    p = ST.pearson_long(ctx.orders_clean(), D1_CORR)
    return p.select("x", "y", C.round_half_up("r", 4).alias("r"))


@register("corr_matrix_long", with_views(["skus_f"], "\nUNION ALL\n".join(
    [f"SELECT '{a}' AS x, '{b}' AS y, {r(f'CORR({a}, {b})', 4)} AS r FROM skus_f"
     for a, b in combinations(D2_CORR, 2)]
    + [f"SELECT '{b}' AS x, '{a}' AS y, {r(f'CORR({a}, {b})', 4)} AS r FROM skus_f"
       for a, b in combinations(D2_CORR, 2)]
    + [f"SELECT '{c}' AS x, '{c}' AS y, 1.0 AS r" for c in D2_CORR])))
def q_corr_matrix_long(ctx):
    p = ST.pearson_long(ctx.skus(), D2_CORR)
    return p.select("x", "y", C.round_half_up("r", 4).alias("r"))


def _spearman_sql() -> str:
    cells = []
    for a, b in combinations(D2_CORR, 2):
        ranked = (f"(SELECT {_AVG_RANK.format(v=a)} AS ra, {_AVG_RANK.format(v=b)} AS rb FROM skus_f "
                  f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
        cells.append(f"SELECT '{a}' AS x, '{b}' AS y, {r('CORR(ra, rb)', 4)} AS r FROM {ranked}")
        cells.append(f"SELECT '{b}' AS x, '{a}' AS y, {r('CORR(ra, rb)', 4)} AS r FROM {ranked}")
    cells += [f"SELECT '{c}' AS x, '{c}' AS y, 1.0 AS r" for c in D2_CORR]
    return with_views(["skus_f"], "\nUNION ALL\n".join(cells))


@register("spearman_matrix", _spearman_sql())
def q_spearman_matrix(ctx):
    s = ST.spearman_long(ctx.skus(), D2_CORR)
    return s.select("x", "y", C.round_half_up("r", 4).alias("r"))


_D1_PAIRS = [("sales", "benefit_per_order"), ("benefit_per_order", "profit_margin_pct"),
             ("delivery_delay_days", "profit_margin_pct"), ("order_item_discount_rate", "profit_margin_pct")]


@register("corr_highlights", with_views(["orders_f"], "\nUNION ALL\n".join(
    f"SELECT '{a}_vs_{b}' AS pair, {r(f'CORR({a}, {b})', 4)} AS r FROM orders_f" for a, b in _D1_PAIRS)))
def q_corr_highlights(ctx):
    return ST.corr_highlights(ST.pearson_long(ctx.orders_clean(), D1_CORR), _D1_PAIRS)


@register("agg_group_stats", with_views(["skus_f"], f"""
SELECT inspection_result, COUNT(defect_rate_raw) AS n, {r('AVG(defect_rate_raw)', 4)} AS mean,
  {r('MEDIAN(defect_rate_raw)', 4)} AS median, {r('STDDEV_SAMP(defect_rate_raw)', 4)} AS std
FROM skus_f WHERE defect_rate_raw IS NOT NULL GROUP BY 1"""))
def q_agg_group_stats(ctx):
    g = ST.agg_group_stats(ctx.skus(), "defect_rate_raw", "inspection_result")
    return g.select("inspection_result", "n", *[C.round_half_up(c, 4).alias(c) for c in ["mean", "median", "std"]])


@register("agg_median", with_views(["orders_f"], f"""
SELECT {r('MEDIAN(sales)', 4)} AS median FROM orders_f"""))
def q_agg_median(ctx):
    return RK.median(ctx.orders(), "sales").select(C.round_half_up("median", 4).alias("median"))


@register("agg_boxplot", with_views(["orders_f"], f"""
SELECT q.shipping_mode, {r('p25', 4)} AS p25, {r('median', 4)} AS median, {r('p75', 4)} AS p75,
  {r('MIN(CASE WHEN v BETWEEN lo AND hi THEN v END)', 4)} AS whisker_low,
  {r('MAX(CASE WHEN v BETWEEN lo AND hi THEN v END)', 4)} AS whisker_high,
  COUNT(*) FILTER (WHERE NOT (v BETWEEN lo AND hi)) AS outliers
FROM (SELECT shipping_mode, QUANTILE_CONT(profit_margin_pct, 0.25) AS p25, MEDIAN(profit_margin_pct) AS median,
        QUANTILE_CONT(profit_margin_pct, 0.75) AS p75 FROM orders_f WHERE profit_margin_pct IS NOT NULL GROUP BY 1) q
JOIN (SELECT shipping_mode, profit_margin_pct AS v FROM orders_f WHERE profit_margin_pct IS NOT NULL) d
  USING (shipping_mode)
CROSS JOIN LATERAL (SELECT q.p25 - 1.5 * (q.p75 - q.p25) AS lo, q.p75 + 1.5 * (q.p75 - q.p25) AS hi)
GROUP BY q.shipping_mode, p25, median, p75"""))
def q_agg_boxplot(ctx):
    b = ST.agg_boxplot(ctx.orders(), "profit_margin_pct", "shipping_mode")
    return b.select("shipping_mode", *[C.round_half_up(c, 4).alias(c) for c in
                                       ["p25", "median", "p75", "whisker_low", "whisker_high"]], "outliers")
