"""Exact ranks and quantiles without a global window or a per-group collect.

The value column is first reduced to distinct (group, value, count) rows
with map-side partial aggregation, so a hot value or hot group shrinks to
one row before any shuffle.  The distinct rows are range-partitioned in
(group, value) order; each partition computes running counts locally, and
per-(partition, group) totals -- a table of at most
#partitions + #groups rows -- give every partition its starting offset.
No task ever holds more than one range partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import materialize


def value_ranks(df: DataFrame, value: str, groups: list[str] | None = None,
                partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Distinct values with their counts and average (tie) ranks.

    Output: groups..., value, cnt, before (rows with a smaller value in the
    group), n (rows in the group), avg_rank = before + (cnt + 1) / 2.
    Nulls are excluded, as rank-based tests drop them.  With ``weight`` the
    input is already (value, count) rows.
    """
    g = list(groups or [])
    n_rows = F.sum(weight) if weight else F.count(F.lit(1))  # weight: rows pre-counted upstream
    vc = (df.where(F.col(value).isNotNull())
          .groupBy(*g, value).agg(n_rows.cast("long").alias("cnt")))
    order = [*[F.col(c) for c in g], F.col(value)]
    ranged = vc.repartitionByRange(partitions, *order) if partitions else vc.repartitionByRange(*order)
    rp = ranged \
           .withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *g).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rp = rp.withColumn("_local", F.coalesce(F.sum("cnt").over(local), F.lit(0)))
    # range bounds come from sampling; the two reads below (totals, join)
    # must see the same partitions, so the frame is written once
    rp = materialize(rp)
    part_tot = rp.groupBy("_pid", *g).agg(F.sum("cnt").alias("_ptot"))
    prev = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = part_tot.select("_pid", *g, F.coalesce(F.sum("_ptot").over(prev), F.lit(0)).alias("_off"),
                           F.sum("_ptot").over(Window.partitionBy(*g)).alias("n"))
    out = rp.join(offs, ["_pid", *g])
    return out.select(*g, value, "cnt", (F.col("_off") + F.col("_local")).alias("before"), "n",
                      (F.col("_off") + F.col("_local") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def with_avg_rank(df: DataFrame, value: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """Attach the average rank of ``value`` (within ``groups``) to every row."""
    g = list(groups or [])
    ranks = value_ranks(df, value, g).select(*g, value, F.col("avg_rank").alias(name))
    return df.join(ranks, [*g, value], "left")


def quantiles(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy / pandas default).

    For q the target position is h = (n - 1) q; the answer interpolates the
    values at floor(h) and ceil(h).  A distinct-value row covers positions
    [before, before + cnt), so each target is found with an equi-join on
    the group and a range test, then one small aggregation per group.
    """
    return quantiles_of(value_ranks(df, value, list(groups or [])), value, qs, groups)


def quantiles_of(vr: DataFrame, value: str, qs: list[float], groups: list[str] | None = None) -> DataFrame:
    """``quantiles`` from rows of ``value_ranks``."""
    g = list(groups or [])
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("cnt"))
        vr = vr.withColumns({f"_lo{i}": F.when(covers(lo), F.col(value)),
                             f"_hi{i}": F.when(covers(hi), F.col(value)),
                             f"_fr{i}": h - lo})
        aggs += [F.max(f"_lo{i}").alias(f"_lo{i}"), F.max(f"_hi{i}").alias(f"_hi{i}"),
                 F.max(f"_fr{i}").alias(f"_fr{i}")]
    keep = vr.where(reduce(lambda a, b: a | b, [F.col(f"_lo{i}").isNotNull() | F.col(f"_hi{i}").isNotNull()
                                                 for i in range(len(qs))]))
    red = keep.groupBy(*g).agg(*aggs) if g else keep.agg(*aggs)
    outs = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).alias(_qname(q))
            for i, q in enumerate(qs)]
    return red.select(*g, *outs)


def _qname(q: float) -> str:
    return "median" if q == 0.5 else f"p{int(round(q * 100))}"


def median(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    return quantiles(df, value, [0.5], groups)


def approx_median(df: DataFrame, value: str, groups: list[str] | None = None,
                  accuracy: int = 10_000) -> DataFrame:
    """Approximate median (Greenwald-Khanna sketch, mergeable partial
    aggregation): relative rank error 1 / accuracy, bounded memory per group.
    Use when an exact median is not required."""
    g = list(groups or [])
    agg = F.percentile_approx(value, 0.5, accuracy).alias("median")
    return df.groupBy(*g).agg(agg) if g else df.agg(agg)
