"""Monitoring measures the source application only displayed as constants:
daily inference volume, population stability (PSI) drift, accuracy per
period and late-delivery rate per time window.  Batch forms here; the
streaming forms (watermark + window) are in ``streams``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import ranks as RK
from kestrel.session import materialize

PSI_WARNING = 0.2  # fixed value: drift warning threshold
PSI_EPS = 1e-4     # share used for an empty bucket (avoids log(0))


def event_time(c: str = "ts"):
    """Parquet timestamps arrive without zone; watermarks need TIMESTAMP."""
    return F.col(c).cast("timestamp")


def inference_volume_daily(log: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    return log.groupBy(F.to_date(event_time(ts)).alias("day"), F.col(kind).alias("prediction_type")) \
              .agg(F.count(F.lit(1)).alias("requests"))


def late_rate_windows(orders: DataFrame, width: str = "7 days") -> DataFrame:
    """Tumbling windows on the order date (aligned to the epoch)."""
    w = F.window(event_time("order_date"), width)
    return (orders.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("orders"),
                                              F.sum("late_delivery_flag").alias("late"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "orders", "late",
                    F.round(F.col("late").cast("decimal(38,9)") * 100 / F.col("orders"), 2).cast("double")
                    .alias("late_rate_pct")))


def psi_drift(scores: DataFrame, value: str, period: str, baseline: F.Column, bins: int = 10) -> DataFrame:
    """PSI of each period against the baseline rows' decile buckets.

    Two passes over the log: exact baseline quantiles (distributed ranks,
    one small row of cut points), then one grouped count per (period,
    baseline flag, bucket).  That small count table is written once and feeds
    the reference shares, the period totals and the shares per period.  All
    ``bins`` buckets count in every period, also those empty in the baseline
    or in the period (their share is ``PSI_EPS``).
    """
    qs = [i / bins for i in range(1, bins)]
    cuts = RK.quantiles(scores.where(baseline), value, qs)
    names = list(cuts.columns)
    bucket = sum((F.col(value) > F.col(n)).cast("int") for n in names)
    counts = materialize(scores.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cuts))
                         .groupBy(period, baseline.alias("_base"), bucket.alias("bucket"))
                         .agg(F.count(F.lit(1)).alias("_c")), "psi-counts")
    base = counts.where("_base").groupBy("bucket").agg(F.sum("_c").alias("_b"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket"))
    ref = (every.join(base, "bucket", "left").crossJoin(base.agg(F.sum("_b").alias("_bt")))
           .select("bucket", (F.coalesce("_b", F.lit(0)) / F.col("_bt")).alias("q")))
    per = counts.groupBy(period, "bucket").agg(F.sum("_c").alias("_c"))
    tot = counts.groupBy(period).agg(F.sum("_c").alias("_t"))
    grid = tot.crossJoin(F.broadcast(ref))  # periods x buckets (bins rows each)
    shares = (grid.join(per, [period, "bucket"], "left")
              .select(period, "bucket", F.greatest(F.coalesce(F.col("_c"), F.lit(0)) / F.col("_t"),
                                                  F.lit(PSI_EPS)).alias("p"),
                      F.greatest(F.col("q"), F.lit(PSI_EPS)).alias("q")))
    psi = shares.groupBy(period).agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))
    return psi.withColumn("drift_warning", F.col("psi") > PSI_WARNING)


SKETCH_K = 1000  # ranks are off by about 0.3 % of a sketch's rows (99 % confidence), a few KB each


def score_sketches(scores: DataFrame, value: str, period: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch per period: (period, sketch, n).  Rows
    without a value, or with NaN, count for nothing.  One partial aggregation;
    the table can be appended to period by period, also several rows a period."""
    v = F.col(value).cast("double")
    return (scores.select(F.col(period), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .groupBy(period).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")))


def psi_from_sketches(sketches: DataFrame, period: str, baseline: F.Column, bins: int = 10) -> DataFrame:
    """PSI of each period from sketches alone; the raw scores aren't read again.

    The baseline's sketches are merged into one row, whose quantiles are the cut
    points (no interpolation); a period's shares are rank differences at them.
    Without baseline rows the PSI is null.
    """
    ranks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    base = (sketches.where(baseline).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
            .select(F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_s", ranks)).alias("cuts")))
    cuts = base.first().cuts  # bins - 1 numbers: the rank function takes constants only
    if cuts is None:
        return sketches.select(period).distinct().select(period, F.lit(None).cast("double").alias("psi"),
                                                         F.lit(None).cast("boolean").alias("drift_warning"))

    def ranked() -> F.Column:
        return F.kll_sketch_get_rank_double("_s", F.array(*[F.lit(float(c)) for c in cuts]))

    ref = sketches.where(baseline).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    ref = ref.select(ranked().alias("_q"))
    each = sketches.groupBy(period).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    each = each.withColumn("_p", ranked()).crossJoin(F.broadcast(ref))  # one row

    def shares(c: str) -> F.Column:
        at = F.concat(F.array(F.lit(0.0)), F.col(c), F.array(F.lit(1.0)))
        return F.zip_with(F.slice(at, 2, bins), F.slice(at, 1, bins), lambda hi, lo: F.greatest(hi - lo, F.lit(PSI_EPS)))

    terms = F.zip_with(shares("_p"), shares("_q"), lambda p, q: (p - q) * F.log(p / q))
    return (each.select(period, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))
            .withColumn("drift_warning", F.col("psi") > PSI_WARNING))


def accuracy_monitor(scored: DataFrame, period: F.Column, label: str, pred: str) -> DataFrame:
    """Prediction log joined to outcomes: accuracy per period."""
    return (scored.groupBy(period.alias("period"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("correct"))
            .withColumn("accuracy_pct",
                        F.round(F.col("correct").cast("decimal(38,9)") * 100 / F.col("n"), 2).cast("double")))
