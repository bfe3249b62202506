"""Model training / scoring / evaluation queries.

Rule scorers and the metrics computed from their predictions are checked
against SQL; forests are checked row-count only (MLlib and the source
library grow different trees) and by tests on AUC and probability range.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.functions import columns as C
from kestrel.operators import ml
from kestrel.plans.oracle_views import with_views
from kestrel.plans.registry import register
from kestrel.session import scratch_path

_P = ("CASE WHEN scheduled_shipping_days <= 2 THEN 0.75 + LEAST(sales / 10000.0, 0.20) "
      "WHEN scheduled_shipping_days >= 5 THEN 0.12 ELSE 0.38 END")
_FLAG = "CAST((scheduled_shipping_days <= 2 OR sales > 1500) AS BIGINT)"


def _re(expr: str, k: int) -> str:
    return f"CAST(ROUND_EVEN(CAST({expr} AS DECIMAL(38,9)), {k}) AS DOUBLE)"


def _model_input(ctx):
    return ctx.orders_clean().withColumnRenamed("Line Key", "row_key")


@register("rule_score_delay", with_views(["orders_f"], f"""
SELECT shipping_mode, CAST(SUM({_FLAG}) AS BIGINT) AS flagged,
  CAST(SUM(CAST({_re(_P, 4)} AS DECIMAL(38,4))) AS DOUBLE) AS late_probability_sum
FROM orders_f GROUP BY 1"""))
def q_rule_score_delay(ctx):
    s = ml.rule_score_delay(ctx.orders())
    return s.groupBy("shipping_mode").agg(
        F.sum("predicted_label").alias("flagged"),
        F.sum(F.col("late_probability").cast("decimal(38,4)")).cast("double").alias("late_probability_sum"))


@register("rule_score_demand", with_views(["orders_f"], f"""
SELECT category_name, CAST(SUM(CAST({_re('GREATEST(180.0 * (1.1 - discount_rate_pct / 100.0) + benefit_per_order * 1.5, 15.0)', 2)}
  AS DECIMAL(38,2))) AS DOUBLE) AS predicted_sales_sum FROM orders_f GROUP BY 1"""))
def q_rule_score_demand(ctx):
    s = ml.rule_score_demand(ctx.orders())
    return s.groupBy("category_name").agg(
        F.sum(F.col("predicted_sales").cast("decimal(38,2)")).cast("double").alias("predicted_sales_sum"))


@register("agg_confusion_matrix", with_views(["orders_f"], f"""
SELECT late_delivery_flag AS actual, {_FLAG} AS predicted, COUNT(*) AS n FROM orders_f GROUP BY 1, 2"""))
def q_agg_confusion_matrix(ctx):
    s = ml.rule_score_delay(ctx.orders())
    return ml.agg_confusion_matrix(s, "late_delivery_flag")


_CM = f"""(SELECT COUNT(*) FILTER (WHERE y = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND p = 0) AS fn, COUNT(*) FILTER (WHERE y = 0 AND p = 0) AS tn
  FROM (SELECT late_delivery_flag AS y, {_FLAG} AS p FROM orders_f))"""


@register("eval_classifier", with_views(["orders_f"], f"""
SELECT CAST(ROUND_EVEN(CAST(tp + tn AS DECIMAL(38,9)) / (tp + tn + fp + fn), 4) AS DOUBLE) AS accuracy,
  CAST(ROUND_EVEN(CAST(tp AS DECIMAL(38,9)) / (tp + fp), 4) AS DOUBLE) AS precision,
  CAST(ROUND_EVEN(CAST(tp AS DECIMAL(38,9)) / (tp + fn), 4) AS DOUBLE) AS recall,
  CAST(ROUND_EVEN(2.0 * tp / (2 * tp + fp + fn), 4) AS DOUBLE) AS f1_score,
  CAST(ROUND_EVEN(CAST((SELECT (SUM(pos * (2 * before + n + 1)) - SUM(pos) * (SUM(pos) + 1)) / (2.0 * SUM(pos) * SUM(n - pos))
    FROM (SELECT n, pos, SUM(n) OVER (ORDER BY p) - n AS before FROM (SELECT {_re(_P, 4)} AS p, COUNT(*) AS n,
      SUM(late_delivery_flag) AS pos FROM orders_f GROUP BY 1))) AS DECIMAL(38,9)), 4) AS DOUBLE) AS roc_auc
FROM {_CM}"""))
def q_eval_classifier(ctx):
    return ml.eval_classifier(ml.rule_score_delay(ctx.orders()), "late_delivery_flag", prob="late_probability")


@register("eval_class_report", with_views(["orders_f"], f"""
SELECT CAST(1 AS BIGINT) AS cls, CAST(ROUND_EVEN(CAST(tp AS DECIMAL(38,9)) / (tp + fp), 4) AS DOUBLE) AS precision,
  CAST(ROUND_EVEN(CAST(tp AS DECIMAL(38,9)) / (tp + fn), 4) AS DOUBLE) AS recall,
  CAST(ROUND_EVEN(2.0 * tp / (2 * tp + fp + fn), 4) AS DOUBLE) AS f1, tp + fn AS support FROM {_CM}
UNION ALL
SELECT 0, CAST(ROUND_EVEN(CAST(tn AS DECIMAL(38,9)) / (tn + fn), 4) AS DOUBLE),
  CAST(ROUND_EVEN(CAST(tn AS DECIMAL(38,9)) / (tn + fp), 4) AS DOUBLE),
  CAST(ROUND_EVEN(2.0 * tn / (2 * tn + fn + fp), 4) AS DOUBLE), tn + fp FROM {_CM}"""))
def q_eval_class_report(ctx):
    return ml.eval_class_report(ml.rule_score_delay(ctx.orders()), "late_delivery_flag")


_PRED = "GREATEST(180.0 * (1.1 - discount_rate_pct / 100.0) + benefit_per_order * 1.5, 15.0)"


@register("eval_regressor", with_views(["orders_f"], f"""
SELECT CAST(ROUND_EVEN(CAST(SQRT(AVG((sales - p) * (sales - p))) AS DECIMAL(38,9)), 4) AS DOUBLE) AS rmse,
  CAST(ROUND_EVEN(CAST(AVG(ABS(sales - p)) AS DECIMAL(38,9)), 4) AS DOUBLE) AS mae,
  CAST(ROUND_EVEN(CAST(1.0 - SUM((sales - p) * (sales - p)) / (VAR_POP(sales) * COUNT(*)) AS DECIMAL(38,9)), 4)
    AS DOUBLE) AS r2,
  CAST(ROUND_EVEN(CAST(AVG(CASE WHEN sales <> 0 THEN ABS((sales - p) / sales) END) * 100 AS DECIMAL(38,9)), 2)
    AS DOUBLE) AS mape
FROM (SELECT sales, {_re(_PRED, 2)} AS p FROM orders_f)"""))
def q_eval_regressor(ctx):
    s = ml.rule_score_demand(ctx.orders())
    return ml.eval_regressor(s, "sales", "predicted_sales")


@register("encode_categoricals", with_views(["orders_f"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COALESCE({c}, 'nan') AS label, CAST(ROW_NUMBER() OVER (ORDER BY COALESCE({c}, 'nan')) - 1 AS BIGINT) AS code, "
    f"COUNT(*) AS n_rows FROM orders_f GROUP BY 2" for c in S.DELAY_CATEGORICALS)))
def q_encode_categoricals(ctx):
    """Every label of every column with its code, and how many rows the codes joined to the rows give."""
    df = ml.encode_input(ctx.orders(), S.DELAY_CATEGORICALS, S.DELAY_NUMERICS)
    codes = ml.label_codes(df, S.DELAY_CATEGORICALS)
    coded = ml.with_codes(df, codes, S.DELAY_CATEGORICALS)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label"), F.col(f"{c}_code").alias("code"))
                                for c in S.DELAY_CATEGORICALS])).alias("x")
    return coded.select(pairs).select("x.*").groupBy("column_name", "label", "code").agg(F.count(F.lit(1)).alias("n_rows"))


@register("prepare_numeric", with_views(["orders_f"], """
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE COALESCE(profit_margin_pct, 0) = 0) AS zero_margin
FROM orders_f"""))
def q_prepare_numeric(ctx):
    d = ml.encode_input(ctx.orders(), [], ["profit_margin_pct"])
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("profit_margin_pct") == 0).alias("zero_margin"))


_MODELS: dict = {}


def _delay_model(ctx):
    """Trained once per (session, data folder) and shared by the scoring queries."""
    key = ("delay", ctx.spark.sparkContext.applicationId, ctx._scope)
    if key not in _MODELS:
        _MODELS[key] = ml.train_delay_classifier(_model_input(ctx))
    return _MODELS[key]


def _sales_model(ctx):
    key = ("sales", ctx.spark.sparkContext.applicationId, ctx._scope)
    if key not in _MODELS:
        _MODELS[key] = ml.train_sales_regressor(_model_input(ctx))
    return _MODELS[key]


@register("train_delay_classifier")
def q_train_delay_classifier(ctx):
    model, test = _delay_model(ctx)
    scored = ml.score_delay_batch(model, test)
    return ml.eval_classifier(scored, "label", "predicted_label", prob="probability")


@register("score_delay_batch")
def q_score_delay_batch(ctx):
    model, _ = _delay_model(ctx)
    scored = ml.score_delay_batch(model, _model_input(ctx))
    return scored.groupBy("shipping_mode", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), C.round_half_up(F.avg("late_probability"), 4).alias("mean_p_late"))


@register("train_sales_regressor")
def q_train_sales_regressor(ctx):
    model, test = _sales_model(ctx)
    return ml.eval_regressor(model.transform(test), "label", "prediction")


@register("score_demand_batch")
def q_score_demand_batch(ctx):
    model, _ = _sales_model(ctx)
    s = ml.score_demand_batch(model, _model_input(ctx))
    return s.groupBy("category_name").agg(F.count(F.lit(1)).alias("n"),
                                          C.round_half_up(F.avg("predicted_sales"), 2).alias("mean_predicted"))


@register("feature_importance")
def q_feature_importance(ctx):
    model, _ = _delay_model(ctx)
    feats = [f"{c}_idx" for c in S.DELAY_CATEGORICALS] + S.DELAY_NUMERICS
    return ml.feature_importance(model, ctx.spark, feats)


@register("model_save_load")
def q_model_save_load(ctx):
    model, test = _delay_model(ctx)
    path = scratch_path(ctx.spark, "delay-model")
    ml.model_save(model, path)
    back = ml.model_load(path)
    a = ml.score_delay_batch(model, test).select("row_key", F.col("late_probability").alias("a"))
    b = ml.score_delay_batch(back, test).select("row_key", F.col("late_probability").alias("b"))
    j = a.join(b, "row_key")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differences"))


def _registry(ctx):
    from kestrel.operators import scoring
    spark = ctx.spark
    t = datetime(2001, 6, 1)
    scores = scoring.score_suppliers(ctx.skus())
    inv = scoring.optimize_inventory(ctx.skus())
    rows = [
        ml.registry_row(spark, "supplier_scorer", "1.0", "WeightedCompositeScore",
                        scoring.agg_tier_counts(scores), "models/supplier_scores", "overall_score", t),
        ml.registry_row(spark, "inventory_optimizer", "1.0", "AnalyticalFormulas",
                        scoring.agg_inventory_metrics(inv), "models/inventory_recommendations", "reorder_point", t),
        ml.registry_row(spark, "delay_rules", "0.1", "Rules",
                        ml.eval_classifier(ml.rule_score_delay(ctx.orders()), "late_delivery_flag"),
                        "rules/delay", "late_delivery_flag", t),
    ]
    out = rows[0]
    for r_ in rows[1:]:
        out = out.unionByName(r_)
    return out


@register("model_registry_append", with_views(["skus_f"], """
SELECT 'supplier_scorer' AS model_name, 'supplier_scoring' AS model_type, TRUE AS is_active
UNION ALL SELECT 'inventory_optimizer', 'inventory_optimization', TRUE
UNION ALL SELECT 'delay_rules', 'delay_prediction', TRUE FROM (SELECT COUNT(*) FROM skus_f)"""))
def q_model_registry_append(ctx):
    path = scratch_path(ctx.spark, "registry")
    from kestrel.sources.sinks import sink_append
    sink_append(_registry(ctx), path)
    return ctx.spark.read.parquet(path).select("model_name", "model_type", "is_active")


@register("registry_one_active", with_views(["skus_f"], """
SELECT 'one_active_per_type' AS rule, CAST(0 AS BIGINT) AS violations FROM (SELECT COUNT(*) FROM skus_f)
UNION ALL SELECT 'name_version_unique', CAST(0 AS BIGINT)"""))
def q_registry_one_active(ctx):
    v = ml.registry_one_active(_registry(ctx))
    rules = ctx.spark.createDataFrame([("one_active_per_type",), ("name_version_unique",)], "rule string")
    cnt = v.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return rules.join(cnt, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).cast("long")
                                                  .alias("violations"))


@register("scan_json_registry", with_views(["skus_f"], """
SELECT 'supplier_scorer' AS model_name, '1.0' AS model_version, 'WeightedCompositeScore' AS algorithm,
  'active' AS status, CAST((SELECT COUNT(DISTINCT supplier_name) FROM skus_f) AS DOUBLE) AS scored
UNION ALL SELECT 'inventory_optimizer', '1.0', 'AnalyticalFormulas', 'active',
  CAST((SELECT COUNT(*) FROM skus_f) AS DOUBLE)
UNION ALL SELECT 'delay_rules', '0.1', 'Rules', 'active', CAST(NULL AS DOUBLE)"""))
def q_scan_json_registry(ctx):
    """Registry written as one JSON array document and read back multi-line."""
    path = scratch_path(ctx.spark, "registry-json")
    reg = _registry(ctx).select("model_name", "model_version", "algorithm", "metrics", "status")
    doc = reg.agg(F.to_json(F.collect_list(F.struct(*reg.columns))).alias("value"))  # 3 rows -> 1 document
    doc.write.mode("overwrite").text(path)
    from kestrel.sources.files import scan_json_array
    back = scan_json_array(ctx.spark, path)
    m = F.col("metrics")
    scored = F.coalesce(F.get_json_object(m, "$.suppliers_scored"), F.get_json_object(m, "$.skus_analyzed"))
    return back.select("model_name", "model_version", "algorithm", "status", scored.cast("double").alias("scored"))
