"""Classification metrics and model-run ranking.

A13 confusion matrix, A14 metrics (accuracy, weighted/macro precision,
recall, F1 with 0 on zero division, Cohen's kappa), E1 weighted F1, A15 CV
summary, A16 teacher confidence summary, A17 latency summary, M11-M13
efficiency / mobile score / eligibility, K2-K4, K6 ranking and selection.

Metrics are computed from confusion counts: the data pass is one
``groupBy(group, y, yhat).count()``; everything after runs on a table with
(classes^2 x groups) rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quantiles import exact_quantiles

METRIC_NAMES = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
                "macro_precision", "macro_recall", "macro_f1", "kappa"]


def _z(num: Column, den: Column) -> Column:
    """Ratio with 0 on a zero denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, y: str, yhat: str, group_cols: list[str] | None = None,
                     weight: str | None = None) -> DataFrame:
    """Counts (or summed weights) by (group, true, predicted)."""
    g = group_cols or []
    n = F.sum(F.col(weight)).cast("double") if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(*g, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(n.alias("n"))


def classification_metrics(cm: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A14 from a confusion table ``(group..., y, yhat, n)``.

    Labels are the union of true and predicted classes per group.
    """
    g = group_cols or []
    true_side = cm.groupBy(*g, F.col("y").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0.0)).alias("tp"))
    pred_side = cm.groupBy(*g, F.col("yhat").alias("c")).agg(F.sum("n").alias("predicted"))
    per_class = true_side.join(pred_side, [*g, "c"], "full_outer").select(
        *g, "c", *[F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in ("support", "tp", "predicted")])
    per_class = per_class.withColumns({
        "precision": _z(F.col("tp"), F.col("predicted")),
        "recall": _z(F.col("tp"), F.col("support")),
    }).withColumn("f1", _z(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    agg = per_class.groupBy(*g).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("support") * F.col("precision")).alias("_wp"),
        F.sum(F.col("support") * F.col("recall")).alias("_wr"),
        F.sum(F.col("support") * F.col("f1")).alias("_wf"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("support") * F.col("predicted")).alias("_pe_num"),
    )
    n = F.col("_n")
    po = _z(F.col("_tp"), n)
    pe = F.try_divide(F.col("_pe_num"), n * n)
    return agg.select(
        *g,
        po.alias("accuracy"),
        _z(F.col("_wp"), n).alias("weighted_precision"),
        _z(F.col("_wr"), n).alias("weighted_recall"),
        _z(F.col("_wf"), n).alias("weighted_f1"),
        "macro_precision", "macro_recall", "macro_f1",
        F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa"),
        n.alias("n_rows"),
    )


def evaluate(df: DataFrame, y: str, yhat: str, group_cols: list[str] | None = None,
             weight: str | None = None) -> DataFrame:
    return classification_metrics(confusion_matrix(df, y, yhat, group_cols, weight), group_cols)


def weighted_f1(df: DataFrame, y: str, yhat: str, group_cols: list[str] | None = None,
                weight: str | None = None) -> DataFrame:
    """Support-weighted F1 per group."""
    m = evaluate(df, y, yhat, group_cols, weight)
    return m.select(*(group_cols or []), "weighted_f1")


def cv_summary(fold_metrics: DataFrame, group_cols: list[str]) -> DataFrame:
    """Mean and population std of each metric over folds."""
    aggs = []
    for m in METRIC_NAMES:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def teacher_confidence_summary(df: DataFrame, conf_col: str = "confidence",
                               group_cols: list[str] | None = None) -> DataFrame:
    """Mean and median of the teacher's max probability (the median by
    distributed selection)."""
    return _with_quantiles(df, conf_col, {"confidence_median": 0.5}, group_cols or [],
                           [F.avg(conf_col).alias("confidence_mean")])


def _with_quantiles(df: DataFrame, col: str, quantiles: dict[str, float], groups: list[str], aggs: list) -> DataFrame:
    """Aggregates per group plus exact quantiles; groups are few labels."""
    found = exact_quantiles(df, [col], list(quantiles.values()), groups)
    keys = list(dict.fromkeys(k[:len(groups)] for k in found))
    fields = [df.schema[g] for g in groups] + [StructField(n, DoubleType()) for n in quantiles]
    rows = [(*g, *[found[(*g, col, q)] for q in quantiles.values()]) for g in keys]
    table = df.sparkSession.createDataFrame(rows, StructType([StructField(f"_{f.name}" if i < len(groups) else f.name, f.dataType)
                                                              for i, f in enumerate(fields)]))
    out = df.groupBy(*groups).agg(*aggs)
    if not groups:
        return out.select("*", *[F.lit(found[col, q]).cast("double").alias(n) for n, q in quantiles.items()])
    cond = [out[g].eqNullSafe(table[f"_{g}"]) for g in groups]
    return out.join(table, cond).drop(*[f"_{g}" for g in groups])


def latency_summary(measurements: DataFrame, model_col: str, ms_col: str) -> DataFrame:
    """Mean, p50, p95 (linear interpolation) of measured times per model;
    the percentiles by distributed selection."""
    return _with_quantiles(measurements, ms_col, {"p50_ms": 0.5, "p95_ms": 0.95}, [model_col],
                           [F.avg(ms_col).alias("mean_ms"), F.count(F.lit(1)).alias("n_measurements")])


# Mobile budget and score weights.
SIZE_BUDGET_KB, SIZE_SLOPE_KB = 1000.0, 3000.0
LATENCY_BUDGET_MS, LATENCY_SLOPE_MS = 25.0, 100.0
EFFICIENCY_WEIGHTS = (0.65, 0.35)
SCORE_WEIGHTS = (0.55, 0.15, 0.15, 0.15)  # weighted F1, macro F1, (kappa+1)/2, efficiency
SKIPPED_LATENCY_MS = 9999.0


def efficiency_score(size_kb: Column, p95_ms: Column) -> Column:
    """Size 1 up to 1000 KB then -1/3000 per KB; latency 1 up to 25 ms
    then -1/100 per ms; floors at 0; weighted 0.65 / 0.35."""
    size = F.when(size_kb <= SIZE_BUDGET_KB, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (size_kb - SIZE_BUDGET_KB) / F.lit(SIZE_SLOPE_KB)))
    lat = F.when(p95_ms <= LATENCY_BUDGET_MS, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (p95_ms - LATENCY_BUDGET_MS) / F.lit(LATENCY_SLOPE_MS)))
    return F.lit(EFFICIENCY_WEIGHTS[0]) * size + F.lit(EFFICIENCY_WEIGHTS[1]) * lat


def mobile_score(wf1: Column, mf1: Column, kappa: Column, eff: Column) -> Column:
    """0.55 wF1 + 0.15 mF1 + 0.15 (kappa+1)/2 + 0.15 efficiency."""
    a, b, c, d = SCORE_WEIGHTS
    return F.lit(a) * wf1 + F.lit(b) * mf1 + F.lit(c) * ((kappa + F.lit(1.0)) / F.lit(2.0)) + F.lit(d) * eff


def eligibility(size_kb: Column, p95_ms: Column | None) -> Column:
    """Within both budgets; with latency skipped (null) size only."""
    size_ok = F.coalesce(size_kb <= SIZE_BUDGET_KB, F.lit(False))
    if p95_ms is None:
        return size_ok
    return F.when(p95_ms.isNull(), size_ok).otherwise(size_ok & (p95_ms <= LATENCY_BUDGET_MS))


def score_runs(runs: DataFrame) -> DataFrame:
    """M11-M13 over ``model_runs`` (size_kb, single_pred_p95_ms, metrics);
    a skipped latency is scored as 9999 ms."""
    p95 = F.coalesce(F.col("single_pred_p95_ms"), F.lit(SKIPPED_LATENCY_MS))
    eff = efficiency_score(F.col("size_kb"), p95)
    return runs.withColumns({
        "eligible_mobile": eligibility(F.col("size_kb"), F.col("single_pred_p95_ms")),
        "efficiency_score": eff,
    }).withColumn("mobile_score", mobile_score(F.col("weighted_f1"), F.col("macro_f1"), F.col("kappa"),
                                               F.col("efficiency_score")))


def rank_candidates(runs: DataFrame, segment: list[str] | None = None, style: str = "mobile") -> DataFrame:
    """K2: rank by eligible, then mobile score, then weighted F1 (``style='mobile'``)
    or eligible, weighted F1, mobile score (``style='transfer'``); all descending,
    model name as the final tie-break. The window spans one segment of the
    candidate table (tens of rows), never data rows."""
    keys = ["eligible_mobile", "mobile_score", "weighted_f1"] if style == "mobile" else \
        ["eligible_mobile", "weighted_f1", "mobile_score"]
    w = Window.partitionBy(*(segment or [])).orderBy(*[F.col(k).desc() for k in keys], F.col("model_name"))
    return runs.withColumn("rank", F.row_number().over(w))


def select_champion(runs: DataFrame, segment: list[str] | None = None, style: str = "mobile") -> DataFrame:
    """K3: among eligible models the best weighted F1 then mobile score; if
    none is eligible, the top of K2 (transfer style: always the top of K2)."""
    ranked = rank_candidates(runs, segment, style)
    seg = segment or []
    if style == "mobile":
        w = Window.partitionBy(*seg).orderBy(F.col("eligible_mobile").desc(), F.col("weighted_f1").desc(),
                                             F.col("mobile_score").desc(), F.col("model_name"))
        any_el = F.max(F.col("eligible_mobile").cast("int")).over(Window.partitionBy(*seg))
        pick = F.when(any_el == 1, F.row_number().over(w)).otherwise(F.col("rank"))
        ranked = ranked.withColumn("_pick", pick)
    else:
        ranked = ranked.withColumn("_pick", F.col("rank"))
    return ranked.filter(F.col("_pick") == 1).drop("_pick")


# Name prefixes of linear model families.
LINEAR_PREFIXES = ("logreg", "sgd")


def best_linear(runs: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """K4: best weighted F1 among linear families."""
    lin = runs.filter(F.lower("model_name").startswith(LINEAR_PREFIXES[0]) |
                      F.lower("model_name").startswith(LINEAR_PREFIXES[1]))
    w = Window.partitionBy(*(segment or [])).orderBy(F.col("weighted_f1").desc(), F.col("model_name"))
    return lin.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_by_f1(runs: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """K6: argmax weighted F1, first name on ties (``min_by``, one partial aggregate)."""
    return runs.groupBy(*(segment or [])).agg(
        F.min_by("model_name", F.struct(-F.col("weighted_f1"), F.col("model_name"))).alias("best_model"),
        F.max("weighted_f1").alias("best_weighted_f1"))
