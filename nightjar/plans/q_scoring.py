"""Registered queries for metrics, ranking, scoring, thresholds and
robustness (A13-A17, E1-E5, K2-K4, K6, M9, M11-M13, R1-R3, R5-R7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrand import draws_sql, hash_words_sql, poisson1_sql
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import nights as N
from ..operators import robust as E
from ..operators import scoring as R
from ..operators import splits as S
from ..sources.contract_data import NIGHT_CONTRACT
from . import bindings as B
from .q_nights import _night_features_sql, _samples, _segments
from .registry import oracle_wrap, presentable, register

KEYS = B.MODEL_KEYS
METRIC_COLS = M.METRIC_NAMES


def _preds(spark, sf):
    return B.predictions(B.table(spark, sf, "lineitem"))


# ------------------------------------------------------------------ SQL helpers
def metrics_sql(cm_sql: str, g: list[str]) -> str:
    """A14 over a confusion table ``(g..., y, yhat, n)`` in DuckDB SQL."""
    gs = ", ".join(g)
    gsc = gs + ", " if g else ""
    using = f"USING ({gs}, c)" if g else "USING (c)"
    return f"""
WITH cm AS ({cm_sql}),
tc AS (SELECT {gsc}y AS c, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS tp FROM cm GROUP BY ALL),
pc AS (SELECT {gsc}yhat AS c, sum(n) AS predicted FROM cm GROUP BY ALL),
pcl AS (SELECT {gsc}c, CAST(coalesce(support, 0) AS DOUBLE) AS support, CAST(coalesce(tp, 0) AS DOUBLE) AS tp,
               CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted FROM tc FULL JOIN pc {using}),
pm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec,
              CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM pcl),
ag AS (SELECT {gsc}sum(support) AS n, sum(tp) AS tp, sum(support * prec) AS wp, sum(support * rec) AS wr,
              sum(support * f1) AS wf, avg(prec) AS macro_precision, avg(rec) AS macro_recall, avg(f1) AS macro_f1,
              sum(support * predicted) / (sum(support) * sum(support)) AS pe FROM pm {'GROUP BY ' + gs if g else ''})
SELECT {gsc}tp / n AS accuracy, wp / n AS weighted_precision, wr / n AS weighted_recall, wf / n AS weighted_f1,
       macro_precision, macro_recall, macro_f1, (tp / n - pe) / NULLIF(1 - pe, 0) AS kappa FROM ag"""


def hash_u_sql(key_sql: str) -> str:
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT) / 4294967296.0)"


def key_sql(cols=KEYS) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in cols) + ")"


# ------------------------------------------------------------------ R1 / A13 / A14 / E1
@register("score_linear_contract", op_ids="R1",
          sql=oracle_wrap(f"SELECT {', '.join(KEYS)}, target, logit, p1, predicted_label FROM ({B.PREDICTIONS_SQL}) p",
                          ["logit", "p1"]))
def q_score(spark, sf):
    return presentable(_preds(spark, sf).select(*KEYS, "target", "logit", "p1", "predicted_label"))


def _night_contract_sql() -> str:
    c = NIGHT_CONTRACT
    logit = B.contract_logit_sql(c)
    return f"""SELECT subject_id, night_date, logit, 1.0 / (1.0 + exp(-logit)) AS p1,
 CAST(1.0 / (1.0 + exp(-logit)) >= 0.5 AS INTEGER) AS predicted_label
 FROM (SELECT *, {logit} AS logit FROM ({_night_features_sql(False)}) n) s"""


@register("score_night_contract", op_ids="R1 R3",
          sql=oracle_wrap(_night_contract_sql(), ["logit", "p1"]))
def q_score_nights(spark, sf):
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    c = R.LinearContract.from_mapping(NIGHT_CONTRACT)
    return presentable(R.score_linear_contract(nights, c).select("subject_id", "night_date", "logit", "p1",
                                                                  "predicted_label"))


@register("score_contracts_long", op_ids="R1",
          sql=oracle_wrap(f"SELECT subject_id, night_date, 'published' AS contract_id, logit, p1 "
                          f"FROM ({_night_contract_sql()}) s", ["logit", "p1"]))
def q_score_long(spark, sf):
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    feats = NIGHT_CONTRACT["feature_order"]
    long = nights.select("subject_id", "night_date", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])))
    c = R.LinearContract.from_mapping(NIGHT_CONTRACT)
    contracts = c.to_rows(spark, "published")
    intercepts = spark.createDataFrame([("published", c.intercept)], "contract_id string, intercept double")
    out = R.score_contracts_long(long, contracts, intercepts, ["subject_id", "night_date"])
    return presentable(out.select("subject_id", "night_date", "contract_id", "logit", "p1"))


_CM_SQL = f"SELECT target AS y, predicted_label AS yhat, CAST(count(*) AS DOUBLE) AS n FROM ({B.PREDICTIONS_SQL}) p GROUP BY ALL"


@register("confusion_matrix", op_ids="A13", sql=_CM_SQL)
def q_cm(spark, sf):
    return M.confusion_matrix(_preds(spark, sf), "target", "predicted_label")


@register("classification_metrics", op_ids="A14", sql=oracle_wrap(metrics_sql(_CM_SQL, []), METRIC_COLS))
def q_metrics(spark, sf):
    return presentable(M.evaluate(_preds(spark, sf), "target", "predicted_label").drop("n_rows"))


_CM_SUBJ_SQL = (f"SELECT subject_id, target AS y, predicted_label AS yhat, CAST(count(*) AS DOUBLE) AS n "
                f"FROM ({B.PREDICTIONS_SQL}) p GROUP BY ALL")


@register("weighted_f1", op_ids="E1",
          sql=oracle_wrap(f"SELECT subject_id, weighted_f1 FROM ({metrics_sql(_CM_SUBJ_SQL, ['subject_id'])}) m",
                          ["weighted_f1"]))
def q_wf1(spark, sf):
    return presentable(M.weighted_f1(_preds(spark, sf), "target", "predicted_label", ["subject_id"]))


# ------------------------------------------------------------------ R5-R7
@register("apply_threshold", op_ids="R5",
          sql=f"""SELECT {', '.join(KEYS)}, m.model_name, CAST(p.p1 >= m.threshold AS INTEGER) AS decision
 FROM ({B.PREDICTIONS_SQL}) p, ({B.model_table_sql()}) m""")
def q_apply_threshold(spark, sf):
    # Each row is decided under every model's threshold: a fixed fan-out of
    # five by ``explode`` over the model parameters, not a join.
    arr = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(float(t)).alias("threshold"))
                    for n, t, _ in B.MODEL_OF_EVENT.values()])
    j = _preds(spark, sf).withColumn("_m", F.explode(arr)).select(
        *KEYS, "p1", F.col("_m.model_name").alias("model_name"), F.col("_m.threshold").alias("threshold"))
    return R.apply_threshold(j, "p1", F.col("threshold")).select(*KEYS, "model_name", "decision")


def _sweep_sql(pred_sql: str, g: list[str]) -> str:
    gs = ", ".join(g)
    gsc = gs + ", " if g else ""
    cm = (f"SELECT {gsc}t_int, target AS y, CAST(p1 >= t_int / 100.0 AS INTEGER) AS yhat, CAST(count(*) AS DOUBLE) AS n "
          f"FROM ({pred_sql}) p, range(20, 81) r(t_int) GROUP BY ALL")
    m = metrics_sql(cm, [*g, "t_int"])
    order = "weighted_f1 DESC, kappa DESC, abs(t_int - 50) ASC, t_int ASC"
    part = f"PARTITION BY {gs}" if g else ""
    return f"""SELECT *, t_int / 100.0 AS threshold,
 row_number() OVER ({part} ORDER BY {order}) = 1 AS is_best FROM ({m}) mm"""


@register("threshold_sweep", op_ids="R6", bench=True,
          sql=oracle_wrap(_sweep_sql(B.PREDICTIONS_SQL, []), METRIC_COLS + ["threshold"]))
def q_sweep(spark, sf):
    return presentable(R.threshold_sweep(_preds(spark, sf), "p1", "target"))


def _gate_sql(sweep_sql: str) -> str:
    return f"""WITH s AS ({sweep_sql}),
b AS (SELECT threshold AS tuned_threshold, t_int, weighted_f1 AS tuned_weighted_f1 FROM s WHERE is_best),
d AS (SELECT weighted_f1 AS default_weighted_f1 FROM s WHERE t_int = 50)
SELECT tuned_threshold, tuned_weighted_f1, default_weighted_f1, tuned_weighted_f1 - default_weighted_f1 AS delta_weighted_f1,
 CASE WHEN tuned_weighted_f1 - default_weighted_f1 < 0.02 THEN 'fallback_gain_lt_0.02'
      WHEN abs(t_int - 50) / 100.0 > 0.1 + 1e-12 THEN 'fallback_shift_gt_0.10' ELSE 'accepted_tuned_threshold' END AS reason,
 CASE WHEN tuned_weighted_f1 - default_weighted_f1 >= 0.02 AND abs(t_int - 50) / 100.0 <= 0.1 + 1e-12
      THEN tuned_threshold ELSE 0.5 END AS deployment_threshold
FROM b, d"""


@register("deployment_threshold_gate", op_ids="R7",
          sql=oracle_wrap(_gate_sql(_sweep_sql(B.PREDICTIONS_SQL, [])),
                          ["tuned_threshold", "tuned_weighted_f1", "default_weighted_f1", "delta_weighted_f1",
                           "deployment_threshold"]))
def q_gate(spark, sf):
    return presentable(R.deployment_threshold_gate(R.threshold_sweep(_preds(spark, sf), "p1", "target")))


# ------------------------------------------------------------------ model runs
def model_runs(spark, sf):
    """One row per candidate: latency stats (A17) from events, size from
    props, metrics of its thresholded lineitem predictions, then M11-M13."""
    ev = B.table(spark, sf, "events")
    models = B.model_table(spark)
    meas = ev.select("event_type", (F.col("value") / 10.0).alias("ms"),
                     F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    lat = M.latency_summary(meas, "event_type", "ms")
    size = meas.groupBy("event_type").agg(F.avg("k").alias("mean_k"))
    runs = lat.join(size, "event_type").join(F.broadcast(models), "event_type").select(
        "model_name", "threshold", (F.col("mean_k") * F.col("size_factor")).alias("size_kb"),
        F.col("p50_ms").alias("single_pred_p50_ms"), F.col("p95_ms").alias("single_pred_p95_ms"),
        F.col("mean_ms").alias("single_pred_mean_ms"))
    # Per model decisions: 5 thresholds over the same probabilities, one
    # confusion aggregate grouped by model.
    p = _preds(spark, sf).select("target", "p1")
    thresholds = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(float(t)).alias("threshold"))
                           for n, t, _ in B.MODEL_OF_EVENT.values()])
    dec = p.withColumn("_m", F.explode(thresholds)).select(
        "target", F.col("_m.model_name").alias("model_name"),
        (F.col("p1") >= F.col("_m.threshold")).cast("int").alias("yhat"))
    met = M.evaluate(dec, "target", "yhat", ["model_name"]).drop("n_rows")
    return M.score_runs(runs.join(met, "model_name"))


_RUNS_DOUBLES = ["threshold", "size_kb", "single_pred_p50_ms", "single_pred_p95_ms", "single_pred_mean_ms",
                 *METRIC_COLS, "efficiency_score", "mobile_score"]


def _runs_sql() -> str:
    cm = (f"SELECT m.model_name, target AS y, CAST(p1 >= m.threshold AS INTEGER) AS yhat, CAST(count(*) AS DOUBLE) AS n "
          f"FROM ({B.PREDICTIONS_SQL}) p, ({B.model_table_sql()}) m GROUP BY ALL")
    eff_size = "CASE WHEN size_kb <= 1000 THEN 1.0 ELSE greatest(0.0, 1.0 - (size_kb - 1000) / 3000.0) END"
    eff_lat = ("CASE WHEN coalesce(single_pred_p95_ms, 9999.0) <= 25 THEN 1.0 "
               "ELSE greatest(0.0, 1.0 - (coalesce(single_pred_p95_ms, 9999.0) - 25) / 100.0) END")
    return f"""
WITH lat AS (SELECT event_type, avg(value / 10.0) AS mean_ms, quantile_cont(value / 10.0, 0.5) AS p50,
                    quantile_cont(value / 10.0, 0.95) AS p95,
                    avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean_k FROM events GROUP BY 1),
runs AS (SELECT m.model_name, m.threshold, lat.mean_k * m.size_factor AS size_kb, lat.p50 AS single_pred_p50_ms,
                lat.p95 AS single_pred_p95_ms, lat.mean_ms AS single_pred_mean_ms
         FROM lat JOIN ({B.model_table_sql()}) m USING (event_type)),
met AS ({metrics_sql(cm, ['model_name'])}),
j AS (SELECT * FROM runs JOIN met USING (model_name)),
s AS (SELECT *, size_kb <= 1000 AND single_pred_p95_ms <= 25 AS eligible_mobile,
             0.65 * ({eff_size}) + 0.35 * ({eff_lat}) AS efficiency_score FROM j)
SELECT *, 0.55 * weighted_f1 + 0.15 * macro_f1 + 0.15 * ((kappa + 1.0) / 2.0) + 0.15 * efficiency_score AS mobile_score
FROM s"""


@register("latency_summary", op_ids="A17",
          sql=oracle_wrap("""SELECT event_type, avg(value / 10.0) AS mean_ms, quantile_cont(value / 10.0, 0.5) AS p50_ms,
 quantile_cont(value / 10.0, 0.95) AS p95_ms, count(*) AS n_measurements FROM events GROUP BY 1""",
                          ["mean_ms", "p50_ms", "p95_ms"]))
def q_latency(spark, sf):
    ev = B.table(spark, sf, "events").select("event_type", (F.col("value") / 10.0).alias("ms"))
    return presentable(M.latency_summary(ev, "event_type", "ms"))


@register("mobile_score", op_ids="M11 M12 M13", sql=oracle_wrap(_runs_sql(), _RUNS_DOUBLES))
def q_runs(spark, sf):
    return presentable(model_runs(spark, sf))


def _rank_sql(order: str) -> str:
    return f"SELECT model_name, row_number() OVER (ORDER BY {order}) AS rank FROM ({_runs_sql()}) r"


@register("rank_candidates", op_ids="K2",
          sql=_rank_sql("eligible_mobile DESC, mobile_score DESC, weighted_f1 DESC, model_name"))
def q_rank(spark, sf):
    return M.rank_candidates(model_runs(spark, sf)).select("model_name", "rank")


@register("select_champion", op_ids="K3",
          sql=f"""WITH r AS ({_runs_sql()})
SELECT model_name FROM r ORDER BY
  CASE WHEN (SELECT bool_or(eligible_mobile) FROM r) THEN CAST(eligible_mobile AS INT) ELSE 0 END DESC,
  CASE WHEN (SELECT bool_or(eligible_mobile) FROM r) THEN weighted_f1 ELSE NULL END DESC NULLS LAST,
  CASE WHEN (SELECT bool_or(eligible_mobile) FROM r) THEN mobile_score ELSE NULL END DESC NULLS LAST,
  CAST(eligible_mobile AS INT) DESC, mobile_score DESC, weighted_f1 DESC, model_name LIMIT 1""")
def q_champion(spark, sf):
    return M.select_champion(model_runs(spark, sf)).select("model_name")


@register("best_linear", op_ids="K4",
          sql=f"""SELECT model_name FROM ({_runs_sql()}) r WHERE model_name LIKE 'logreg%' OR model_name LIKE 'sgd%'
 ORDER BY weighted_f1 DESC, model_name LIMIT 1""")
def q_best_linear(spark, sf):
    return M.best_linear(model_runs(spark, sf)).select("model_name")


@register("best_by_f1", op_ids="K6",
          sql=oracle_wrap(f"""SELECT arg_min(model_name, (-weighted_f1, model_name)) AS best_model,
 max(weighted_f1) AS best_weighted_f1 FROM ({_runs_sql()}) r""", ["best_weighted_f1"]))
def q_best_f1(spark, sf):
    return presentable(M.best_by_f1(model_runs(spark, sf)))


# ------------------------------------------------------------------ A15 / A16 / M9
def _fold_preds(spark, sf):
    folds = S.walk_forward_folds(B.model_rows(B.table(spark, sf, "lineitem")), B.MODEL_ORDER, "target")
    c = R.LinearContract.from_mapping(B.LINEITEM_CONTRACT)
    return R.score_linear_contract(folds.filter(F.col("test_fold") >= 0), c)


def _cv_sql() -> str:
    from .q_labels import _folds_sql
    folds = _folds_sql(cols=[*KEYS, *B.MODEL_FEATURES, "target"])
    logit = B.contract_logit_sql(B.LINEITEM_CONTRACT)
    preds = f"SELECT *, 1.0 / (1.0 + exp(-({logit}))) AS p1 FROM ({folds}) f WHERE test_fold >= 0"
    cm = (f"SELECT m.model_name, test_fold, target AS y, CAST(p1 >= m.threshold AS INTEGER) AS yhat, "
          f"CAST(count(*) AS DOUBLE) AS n FROM ({preds}) p, ({B.model_table_sql()}) m GROUP BY ALL")
    per_fold = metrics_sql(cm, ["model_name", "test_fold"])
    aggs = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in METRIC_COLS)
    return f"SELECT model_name, count(*) AS folds, {aggs} FROM ({per_fold}) pf GROUP BY model_name"


@register("cv_summary", op_ids="A15 M8",
          sql=oracle_wrap(_cv_sql(), [f"{m}_{s}" for m in METRIC_COLS for s in ("mean", "std")]))
def q_cv(spark, sf):
    fp = _fold_preds(spark, sf)
    thresholds = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(float(t)).alias("threshold"))
                           for n, t, _ in B.MODEL_OF_EVENT.values()])
    dec = fp.withColumn("_m", F.explode(thresholds)).select(
        "test_fold", "target", F.col("_m.model_name").alias("model_name"),
        (F.col("p1") >= F.col("_m.threshold")).cast("int").alias("yhat"))
    per_fold = M.evaluate(dec, "target", "yhat", ["model_name", "test_fold"])
    return presentable(M.cv_summary(per_fold, ["model_name"]))


@register("teacher_targets", op_ids="M9 A16",
          sql=oracle_wrap(f"""SELECT avg(greatest(p1, 1 - p1)) AS confidence_mean,
 median(greatest(p1, 1 - p1)) AS confidence_median FROM ({B.PREDICTIONS_SQL}) p""",
                          ["confidence_mean", "confidence_median"]))
def q_teacher(spark, sf):
    p = _preds(spark, sf).withColumn("confidence", F.greatest(F.col("p1"), F.lit(1.0) - F.col("p1")))
    return presentable(M.teacher_confidence_summary(p))


_TEACHER_MIN, _STUDENT_MIN = 0.55, 0.6


@register("teacher_blended_labels", op_ids="M9 M10",
          sql=oracle_wrap(f"""SELECT {', '.join(KEYS)}, confidence, blended_label,
 CASE WHEN confidence >= {_STUDENT_MIN} THEN predicted_label ELSE target END AS student_label,
 CASE WHEN confidence >= {_STUDENT_MIN} THEN predicted_label ELSE blended_label END AS student_label_reference
 FROM (SELECT *, CASE WHEN confidence >= {_TEACHER_MIN} THEN predicted_label ELSE target END AS blended_label
 FROM (SELECT *, greatest(p1, 1 - p1) AS confidence FROM ({B.PREDICTIONS_SQL}) p) a) b""", ["confidence"]))
def q_blended(spark, sf):
    """Per row: the teacher's blended label, and the student's target in both
    modes: with the true label as truth, and with the blended one (as the
    reference does)."""
    p = _preds(spark, sf).withColumn("confidence", F.greatest(F.col("p1"), F.lit(1.0) - F.col("p1")))
    p = ML.teacher_targets(p, "target", _TEACHER_MIN)
    true = ML.distill_labels(p, "target", _STUDENT_MIN)
    both = ML.distill_labels(true.withColumnRenamed("student_label", "_true"), "blended_label", _STUDENT_MIN)
    return presentable(both.select(*KEYS, "confidence", "blended_label", F.col("_true").alias("student_label"),
                                   F.col("student_label").alias("student_label_reference")))


# ------------------------------------------------------------------ E2-E5
N_BOOT = 500  # the phase runner's replicate count


def _boot_sql(n_boot=N_BOOT, seed=42):
    low, high = hash_words_sql(f"concat_ws('|', {key_sql()}, '{seed}')")
    w = poisson1_sql("u")
    rows = (f"SELECT * FROM (SELECT target AS y, predicted_label AS yhat, {low} AS low, {high} AS high "
            f"FROM ({B.PREDICTIONS_SQL}) p) p2, range({n_boot}) t(r)")
    cm = (f"SELECT r AS replicate, y, yhat, sum(w) AS n FROM (SELECT r, y, yhat, CAST({w} AS DOUBLE) AS w FROM "
          f"({draws_sql(rows, 'low', 'high', 'r')}) x0) x WHERE w > 0 GROUP BY ALL")
    return f"""SELECT avg(weighted_f1) AS mean, stddev_pop(weighted_f1) AS std,
 quantile_cont(weighted_f1, 0.025) AS ci95_low, quantile_cont(weighted_f1, 0.975) AS ci95_high,
 count(*) AS replicates FROM ({metrics_sql(cm, ['replicate'])}) m"""


@register("bootstrap_ci", op_ids="E2", sql=oracle_wrap(_boot_sql(), ["mean", "std", "ci95_low", "ci95_high"]))
def q_boot(spark, sf):
    return presentable(E.bootstrap_ci(_preds(spark, sf), "target", "predicted_label", N_BOOT, key_cols=KEYS))


def _boot_cells_sql(n_boot=N_BOOT, seed=42):
    low, high = hash_words_sql(f"concat_ws('|', y, yhat, '{seed}')")
    cells = f"""SELECT *, CAST(ceil(12 * sqrt(n)) + 16 AS BIGINT) AS span FROM (
 SELECT target AS y, predicted_label AS yhat, count(*) AS n FROM ({B.PREDICTIONS_SQL}) p GROUP BY ALL) c"""
    ks = f"SELECT y, yhat, n, greatest(0, n - span) AS lo, unnest(range(greatest(0, n - span), n + span + 1)) AS k FROM ({cells}) c"
    logs = f"""SELECT *, sum(CASE WHEN k > lo THEN ln(n) - ln(k) ELSE 0 END) OVER (PARTITION BY y, yhat ORDER BY k) AS lw FROM ({ks}) s"""
    w = f"SELECT *, exp(lw - max(lw) OVER (PARTITION BY y, yhat)) AS w FROM ({logs}) s"
    cdf = f"""SELECT y, yhat, k, sum(w) OVER (PARTITION BY y, yhat ORDER BY k) / sum(w) OVER (PARTITION BY y, yhat) AS v FROM ({w}) s"""
    reps = f"SELECT y, yhat, greatest(0, n - span) AS lo, {low} AS low, {high} AS high, r FROM ({cells}) c, range({n_boot}) t(r)"
    u = draws_sql(reps, "low", "high", "r")
    cm = f"""SELECT u.r AS replicate, u.y, u.yhat, CAST(coalesce(d.k + 1, u.lo) AS DOUBLE) AS n
 FROM ({u}) u ASOF LEFT JOIN ({cdf}) d ON u.y = d.y AND u.yhat = d.yhat AND u.u >= d.v"""
    return f"""SELECT avg(weighted_f1) AS mean, stddev_pop(weighted_f1) AS std,
 quantile_cont(weighted_f1, 0.025) AS ci95_low, quantile_cont(weighted_f1, 0.975) AS ci95_high,
 count(*) AS replicates FROM ({metrics_sql(f"SELECT * FROM ({cm}) c WHERE n > 0", ['replicate'])}) m"""


@register("bootstrap_ci_cells", op_ids="E2", sql=oracle_wrap(_boot_cells_sql(), ["mean", "std", "ci95_low", "ci95_high"]))
def q_boot_cells(spark, sf):
    return presentable(E.bootstrap_ci(_preds(spark, sf), "target", "predicted_label", N_BOOT))


@register("bootstrap_ci_multinomial", op_ids="E2")
def q_boot_multinomial(spark, sf):
    # Same law as the reference's resampling; numpy draws, so no SQL oracle
    # (tests compare its interval with the hash-keyed form).
    return presentable(E.bootstrap_ci_multinomial(_preds(spark, sf), "target", "predicted_label", 1000))


def _corrupt_sql(kind: str, level: float) -> str:
    feats = B.MODEL_FEATURES
    parts = []
    low, high = hash_words_sql(f"concat_ws('|', {key_sql()}, '42')")
    source = f"SELECT *, {low} AS _low, {high} AS _high FROM ({B.MODEL_ROWS_SQL}) m"
    for i in range(2 * len(feats)):
        source = draws_sql(source, "_low", "_high", str(i), f"_u{i}")
    for i, c in enumerate(feats):
        u1, u2 = f"_u{2 * i}", f"_u{2 * i + 1}"
        if kind == "missingness":
            parts.append(f"CASE WHEN {u1} < {level!r} THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}")
        else:
            std = f"(SELECT CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM lineitem)"
            z = f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2 * pi() * {u2}))"
            parts.append(f"CAST({c} AS DOUBLE) + {z} * {std} * {level!r} AS {c}")
    return f"SELECT {', '.join(KEYS)}, target, {', '.join(parts)} FROM ({source}) m"


@register("corrupt_missing", op_ids="E3",
          sql=oracle_wrap(_corrupt_sql("missingness", 0.3), B.MODEL_FEATURES))
def q_corrupt_missing(spark, sf):
    m = B.model_rows(B.table(spark, sf, "lineitem"))
    return presentable(E.corrupt_missing(m, B.MODEL_FEATURES, 0.3, KEYS).select(*KEYS, "target", *B.MODEL_FEATURES))


@register("corrupt_noise", op_ids="E4",
          sql=oracle_wrap(_corrupt_sql("noise", 0.3), B.MODEL_FEATURES))
def q_corrupt_noise(spark, sf):
    m = B.model_rows(B.table(spark, sf, "lineitem"))
    return presentable(E.corrupt_noise(m, B.MODEL_FEATURES, 0.3, KEYS).select(*KEYS, "target", *B.MODEL_FEATURES))


def _curve_sql() -> str:
    parts = []
    for kind in ("missingness", "noise"):
        for lv in E.CURVE_LEVELS:
            cor = _corrupt_sql(kind, lv)
            logit = B.contract_logit_sql(B.LINEITEM_CONTRACT)
            parts.append(f"SELECT '{kind}' AS kind, {lv!r} AS level, target AS y, "
                         f"CAST(1.0 / (1.0 + exp(-({logit}))) >= 0.5 AS INTEGER) AS yhat FROM ({cor}) c")
    cm = f"SELECT kind, level, y, yhat, CAST(count(*) AS DOUBLE) AS n FROM ({' UNION ALL '.join(parts)}) u GROUP BY ALL"
    return f"SELECT kind, level, weighted_f1 FROM ({metrics_sql(cm, ['kind', 'level'])}) m"


@register("robustness_curve", op_ids="E5", sql=oracle_wrap(_curve_sql(), ["level", "weighted_f1"]))
def q_curve(spark, sf):
    m = B.model_rows(B.table(spark, sf, "lineitem"))
    c = R.LinearContract.from_mapping(B.LINEITEM_CONTRACT)
    return presentable(E.robustness_curve(m, B.MODEL_FEATURES, KEYS, lambda d: R.score_linear_contract(d, c), "target"))
