"""Registered queries for preprocessing, fitting, distillation, encoder and
batch scoring (A10-A12, A18, F5-F7, K5, M2-M10, P19, R2-R4, R8, S7).

Linear fits and components have SQL oracles (``fits_sql``); forests, boosted
trees and what is made from them have none, their invariants are in
``tests/test_models.py``, ``tests/test_grid.py`` and ``tests/test_boosting.py``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import grid as G
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import nights as N
from ..operators import prep as P
from ..operators import scoring as R
from ..operators import sensors as Z
from ..operators import splits as S
from ..operators.parallel import side_by_side
from ..operators.store import batch_predict, choose_model, save_model
from ..session import checkpoint_dir, cut_lineage, delete_folder
from ..sources.contract_data import NIGHT_CONTRACT
from . import bindings as B
from . import fits_sql as Q
from .q_features import labelled_nights
from .q_labels import _SPLIT_SQL, _folds_sql
from .q_sensors import _union as sensor_windows
from .q_nights import _night_features_sql, _samples, _segments
from .q_scoring import METRIC_COLS, metrics_sql
from .registry import oracle_wrap, presentable, register

FEATS = B.MODEL_FEATURES
KEYS = B.MODEL_KEYS


def _split(spark, sf):
    return S.chronological_split(B.model_rows(B.table(spark, sf, "lineitem")), B.MODEL_ORDER)


def _train_test(spark, sf):
    sp = _split(spark, sf)
    return sp.filter("split = 'train'"), sp.filter("split = 'test'")


@register("column_medians", op_ids="A11",
          sql=oracle_wrap("SELECT " + ", ".join(f"median({c}) AS {c}" for c in FEATS) + " FROM lineitem", FEATS))
def q_medians(spark, sf):
    return presentable(P.column_medians(B.table(spark, sf, "lineitem"), FEATS))


@register("column_mean_scale", op_ids="A12",
          sql=oracle_wrap(" UNION ALL ".join(
              f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale FROM lineitem"
              for c in FEATS), ["mean", "scale"]))
def q_mean_scale(spark, sf):
    return presentable(P.column_mean_scale(B.table(spark, sf, "lineitem"), FEATS))


def _m2_sql():
    split = f"""SELECT *, CASE WHEN pos < floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM ({B.MODEL_POS_SQL}) p"""
    stats = ", ".join(f"median({c}) AS {c}_med, avg({c}) AS {c}_mean, "
                      f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_scale" for c in FEATS)
    cols = ", ".join(f"(coalesce({c}, {c}_med) - {c}_mean) / {c}_scale AS {c}" for c in FEATS)
    return f"""WITH s AS ({split}), st AS (SELECT {stats} FROM s WHERE split = 'train')
SELECT {', '.join(KEYS)}, {cols} FROM s, st"""


@register("impute_and_scale", op_ids="M2", sql=oracle_wrap(_m2_sql(), FEATS))
def q_m2(spark, sf):
    sp = _split(spark, sf)
    pre = P.fit_preprocess(sp.filter("split = 'train'"), FEATS)
    return presentable(P.impute_and_scale(sp, pre, KEYS))


_PROFILE_TEXT = ["l_returnflag", "l_linestatus"]
_PROFILE_SQL = " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
 quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max,
 NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM lineitem""" for c in FEATS]
    + [f"""SELECT '{c}', sum(n)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*),
 (list(v ORDER BY n DESC, v))[1], max(n) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) t"""
       for c in _PROFILE_TEXT])


@register("column_profile", op_ids="A10", sql=oracle_wrap(_PROFILE_SQL, ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_profile(spark, sf):
    return presentable(P.column_profile(B.table(spark, sf, "lineitem"), FEATS, _PROFILE_TEXT))


def _test_predictions(fitted, test):
    return presentable(fitted.transform(test, [*KEYS, "target"]))


def _fit_candidates(spark, sf, fits, shared=None):
    """Test predictions of every candidate, one row per model and test row.
    The split is written once, one preprocessing serves all candidates (and
    what ``shared`` makes from both), and their fits run side by side."""
    split = cut_lineage(_split(spark, sf))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    pre = P.fit_preprocess(train, FEATS)
    given = [shared(train, pre)] if shared else []
    out = None
    for fitted in side_by_side(spark, [lambda fit=fit: fit(train, pre, *given) for fit in fits]):
        p = fitted.transform(test, [*KEYS, "target"]).withColumn("model_name", F.lit(fitted.name))
        out = p if out is None else out.unionByName(p)
    return presentable(out)


# The candidates of the mobile model step, and the trees of the
# baseline forest.
LOGREG_C, SGD_ALPHA, SMALL_FORESTS = [0.1, 0.5, 1.0, 2.0], [1e-4, 5e-4, 1e-3], [(64, 6), (96, 8)]
BASELINE_TREES = 300
#: Trees of a part of a forest, with a seed of its own.
PART_TREES = 50


def _baseline_forest(train, pre=None, cells=None):
    """The baseline's trees have no depth limit."""
    return ML.fit_forest(train, FEATS, "target", trees=BASELINE_TREES, depth=None, min_leaf=1, pre=pre, part_trees=PART_TREES, cells=cells)


def _linear_fits_sql(fits: list[tuple[str, str]]) -> str:
    """Test predictions of logistic fits (name, regularisation) on the split's train part."""
    ctes = Q.logistic_ctes(_SPLIT_SQL, FEATS, "target", [(name, "split = 'train'", reg) for name, reg in fits])
    p1 = Q.logistic_p1(FEATS)
    return oracle_wrap(f"""WITH RECURSIVE {ctes}, scored AS (SELECT {', '.join(KEYS)}, target, {p1} AS p1, fit AS model_name
 FROM lr_rows, model WHERE split = 'test')
SELECT {', '.join(KEYS)}, target, p1, CAST(p1 > 0.5 AS INTEGER) AS predicted_label, greatest(p1, 1 - p1) AS confidence, model_name
FROM scored""", ["p1", "confidence"])


# Fits are unique minima, worked out to the last digits on both sides.
@register("fit_logistic", op_ids="M3 M1", sql=_linear_fits_sql([(f"logreg_c{c}", f"1.0 / ({c!r} * lr_n)") for c in LOGREG_C]))
def q_fit_lr(spark, sf):
    return _fit_candidates(spark, sf, [lambda tr, pre, c=c: ML.fit_logistic(tr, FEATS, "target", C=c, pre=pre) for c in LOGREG_C])


@register("fit_sgd_logistic", op_ids="M4", sql=_linear_fits_sql([(f"sgd_a{a}", repr(a)) for a in SGD_ALPHA]))
def q_fit_sgd(spark, sf):
    return _fit_candidates(spark, sf, [lambda tr, pre, a=a: ML.fit_sgd_logistic(tr, FEATS, "target", alpha=a, pre=pre)
                                       for a in SGD_ALPHA])


@register("fit_forest", op_ids="M5")
def q_fit_rf(spark, sf):
    small = [lambda tr, pre, cells, n=n, d=d: ML.fit_forest(tr, FEATS, "target", trees=n, depth=d, pre=pre, cells=cells)
             for n, d in SMALL_FORESTS]
    return _fit_candidates(spark, sf, small + [_baseline_forest], lambda tr, pre: ML.forest_cells(tr, pre, "target"))


@register("feature_importance_rank", op_ids="K5")
def q_importance(spark, sf):
    train = cut_lineage(_split(spark, sf)).filter("split = 'train'")
    return ML.feature_importance(spark, _baseline_forest(train))


@register("fit_boosted_trees", op_ids="M6")
def q_fit_gbt(spark, sf):
    return _fit_candidates(spark, sf, [lambda tr, pre: ML.fit_boosted_trees(tr, FEATS, "target")])


def _folds(spark, sf, candidates=(5, 4, 3)):
    return S.walk_forward_folds(B.model_rows(B.table(spark, sf, "lineitem")), B.MODEL_ORDER, "target", candidates)


def cross_validate_folds(folds, label: str, fits: dict, spaces: dict[str, list[str]]):
    """M8 over an already cut fold table: for every space, model and fold,
    drop the train part's all-missing columns (P15), fit on ``test_fold < f``,
    score ``test_fold == f``; one metric row per (space, model, fold). The
    models of one fold share its fitted preprocessing. The loop runs on the
    driver over Spark fits and only metric rows come back."""
    k = folds.select(F.max("n_folds")).first()[0] or 0
    out = None
    for space, cols in spaces.items():
        for f in range(k):
            train = folds.filter(F.col("test_fold") < f)
            test = folds.filter(F.col("test_fold") == f)
            usable = X.non_null_columns(train, cols)
            pre = P.fit_preprocess(train, usable)     # shared by the models of this fold
            for model_name, fit in fits.items():
                fitted = fit(train, usable, label, pre)
                pred = fitted.transform(test, [label])
                m = M.evaluate(pred, label, "predicted_label").drop("n_rows").select(
                    F.lit(space).alias("space"), F.lit(model_name).alias("model_name"), F.lit(f).alias("fold"), "*")
                out = m if out is None else out.unionByName(m)
    if out is None:  # no valid set of folds: no metrics
        names = ", ".join(f"{m} double" for m in M.METRIC_NAMES)
        return folds.sparkSession.createDataFrame([], f"space string, model_name string, fold int, {names}")
    return out


_LOGREG = {"logreg_c1.0": lambda tr, cols, y, pre: ML.fit_logistic(tr, cols, y, C=1.0, pre=pre)}


def cross_validate(spark, sf, fits: dict, spaces: dict[str, list[str]]):
    """M8 (and M7 over several spaces) on the model rows. The fold table is
    cut once and written to the shared checkpoint folder (the k fits reread
    it; a lost executor re-reads instead of recomputing the cut)."""
    return cross_validate_folds(cut_lineage(_folds(spark, sf)), "target", fits, spaces)


def _fold_fits_sql(candidates: tuple[int, ...]) -> str:
    """Common table expressions of one logistic fit (C = 1) for each fold, and
    ``scored``: every row of a test block under its fold's fit."""
    rows = _folds_sql(candidates, [*KEYS, *FEATS, "target"])
    fits = [(str(f), f"test_fold < {f} AND {f} < n_folds", "1.0 / lr_n") for f in range(max(candidates))]
    return f"""{Q.logistic_ctes(rows, FEATS, "target", fits)},
scored AS (SELECT r.*, {Q.logistic_p1(FEATS)} AS p1 FROM lr_rows r JOIN model ON CAST(test_fold AS VARCHAR) = fit)"""


_CV_CM_SQL = "SELECT test_fold AS fold, target AS y, CAST(p1 > 0.5 AS INTEGER) AS yhat, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY ALL"


@register("cross_validate", op_ids="M8 W7",
          sql=oracle_wrap(f"""WITH RECURSIVE {_fold_fits_sql((5, 4, 3))}
SELECT 'baseline' AS space, 'logreg_c1.0' AS model_name, * FROM ({metrics_sql(_CV_CM_SQL, ['fold'])}) m""", METRIC_COLS))
def q_cv(spark, sf):
    return presentable(cross_validate(spark, sf, _LOGREG, {"baseline": FEATS}))


# The models of the ablation.
GRID_FITS = {
    "logreg": lambda tr, cols, y, pre: ML.fit_logistic(tr, cols, y, C=0.1, pre=pre, max_iter=3000),
    "rf_small": lambda tr, cols, y, pre: ML.fit_forest(tr, cols, y, trees=96, depth=8, pre=pre),
    "hist_gb": G.BoostedSettings(),
}


def grid_inputs(spark, sf):
    """Labelled nights in time order with the columns of all three spaces, cut
    into folds, and the spaces' columns."""
    keep = ["subject_id", "night_date", "label_date", "label"]
    nights = labelled_nights(spark, sf)
    combined, columns = X.combined_features(nights, keep)
    baseline = X.baseline_features(nights, keep)[1]
    spaces = {"baseline": baseline, "transfer": [c for c in columns if c not in set(baseline)], "combined": columns}
    return cut_lineage(S.walk_forward_folds(combined, ["night_date", "subject_id"], "label")), spaces


@register("ablation_grid", op_ids="M7 A15")
def q_ablation(spark, sf):
    """The whole grid over the labelled nights, fitted anew by every call."""
    return full_grid(spark, sf, table=f"grid-{uuid.uuid4().hex}")


def full_grid(spark, sf, fits=None, table=None):
    """The ablation with all three models, or those given. Runs of the same
    rows and settings in the same ``table`` are not fitted again."""
    fits = fits or GRID_FITS
    folds, spaces = grid_inputs(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table or 'grid-' + G.grid_id(folds, spaces, sorted(fits))}"
    runs, _ = G.run_grid(folds, "label", spaces, fits, G.RunTable(spark, path))
    return presentable(G.rank_grid(runs))


@register("out_of_fold_probabilities", op_ids="R4",
          sql=oracle_wrap(f"""WITH RECURSIVE {_fold_fits_sql((5, 4, 3, 2))}
SELECT {', '.join(KEYS)}, target, test_fold, p1, CAST(p1 > 0.5 AS INTEGER) AS predicted_label, greatest(p1, 1 - p1) AS confidence
FROM lr_rows LEFT JOIN scored USING ({', '.join(KEYS)}, target, test_fold)""", ["p1", "confidence"]))
def q_oof(spark, sf):
    return presentable(out_of_fold(cut_lineage(_folds(spark, sf, (5, 4, 3, 2))), FEATS, "target", KEYS))


def out_of_fold(folds, cols, label, keys):
    """Probabilities of rows in test blocks by a model of all rows before
    the block; null for the head block, and for all rows without valid folds."""
    k = folds.select(F.max("n_folds")).first()[0] or 0
    head = folds.filter(F.coalesce(F.col("test_fold") < 0, F.lit(True)))
    out = head.select(*keys, label, "test_fold", F.lit(None).cast("double").alias("p1"),
                      F.lit(None).cast("int").alias("predicted_label"), F.lit(None).cast("double").alias("confidence"))
    for f in range(k):
        fitted = ML.fit_logistic(folds.filter(F.col("test_fold") < f), cols, label, C=1.0)
        out = out.unionByName(fitted.transform(folds.filter(F.col("test_fold") == f), [*keys, label, "test_fold"]))
    return out



@register("distill_labels", op_ids="M10 M9")
def q_distill(spark, sf):
    split = cut_lineage(_split(spark, sf))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    teacher = ML.fit_forest(train, FEATS, "target", trees=64, depth=6)
    tp = ML.teacher_targets(teacher.transform(train, [*KEYS, *FEATS, "target"]), "target")
    # The teacher's scores feed several passes of the student's fit: written
    # once to the shared checkpoint folder.
    tp = cut_lineage(ML.distill_labels(tp, "target"))
    # One preprocessing: the student's rows are the teacher's.
    student = ML.fit_student(tp, FEATS, "target", C=2.0, name="logreg_distilled_c2_0", pre=teacher.pre)
    return _test_predictions(student, test)


_EXPORTED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}_med AS median, {c}_mean AS mean, {c}_scale AS scale, b{i} AS coef FROM model"
    for i, c in enumerate(FEATS, 1))


@register("export_linear_contract", op_ids="R8 R1",
          sql=oracle_wrap(f"""WITH RECURSIVE {Q.logistic_ctes(_SPLIT_SQL, FEATS, "target", [("logreg_c0_1", "split = 'train'", "1.0 / (0.1 * lr_n)")])}
SELECT 'logreg_c0_1' AS contract_id, *, 0.0 AS max_abs_diff FROM ({_EXPORTED}) e""",
                          ["median", "mean", "scale", "coef", "max_abs_diff"]))
def q_export(spark, sf):
    train, test = _train_test(spark, sf)
    fitted = ML.fit_logistic(train, FEATS, "target", C=0.1)
    contract = ML.export_linear_contract(fitted, threshold=0.5)
    by_model = fitted.transform(test, KEYS).select(*KEYS, F.col("p1").alias("p_model"))
    by_contract = R.score_linear_contract(test, contract).select(*KEYS, F.col("p1").alias("p_contract"))
    parity = by_model.join(by_contract, KEYS).agg(F.max(F.abs(F.col("p_model") - F.col("p_contract")))
                                                  .alias("max_abs_diff"))
    rows = contract.to_rows(spark, "logreg_c0_1")
    # Parity of the exported contract with the model: one scalar per feature row.
    return presentable(rows.withColumn("max_abs_diff", parity.scalar()))


# ------------------------------------------------------------------ encoder (embeddings)
EMB_COLS = [f"emb_{i}" for i in range(64)]


def _flat(spark, sf):
    emb = B.table(spark, sf, "embeddings")
    return P.flatten_nested_samples(emb, "embedding", 64, ["vec_id", "label"], prefix="emb")



@register("flatten_nested_samples", op_ids="S7",
          sql=oracle_wrap("SELECT vec_id, label, " + ", ".join(
              f"CAST(embedding[{i + 1}] AS DOUBLE) AS emb_{i}" for i in range(64)) + " FROM embeddings", EMB_COLS))
def q_flatten(spark, sf):
    return presentable(_flat(spark, sf))


@register("flatten_parallel_arrays", op_ids="S7",
          sql="""SELECT user_id, day, CAST(epoch_us(ts) / 1e6 AS DOUBLE) AS time_s, value, event_id
 FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) e""")
def q_parallel(spark, sf):
    """Payloads of parallel 1-D arrays, one for each user and day, to rows; the
    array of another length is dropped."""
    e = B.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    by_time = F.sort_array(F.collect_list(F.struct(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "event_id", "value")))
    p = e.groupBy("user_id", "day").agg(by_time.alias("s")).select(
        "user_id", "day", F.col("s.t").alias("time"), F.col("s.value").alias("value"), F.col("s.event_id").alias("event_id"),
        F.array(F.lit("header")).alias("names"))
    rows = P.parallel_arrays_to_rows(p, ["value", "event_id", "time"], ["user_id", "day"])
    return rows.select("user_id", "day", "time_s", "value", "event_id")


@register("flatten_struct", op_ids="S7",
          sql="""SELECT event_id AS id, user_id AS sample_user, event_type AS sample_reading_kind, value AS sample_reading_x,
 TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS sample_reading_more_k FROM events""")
def q_struct(spark, sf):
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    reading = F.struct(F.col("event_type").alias("kind"), F.col("value").alias("x"), F.struct(k.alias("k")).alias("more"))
    return P.flatten_struct(e.select(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("user"),
                                                                           reading.alias("reading")).alias("sample")))


_FLAT_SQL = "SELECT vec_id AS id, " + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(64)) + " FROM embeddings"


@register("explained_variance", op_ids="F5 A18",
          sql=oracle_wrap(f"""WITH RECURSIVE {Q.components_ctes(_FLAT_SQL, EMB_COLS, 8)}
SELECT component, share AS explained_variance_ratio, sum(share) OVER (ORDER BY component) AS cumulative FROM pc_share""",
                          ["explained_variance_ratio", "cumulative"]))
def q_explained(spark, sf):
    enc = P.fit_window_encoder(_flat(spark, sf), EMB_COLS, latent=8)
    return presentable(enc.explained_variance(spark))


_LATENT = P.latent_names(8)


@register("apply_encoder", op_ids="F6 F7",
          sql=oracle_wrap(f"""WITH RECURSIVE {Q.components_ctes(_FLAT_SQL, EMB_COLS, 8)}, z AS (
 SELECT id, component, sum(x * v) AS z FROM pc_scaled JOIN pc_load USING (c) GROUP BY ALL)
SELECT e.vec_id, e.label, {', '.join(f"max(CASE WHEN component = {j} THEN z END) AS {n}" for j, n in enumerate(_LATENT, 1))}
FROM embeddings e JOIN z ON z.id = e.vec_id GROUP BY ALL""", _LATENT))
def q_encode(spark, sf):
    flat = _flat(spark, sf)
    enc = P.fit_window_encoder(flat, EMB_COLS, latent=8)
    return presentable(P.apply_encoder(flat, enc, ["vec_id", "label"], P.latent_names))


def window_encoder(spark, sf):
    """F5 on the union of the sensor window tables (written once)."""
    windows = cut_lineage(sensor_windows(spark, sf))
    cols = [c for c in Z.numeric_channels(windows) if not c.startswith(("window_", "target_"))]
    return windows, P.fit_window_encoder(windows, X.non_null_columns(windows, cols), latent=8)


@register("latent_table", op_ids="F5 F7")
def q_latent(spark, sf):
    windows, enc = window_encoder(spark, sf)
    return presentable(P.apply_encoder(windows, enc, [*Z.GROUP, Z.WINDOW], P.latent_names))


@register("transfer_features_encoded", op_ids="F3 F6")
def q_transfer_encoded(spark, sf):
    """F3 with the encoder's components; the overlap of the night table with
    the encoder's inputs stands beside them."""
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    enc = window_encoder(spark, sf)[1]
    shared, total = P.encoder_overlap(nights, enc)
    out, _ = X.transfer_features(nights, ["subject_id", "night_date"], encoder=enc)
    return presentable(out.withColumns({"encoder_inputs_shared": F.lit(shared), "encoder_inputs": F.lit(total)}))


@register("combined_features_encoded", op_ids="F4 F6")
def q_combined_encoded(spark, sf):
    """F4 with the encoder's components behind baseline and transfer."""
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    out, _ = X.combined_features(nights, ["subject_id", "night_date"], encoder=window_encoder(spark, sf)[1])
    return presentable(out)


# ------------------------------------------------------------------ R2 / R3 / P16 / P19
@register("predict_with_saved_model", op_ids="R2 P16")
def q_saved(spark, sf):
    """Models written to the store and read back; the first that exists and
    knows a column of the table scores every test row. The table lacks one of
    the model's features."""
    split = cut_lineage(_split(spark, sf))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'").drop("l_tax")
    store = f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    other = train.select("target", *[F.col(c).alias(f"other_{c}") for c in FEATS])
    save_model(spark, ML.fit_logistic(other, [f"other_{c}" for c in FEATS], "target"), f"{store}/other")
    save_model(spark, ML.fit_forest(train, FEATS, "target"), f"{store}/forest")
    model = choose_model(spark, [f"{store}/absent", f"{store}/other", f"{store}/forest"], test)
    out = cut_lineage(batch_predict(test, model, KEYS).withColumn("model_name", F.lit(model.name)))
    delete_folder(spark, store)
    probabilities = F.map_from_entries(F.transform(F.map_entries("probabilities"),
                                                   lambda e: F.struct(e["key"], F.round(e["value"], 6))))
    return presentable(out.withColumn("probabilities", probabilities.cast("string")))


def _night_scores(spark, sf):
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    c = R.LinearContract.from_mapping(NIGHT_CONTRACT)
    s = R.score_linear_contract(nights, c)
    return s.withColumn("confidence", F.greatest(F.col("p1"), F.lit(1.0) - F.col("p1")))


_R2_SQL = f"""SELECT subject_id, night_date, predicted_label, greatest(p1, 1 - p1) AS confidence FROM (
 SELECT *, 1.0 / (1.0 + exp(-logit)) AS p1, CAST(1.0 / (1.0 + exp(-logit)) >= 0.5 AS INTEGER) AS predicted_label
 FROM (SELECT *, {B.contract_logit_sql(NIGHT_CONTRACT)} AS logit FROM ({_night_features_sql(False)}) n) a) b"""


@register("batch_predict", op_ids="R2", sql=oracle_wrap(_R2_SQL, ["confidence"]))
def q_batch(spark, sf):
    return presentable(_night_scores(spark, sf).select("subject_id", "night_date", "predicted_label", "confidence"))


@register("predictions_over_time", op_ids="R3",
          sql=oracle_wrap(f"SELECT * FROM ({_R2_SQL}) r ORDER BY subject_id, night_date", ["confidence"]))
def q_over_time(spark, sf):
    s = _night_scores(spark, sf).select("subject_id", "night_date", "predicted_label", "confidence")
    return presentable(s.orderBy("subject_id", "night_date"))


# Fixed value: the date a person asks about in the single-date view.
QUERY_DATE = "2024-01-15"


@register("filter_by_date", op_ids="P19",
          sql=oracle_wrap(f"SELECT * FROM ({_R2_SQL}) r WHERE night_date = DATE '{QUERY_DATE}'", ["confidence"]))
def q_by_date(spark, sf):
    s = L.filter_by_date(_night_scores(spark, sf), QUERY_DATE)
    return presentable(s.select("subject_id", "night_date", "predicted_label", "confidence"))
