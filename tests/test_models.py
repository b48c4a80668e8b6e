"""Invariants of the fitted parts (no SQL oracle exists for fits)."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from nightjar.operators import models as ML
from nightjar.operators import prep as P
from nightjar.operators import robust as E
from nightjar.operators import scoring as R
from nightjar.operators import splits as S
from nightjar.plans import bindings as B

FEATS = B.MODEL_FEATURES


@pytest.fixture(scope="module")
def split(spark):
    sp = S.chronological_split(B.model_rows(B.table(spark, SF_SMALL, "lineitem")), B.MODEL_ORDER).persist()
    return sp.filter("split = 'train'"), sp.filter("split = 'test'")


def test_split_is_chronological(split):
    train, test = split
    assert train.agg(F.max("l_shipdate")).first()[0] <= test.agg(F.min("l_shipdate")).first()[0]


def test_folds_train_before_test(spark):
    folds = S.walk_forward_folds(B.model_rows(B.table(spark, SF_SMALL, "lineitem")), B.MODEL_ORDER, "target")
    k = folds.select(F.max("n_folds")).first()[0]
    assert k == 5
    for f in range(k):
        tr_max = folds.filter(F.col("test_fold") < f).agg(F.max("l_shipdate")).first()[0]
        te_min = folds.filter(F.col("test_fold") == f).agg(F.min("l_shipdate")).first()[0]
        assert tr_max <= te_min


def test_contract_parity_with_model(spark, split):
    train, test = split
    fitted = ML.fit_logistic(train, FEATS, "target", C=0.1)
    contract = ML.export_linear_contract(fitted)
    a = fitted.transform(test, B.MODEL_KEYS).select(*B.MODEL_KEYS, F.col("p1").alias("pm"))
    b = R.score_linear_contract(test, contract).select(*B.MODEL_KEYS, F.col("p1").alias("pc"))
    diff = a.join(b, B.MODEL_KEYS).agg(F.max(F.abs(F.col("pm") - F.col("pc")))).first()[0]
    assert diff < 1e-9


def test_forest_probabilities_in_unit_interval(spark, split):
    train, test = split
    fitted = ML.fit_forest(train, FEATS, "target", trees=16, depth=4)
    p = fitted.transform(test, ["target"]).agg(F.min("p1"), F.max("p1"), F.min("confidence")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0 and p[2] >= 0.5
    imp = ML.feature_importance(spark, fitted).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)


def test_pca_variance_ratios(spark):
    emb = P.flatten_nested_samples(B.table(spark, SF_SMALL, "embeddings"), "embedding", 64, ["vec_id"], "emb")
    enc = P.fit_window_encoder(emb, [f"emb_{i}" for i in range(64)], latent=8)
    ev = [r["explained_variance_ratio"] for r in enc.explained_variance(spark).orderBy("component").collect()]
    assert len(ev) == 8 and all(0 <= v <= 1 for v in ev) and ev == sorted(ev, reverse=True)
    z = P.apply_encoder(emb, enc, ["vec_id"])
    assert len(z.columns) == 9 and z.count() == emb.count()


def test_multinomial_bootstrap_agrees_with_hash_bootstrap(spark):
    preds = B.predictions(B.table(spark, SF_SMALL, "lineitem"))
    a = E.bootstrap_ci(preds, "target", "predicted_label", n_boot=300).first()
    b = E.bootstrap_ci_multinomial(preds, "target", "predicted_label", n_boot=300).first()
    assert b["replicates"] == 300
    assert abs(a["mean"] - b["mean"]) < 0.01
    assert abs(a["std"] - b["std"]) < 0.5 * max(a["std"], b["std"])


def test_pca_sign_convention(spark):
    emb = P.flatten_nested_samples(B.table(spark, SF_SMALL, "embeddings"), "embedding", 64, ["vec_id"], "emb")
    enc = P.fit_window_encoder(emb, [f"emb_{i}" for i in range(64)], latent=4)
    pc = enc.pca_model.pc.toArray()
    for j, s in enumerate(enc.signs()):
        col = pc[:, j] * s
        assert col[abs(col).argmax()] > 0


def test_fold_loop_grid_and_per_fold_missing_drop(spark):
    """M7/M8: one metric row per (space, model, fold); a column that is all
    missing in a fold's train part is dropped for that fold only; fold
    metrics equal a direct fit on the same train/test parts."""
    import random
    from nightjar.operators import metrics as M
    from nightjar.plans.q_models import cross_validate_folds
    rnd = random.Random(7)
    rows = []
    for t in range(240):
        x1 = rnd.gauss(0, 1)
        late = None if t < 60 else rnd.gauss(0, 1)   # head block is t < 40
        rows.append((t, x1, late, int(x1 + rnd.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "t int, x1 double, x_late double, label int")
    folds = S.walk_forward_folds(df, ["t"], "label").persist()
    assert folds.select(F.max("n_folds")).first()[0] == 5
    seen = []

    def fit(tr, cols, y, pre):
        seen.append(tuple(cols))
        return ML.fit_logistic(tr, cols, y, C=1.0, pre=pre)

    runs = cross_validate_folds(folds, "label", {"logreg": fit},
                                {"both": ["x1", "x_late"], "x1_only": ["x1"]}).persist()
    assert runs.count() == 10
    assert seen[:5] == [("x1",)] + [("x1", "x_late")] * 4
    assert seen[5:] == [("x1",)] * 5
    got = runs.filter("space = 'both' AND fold = 2").first()["accuracy"]
    train, test = folds.filter(F.col("test_fold") < 2), folds.filter(F.col("test_fold") == 2)
    direct = M.evaluate(ML.fit_logistic(train, ["x1", "x_late"], "label", C=1.0).transform(test, ["label"]),
                        "label", "predicted_label").first()["accuracy"]
    assert got == pytest.approx(direct, abs=1e-12)


def test_transfer_space_carries_encoder_components(spark):
    import datetime
    import random
    import warnings

    from nightjar.operators import features as X
    rnd = random.Random(2)
    rows = [("s", datetime.date(2024, 1, 1) + datetime.timedelta(days=i), rnd.random(), rnd.random() if i % 5 else None, 2.0) for i in range(40)]
    nights = spark.createDataFrame(rows, "subject_id string, night_date date, hr_mean double, hrv_mean double, rem_minutes double")
    enc = P.fit_window_encoder(nights, ["hr_mean", "hrv_mean"], latent=2)
    assert P.encoder_overlap(nights, enc) == (2, 2)
    plain, names = X.transfer_features(nights, ["subject_id", "night_date"])
    out, more = X.transfer_features(nights, ["subject_id", "night_date"], encoder=enc)
    assert more == [*names, "public_enc_00", "public_enc_01"] and out.columns == [*plain.columns, "public_enc_00", "public_enc_01"]
    direct = {r["night_date"]: r for r in P.apply_encoder(nights, enc, ["night_date"]).collect()}
    for r in out.collect():
        assert r["public_enc_00"] == pytest.approx(direct[r["night_date"]]["public_enc_00"])
    both, order = X.combined_features(nights, ["subject_id", "night_date"], encoder=enc)
    assert order[:3] == ["hr_mean", "hrv_mean", "rem_minutes"] and both.columns[2:] == order and both.count() == 40
    other = P.fit_window_encoder(nights.withColumnRenamed("hr_mean", "acc").withColumnRenamed("hrv_mean", "gyro"), ["acc", "gyro"], latent=1)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        X.transfer_features(nights, ["subject_id", "night_date"], encoder=other)
    assert P.encoder_overlap(nights, other) == (0, 2) and any("inputs" in str(w.message) for w in seen)
    with pytest.raises(ValueError, match="date column"):
        X.transfer_features(nights.drop("night_date"), ["subject_id"])


def test_profile_of_numbers_and_texts(spark):
    df = spark.createDataFrame([(1.0, "b", None), (2.0, "a", None), (4.0, "a", None), (None, "b", None), (9.0, None, None)],
                               "x double, t string, none string")
    got = {r["column"]: r for r in P.column_profile(df, ["x"], ["t", "none"]).collect()}
    x, t, none = got["x"], got["t"], got["none"]
    assert (x["count"], x["mean"], x["min"], x["p25"], x["p50"], x["p75"], x["max"]) == (4, 4.0, 1.0, 1.75, 3.0, 5.25, 9.0)
    assert (t["count"], t["unique"], t["top"], t["freq"]) == (4, 2, "a", 2)
    assert (none["count"], none["unique"], none["top"], none["freq"]) == (0, 0, None, None)


def test_without_valid_folds_there_are_no_metrics_and_no_crash(spark):
    from nightjar.plans import q_models as Q
    one_class = spark.createDataFrame([(i, float(i), 1) for i in range(30)], "id int, x double, y int")
    folds = S.walk_forward_folds(one_class, ["id"], "y", (5, 4, 3, 2))
    assert Q.cross_validate_folds(folds, "y", Q._LOGREG, {"one": ["x"]}).count() == 0
    oof = Q.out_of_fold(folds, ["x"], "y", ["id"]).collect()
    assert len(oof) == 30 and all(r["p1"] is None for r in oof)


def test_solver_limits_are_told(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), int(i % 3 == 0)) for i in range(60)], "a double, b double, y int")
    with pytest.raises(RuntimeError, match="convergence"):
        ML.fit_logistic(df, ["a", "b"], "y", max_iter=1)
    with pytest.raises(ValueError, match="depth"):
        ML.fit_forest(df, ["a", "b"], "y", depth=31)
    teacher = spark.createDataFrame([(0.4, 1, 0), (0.6, 1, 0), (1.7, 1, 0), (None, 1, 0)], "confidence double, predicted_label int, truth int")
    assert [r["blended_label"] for r in ML.teacher_targets(teacher, "truth").collect()] == [0, 1, 1, 0]
    assert [r["student_label"] for r in ML.distill_labels(teacher, "truth", 0.6).collect()] == [0, 1, 1, 0]
