"""Golden values published with the reference: metrics recomputed from the
nine confusion matrices of its mobile score table, the champion choice, and
the linear-contract scores of the demo and all-missing inputs."""
import math

import pytest
from pyspark.sql import functions as F

from nightjar.operators import metrics as M
from nightjar.operators import scoring as R
from nightjar.sources.contract_data import NIGHT_CONTRACT

# Published rows (model, eligible, size_kb, p95_ms, cm [[tn, fp], [fn, tp]],
# accuracy, weighted F1, macro F1, kappa, mobile score).
PUBLISHED = [
    ("rf_small_n96_d8", True, 325.3232421875, 15.142781100000224, [[24, 29], [23, 32]],
     0.5185185185185185, 0.5165261813537675, 0.5158620689655172, 0.03471983499484366, 0.589072697714013),
    ("rf_small_n64_d6", True, 179.3857421875, 15.415064099999753, [[20, 33], [21, 34]],
     0.5, 0.49267527031740493, 0.4914544820369724, -0.004478126076472799, 0.5693537115243832),
    ("logreg_c0_1", True, 4.994140625, 0.9530878000001186, [[26, 27], [29, 26]],
     0.48148148148148145, 0.48148148148148145, 0.48148148148148145, -0.03668152211175868, 0.5592859228786551),
    ("logreg_c0_5", True, 4.994140625, 0.951918599999968, [[27, 26], [33, 22]],
     0.4537037037037037, 0.4520609190683939, 0.45253028610705387, -0.09034907597535935, 0.5347368677055229),
    ("logreg_c2_0", True, 4.994140625, 0.9573956499997927, [[30, 23], [36, 19]],
     0.4537037037037037, 0.4469359335945145, 0.44797712899592823, -0.08811475409836045, 0.5314027262689952),
    ("logreg_c1_0", True, 4.994140625, 0.9753524500000443, [[28, 25], [36, 19]],
     0.4351851851851852, 0.4303577081354859, 0.43123543123543123, -0.12576896787423086, 0.5169493815692646),
    ("sgd_log_alpha0_001", True, 5.220703125, 0.9769248499998273, [[23, 30], [32, 23]],
     0.42592592592592593, 0.42592592592592593, 0.42592592592592593, -0.14775454233801844, 0.5120665574727967),
    ("sgd_log_alpha0_0005", True, 5.220703125, 0.9486524500000204, [[22, 31], [31, 24]],
     0.42592592592592593, 0.42592592592592593, 0.42572898799313896, -0.14854202401372207, 0.511977955657201),
    ("sgd_log_alpha0_0001", True, 5.220703125, 0.9629912999996826, [[31, 22], [40, 15]],
     0.42592592592592593, 0.41143317230273757, 0.41304347826086957, -0.14149335151721787, 0.5026327651418447),
]


def _cm_rows():
    rows = []
    for name, *_rest in PUBLISHED:
        cm = _rest[3]
        for y in (0, 1):
            for yhat in (0, 1):
                rows.append((name, y, yhat, float(cm[y][yhat])))
    return rows


def test_metrics_from_published_confusion(spark):
    cm = spark.createDataFrame(_cm_rows(), "model_name string, y int, yhat int, n double")
    got = {r["model_name"]: r for r in M.classification_metrics(cm, ["model_name"]).collect()}
    for name, _el, _size, _p95, _cm, acc, wf1, mf1, kappa, _ms in PUBLISHED:
        r = got[name]
        assert r["accuracy"] == pytest.approx(acc, abs=1e-9)
        assert r["weighted_f1"] == pytest.approx(wf1, abs=1e-9)
        assert r["macro_f1"] == pytest.approx(mf1, abs=1e-9)
        assert r["kappa"] == pytest.approx(kappa, abs=1e-9)


def _runs(spark):
    cm = spark.createDataFrame(_cm_rows(), "model_name string, y int, yhat int, n double")
    met = M.classification_metrics(cm, ["model_name"]).drop("n_rows")
    meta = spark.createDataFrame([(p[0], p[2], p[3]) for p in PUBLISHED],
                                 "model_name string, size_kb double, single_pred_p95_ms double")
    return M.score_runs(meta.join(met, "model_name"))


def test_mobile_score_and_champion(spark):
    runs = {r["model_name"]: r for r in _runs(spark).collect()}
    for name, el, *_x, ms in PUBLISHED:
        assert runs[name]["eligible_mobile"] is el
        assert runs[name]["efficiency_score"] == pytest.approx(1.0)
        assert runs[name]["mobile_score"] == pytest.approx(ms, abs=1e-9)
    champ = M.select_champion(_runs(spark)).collect()
    assert [r["model_name"] for r in champ] == ["rf_small_n96_d8"]
    best_lin = M.best_linear(_runs(spark)).collect()
    assert [r["model_name"] for r in best_lin] == ["logreg_c0_1"]


# The demo night of the device app (30 features).
DEMO = {
    "total_sleep_minutes": 415.0, "asleep_minutes": 415.0, "in_bed_minutes": 450.0,
    "sleep_efficiency": 415.0 / 450.0, "rem_minutes": 92.0, "deep_minutes": 74.0, "core_minutes": 249.0,
    "rem_pct": 92.0 / 415.0, "deep_pct": 74.0 / 415.0, "core_pct": 249.0 / 415.0,
    "hr_mean": 64.0, "hr_min": 52.0, "hr_max": 78.0, "hr_median": 63.0, "hr_std": 4.1,
    "hrv_mean": 58.0, "hrv_min": 42.0, "hrv_max": 88.0, "hrv_median": 55.0, "hrv_std": 10.5,
    "resp_mean": 15.2, "resp_min": 13.4, "resp_max": 18.1, "resp_median": 15.1, "resp_std": 0.9,
    "spo2_mean": 0.982, "spo2_min": 0.967, "spo2_max": 0.992, "spo2_median": 0.982, "spo2_std": 0.004,
}


def test_contract_golden_scores(spark):
    c = R.LinearContract.from_mapping(NIGHT_CONTRACT)
    cols = c.feature_order
    demo = tuple(float(DEMO[f]) for f in cols)
    missing = tuple(None for _ in cols)
    df = spark.createDataFrame([("demo",) + demo, ("missing",) + missing],
                               "case string, " + ", ".join(f"{f} double" for f in cols))
    got = {r["case"]: r for r in R.score_linear_contract(df, c).collect()}
    assert got["demo"]["logit"] == pytest.approx(-0.760309758, abs=1e-8)
    assert got["demo"]["p1"] == pytest.approx(0.318579018, abs=1e-8)
    assert got["demo"]["predicted_label"] == 0
    assert got["missing"]["logit"] == pytest.approx(-0.087083343, abs=1e-8)
    assert got["missing"]["p1"] == pytest.approx(0.478242912, abs=1e-8)


def test_contract_json_roundtrip_and_long_form(spark):
    c = R.LinearContract.from_mapping(NIGHT_CONTRACT)
    c2 = R.LinearContract.from_json(c.to_json())
    assert c2.coef == c.coef and c2.feature_order == c.feature_order
    rows = [("n1", f, float(DEMO[f])) for f in c.feature_order[:20]]  # 10 features absent -> medians
    long = spark.createDataFrame(rows, "row string, feature string, value double")
    out = R.score_contracts_long(long, c.to_rows(spark, "pub"),
                                 spark.createDataFrame([("pub", c.intercept)], "contract_id string, intercept double"),
                                 ["row"]).first()
    wide = spark.createDataFrame([tuple(float(DEMO[f]) for f in c.feature_order[:20])],
                                 ", ".join(f"{f} double" for f in c.feature_order[:20]))
    ref = R.score_linear_contract(wide, c).first()
    assert out["logit"] == pytest.approx(ref["logit"], abs=1e-12)
    assert math.isfinite(out["p1"])
