"""Semantics that differ between pandas/scikit-learn and Spark."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightjar.functions import calendar_columns, safe_divide, to_numeric_or_null
from nightjar.operators import features as X
from nightjar.operators import nights as N
from nightjar.operators import prep as P
from nightjar.operators import scoring as R
from nightjar.operators import sensors as Z


def test_exact_median_and_population_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert P.column_medians(df, ["x"]).first()["x"] == 3.0          # not 2.0 (Imputer)
    sc = P.column_mean_scale(df, ["x"]).first()
    assert sc["mean"] == 4.0 and sc["scale"] == pytest.approx(3.082207001, abs=1e-8)  # population
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert P.column_mean_scale(const, ["x"]).first()["scale"] == 1.0


def test_nan_and_inf_become_missing(spark):
    df = spark.createDataFrame([("1",), ("NaN",), ("2",), ("inf",), ("abc",)], "v string")
    vals = [r["x"] for r in df.select(to_numeric_or_null("v").alias("x")).collect()]
    assert vals == [1.0, None, 2.0, None, None]
    agg = df.select(to_numeric_or_null("v").alias("x")).agg(F.avg("x"), F.count("x")).first()
    assert agg[0] == 1.5 and agg[1] == 2


def test_safe_divide_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [None, None, 1.5]


def test_weekday_monday_zero_and_month_cycle(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 6),), (None,)], "d date")
    rows = df.select(*calendar_columns("d")).collect()
    assert rows[0]["day_of_week"] == 0.0 and rows[0]["is_weekend"] == 0.0
    assert rows[1]["day_of_week"] == 5.0 and rows[1]["is_weekend"] == 1.0
    assert rows[2]["day_of_week"] is None and rows[2]["is_weekend"] == 0.0
    assert rows[2]["month_sin"] == pytest.approx(0.5)  # missing month counts as January


def _night(spark, start, end):
    return spark.createDataFrame([(1, dt.date(2024, 1, 1), start, end)],
                                 "subject_id long, night_date date, sleep_start timestamp, sleep_end timestamp")


def test_range_join_inclusive_and_strict(spark):
    s, e = dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 2, 7, 0)
    samples = spark.createDataFrame([
        (1, "hr", s, s + dt.timedelta(minutes=1), 50.0),             # at start: in
        (1, "hr", e, e + dt.timedelta(minutes=1), 70.0),             # at end: in (inclusive), out (strict: ends after)
        (1, "hr", s - dt.timedelta(seconds=1), s, 99.0),             # before: out
        (2, "hr", s, s, 10.0),                                       # other subject
    ], "subject_id long, metric string, ts timestamp, end_ts timestamp, value double")
    inc = N.night_metric_range_join(_night(spark, s, e), samples, ["hr"], bucket_seconds=3600).first()
    assert inc["hr_min"] == 50.0 and inc["hr_max"] == 70.0 and inc["hr_std"] == 10.0  # population std
    strict = N.night_metric_range_join(_night(spark, s, e), samples, ["hr"], strict=True).first()
    assert strict["hr_max"] == 50.0
    none = N.night_metric_range_join(_night(spark, s, s), samples.filter("value > 1000"), ["hr"]).first()
    assert none["hr_mean"] is None


def test_rolling_excludes_current_row(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, d), None if v is None else float(v)) for d, v in [(1, 1), (2, 2), (3, 4), (4, None), (5, 8)]],
                               "subject_id long, label_date date, total_sleep_minutes double")
    cols = X.rolling_columns(["total_sleep_minutes"], "label_date")
    out = df.select("label_date", *cols).orderBy("label_date").collect()
    assert out[0]["total_sleep_minutes_past3_mean"] is None
    assert out[1]["total_sleep_minutes_past3_mean"] == 1.0
    assert out[3]["total_sleep_minutes_past3_mean"] == pytest.approx(7 / 3)
    assert out[4]["total_sleep_minutes_past3_mean"] == 3.0           # 2, 4, null -> (2+4)/2
    assert out[2]["total_sleep_minutes_delta"] == 2.0 and out[4]["total_sleep_minutes_delta"] is None


def test_asof_exact_midpoint_and_last_of_ties(spark):
    rows = [("a", "d", 0.0, "w", 1), ("a", "d", 45.0, "x", 2), ("a", "d", 45.0, "y", 3), ("a", "d", 100.0, "z", 4)]
    labels = spark.createDataFrame(rows, "subject_id string, dataset_name string, time_s double, label string, ingest_seq long")
    got = {r["window_index"]: r["label"] for r in Z.asof_window_labels(labels, 30.0).collect()}
    # windows 0..4 (ceil(100/30)=4); midpoints 15, 45, 75, 105, 135
    assert got == {0: "w", 1: "y", 2: "y", 3: "z", 4: "z"}


def test_sweep_bucket_floating_point(spark):
    df = spark.createDataFrame([(0.29,), (0.2899999,), (0.8,), (0.1,), (0.95,)], "p double")
    b = [r[0] for r in df.select(R.sweep_bucket(F.col("p"))).collect()]
    assert b == [29, 28, 80, 19, 80]


def test_threshold_gate_reasons(spark):
    sweep = spark.createDataFrame([(50, 0.50, False), (55, 0.53, True)],
                                  "t_int int, weighted_f1 double, is_best boolean").withColumn(
        "threshold", F.col("t_int") / 100.0)
    g = R.deployment_threshold_gate(sweep).first()
    assert g["reason"] == "accepted_tuned_threshold" and g["deployment_threshold"] == 0.55
    far = sweep.withColumn("t_int", F.when(F.col("is_best"), 70).otherwise(F.col("t_int"))) \
        .withColumn("threshold", F.col("t_int") / 100.0)
    assert R.deployment_threshold_gate(far).first()["reason"] == "fallback_shift_gt_0.10"
    small = sweep.withColumn("weighted_f1", F.when(F.col("is_best"), 0.51).otherwise(0.50))
    assert R.deployment_threshold_gate(small).first()["deployment_threshold"] == 0.5
    for t, kept in ((60, False), (59, True), (40, True), (39, False)):  # the grid's 0.60 lies a trace above 0.6
        edge = sweep.withColumn("t_int", F.when(F.col("is_best"), t).otherwise(F.col("t_int"))).withColumn("threshold", F.col("t_int") / 100.0)
        assert (R.deployment_threshold_gate(edge).first()["reason"] == "accepted_tuned_threshold") is kept
    none = R.deployment_threshold_gate(sweep.limit(0)).first()
    assert none["reason"] == "fallback_no_tuning" and none["deployment_threshold"] == 0.5


def test_long_form_scores_rows_without_known_features(spark):
    contracts = spark.createDataFrame([("c", "f", 2.0, 1.0, 4.0, 8.0), ("d", "g", 0.0, 0.0, 0.0, 1.0)],
                                      "contract_id string, feature string, median double, mean double, scale double, coef double")
    intercepts = spark.createDataFrame([("c", 0.5), ("d", -1.0)], "contract_id string, intercept double")
    long = spark.createDataFrame([(1, "f", 3.0), (2, "other", 9.0), (3, None, 1.0)], "row int, feature string, value double")
    got = {(r["row"], r["contract_id"]): r["logit"] for r in R.score_contracts_long(long, contracts, intercepts, ["row"]).collect()}
    assert got == {(1, "c"): 4.5, (2, "c"): 2.5, (3, "c"): 2.5, (1, "d"): -1.0, (2, "d"): -1.0, (3, "d"): -1.0}


def test_hashed_draws_use_64_bits_and_nulls_stand_apart(spark):
    from nightjar.functions.hashrand import mix_uniform
    from nightjar.operators import robust
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(robust.row_key(["x", "y", "z"])).collect()}) == 2
    words = spark.createDataFrame([(7, 1), (7, 2)], "low long, high long")
    u = [r[0] for r in words.select(mix_uniform((F.col("low"), F.col("high")), F.lit(3))).collect()]
    assert u[0] != u[1] and all(0 <= x < 1 for x in u)


def test_stage_flags_text_and_codes(spark):
    df = spark.createDataFrame([("HKCategoryValueSleepAnalysisAsleepREM", 5), ("inbed", 0), (None, None)],
                               "value string, value_code int")
    t = N.sleep_stage_flags(df).collect()
    assert t[0]["is_rem"] and t[0]["is_asleep"] and not t[0]["is_in_bed"]
    assert t[1]["is_in_bed"] and not t[2]["is_asleep"]
    c = N.sleep_stage_codes(df).collect()
    assert c[0]["is_rem"] and c[0]["is_asleep"] and c[1]["is_in_bed"] and not c[2]["is_asleep"]


def test_missing_quality_bands(spark):
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 1.0, None, None), (2, None, None, None)], "k int, a double, b double, c double")
    out = {r["k"]: r["data_quality"] for r in X.contract_missing_quality(df, cols + [f"x{i}" for i in range(6)], ["k"]).collect()}
    assert out == {1: "Fair", 2: "Poor"}


def test_quantiles_end_on_any_value(spark):
    from nightjar.operators import prep as P
    from nightjar.operators.quantiles import exact_quantiles
    inf, tiny = float("inf"), 5e-324
    rows = [(1.0, inf, tiny, 7.0, 1e308), (2.0, -inf, 2 * tiny, 7.0, -1e308), (3.0, None, 0.0, None, 1e-308), (inf, inf, -tiny, 7.0, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = exact_quantiles(df, list("abcde"), [0.0, 0.5, 1.0])
    assert [got["a", q] for q in (0.0, 0.5, 1.0)] == [1.0, 2.0, 3.0]  # infinite: missing
    assert got["b", 0.5] is None and got["d", 0.5] == 7.0
    assert [got["c", q] for q in (0.0, 1.0)] == [-tiny, 2 * tiny]
    assert [got["e", q] for q in (0.0, 0.5, 1.0)] == [-1e308, 1e-308, 1e308]
    assert tuple(P.column_medians(df, ["a", "b"], 0.0).first()) == (2.0, 0.0)


def test_poisson_draws_have_their_law(spark):
    import math
    from collections import Counter

    from nightjar.operators import robust as E
    cells = spark.createDataFrame([("a", 1.0), ("b", 7.0), ("c", 2500.0)], "k string, n double")
    draws = E.poisson_draws(cells, ["k"], "n", 4000, 42)
    got = {}
    for r in draws.collect():
        got.setdefault(r["k"], []).append(r["draw"])
    for k, n in (("a", 1), ("b", 7), ("c", 2500)):
        d = got[k]
        assert len(d) == 4000
        mean, var = sum(d) / 4000, sum(x * x for x in d) / 4000 - (sum(d) / 4000) ** 2
        assert abs(mean - n) < 4 * math.sqrt(n / 4000) and abs(var / n - 1) < 0.1
    seen = Counter(got["a"])
    for x in range(4):
        assert abs(seen[x] / 4000 - math.exp(-1) / math.factorial(x)) < 0.03
    # the plan reads the data once, for the confusion counts: no row meets a replicate
    df = spark.range(1000).selectExpr("cast(id % 2 as int) as y", "cast(id % 3 = 0 as int) as yhat")
    assert E.bootstrap_ci(df, "y", "yhat", 50).first()["replicates"] == 50
