"""Scale properties: exact results on skewed fixtures (checked by brute
force), independence from the shuffle partition count, and plan shape (no
Cartesian product or nested-loop join in the data-sized plans)."""
import datetime
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from nightjar.operators import nights as N
from nightjar.operators import positions as Pos
from nightjar.operators import quantiles as Q
from nightjar.operators import scoring as R
from nightjar.operators import metrics as M
from nightjar.operators import sensors as Z
from nightjar.operators import splits as S


def test_position_blocks_with_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        d = 5 if i % 3 == 0 else rnd.randint(0, 40)       # one key holds a third of the rows
        rows.append((d, rnd.randint(0, 10_000), i))
    df = spark.createDataFrame(rows, "d int, v int, id int")
    cuts = [700, 1500, 2999]
    got = {r["id"]: r["b"] for r in Pos.OrderedRows(df, ["d", "v", "id"], 16).blocks({"b": cuts}).collect()}
    order = sorted(rows)
    want = {row[2]: sum(pos >= c for c in cuts) for pos, row in enumerate(order)}
    assert got == want


def test_split_and_folds_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 30), i, rnd.randint(0, 1)) for i in range(997)]
    df = spark.createDataFrame(rows, "d int, id int, y int")
    split = {r["id"]: r["split"] for r in S.chronological_split(df, ["d", "id"]).collect()}
    order = sorted(rows)
    k = int(len(rows) * 0.7)
    assert split == {row[1]: ("train" if pos < k else "test") for pos, row in enumerate(order)}
    folds = {r["id"]: (r["test_fold"], r["n_folds"]) for r in S.walk_forward_folds(df, ["d", "id"], "y").collect()}
    n, kk = len(rows), 5
    ts = n // (kk + 1)
    for pos, row in enumerate(order):
        start = n - kk * ts
        want = -1 if pos < start else (pos - start) // ts
        assert folds[row[1]] == (want, 5)


def test_range_join_hot_subject_brute_force(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    nights = []
    for d in range(20):
        s = base + dt.timedelta(days=d, hours=22, minutes=rnd.randint(0, 60))
        nights.append((1, (base + dt.timedelta(days=d)).date(), s, s + dt.timedelta(hours=rnd.randint(1, 30))))
    samples = []
    for i in range(6000):  # subject 1 is hot
        ts = base + dt.timedelta(seconds=rnd.randint(0, 22 * 86400))
        samples.append((1 if i % 2 else rnd.randint(2, 5), "hr", ts, ts, float(rnd.randint(40, 120))))
    ndf = spark.createDataFrame(nights, "subject_id long, night_date date, sleep_start timestamp, sleep_end timestamp")
    sdf = spark.createDataFrame(samples, "subject_id long, metric string, ts timestamp, end_ts timestamp, value double")
    got = {r["night_date"]: r for r in N.night_metric_range_join(ndf, sdf, ["hr"], bucket_seconds=1800).collect()}
    for subj, nd, s, e in nights:
        vals = [v for (sj, _m, ts, _e, v) in samples if sj == subj and s <= ts <= e]
        r = got[nd]
        if not vals:
            assert r["hr_mean"] is None
            continue
        assert r["hr_mean"] == pytest.approx(statistics.fmean(vals))
        assert r["hr_median"] == pytest.approx(statistics.median(vals))
        assert r["hr_std"] == pytest.approx(statistics.pstdev(vals))
        assert (r["hr_min"], r["hr_max"]) == (min(vals), max(vals))


def test_exact_quantiles_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([None, float("nan"), rnd.gauss(0, 1) * 10 ** rnd.randint(-9, 9), 7.0]), rnd.random(), None)
            for g in ("a", "b", None) for _ in range(1501 if g == "a" else 800)]
    rows += [("c", 1.5e308, 1.0, None), ("c", -1.5e308, 1.0, None), ("c", 0.25, 1.0, None), ("d", None, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    qs = [0.0, 0.025, 0.5, 0.95, 1.0]

    def want(values, q):
        v = sorted(x for x in values if x is not None and x == x)
        if not v:
            return None
        at = q * (len(v) - 1)
        lo, hi = v[math.floor(at)], v[math.ceil(at)]
        return lo if lo == hi else lo + (at - math.floor(at)) * (hi - lo)
    whole, by = Q.exact_quantiles(df, ["x", "y", "z"], qs), Q.exact_quantiles(df, ["x", "y"], qs, ["g"])
    for q in qs:
        for i, c in enumerate("xyz", 1):
            assert whole[c, q] == want([r[i] for r in rows], q)
        for g in ("a", "b", None, "c", "d"):
            for i, c in enumerate("xy", 1):
                assert by[g, c, q] == want([r[i] for r in rows if r[0] == g], q)
    assert Q.exact_quantiles(df.limit(0), ["x"], [0.5]) == {("x", 0.5): None}
    with pytest.raises(ValueError, match="groups"):
        Q.exact_quantiles(spark.range(2000).selectExpr("id", "1.0 as v"), ["v"], [0.5], ["id"])


def test_fits_hold_no_whole_column_median(spark):
    import __spark_entry__ as E
    for name in ("column_medians", "impute_and_scale", "teacher_targets", "latency_summary"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median(" not in plan and "percentile(" not in plan


def test_asof_labels_bucket_carry(spark):
    # Labels far apart: the next label lives several time buckets later.
    rows = [("a", "d", 10.0, "x", 1), ("a", "d", 5000.0, "y", 2), ("b", "d", 70.0, "q", 3)]
    labels = spark.createDataFrame(rows, "subject_id string, dataset_name string, time_s double, label string, ingest_seq long")
    got = {(r["subject_id"], r["window_index"]): r["label"]
           for r in Z.asof_window_labels(labels, 1000.0, bucket_sec=1000.0).collect()}
    # a: windows 0..5, label x until t=5000; b: windows 0..1 (ceil(70/1000) = 1).
    assert got == {("a", 0): "x", ("a", 1): "x", ("a", 2): "x", ("a", 3): "x", ("a", 4): "x", ("a", 5): "y",
                   ("b", 0): "q", ("b", 1): "q"}


def test_threshold_sweep_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "p double, y int")
    sweep = {r["t_int"]: r for r in R.threshold_sweep(df, "p", "y").collect()}
    assert len(sweep) == 61 and sum(r["is_best"] for r in sweep.values()) == 1
    for t in (20, 37, 50, 80):
        pred = [(y, int(p >= t / 100.0)) for p, y in rows]
        cm = spark.createDataFrame([(y, yh, 1.0) for y, yh in pred], "y int, yhat int, n double") \
            .groupBy("y", "yhat").agg(F.sum("n").alias("n"))
        ref = M.classification_metrics(cm).first()
        assert sweep[t]["weighted_f1"] == pytest.approx(ref["weighted_f1"], abs=1e-12)
        assert sweep[t]["kappa"] == pytest.approx(ref["kappa"], abs=1e-12)


@pytest.mark.parametrize("name", ["night_metric_range_join", "asof_window_labels", "chronological_split",
                                  "transfer_features", "threshold_sweep"])
def test_partition_independence(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    results = []
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results.append(sorted(tuple(r) for r in q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


HEADLINE = ["night_metric_range_join", "device_metric_stats", "join_next_day_labels", "transfer_features",
            "chronological_split", "walk_forward_folds", "threshold_sweep", "robustness_curve",
            "tumbling_window_stats", "asof_window_labels", "assemble_sensor_windows", "bootstrap_ci"]


@pytest.mark.parametrize("name", HEADLINE)
def test_plan_has_no_cartesian_or_nested_loop(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_ordered_rows_spread_a_hot_date_and_equal_rows(spark):
    """90 % of the rows on one text date, a third of those equal in all columns:
    every partition stays small, cuts are exact, and a rerun gives the same."""
    rnd = random.Random(13)
    rows = [("2024-05-05" if i % 10 else f"2024-0{rnd.randint(1, 9)}-01", "same" if i % 3 == 0 else f"v{i}") for i in range(6000)]
    rows += [(None, "null date")] * 30
    df = spark.createDataFrame(rows, "d string, v string").repartition(5)
    ordered = Pos.OrderedRows(df, ["d"], 20)
    sizes = [b - a for a, b in ordered.first.values()]
    assert sum(sizes) == ordered.n == 6030 and max(sizes) < 3 * 6030 / 20
    out = ordered.blocks({"b": [30, 1000, 4000], "c": [0, 6030]})
    got = out.collect()
    assert [sum(r["b"] == k for r in got) for k in range(4)] == [30, 970, 3000, 2030] and {r["c"] for r in got} == {1}
    assert {r["d"] for r in got if r["b"] == 0} == {None}
    for k in (1, 2):
        assert max(r["d"] for r in got if r["b"] == k) <= min(r["d"] for r in got if r["b"] == k + 1)
    assert sorted(map(str, got)) == sorted(map(str, out.collect()))
    stamp = spark.range(3000).selectExpr("timestamp_seconds(id * 7919 % 3001) as t", "id")  # unique timestamps
    first = Pos.OrderedRows(stamp, ["t"], 8).blocks({"b": [1234]}).where("b = 0")
    assert first.count() == 1234 and first.agg({"t": "max"}).first()[0] < stamp.join(first, "id", "left_anti").agg({"t": "min"}).first()[0]
    assert Pos.OrderedRows(df.limit(0), ["d"]).blocks({"b": [0]}).count() == 0


def test_asof_labels_random_brute_force(spark):
    import math
    rnd = random.Random(21)
    rows, seq = [], 0
    for subj in ["a", "b", "c"]:
        n = 400 if subj == "a" else 30                      # "a" is hot and spans many day buckets
        for _ in range(n):
            t = float(rnd.randint(0, 40 * 86400)) + rnd.choice([0.0, 0.25, 0.5])
            rows.append((subj, "d", t, rnd.choice("xyzw"), seq))
            seq += 1
        rows.append((subj, "d", rows[-1][2], "dup", seq))   # duplicate time: the later ingest wins
        seq += 1
    w = 3600.0
    labels = spark.createDataFrame(rows, "subject_id string, dataset_name string, time_s double, label string, ingest_seq long")
    got = {(r["subject_id"], r["window_index"]): r["label"] for r in Z.asof_window_labels(labels, w).collect()}
    want = {}
    for subj in ["a", "b", "c"]:
        mine = sorted((t, s, lab) for sj, _d, t, lab, s in rows if sj == subj)
        lo, hi = math.floor(mine[0][0] / w), math.ceil(mine[-1][0] / w)
        for k in range(lo, hi + 1):
            mid = k * w + w / 2
            before = [x for x in mine if x[0] <= mid]
            if before:
                want[(subj, k)] = before[-1][2]
    assert got == want


def test_assemble_notes_for_missing_streams(spark):
    motion = spark.createDataFrame([("a", "d", 0, 1.0), ("b", "d", 0, 2.0)],
                                   "subject_id string, dataset_name string, window_index long, acc_x_mean double")
    labels = spark.createDataFrame([("a", "d", 0, "wake"), ("c", "d", 0, "rem")],
                                   "subject_id string, dataset_name string, window_index long, label string")
    windows, notes = Z.assemble_sensor_windows(motion, None, None, labels, 30.0)
    assert [(r["subject_id"], r["label"], r["window_end_s"]) for r in windows.collect()] == [("a", "wake", 30.0)]
    assert sorted((r["subject_id"], r["note"]) for r in notes.collect()) == [("b", "missing labels"),
                                                                            ("c", "missing motion")]


def test_preferred_sample_stats_equals_sequential_preferences(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 40), float(i), rnd.random() < p, rnd.random() < 0.3, rnd.choice("xyz"))
            for i in range(300) for p in [rnd.choice([0.3, 1.0])]]
    rows += [(99, 1.0, True, False, "q"), (99, 3.0, True, False, "p"), (98, None, False, True, "x")]
    df = spark.createDataFrame(rows, "scope int, value double, is_user_entered boolean, is_watch boolean, source_name string")
    first = N.prefer_with_fallback(df, ["scope"], ~F.col("is_user_entered"))
    want = {}
    for r in N.prefer_with_fallback(first, ["scope"], F.col("is_watch")).collect():
        want.setdefault(r["scope"], []).append(r)
    share = {r["scope"]: r["s"] for r in first.groupBy("scope").agg(F.avg(F.col("is_watch").cast("double")).alias("s")).collect()}
    got = {r["scope"]: r for r in N.preferred_sample_stats(df, ["scope"], F.col("value")).collect()}
    assert set(got) == {k for k, own in want.items() if any(r["value"] is not None for r in own)} and 99 in got
    for k, r in got.items():
        own = [x["value"] for x in want[k] if x["value"] is not None]
        assert r["m_mean"] == pytest.approx(statistics.fmean(own)) and r["m_median"] == statistics.median(own)
        assert r["sample_count"] == len(want[k]) and r["watch_share"] == pytest.approx(share[k])
        assert r["sources"] == ", ".join(sorted({x["source_name"] for x in want[k]}))


def test_device_nights_keep_nonpositive_segments_in_the_span(spark):
    t = lambda h, m=0: datetime.datetime(2024, 1, 2, h, m)
    day = datetime.date(2024, 1, 1)
    rows = [("a", t(1), t(2), 60.0, day, True, False), ("a", t(5), t(4), -60.0, day, False, True),  # negative: span only
            ("a", t(3), t(3), 0.0, day, True, False), ("b", t(2), t(2), 0.0, day, True, False)]
    df = spark.createDataFrame([(s, a, b, d, n, *[f] * 5, False, w) for s, a, b, d, n, f, w in rows],
                               "subject_id string, start_ts timestamp, end_ts timestamp, duration_min double, night_date date, "
                               + ", ".join(f"{f} boolean" for f in N.FLAG_TO_MINUTES) + ", is_user_entered boolean, is_watch boolean")
    every = {r["subject_id"]: r for r in N.device_nights(df.withColumn("is_watch", F.lit(False))).collect()}
    assert (every["a"]["sleep_start"], every["a"]["sleep_end"], every["a"]["asleep_minutes"]) == (t(1), t(4), 60.0)
    assert every["b"]["asleep_minutes"] == 0.0 and every["b"]["sleep_efficiency"] == 0.0  # a night of such segments stays
    watch = {r["subject_id"]: r for r in N.device_nights(df).collect()}
    assert (watch["a"]["sleep_start"], watch["a"]["sleep_end"], watch["a"]["asleep_minutes"]) == (t(5), t(4), 0.0)


def test_device_chain_reads_events_at_most_three_times(spark):
    import __spark_entry__ as E
    plan = E.queries()["device_metric_stats"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3


def test_position_blocks_single_order_column_with_ties(spark):
    """One order column whose hot value straddles several cuts: blocks have
    the exact cut sizes, follow the key order, and are the same on a rerun."""
    rnd = random.Random(11)
    keys = [5] * 400 + [rnd.randrange(10) for _ in range(200)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int").repartition(4)
    cuts = [100, 250, 450]
    out = Pos.OrderedRows(df, ["k"], 6).blocks({"blk": cuts})
    rows = out.collect()
    sizes = [sum(1 for r in rows if r["blk"] == b) for b in range(4)]
    assert sizes == [100, 150, 200, 150]
    by_block = {}
    for r in rows:
        by_block.setdefault(r["blk"], []).append(r["k"])
    for b in range(3):
        assert max(by_block[b]) <= min(by_block[b + 1])
    again = {r["id"]: r["blk"] for r in out.collect()}
    assert again == {r["id"]: r["blk"] for r in rows}


def test_asof_labels_of_existing_windows_brute_force(spark):
    """30-second windows with gaps of weeks: looked up, never generated."""
    import math
    rnd = random.Random(22)
    labels, windows, seq = [], set(), 0
    for subj, n in (("a", 300), ("b", 5), ("c", 0), ("d", 1)):
        for _ in range(n):
            t = float(rnd.randint(0, 90 * 86400)) + rnd.choice([0.0, 0.25, 15.0])
            labels.append((subj, "x", t, rnd.choice(["wake", "deep", None]), seq))
            seq += 1
        if n:
            labels.append((subj, "x", labels[-1][2], "dup", seq))
            mid = math.floor(labels[-1][2] / 30.0) * 30.0 + 15.0
            labels.append((subj, "x", mid, "at the midpoint", seq + 1))
            windows.add((subj, "x", int(mid // 30)))
            seq += 2
        windows |= {(subj, "x", rnd.randint(-10, 91 * 2880)) for _ in range(200)}
    lab = spark.createDataFrame(labels, "subject_id string, dataset_name string, time_s double, label string, ingest_seq long")
    win = spark.createDataFrame(sorted(windows) * 2, "subject_id string, dataset_name string, window_index long")
    got = Z.asof_labels_of_windows(win, lab, 30.0, bucket_sec=7200.0)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["subject_id"], r["window_index"]): r["label"] for r in got.collect()}
    want = {}
    for subj, _, k in windows:
        mine = sorted((t, s, x) for sj, _, t, x, s in labels if sj == subj and x)
        if mine and math.floor(mine[0][0] / 30) <= k <= math.ceil(mine[-1][0] / 30):
            before = [x for x in mine if x[0] <= k * 30.0 + 15.0]
            if before:
                want[subj, k] = before[-1][2]
    assert rows == want and len(rows) == got.count()
    assert "at the midpoint" in want.values()
    # the same as all windows of the range, where those are generated
    every = {(r["subject_id"], r["window_index"]): r["label"] for r in Z.asof_window_labels(lab, 30.0).join(
        win.select("subject_id", "window_index").distinct(), ["subject_id", "window_index"]).collect()}
    assert every == rows


def test_dataset_summary_folds_one_table_of_presence(spark):
    rows = [("d1", str(i % 7), ["a", "b", None][i % 3]) for i in range(60)] + [("d2", str(i % 3), "a") for i in range(9)]
    df = spark.createDataFrame(rows, "dataset_name string, subject_id string, label string")
    got = {r["dataset_name"]: tuple(r)[1:] for r in Z.dataset_summary(df).collect()}
    assert got == {"d1": (60, 7, 2), "d2": (9, 3, 1), "__all__": (69, 7, 2)}
    assert "Expand" not in Z.dataset_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert Z.dataset_summary(df.drop("label")).columns == ["dataset_name", "rows", "subjects"]
