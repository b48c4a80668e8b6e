"""Night-level operators: sleep segments -> one row per (subject, night).

P2-P6 flags and keys, A2 night summary, A3 metric stats, J1/J2 range join of
samples into sleep windows, P13/P21/A4 source rules, P20 lookback, W10 latest
night, P24 percentages.

Every operator is keyed by ``subject_id`` so one person and millions of people
run the same plan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import safe_divide, to_numeric_or_null
from ..functions.timeparse import assign_night, interval_minutes, parse_offset_instant, parse_offset_wallclock

SUBJECT = "subject_id"

# The four metric streams of the night table, in schema order,
# and the five statistics per metric.
METRICS = ["hr", "hrv", "resp", "spo2"]
METRIC_STATS = ["mean", "min", "max", "median", "std"]
SLEEP_COLUMNS = [
    "in_bed_minutes", "rem_minutes", "deep_minutes", "core_minutes", "asleep_minutes",
    "total_sleep_minutes", "sleep_efficiency", "rem_pct", "deep_pct", "core_pct",
]
NIGHT_FEATURES = SLEEP_COLUMNS + [f"{m}_{s}" for m in METRICS for s in METRIC_STATS]

# Stage substrings matched case-insensitively (P5) and numeric
# stage codes (P6): 0 in bed, 1 asleep unspecified, 3 core, 4 deep, 5 REM.
STAGE_SUBSTRINGS = {"is_in_bed": "inbed", "is_rem": "rem", "is_deep": "deep",
                    "is_core": "core", "is_asleep": "asleep"}
STAGE_CODES = {"is_in_bed": [0], "is_rem": [5], "is_deep": [4], "is_core": [3], "is_asleep": [1, 3, 4, 5]}
FLAG_TO_MINUTES = {"is_in_bed": "in_bed_minutes", "is_rem": "rem_minutes", "is_deep": "deep_minutes",
                   "is_core": "core_minutes", "is_asleep": "asleep_minutes"}


# ---------------------------------------------------------------- P5 / P6
def sleep_stage_flags(df: DataFrame, value_col: str = "value") -> DataFrame:
    """P5: case-insensitive substring flags; null text -> all false."""
    low = F.lower(F.col(value_col))
    return df.withColumns({flag: F.coalesce(F.contains(low, F.lit(sub)), F.lit(False))
                           for flag, sub in STAGE_SUBSTRINGS.items()})


def sleep_stage_codes(df: DataFrame, code_col: str = "value_code") -> DataFrame:
    """The same flags from numeric stage codes."""
    code = F.col(code_col).cast("int")
    return df.withColumns({flag: F.coalesce(code.isin(codes), F.lit(False))
                           for flag, codes in STAGE_CODES.items()})


# ---------------------------------------------------------------- P1-P4
def sleep_segments(records: DataFrame, start_col: str = "start_raw", end_col: str = "end_raw",
                   value_col: str = "value_raw") -> DataFrame:
    """Parse raw sleep records into segments with instants, wall clock,
    duration in minutes, night key and stage flags."""
    out = records.withColumns({
        "start_ts": parse_offset_instant(start_col),
        "end_ts": parse_offset_instant(end_col),
        "start_local": parse_offset_wallclock(start_col),
    })
    out = out.withColumns({
        "duration_min": interval_minutes("start_ts", "end_ts"),
        "night_date": assign_night("start_local"),
    })
    return sleep_stage_flags(out, value_col)


def recent_lookback(df: DataFrame, as_of, days: int = 3, ts_col: str = "start_ts") -> DataFrame:
    """P20: rows at or after ``as_of - days``; ``as_of`` is a parameter."""
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.filter(F.col(ts_col) >= as_of_col - F.make_dt_interval(F.lit(days)))


def _minutes(flag: str, where: Column | None = None) -> Column:
    hit = F.col(flag) if where is None else F.col(flag) & where
    return F.sum(F.when(hit, F.col("duration_min")).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- A2 + P24
def night_sleep_summary(segments: DataFrame, zero_fill: bool = False) -> DataFrame:
    """A2 + P24: one row per (subject, night).

    ``zero_fill`` gives the device flavour (ratios 0 instead of missing when the
    denominator is 0).
    """
    sums = [_minutes(flag).alias(name) for flag, name in FLAG_TO_MINUTES.items()]
    agg = (segments.groupBy(SUBJECT, "night_date")
           .agg(F.min("start_ts").alias("sleep_start"), F.max("end_ts").alias("sleep_end"), *sums))
    return sleep_percentages(agg.withColumn("total_sleep_minutes", F.col("asleep_minutes")), zero_fill)


def sleep_percentages(df: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Efficiency and stage shares of total sleep."""
    def ratio(a, b):
        r = safe_divide(a, b)
        return F.coalesce(r, F.lit(0.0)) if zero_fill else r
    return df.withColumns({
        "sleep_efficiency": ratio("asleep_minutes", "in_bed_minutes"),
        "rem_pct": ratio("rem_minutes", "total_sleep_minutes"),
        "deep_pct": ratio("deep_minutes", "total_sleep_minutes"),
        "core_pct": ratio("core_minutes", "total_sleep_minutes"),
    })


# ---------------------------------------------------------------- A3
def metric_stat_columns(metric: str, value: Column, metric_col: Column | None = None,
                        median_accuracy: int | None = None) -> list[Column]:
    """A3: mean, min, max, median, population std of one metric.

    With ``metric_col`` the aggregates are conditional on the metric, so all
    metrics come out of one aggregation (one shuffle) over a long sample table.
    The median is exact by default (its buffer holds the group's distinct
    values); ``median_accuracy`` switches to ``percentile_approx`` with a
    bounded sketch for groups too large to hold.
    """
    v = value if metric_col is None else F.when(metric_col == F.lit(metric), value)
    med = F.median(v) if median_accuracy is None else F.percentile_approx(v, 0.5, median_accuracy)
    return [
        F.avg(v).alias(f"{metric}_mean"),
        F.min(v).alias(f"{metric}_min"),
        F.max(v).alias(f"{metric}_max"),
        med.cast("double").alias(f"{metric}_median"),
        F.stddev_pop(v).alias(f"{metric}_std"),
    ]


# ---------------------------------------------------------------- J1 / J2
def _bucket(ts: Column, bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(bucket_seconds * 1_000_000)).cast("long")


def night_metric_range_join(nights: DataFrame, samples: DataFrame, metrics: list[str] = METRICS,
                            bucket_seconds: int = 21600, strict: bool = False,
                            median_accuracy: int | None = None) -> DataFrame:
    """J1 (and J2 with ``strict``): attach per-night metric statistics.

    Samples ``(subject_id, metric, ts, value)`` — plus ``end_ts`` for the strict
    flavour — fall in a night when ``sleep_start <= ts <= sleep_end`` (both ends
    inclusive). Nights without samples keep nulls; a sample may count for two
    overlapping nights.

    Spark has no range-join operator and a subject-only equi key is quadratic
    per subject, so each night is exploded into the time buckets it covers and
    joined on ``(subject_id, bucket)`` with the range as a residual predicate.
    A sample has exactly one bucket, so it meets each night at most once. The
    bucket key also splits a hot subject over many tasks; AQE's skew join
    splits a hot bucket further.

    The join is INNER on purpose: AQE may then broadcast the (small) span
    side or split a hot (subject, bucket) of samples; nights without samples
    come back through the left join to the night table. (A single LEFT join
    from the spans would save that second join but forbids both.)
    """
    hits = samples_in_nights(nights, samples, strict, bucket_seconds)
    stats = [c for m in metrics
             for c in metric_stat_columns(m, to_numeric_or_null("value"), F.col("metric"), median_accuracy)]
    per_night = hits.groupBy(SUBJECT, "night_date").agg(*stats)
    return nights.join(per_night, [SUBJECT, "night_date"], "left")


def samples_in_nights(nights: DataFrame, samples: DataFrame, strict: bool = False,
                      bucket_seconds: int = 21600) -> DataFrame:
    """The bucketed range join of J1 / J2: every sample with the night it falls in."""
    keys = nights.select(SUBJECT, "night_date", "sleep_start", "sleep_end")
    lo, hi = _bucket(F.col("sleep_start"), bucket_seconds), _bucket(F.col("sleep_end"), bucket_seconds)
    spans = (keys.filter(F.col("sleep_end") >= F.col("sleep_start"))  # sequence() counts down otherwise
             .withColumn("bucket", F.explode(F.sequence(lo, hi))))
    s = samples.withColumnRenamed(SUBJECT, "_subject").withColumn("_bucket", _bucket(F.col("ts"), bucket_seconds))
    inside = (F.col("end_ts") <= F.col("sleep_end")) if strict else (F.col("ts") <= F.col("sleep_end"))
    cond = [spans[SUBJECT] == s["_subject"], spans["bucket"] == s["_bucket"], F.col("ts") >= F.col("sleep_start"), inside]
    return spans.join(s, cond, "inner").drop("_subject", "_bucket", "bucket")


def night_features(segments: DataFrame, samples: DataFrame, bucket_seconds: int = 21600,
                   strict: bool = False, zero_fill: bool = False) -> DataFrame:
    """First slice: A2 + P24 + J1 + A3 with the fixed night schema order."""
    nights = night_sleep_summary(segments, zero_fill=zero_fill)
    joined = night_metric_range_join(nights, samples, METRICS, bucket_seconds, strict)
    return joined.select(SUBJECT, "night_date", "sleep_start", "sleep_end", *NIGHT_FEATURES)


# ---------------------------------------------------------------- P13 / P21 / A4 / W10
def source_flags(df: DataFrame, source_col: str = "source_name", metadata_col: str | None = None,
                 bundle_col: str | None = None) -> DataFrame:
    """Watch source (its name or its bundle identifier contains 'watch',
    any case) and user-entered flag from the record's metadata array (absent ->
    false)."""
    names = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit("watch")), F.lit(False))
             for c in (source_col, bundle_col) if c is not None]
    out = df.withColumn("is_watch", names[0] if len(names) == 1 else names[0] | names[1])
    if metadata_col is None:
        return out.withColumn("is_user_entered", F.lit(False))
    entered = F.exists(F.col(metadata_col), lambda m: (m["key"] == F.lit("HKWasUserEntered")) & (m["value"] == F.lit("1")))
    return out.withColumn("is_user_entered", F.coalesce(entered, F.lit(False)))


def prefer_with_fallback(df: DataFrame, scope: list[str], preferred: Column) -> DataFrame:
    """Keep preferred rows; a scope with no preferred row keeps all rows.

    The "any preferred" flag is a partial aggregate per scope joined back, not
    a window over the scope. The frame is read twice; chains of preferences
    over aggregates use ``device_nights`` / ``preferred_sample_stats``, which
    read it once."""
    flagged = df.withColumn("_pref", F.coalesce(preferred, F.lit(False)))
    any_pref = flagged.groupBy(*scope).agg(F.max(F.col("_pref").cast("int")).alias("_any_pref"))
    return (flagged.join(any_pref, scope, "inner")
            .filter(F.col("_pref") | (F.col("_any_pref") == 0)).drop("_pref", "_any_pref"))


def device_nights(segments: DataFrame, days: int = 3) -> DataFrame:
    """P4, P20, P21 (twice), W10 and A2 in the device flavour: per subject the
    latest night within ``days`` of its newest segment.

    Segments that were not entered by hand are preferred per subject, watch
    segments within the night. Start and end span all chosen segments; minutes
    count only segments of positive length (P4). One aggregate per (subject,
    night) holds the numbers of all four preference cases (partial aggregates,
    nothing is joined to itself); the latest night and its case are then picked
    from that table with a maximum of structs per subject.
    """
    as_of = segments.groupBy(SUBJECT).agg(F.max("start_ts").alias("as_of"))
    recent = recent_lookback(segments.join(as_of, SUBJECT), F.col("as_of"), days)
    entered, watch = F.coalesce(F.col("is_user_entered"), F.lit(False)), F.coalesce(F.col("is_watch"), F.lit(False))
    cases = {"ow": ~entered & watch, "o": ~entered, "w": watch, "a": F.lit(True)}
    long_enough = F.col("duration_min") > 0

    def numbers(where: Column) -> Column:
        return F.struct(F.count_if(where).alias("n"), F.min(F.when(where, F.col("start_ts"))).alias("sleep_start"),
                        F.max(F.when(where, F.col("end_ts"))).alias("sleep_end"),
                        *[_minutes(flag, where & long_enough).alias(name) for flag, name in FLAG_TO_MINUTES.items()])
    nights = recent.groupBy(SUBJECT, "night_date").agg(*[numbers(w).alias(c) for c, w in cases.items()])
    own = F.when(F.col("ow.n") > 0, F.col("ow")).otherwise(F.col("o"))
    all_ = F.when(F.col("w.n") > 0, F.col("w")).otherwise(F.col("a"))
    latest = nights.groupBy(SUBJECT).agg(
        F.max(F.when(F.col("o.n") > 0, F.struct("night_date", own.alias("x")))).alias("own"),
        F.max(F.struct("night_date", all_.alias("x"))).alias("any"))
    best = latest.select(SUBJECT, F.coalesce("own", "any").alias("best")).select(SUBJECT, "best.night_date", "best.x.*")
    return sleep_percentages(best.drop("n").withColumn("total_sleep_minutes", F.col("asleep_minutes")), zero_fill=True)


def preferred_sample_stats(hits: DataFrame, scope: list[str], value: Column) -> DataFrame:
    """A3, A4 and P21 twice over samples of a scope, in one aggregate: samples
    not entered by hand are preferred, then watch samples among those.
    ``sample_count`` and ``sources`` are of the chosen samples, ``watch_share``
    of those before the watch rule; a scope without a finite chosen value goes."""
    entered, watch = F.coalesce(F.col("is_user_entered"), F.lit(False)), F.coalesce(F.col("is_watch"), F.lit(False))
    cases = {"ow": ~entered & watch, "o": ~entered, "w": watch, "a": F.lit(True)}

    def numbers(where: Column) -> Column:
        v = F.when(where, value)
        return F.struct(*metric_stat_columns("m", v), F.count(v).alias("finite"), F.count_if(where).alias("sample_count"),
                        F.count_if(where & watch).alias("n_watch"),
                        F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("source_name")))), ", ").alias("sources"))
    per = hits.groupBy(*scope).agg(*[numbers(w).alias(c) for c, w in cases.items()])
    has = lambda c: F.col(f"{c}.sample_count") > 0
    chosen = F.when(has("ow"), F.col("ow")).when(has("o"), F.col("o")).when(has("w"), F.col("w")).otherwise(F.col("a"))
    usable = F.when(has("o"), F.col("o")).otherwise(F.col("a"))
    share = F.try_divide(usable["n_watch"].cast("double"), usable["sample_count"])
    return (per.select(*scope, chosen.alias("x"), share.alias("watch_share")).where("x.finite > 0")
            .select(*scope, "x.*", "watch_share").drop("finite", "n_watch"))
