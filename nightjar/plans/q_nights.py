"""Registered queries for the night slice (P1-P6, P13, P20-P22, P24, A2-A4,
J1, J2, W10) over the driver's ``events`` table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nights as N
from ..functions.clean import finite_or_null
from . import bindings as B
from .registry import oracle_wrap, presentable, register

NIGHT_DOUBLES = N.NIGHT_FEATURES


def _segments(spark, sf):
    return N.sleep_segments(B.sleep_records(B.table(spark, sf, "events")))


def _samples(spark, sf):
    return B.metric_samples(B.table(spark, sf, "events"))


# ------------------------------------------------------------------ SQL pieces
def _minutes_sql(flag):
    return f"sum(CASE WHEN {flag} THEN duration_min ELSE CAST(0 AS DOUBLE) END)"


def _nights_sql(extra_where: str = "") -> str:
    return f"""
SELECT subject_id, night_date, min(start_ts) AS sleep_start, max(end_ts) AS sleep_end,
       {_minutes_sql('is_in_bed')} AS in_bed_minutes, {_minutes_sql('is_rem')} AS rem_minutes,
       {_minutes_sql('is_deep')} AS deep_minutes, {_minutes_sql('is_core')} AS core_minutes,
       {_minutes_sql('is_asleep')} AS asleep_minutes
FROM ({B.SEGMENTS_SQL}) s {extra_where}
GROUP BY subject_id, night_date"""


def _pct_sql(zero_fill=False):
    def r(a, b):
        e = f"{a} / NULLIF({b}, 0)"
        return f"coalesce({e}, 0.0)" if zero_fill else e
    return (f"asleep_minutes AS total_sleep_minutes, {r('asleep_minutes', 'in_bed_minutes')} AS sleep_efficiency, "
            f"{r('rem_minutes', 'asleep_minutes')} AS rem_pct, {r('deep_minutes', 'asleep_minutes')} AS deep_pct, "
            f"{r('core_minutes', 'asleep_minutes')} AS core_pct")


def _stats_sql(metric):
    v = f"CASE WHEN metric = '{metric}' THEN value END"
    return (f"avg({v}) AS {metric}_mean, min({v}) AS {metric}_min, max({v}) AS {metric}_max, "
            f"median({v}) AS {metric}_median, stddev_pop({v}) AS {metric}_std")


def _night_features_sql(strict: bool) -> str:
    cond = ("s.ts >= n.sleep_start AND s.end_ts <= n.sleep_end" if strict
            else "s.ts >= n.sleep_start AND s.ts <= n.sleep_end")
    stats = ", ".join(_stats_sql(m) for m in N.METRICS)
    return f"""
WITH n AS ({_nights_sql()}),
st AS (SELECT n.subject_id, n.night_date, {stats}
       FROM n JOIN ({B.SAMPLES_SQL}) s ON s.subject_id = n.subject_id AND {cond}
       GROUP BY n.subject_id, n.night_date)
SELECT n.subject_id, n.night_date, n.sleep_start AT TIME ZONE 'UTC' AS sleep_start,
       n.sleep_end AT TIME ZONE 'UTC' AS sleep_end,
       in_bed_minutes, rem_minutes, deep_minutes, core_minutes, asleep_minutes, {_pct_sql()},
       {', '.join(f'{m}_{s}' for m in N.METRICS for s in N.METRIC_STATS)}
FROM n LEFT JOIN st USING (subject_id, night_date)"""


# ------------------------------------------------------------------ queries
@register("night_metric_range_join", op_ids="J1 A3 A2 P24 P1-P3 P5 P7-P9",
          sql=oracle_wrap(_night_features_sql(strict=False), NIGHT_DOUBLES), bench=True)
def q_night_features(spark, sf):
    return presentable(N.night_features(_segments(spark, sf), _samples(spark, sf)))


@register("night_metric_strict_join", op_ids="J2",
          sql=oracle_wrap(_night_features_sql(strict=True), NIGHT_DOUBLES))
def q_night_features_strict(spark, sf):
    return presentable(N.night_features(_segments(spark, sf), _samples(spark, sf), strict=True))


_SUMMARY_COLS = ["in_bed_minutes", "rem_minutes", "deep_minutes", "core_minutes", "asleep_minutes",
                 "total_sleep_minutes", "sleep_efficiency", "rem_pct", "deep_pct", "core_pct"]


@register("night_sleep_summary", op_ids="A2 P24",
          sql=oracle_wrap(f"""SELECT subject_id, night_date, sleep_start AT TIME ZONE 'UTC' AS sleep_start,
 sleep_end AT TIME ZONE 'UTC' AS sleep_end, in_bed_minutes, rem_minutes, deep_minutes, core_minutes,
 asleep_minutes, {_pct_sql()} FROM ({_nights_sql()}) n""", _SUMMARY_COLS))
def q_night_summary(spark, sf):
    return presentable(N.night_sleep_summary(_segments(spark, sf)))


@register("sleep_stage_flags", op_ids="P1 P2 P3 P5",
          sql=oracle_wrap(f"""SELECT subject_id, uuid, value_raw, start_ts AT TIME ZONE 'UTC' AS start_ts,
 end_ts AT TIME ZONE 'UTC' AS end_ts, start_local, night_date, duration_min,
 is_in_bed, is_rem, is_deep, is_core, is_asleep FROM ({B.SEGMENTS_SQL}) s""", ["duration_min"]))
def q_stage_flags(spark, sf):
    seg = _segments(spark, sf)
    return presentable(seg.select("subject_id", "uuid", "value_raw", "start_ts", "end_ts", "start_local",
                                  "night_date", "duration_min", "is_in_bed", "is_rem", "is_deep",
                                  "is_core", "is_asleep"))


@register("sleep_stage_codes", op_ids="P6",
          sql=f"""SELECT subject_id, uuid, value_code, value_code = 0 AS is_in_bed, value_code = 5 AS is_rem,
 value_code = 4 AS is_deep, value_code = 3 AS is_core, value_code IN (1, 3, 4, 5) AS is_asleep
 FROM ({B.SLEEP_RECORDS_SQL}) r""")
def q_stage_codes(spark, sf):
    rec = B.sleep_records(B.table(spark, sf, "events"))
    return N.sleep_stage_codes(rec, "value_code").select(
        "subject_id", "uuid", "value_code", "is_in_bed", "is_rem", "is_deep", "is_core", "is_asleep")


# --------------------------------------------------------- device flavour
# The on-device rules, per subject: 3-day lookback before the subject's own
# latest record (P20), non-user-entered preferred (P21), latest night (W10),
# watch sources preferred within the night (P13, P21), segments <= 0 minutes
# left out of the minute sums (P4), numeric stage codes (P6), zero-filled ratios (P24); samples
# strictly inside the night (J2), preferred the same way per night and metric,
# finite only (P22), with count, sources and watch share (A4).
def device_nights(spark, sf):
    seg = N.sleep_segments(B.sleep_records(B.table(spark, sf, "events")))
    return N.device_nights(N.sleep_stage_codes(N.source_flags(seg, "source_name", "metadata"), "value_code"))


def device_metric_stats(spark, sf):
    nights = device_nights(spark, sf).select("subject_id", "night_date", "sleep_start", "sleep_end")
    s = N.source_flags(_samples(spark, sf), "source_name", "metadata")
    return N.preferred_sample_stats(N.samples_in_nights(nights, s, strict=True), ["subject_id", "night_date", "metric"],
                                    finite_or_null("value"))


_DEV_SEG_SQL = f"""
SELECT *, coalesce(value_code = 0, false) AS c_in_bed, coalesce(value_code = 5, false) AS c_rem,
       coalesce(value_code = 4, false) AS c_deep, coalesce(value_code = 3, false) AS c_core,
       coalesce(value_code IN (1, 3, 4, 5), false) AS c_asleep, contains(lower(source_name), 'watch') AS is_watch
FROM ({B.SEGMENTS_SQL}) s"""
_DEV_NIGHTS_SQL = f"""
WITH s0 AS ({_DEV_SEG_SQL}),
s1 AS (SELECT s0.* FROM s0 JOIN (SELECT subject_id, max(start_ts) AS as_of FROM s0 GROUP BY 1) a USING (subject_id)
       WHERE start_ts >= as_of - INTERVAL 72 HOUR),
s2 AS (SELECT * FROM s1 WHERE NOT is_user_entered
         OR subject_id IN (SELECT subject_id FROM s1 GROUP BY 1 HAVING NOT bool_or(NOT is_user_entered))),
s3 AS (SELECT * FROM s2 WHERE (subject_id, night_date) IN (SELECT subject_id, max(night_date) FROM s2 GROUP BY 1)),
s4 AS (SELECT * FROM s3 WHERE is_watch
         OR (subject_id, night_date) IN (SELECT subject_id, night_date FROM s3 GROUP BY 1, 2 HAVING NOT bool_or(is_watch))),
n AS (SELECT subject_id, night_date, min(start_ts) AS sleep_start, max(end_ts) AS sleep_end,
       sum(CASE WHEN c_in_bed AND duration_min > 0 THEN duration_min ELSE CAST(0 AS DOUBLE) END) AS in_bed_minutes,
       sum(CASE WHEN c_rem AND duration_min > 0 THEN duration_min ELSE CAST(0 AS DOUBLE) END) AS rem_minutes,
       sum(CASE WHEN c_deep AND duration_min > 0 THEN duration_min ELSE CAST(0 AS DOUBLE) END) AS deep_minutes,
       sum(CASE WHEN c_core AND duration_min > 0 THEN duration_min ELSE CAST(0 AS DOUBLE) END) AS core_minutes,
       sum(CASE WHEN c_asleep AND duration_min > 0 THEN duration_min ELSE CAST(0 AS DOUBLE) END) AS asleep_minutes
      FROM s4 GROUP BY 1, 2)
SELECT subject_id, night_date, sleep_start, sleep_end, in_bed_minutes, rem_minutes, deep_minutes, core_minutes,
       asleep_minutes, {_pct_sql(zero_fill=True)} FROM n"""


@register("device_night_summary", op_ids="P4 P6 P13 P20 P21 W10 P24",
          sql=oracle_wrap(f"""SELECT subject_id, night_date, sleep_start AT TIME ZONE 'UTC' AS sleep_start,
 sleep_end AT TIME ZONE 'UTC' AS sleep_end, * EXCLUDE (subject_id, night_date, sleep_start, sleep_end)
 FROM ({_DEV_NIGHTS_SQL}) d""", _SUMMARY_COLS))
def q_device_nights(spark, sf):
    return presentable(device_nights(spark, sf))


_DEV_STATS_DOUBLES = ["m_mean", "m_min", "m_max", "m_median", "m_std", "watch_share"]


@register("device_metric_stats", op_ids="J2 P13 P21 P22 A3 A4",
          sql=oracle_wrap(f"""
WITH n AS ({_DEV_NIGHTS_SQL}),
h AS (SELECT n.night_date, s.*, contains(lower(s.source_name), 'watch') AS is_watch
      FROM n JOIN ({B.SAMPLES_SQL}) s ON s.subject_id = n.subject_id AND s.ts >= n.sleep_start AND s.end_ts <= n.sleep_end),
u AS (SELECT * FROM h WHERE NOT is_user_entered OR (subject_id, night_date, metric) IN
        (SELECT subject_id, night_date, metric FROM h GROUP BY ALL HAVING NOT bool_or(NOT is_user_entered))),
q AS (SELECT subject_id, night_date, metric, avg(CAST(is_watch AS DOUBLE)) AS watch_share FROM u GROUP BY ALL),
c AS (SELECT * FROM u WHERE is_watch OR (subject_id, night_date, metric) IN
        (SELECT subject_id, night_date, metric FROM u GROUP BY ALL HAVING NOT bool_or(is_watch))),
cq AS (SELECT subject_id, night_date, metric, count(*) AS sample_count,
         array_to_string(list_sort(list(DISTINCT source_name)), ', ') AS sources FROM c GROUP BY ALL),
f AS (SELECT * FROM c WHERE value IS NOT NULL AND isfinite(value)),
st AS (SELECT subject_id, night_date, metric, avg(value) AS m_mean, min(value) AS m_min, max(value) AS m_max,
         median(value) AS m_median, stddev_pop(value) AS m_std FROM f GROUP BY ALL)
SELECT st.*, cq.sample_count, cq.sources, q.watch_share FROM st JOIN q USING (subject_id, night_date, metric)
 JOIN cq USING (subject_id, night_date, metric)""",
                          _DEV_STATS_DOUBLES))
def q_device_metric_stats(spark, sf):
    return presentable(device_metric_stats(spark, sf))
