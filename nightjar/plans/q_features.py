"""Registered queries for feature spaces over labelled nights (F1-F4, P8,
P9, P14-P16, P23, A19, A20, W1-W4, J9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..functions.clean import safe_divide, sanitize_numeric
from ..operators import features as X
from ..operators import labels as L
from ..operators import nights as N
from . import bindings as B
from .q_labels import _labels
from .q_nights import _night_features_sql, _samples, _segments
from .registry import oracle_wrap, presentable, register

KEYS = ["subject_id", "night_date", "label_date", "label"]


def labelled_nights(spark, sf):
    """Model table: night features with their next-day label (labelled only)."""
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    return L.join_next_day_labels(nights, _labels(spark, sf)).filter(F.col("label").isNotNull())


MODEL_NIGHTS_SQL = f"""
SELECT n.subject_id, n.night_date, CAST(n.night_date + INTERVAL 1 DAY AS DATE) AS label_date, l.label,
       {', '.join('n.' + c for c in N.NIGHT_FEATURES)}
FROM ({_night_features_sql(False)}) n
JOIN ({B.DEDUP_LABELS_SQL}) l
  ON l.subject_id = n.subject_id AND l.label_date = CAST(n.night_date + INTERVAL 1 DAY AS DATE)"""


# ------------------------------------------------------------------ SQL generators
def _div(a, b):
    return f"({a} / NULLIF({b}, 0))"


RATIO_SQL = [
    "in_bed_minutes - asleep_minutes", _div("total_sleep_minutes", "in_bed_minutes"),
    _div("asleep_minutes", "in_bed_minutes"), _div("rem_minutes", "deep_minutes"),
    _div("deep_minutes", "core_minutes"), _div("rem_minutes", "total_sleep_minutes"),
    _div("deep_minutes", "total_sleep_minutes"), _div("core_minutes", "total_sleep_minutes"),
    "rem_minutes + deep_minutes - core_minutes", _div("hrv_mean", "hr_mean"),
    _div("resp_mean", "hr_mean"), "1.0 - spo2_mean",
]


def ratio_sql() -> list[str]:
    return [f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(RATIO_SQL, X.RATIO_COLUMNS)]


def missing_sql(cols) -> list[str]:
    miss = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)
    n = len(cols)
    return [f"{n} - ({miss}) AS observed_numeric_count", f"({miss}) AS missing_numeric_count",
            f"({miss}) / {float(n)} AS missing_numeric_rate", f"({n} - ({miss})) / {float(n)} AS observed_numeric_rate"]


def calendar_sql(col) -> list[str]:
    dow = f"CAST(isodow({col}) - 1 AS DOUBLE)"
    rad = f"(2 * pi() * (CAST(coalesce(month({col}), 1) AS DOUBLE) / 12.0))"
    return [f"{dow} AS day_of_week", f"coalesce(CAST({dow} >= 5 AS DOUBLE), 0.0) AS is_weekend",
            f"sin({rad}) AS month_sin", f"cos({rad}) AS month_cos"]


def rolling_sql(targets, order_col="label_date", part="subject_id") -> list[str]:
    out = []
    for t in targets:
        for k in X.ROLLING_WINDOWS:
            w = f"OVER (PARTITION BY {part} ORDER BY {order_col} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            out.append(f"avg({t}) {w} AS {t}_past{k}_mean")
            out.append(f"stddev_pop({t}) {w} AS {t}_past{k}_std")
            if k == X.ROLLING_WINDOWS[0]:
                out.append(f"{t} - lag({t}) OVER (PARTITION BY {part} ORDER BY {order_col}) AS {t}_delta")
            out.append(f"{t} - avg({t}) {w} AS {t}_past{k}_trend")
    return out


TRANSFER_NAMES = (X.MISSINGNESS_COLUMNS + X.RATIO_COLUMNS + X.CALENDAR_COLUMNS
                  + X.rolling_names(X.ROLLING_TARGETS))
TRANSFER_DOUBLES = [c for c in TRANSFER_NAMES if c not in ("observed_numeric_count", "missing_numeric_count")]


def _transfer_select_sql() -> str:
    return ", ".join(missing_sql(N.NIGHT_FEATURES) + ratio_sql() + calendar_sql("label_date")
                     + rolling_sql(X.ROLLING_TARGETS))


# ------------------------------------------------------------------ queries
@register("baseline_features", op_ids="F2 P14 P8",
          sql=oracle_wrap(MODEL_NIGHTS_SQL, N.NIGHT_FEATURES))
def q_baseline(spark, sf):
    df, cols = X.baseline_features(labelled_nights(spark, sf), KEYS)
    return presentable(df)


@register("transfer_features", op_ids="F3 A19 P23 F1 W1-W4", bench=True,
          sql=oracle_wrap(f"SELECT {', '.join(KEYS)}, {_transfer_select_sql()} FROM ({MODEL_NIGHTS_SQL}) m",
                          TRANSFER_DOUBLES))
def q_transfer(spark, sf):
    df, names = X.transfer_features(labelled_nights(spark, sf), KEYS)
    return presentable(df)


@register("combined_features", op_ids="F4 J9",
          sql=oracle_wrap(f"SELECT {', '.join(KEYS)}, {', '.join(N.NIGHT_FEATURES)}, {_transfer_select_sql()} "
                          f"FROM ({MODEL_NIGHTS_SQL}) m", N.NIGHT_FEATURES + TRANSFER_DOUBLES))
def q_combined(spark, sf):
    df, names = X.combined_features(labelled_nights(spark, sf), KEYS)
    return presentable(df)


@register("calendar_features", op_ids="F1",
          sql=oracle_wrap(f"SELECT subject_id, label_date, {', '.join(calendar_sql('label_date'))} "
                          f"FROM ({B.DEDUP_LABELS_SQL}) l", X.CALENDAR_COLUMNS))
def q_calendar(spark, sf):
    return presentable(_labels(spark, sf).select("subject_id", "label_date", *calendar_columns("label_date")))


@register("spread_features", op_ids="P23 P9",
          sql=oracle_wrap(f"SELECT subject_id, night_date, {', '.join(ratio_sql())} FROM ({MODEL_NIGHTS_SQL}) m",
                          X.RATIO_COLUMNS))
def q_spread(spark, sf):
    df = labelled_nights(spark, sf)
    return presentable(df.select("subject_id", "night_date", *X.spread_columns(df)))


@register("row_missingness", op_ids="A19",
          sql=oracle_wrap(f"SELECT subject_id, night_date, {', '.join(missing_sql(N.NIGHT_FEATURES))} "
                          f"FROM ({MODEL_NIGHTS_SQL}) m", ["missing_numeric_rate", "observed_numeric_rate"]))
def q_missingness(spark, sf):
    df = labelled_nights(spark, sf)
    return presentable(df.select("subject_id", "night_date", *X.missingness_columns(N.NIGHT_FEATURES)))


_MISS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in N.NIGHT_FEATURES)


@register("contract_missing_quality", op_ids="A20",
          sql=f"""SELECT subject_id, night_date, CAST({_MISS} AS INTEGER) AS missing_features,
 CASE WHEN {_MISS} <= 2 THEN 'Good' WHEN {_MISS} <= 8 THEN 'Fair' ELSE 'Poor' END AS data_quality
 FROM ({_night_features_sql(False)}) n""")
def q_quality(spark, sf):
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf))
    return X.contract_missing_quality(nights, N.NIGHT_FEATURES, ["subject_id", "night_date"])


def _rolling_query(kind: str):
    targets = ["total_sleep_minutes", "hr_mean", "hrv_std"]
    names = [n for n in X.rolling_names(targets) if n.endswith(kind)]

    def fn(spark, sf):
        df = labelled_nights(spark, sf)
        pairs = zip(X.rolling_names(targets), X.rolling_columns(targets, "label_date"))
        cols = [c for n, c in pairs if n in names]
        return presentable(df.select("subject_id", "label_date", *cols))

    sql_cols = [s for s in rolling_sql(targets) if s.split(" AS ")[-1] in names]
    sql = oracle_wrap(f"SELECT subject_id, label_date, {', '.join(sql_cols)} FROM ({MODEL_NIGHTS_SQL}) m", names)
    return fn, sql


for _name, _kind, _ids in [("previous_value_delta", "_delta", "W1"), ("past_rolling_mean", "_mean", "W2"),
                           ("past_rolling_std", "_std", "W3"), ("trend_vs_past", "_trend", "W4")]:
    _fn, _sql = _rolling_query(_kind)
    register(_name, sql=_sql, op_ids=_ids)(_fn)


@register("sanitize_numeric", op_ids="P8 P7",
          sql=oracle_wrap("""SELECT event_id,
 CASE WHEN isfinite(v) THEN v END AS ratio_value, CASE WHEN isfinite(k) THEN k END AS k_value
 FROM (SELECT event_id, value * CASE WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0 END AS v,
              TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e""",
                          ["ratio_value", "k_value"]))
def q_sanitize(spark, sf):
    ev = B.table(spark, sf, "events")
    # IEEE division (not ANSI) to create inf on purpose, then P8 cleans it.
    raw = ev.select("event_id",
                    (F.col("value") * F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)))
                    .alias("ratio_value"),
                    F.get_json_object("props", "$.k").alias("k_value"))
    return presentable(sanitize_numeric(raw.withColumn("k_value", F.col("k_value").try_cast("double")),
                                        ["ratio_value", "k_value"]))


@register("safe_divide", op_ids="P9",
          sql=oracle_wrap("""SELECT subject_id, night_date, rem_minutes / NULLIF(deep_minutes, 0) AS rem_per_deep,
 deep_minutes / NULLIF(in_bed_minutes, 0) AS deep_per_bed FROM (""" + MODEL_NIGHTS_SQL + ") m",
                          ["rem_per_deep", "deep_per_bed"]))
def q_safe_divide(spark, sf):
    df = labelled_nights(spark, sf)
    return presentable(df.select("subject_id", "night_date",
                                 safe_divide("rem_minutes", "deep_minutes").alias("rem_per_deep"),
                                 safe_divide("deep_minutes", "in_bed_minutes").alias("deep_per_bed")))


@register("drop_all_null_columns", op_ids="P15 P14",
          sql=oracle_wrap(f"""SELECT subject_id, night_date,
 {', '.join(c for c in N.NIGHT_FEATURES if not c.startswith(('resp', 'spo2')))} FROM ({MODEL_NIGHTS_SQL}) m""",
                          [c for c in N.NIGHT_FEATURES if not c.startswith(("resp", "spo2"))]))
def q_drop_null(spark, sf):
    # a device without the two slow sensors: their columns are all missing
    df = labelled_nights(spark, sf).withColumns({c: F.lit(None).cast("double") for c in N.NIGHT_FEATURES
                                                 if c.startswith(("resp", "spo2"))})
    cols = X.select_numeric_columns(df)
    return presentable(X.drop_all_null_columns(df, cols, keep=["subject_id", "night_date"]))


# A model column order that differs from the table (two columns
# absent, one text column coerced) for the alignment check.
ALIGN_ORDER = ["hr_mean", "sleep_quality_score", "total_sleep_minutes", "deep_pct", "hr_std", "device_temp"]


@register("align_to_schema", op_ids="P16",
          sql=oracle_wrap(f"""SELECT subject_id, night_date, hr_mean, CAST(NULL AS DOUBLE) AS sleep_quality_score,
 total_sleep_minutes, deep_pct, hr_std, CAST(NULL AS DOUBLE) AS device_temp FROM ({MODEL_NIGHTS_SQL}) m""",
                          [c for c in ALIGN_ORDER]))
def q_align(spark, sf):
    df = labelled_nights(spark, sf).withColumn("hr_std", F.col("hr_std").cast("string"))
    return presentable(X.align_to_schema(df, ALIGN_ORDER, keep=["subject_id", "night_date"]))
