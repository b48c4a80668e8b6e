"""Bindings of the driver's tables to the library's logical tables.

Everything here is derived by Spark from the given parquet tables, so the work
grows with them. The matching DuckDB text for each binding lives next to it
(``*_SQL``) so the oracle SQL is built from the same definitions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Health record type identifiers of the five streams.
RECORD_TYPES = {
    "sleep": "HKCategoryTypeIdentifierSleepAnalysis",
    "hr": "HKQuantityTypeIdentifierHeartRate",
    "hrv": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "resp": "HKQuantityTypeIdentifierRespiratoryRate",
    "spo2": "HKQuantityTypeIdentifierOxygenSaturation",
}

# Units of the quantity records.
UNITS = {"hr": "count/min", "hrv": "ms", "resp": "count/min", "spo2": "%"}

# Binding of event types to sleep stage values (in bed, core,
# deep, REM); 'error' events are not sleep records.
STAGE_OF_EVENT = {
    "view": "HKCategoryValueSleepAnalysisInBed",
    "click": "HKCategoryValueSleepAnalysisAsleepCore",
    "purchase": "HKCategoryValueSleepAnalysisAsleepDeep",
    "signup": "HKCategoryValueSleepAnalysisAsleepREM",
}
STAGE_CODE_OF_EVENT = {"view": 0, "click": 3, "purchase": 4, "signup": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- health records
def _offset_text() -> F.Column:
    # Each subject records in its own UTC offset: -00:00 .. -03:00 by user id.
    return F.concat(F.lit("-0"), (F.col("user_id") % 4).cast("string"), F.lit("00"))


def _stamp(ts: F.Column) -> F.Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), _offset_text())


def _stage_text() -> F.Column:
    expr = F.lit(None).cast("string")
    for ev, stage in STAGE_OF_EVENT.items():
        expr = F.when(F.col("event_type") == ev, F.lit(stage)).otherwise(expr)
    return expr


def _stage_code() -> F.Column:
    expr = F.lit(None).cast("int")
    for ev, code in STAGE_CODE_OF_EVENT.items():
        expr = F.when(F.col("event_type") == ev, F.lit(code)).otherwise(expr)
    return expr


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").try_cast("long")


def _source_name() -> F.Column:
    # Watch source unless props.k is a multiple of 3.
    return F.concat(F.when(_k() % 3 != 0, F.lit("Apple Watch of ")).otherwise(F.lit("iPhone of ")),
                    F.col("user_id").cast("string"))


def _metadata() -> F.Column:
    # User-entered when props.k is even.
    flag = F.when(_k() % 2 == 0, F.lit("1")).otherwise(F.lit("0"))
    return F.array(F.named_struct(F.lit("key"), F.lit("HKWasUserEntered"), F.lit("value"), flag))


def sleep_records(events: DataFrame) -> DataFrame:
    """Sleep records as exported text: start = ts, end = start + ``value``
    minutes truncated to whole seconds, stage from the event type."""
    end = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("long"), F.col("ts"))
    return (events.filter(F.col("event_type") != "error")
            .select(F.col("user_id").alias("subject_id"),
                    F.col("event_id").cast("string").alias("uuid"),
                    F.col("event_id").alias("ingest_seq"),
                    _source_name().alias("source_name"),
                    _metadata().alias("metadata"),
                    _stamp(F.col("ts")).alias("start_raw"),
                    _stamp(end).alias("end_raw"),
                    _stage_text().alias("value_raw"),
                    _stage_code().alias("value_code")))


def metric_records(events: DataFrame) -> DataFrame:
    """Quantity records: heart rate = ``value`` for every event, HRV =
    ``props.k``, respiratory rate and oxygen saturation from the event number
    (every third and every second event has one).

    One scan of ``events``; the four streams come out of ``inline`` over an
    array, not a union of scans.
    """
    stamp = _stamp(F.col("ts"))
    number = F.col("event_id")
    resp = F.when(number % 3 == 0, (12 + number % 9).cast("string"))
    spo2 = F.when(number % 2 == 0, F.concat(F.lit("0.9"), (number % 10).cast("string")))
    rows = F.filter(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value_raw")) for m, v in (
        ("hr", F.col("value").cast("string")), ("hrv", F.get_json_object("props", "$.k")), ("resp", resp), ("spo2", spo2))]),
        lambda r: r["metric"].isin("hr", "hrv") | r["value_raw"].isNotNull())
    end = _stamp(F.timestamp_add("SECOND", F.coalesce(_k(), F.lit(0)), F.col("ts")))
    return events.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("ingest_seq"),
                         F.col("event_type"), _source_name().alias("source_name"), _metadata().alias("metadata"),
                         stamp.alias("start_raw"), end.alias("end_raw"), F.inline(rows))


def metric_samples(events: DataFrame) -> DataFrame:
    """(subject_id, metric, ts instant, value) parsed from the metric records."""
    from ..functions.clean import to_numeric_or_null
    from ..functions.timeparse import parse_offset_instant
    rec = metric_records(events)
    return rec.select("subject_id", "metric", "ingest_seq", "event_type", "source_name", "metadata",
                      parse_offset_instant("start_raw").alias("ts"),
                      parse_offset_instant("end_raw").alias("end_ts"),
                      to_numeric_or_null("value_raw").alias("value"))


# DuckDB text of the same bindings (used by the oracle SQL).
OFFSET_SQL = "('-0' || CAST(user_id % 4 AS VARCHAR) || '00')"
STAMP_SQL = "(strftime({ts}, '%Y-%m-%d %H:%M:%S') || ' ' || " + OFFSET_SQL + ")"
K_SQL = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
SOURCE_SQL = f"(CASE WHEN {K_SQL} % 3 <> 0 THEN 'Apple Watch of ' ELSE 'iPhone of ' END || CAST(user_id AS VARCHAR))"
USER_ENTERED_SQL = f"coalesce({K_SQL} % 2 = 0, false)"
SLEEP_RECORDS_SQL = f"""
SELECT user_id AS subject_id, CAST(event_id AS VARCHAR) AS uuid, event_id AS ingest_seq,
       {SOURCE_SQL} AS source_name, {USER_ENTERED_SQL} AS is_user_entered,
       {STAMP_SQL.format(ts='ts')} AS start_raw,
       {STAMP_SQL.format(ts="ts + to_seconds(CAST(floor(value * 60) AS BIGINT))")} AS end_raw,
       CASE event_type {' '.join(f"WHEN '{e}' THEN '{s}'" for e, s in STAGE_OF_EVENT.items())} END AS value_raw,
       CASE event_type {' '.join(f"WHEN '{e}' THEN {c}" for e, c in STAGE_CODE_OF_EVENT.items())} END AS value_code
FROM events WHERE event_type <> 'error'
"""
SEGMENTS_SQL = f"""
SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0 AS duration_min,
       CAST(start_local - INTERVAL 6 HOUR AS DATE) AS night_date,
       contains(lower(value_raw), 'inbed') AS is_in_bed, contains(lower(value_raw), 'rem') AS is_rem,
       contains(lower(value_raw), 'deep') AS is_deep, contains(lower(value_raw), 'core') AS is_core,
       contains(lower(value_raw), 'asleep') AS is_asleep
FROM (SELECT *, strptime(start_raw, '%Y-%m-%d %H:%M:%S %z') AS start_ts,
             strptime(end_raw, '%Y-%m-%d %H:%M:%S %z') AS end_ts,
             CAST(substr(start_raw, 1, 19) AS TIMESTAMP) AS start_local
      FROM ({SLEEP_RECORDS_SQL}) r) p
"""
_SAMPLE_COMMON = f"""user_id AS subject_id, event_id AS ingest_seq, event_type, {SOURCE_SQL} AS source_name,
       {USER_ENTERED_SQL} AS is_user_entered,
       strptime({STAMP_SQL.format(ts='ts')}, '%Y-%m-%d %H:%M:%S %z') AS ts,
       strptime({STAMP_SQL.format(ts=f"ts + to_seconds(coalesce({K_SQL}, 0))")}, '%Y-%m-%d %H:%M:%S %z') AS end_ts"""
SAMPLES_SQL = f"""
SELECT 'hr' AS metric, {_SAMPLE_COMMON}, CAST(value AS DOUBLE) AS value FROM events
UNION ALL
SELECT 'hrv' AS metric, {_SAMPLE_COMMON}, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events
UNION ALL
SELECT 'resp' AS metric, {_SAMPLE_COMMON}, CAST(12 + event_id % 9 AS DOUBLE) AS value FROM events WHERE event_id % 3 = 0
UNION ALL
SELECT 'spo2' AS metric, {_SAMPLE_COMMON}, CAST('0.9' || CAST(event_id % 10 AS VARCHAR) AS DOUBLE) AS value
FROM events WHERE event_id % 2 = 0
"""


# ---------------------------------------------------------------- night labels
def night_label_rows(events: DataFrame) -> DataFrame:
    """Label file rows derived from events: one row per event for the next
    day of its night, label ``(user_id + day) % 2``; dates where
    ``(user_id + day) % 5 == 0`` are absent; a fixed rule on ``event_id`` plants
    bad dates, bad labels and padded labels. Several events per night make
    duplicate dates (first by ``ingest_seq`` wins)."""
    label_date = F.date_add(F.to_date(F.col("ts") - F.expr("INTERVAL 6 HOURS")), 1)
    key = F.col("user_id") + F.dayofmonth(label_date)
    lab = (key % 2).cast("string")
    label_raw = (F.when(F.col("event_id") % 97 == 0, F.lit("Low"))
                 .when(F.col("event_id") % 89 == 0, F.lit("1.0"))
                 .when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), lab, F.lit(" ")))
                 .otherwise(lab))
    date_raw = F.when(F.col("event_id") % 101 == 0, F.lit("not-a-date")).otherwise(
        F.date_format(label_date, "yyyy-MM-dd"))
    return (events.filter(key % 5 != 0)
            .select(F.col("user_id").alias("subject_id"), date_raw.alias("date"),
                    label_raw.alias("fatigue_label"), F.col("event_id").alias("ingest_seq")))


LABEL_ROWS_SQL = """
SELECT user_id AS subject_id,
       CASE WHEN event_id % 101 = 0 THEN 'not-a-date' ELSE strftime(ld, '%Y-%m-%d') END AS date,
       CASE WHEN event_id % 97 = 0 THEN 'Low' WHEN event_id % 89 = 0 THEN '1.0'
            WHEN event_id % 7 = 0 THEN ' ' || CAST((user_id + day(ld)) % 2 AS VARCHAR) || ' '
            ELSE CAST((user_id + day(ld)) % 2 AS VARCHAR) END AS fatigue_label,
       event_id AS ingest_seq
FROM (SELECT *, CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) + INTERVAL 1 DAY AS DATE) AS ld FROM events) e
WHERE (user_id + day(ld)) % 5 <> 0
"""
VALID_LABELS_SQL = f"""
SELECT *, TRY_CAST(date AS DATE) AS label_date,
       CASE WHEN trim(fatigue_label) IN ('0', '1') THEN CAST(trim(fatigue_label) AS INTEGER) END AS label,
       (TRY_CAST(date AS DATE) IS NOT NULL AND trim(fatigue_label) IN ('0', '1')) AS is_valid,
       CASE WHEN TRY_CAST(date AS DATE) IS NULL THEN 'bad_date'
            WHEN NOT trim(fatigue_label) IN ('0', '1') THEN 'bad_label' END AS problem
FROM ({LABEL_ROWS_SQL}) l
"""
DEDUP_LABELS_SQL = f"""
SELECT subject_id, label_date, arg_min(label, ingest_seq) AS label, min(ingest_seq) AS ingest_seq
FROM ({VALID_LABELS_SQL}) v WHERE is_valid GROUP BY subject_id, label_date
"""


# ---------------------------------------------------------------- model rows
# lineitem as labelled model rows: subject l_suppkey, time l_shipdate, four
# numeric features, binary target l_returnflag = 'R'. The order key is unique.
MODEL_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MODEL_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MODEL_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def model_rows(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        *[c for c in MODEL_ORDER], F.col("l_returnflag"),
        F.col("l_suppkey").alias("subject_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"))


MODEL_ROWS_SQL = f"""
SELECT {', '.join(MODEL_ORDER)}, l_returnflag, l_suppkey AS subject_id,
       CAST(l_returnflag = 'R' AS INTEGER) AS target FROM lineitem
"""
MODEL_POS_SQL = f"""
SELECT *, row_number() OVER (ORDER BY {', '.join(MODEL_ORDER)}) - 1 AS pos, count(*) OVER () AS n
FROM ({MODEL_ROWS_SQL}) m
"""


# ---------------------------------------------------------------- predictions
# lineitem model rows scored by a fixed linear contract (own constants, not a
# fitted model): the prediction table behind metrics, sweeps and robustness.
LINEITEM_CONTRACT = {
    "feature_order": MODEL_FEATURES,
    "imputer_median": [25.0, 36000.0, 0.05, 0.04],
    "scaler_mean": [25.5, 38000.0, 0.05, 0.04],
    "scaler_scale": [14.4, 23000.0, 0.0316, 0.0258],
    "coef": [0.35, -0.25, 0.3, -0.2],
    "intercept": 0.05,
    "classes": [0, 1],
}


def contract_logit_sql(c: dict, value_sql=lambda f: f) -> str:
    terms = [f"{float(c['intercept'])!r}"]
    for f, med, mu, sc, w in zip(c["feature_order"], c["imputer_median"], c["scaler_mean"],
                                 c["scaler_scale"], c["coef"]):
        scale = sc if sc != 0 else 1.0
        terms.append(f"{float(w)!r} * ((coalesce({value_sql(f)}, {float(med)!r}) - {float(mu)!r}) / {float(scale)!r})")
    return " + ".join(terms)


def predictions(lineitem: DataFrame) -> DataFrame:
    from ..operators.scoring import LinearContract, score_linear_contract
    c = LinearContract.from_mapping(LINEITEM_CONTRACT)
    return score_linear_contract(model_rows(lineitem), c)


PREDICTIONS_SQL = f"""
SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS predicted_label FROM (
  SELECT *, 1.0 / (1.0 + exp(-logit)) AS p1 FROM (
    SELECT *, {contract_logit_sql(LINEITEM_CONTRACT)} AS logit FROM ({MODEL_ROWS_SQL}) m) a) b
"""


# ---------------------------------------------------------------- model runs
# Candidate models bound to event types; latency measurements are
# events.value / 10 ms, model size is the mean props.k times a family factor,
# and each model's predictions are the lineitem predictions at its own
# threshold.
MODEL_OF_EVENT = {
    "view": ("logreg_c0_1", 0.45, 0.1),
    "click": ("logreg_c1_0", 0.50, 0.1),
    "purchase": ("sgd_a1e-4", 0.55, 0.1),
    "signup": ("rf_small_n64_d6", 0.40, 20.0),
    "error": ("rf_small_n96_d8", 0.60, 25.0),
}


def model_table(spark: SparkSession) -> DataFrame:
    """The five candidate definitions (a fixed 5-row parameter table)."""
    rows = [(ev, name, float(t), float(f)) for ev, (name, t, f) in MODEL_OF_EVENT.items()]
    return spark.createDataFrame(rows, "event_type string, model_name string, threshold double, size_factor double")


def model_table_sql() -> str:
    vals = ", ".join(f"('{ev}', '{n}', {t!r}, {f!r})" for ev, (n, t, f) in MODEL_OF_EVENT.items())
    return f"SELECT * FROM (VALUES {vals}) v(event_type, model_name, threshold, size_factor)"


# ---------------------------------------------------------------- sensor streams
# events as a sensor archive: motion x = value, y = props.k (no z axis);
# heart rate from view/click events; steps (= props.k) from purchase events;
# labels = event type at the event time. Fixed value: 30-second windows.
SENSOR_WINDOW_S = 30.0


def sensor_base(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("events").alias("dataset_name"), F.col("user_id").cast("string").alias("subject_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time_s"),
        F.col("value").alias("x"), _k().cast("double").alias("y"), F.col("event_type"),
        F.col("event_id").alias("ingest_seq"))


SENSOR_BASE_SQL = """
SELECT 'events' AS dataset_name, CAST(user_id AS VARCHAR) AS subject_id, epoch_us(ts) / 1e6 AS time_s,
       value AS x, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type, event_id AS ingest_seq
FROM events"""


def order_samples(orders: DataFrame) -> DataFrame:
    """orders as a second archive: subject = customer, a file for each order
    priority, time = order date."""
    return orders.select(
        F.lit("orders").alias("dataset_name"), F.col("o_custkey").cast("string").alias("subject_id"),
        F.concat(F.col("o_orderpriority"), F.lit(".csv")).alias("source_file"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)).alias("time_s"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ingest_seq"))


ORDER_SAMPLES_SQL = """
SELECT 'orders' AS dataset_name, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderpriority || '.csv' AS source_file, epoch_us(o_orderdate) / 1e6 AS time_s,
       o_totalprice AS price, o_orderkey AS ingest_seq FROM orders"""


def order_labels(orders: DataFrame) -> DataFrame:
    """Label files of an archive whose subjects are customers: some have no
    motion under their id, and some subjects with motion have no labels."""
    return order_samples(orders).select(F.lit("events").alias("dataset_name"), "subject_id", "time_s", "ingest_seq").join(
        orders.select(F.col("o_orderkey").alias("ingest_seq"), F.col("o_orderstatus").alias("label")), "ingest_seq")


# ---------------------------------------------------------------- raw health records
def health_records(events: DataFrame) -> DataFrame:
    """All records of the export: sleep records plus the four kinds of
    quantity records, in the raw text form of the XML attributes."""
    sleep = sleep_records(events).select(
        "subject_id", F.lit(RECORD_TYPES["sleep"]).alias("record_type"), "uuid", "source_name",
        F.lit(None).cast("string").alias("unit"), "start_raw", "end_raw", F.col("start_raw").alias("created_raw"),
        "value_raw", "metadata")
    q = metric_records(events).select(
        "subject_id",
        F.create_map(*[F.lit(x) for m, t in RECORD_TYPES.items() for x in (m, t)])[F.col("metric")].alias("record_type"),
        F.concat(F.col("ingest_seq").cast("string"), F.lit("-"), F.col("metric")).alias("uuid"), "source_name",
        F.create_map(*[F.lit(x) for m, u in UNITS.items() for x in (m, u)])[F.col("metric")].alias("unit"),
        "start_raw", "end_raw", F.col("start_raw").alias("created_raw"), "value_raw", "metadata")
    return sleep.unionByName(q)


HEALTH_RECORDS_SQL = f"""
SELECT subject_id, '{RECORD_TYPES['sleep']}' AS record_type, uuid, source_name, CAST(NULL AS VARCHAR) AS unit,
       start_raw, end_raw, start_raw AS created_raw, value_raw FROM ({SLEEP_RECORDS_SQL}) s
UNION ALL
SELECT user_id, '{RECORD_TYPES['hr']}', CAST(event_id AS VARCHAR) || '-hr', {SOURCE_SQL}, 'count/min',
       {STAMP_SQL.format(ts='ts')}, {STAMP_SQL.format(ts=f"ts + to_seconds(coalesce({K_SQL}, 0))")},
       {STAMP_SQL.format(ts='ts')}, CAST(value AS VARCHAR) FROM events
UNION ALL
SELECT user_id, '{RECORD_TYPES['hrv']}', CAST(event_id AS VARCHAR) || '-hrv', {SOURCE_SQL}, 'ms',
       {STAMP_SQL.format(ts='ts')}, {STAMP_SQL.format(ts=f"ts + to_seconds(coalesce({K_SQL}, 0))")},
       {STAMP_SQL.format(ts='ts')}, json_extract_string(props, '$.k') FROM events
UNION ALL
SELECT user_id, '{RECORD_TYPES['resp']}', CAST(event_id AS VARCHAR) || '-resp', {SOURCE_SQL}, 'count/min',
       {STAMP_SQL.format(ts='ts')}, {STAMP_SQL.format(ts=f"ts + to_seconds(coalesce({K_SQL}, 0))")},
       {STAMP_SQL.format(ts='ts')}, CAST(12 + event_id % 9 AS VARCHAR) FROM events WHERE event_id % 3 = 0
UNION ALL
SELECT user_id, '{RECORD_TYPES['spo2']}', CAST(event_id AS VARCHAR) || '-spo2', {SOURCE_SQL}, '%',
       {STAMP_SQL.format(ts='ts')}, {STAMP_SQL.format(ts=f"ts + to_seconds(coalesce({K_SQL}, 0))")},
       {STAMP_SQL.format(ts='ts')}, '0.9' || CAST(event_id % 10 AS VARCHAR) FROM events WHERE event_id % 2 = 0
"""
