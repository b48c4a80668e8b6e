"""Registered queries for sources and sinks.

Readers are checked by a round trip: Spark writes data it derives from the
driver tables into a fresh folder under the shared checkpoint folder, the
reader under test loads it with a declared schema, and the oracle computes
the same rows from the tables directly.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from ..operators import nights as N
from ..sources import readers as S
from . import bindings as B
from .q_nights import _night_features_sql, _samples, _segments
from .registry import oracle_wrap, presentable, register

REC_COLS = ["record_type", "uuid", "source_name", "unit", "start_raw", "end_raw", "created_raw", "value_raw"]


def _records(spark, sf):
    return B.health_records(B.table(spark, sf, "events"))


@register("record_type_counts", op_ids="A1",
          sql=f"SELECT record_type, count(*) AS n FROM ({B.HEALTH_RECORDS_SQL}) r GROUP BY 1")
def q_type_counts(spark, sf):
    return S.record_type_counts(_records(spark, sf))


_STREAM_SQL = ("CASE record_type " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in S.RECORD_TYPES.items())
               + " END")
STREAMS_SQL = f"SELECT *, {_STREAM_SQL} AS metric FROM ({B.HEALTH_RECORDS_SQL}) r WHERE {_STREAM_SQL} IS NOT NULL"


@register("split_record_streams", op_ids="S2",
          sql=f"SELECT metric, subject_id, uuid, start_raw, value_raw FROM ({STREAMS_SQL}) s")
def q_streams(spark, sf):
    return S.split_record_streams(_records(spark, sf)).select("metric", "subject_id", "uuid", "start_raw", "value_raw")


@register("preview", op_ids="K7",
          sql=f"""SELECT metric, uuid, start_raw, value_raw FROM (SELECT *, row_number() OVER
 (PARTITION BY metric ORDER BY start_raw, uuid) AS rn FROM ({STREAMS_SQL}) s) p WHERE rn <= 20""")
def q_preview(spark, sf):
    return S.preview(S.split_record_streams(_records(spark, sf))).select("metric", "uuid", "start_raw", "value_raw")


_META_SQL = f"'HKWasUserEntered=' || CASE WHEN {B.USER_ENTERED_SQL} THEN '1' ELSE '0' END"


@register("read_health_records", op_ids="S1",
          sql=f"""SELECT CAST(r.subject_id AS VARCHAR) AS subject_id, {', '.join('r.' + c for c in REC_COLS)}, m.metadata
 FROM ({B.HEALTH_RECORDS_SQL}) r JOIN (SELECT CAST(event_id AS VARCHAR) AS id, {_META_SQL} AS metadata FROM events) m
 ON regexp_extract(r.uuid, '([0-9]+)', 1) = m.id""")
def q_xml(spark, sf):
    path = S.scratch_path(spark, "export-xml")
    S.write_health_records(_records(spark, sf), path)
    pairs = F.transform("metadata", lambda m: F.concat(m["key"], F.lit("="), m["value"]))
    return S.read_health_records(spark, path).select("subject_id", *REC_COLS, F.array_join(pairs, ";").alias("metadata"))


_BUNDLE_SQL = "CASE WHEN event_id % 3 = 0 THEN 'com.example.WatchKit.sleep' WHEN event_id % 3 = 1 THEN 'com.example.phone' END"


@register("source_flags", op_ids="P13",
          sql=f"""SELECT event_id, coalesce(contains(lower({B.SOURCE_SQL}), 'watch'), false)
 OR coalesce(contains(lower({_BUNDLE_SQL}), 'watch'), false) AS is_watch, {B.USER_ENTERED_SQL} AS is_user_entered FROM events""")
def q_flags(spark, sf):
    rows = _records(spark, sf).where(F.col("record_type") == S.RECORD_TYPES["hr"])
    rows = rows.withColumn("event_id", F.regexp_extract("uuid", r"([0-9]+)", 1).cast("long"))
    rows = rows.withColumn("bundle", F.expr(_BUNDLE_SQL))
    return N.source_flags(rows, metadata_col="metadata", bundle_col="bundle").select("event_id", "is_watch", "is_user_entered")


_FORMATS = ("parquet", "csv", "json")


@register("write_outputs", op_ids="S10 S2",
          sql=f"""SELECT fmt, metric, subject_id, uuid, start_raw, value_raw FROM ({STREAMS_SQL}) s,
 (VALUES {', '.join(f"('{f}')" for f in _FORMATS)}) f(fmt)""")
def q_write(spark, sf):
    """The streams written in every format, by stream, and read back whole."""
    rows = S.split_record_streams(_records(spark, sf)).select("metric", "subject_id", "uuid", "start_raw", "value_raw")
    out = None
    for fmt in _FORMATS:
        path = S.write_outputs(rows, S.scratch_path(spark, f"streams-{fmt}"), fmt, partition_by=["metric"])
        back = spark.read.format(fmt).option("header", True).schema(rows.schema).load(path)
        back = back.select(F.lit(fmt).alias("fmt"), *rows.columns)
        out = back if out is None else out.unionByName(back)
    return out


@register("read_sensor_text", op_ids="S4",
          sql=f"""SELECT time_s, CASE WHEN ingest_seq % 7 = 0 AND ingest_seq % 3 <> 1 THEN NULL ELSE x END AS x, y
FROM ({B.SENSOR_BASE_SQL}) b""")
def q_text(spark, sf):
    base = B.sensor_base(B.table(spark, sf, "events"))
    sep = F.when(F.col("ingest_seq") % 3 == 0, F.lit(",")).when(F.col("ingest_seq") % 3 == 1, F.lit(" ")) \
        .otherwise(F.lit(";"))
    # Blanks and short lines: a missing y ends the line after its separator or
    # (every other such line) before it, and some delimited lines lack x.
    blank_x = (F.col("ingest_seq") % 7 == 0) & (F.col("ingest_seq") % 3 != 1)
    end = F.when(F.col("y").isNotNull(), F.concat(sep, F.col("y").cast("string"))).when(
        F.col("ingest_seq") % 2 == 0, sep).otherwise("")
    lines = base.select(F.concat(F.col("time_s").cast("string"), sep, F.when(blank_x, "").otherwise(F.col("x").cast("string")),
                                 end).alias("value"))
    extra = base.select(F.col("subject_id")).distinct().select(
        F.explode(F.array(F.lit("# exported samples"), F.lit("time_s,x,y"))).alias("value"))
    path = S.scratch_path(spark, "sensor-text")
    lines.unionByName(extra).write.mode("overwrite").text(path)
    return S.read_sensor_text(spark, path, ["time_s", "x", "y"]).select("time_s", "x", "y")


_JSON_FEATS = N.NIGHT_FEATURES
JSON_SCHEMA = StructType([StructField("subject_id", LongType()), StructField("night_date", DateType())]
                         + [StructField(c, DoubleType()) for c in _JSON_FEATS])


@register("read_feature_json", op_ids="S8",
          sql=oracle_wrap(f"SELECT subject_id, night_date, {', '.join(_JSON_FEATS)} FROM ({_night_features_sql(False)}) n",
                          _JSON_FEATS))
def q_json(spark, sf):
    nights = N.night_features(_segments(spark, sf), _samples(spark, sf)).select("subject_id", "night_date",
                                                                                  *_JSON_FEATS)
    path = S.scratch_path(spark, "features-json")
    nights.write.mode("overwrite").json(path)
    return presentable(S.read_feature_json(spark, path, JSON_SCHEMA))


@register("load_model_data", op_ids="S9",
          sql=f"""SELECT subject_id, TRY_CAST(date AS DATE) AS date, fatigue_label, ingest_seq,
 TRY_CAST(date AS DATE) AS sort_key FROM ({B.LABEL_ROWS_SQL}) l""")
def q_csv(spark, sf):
    rows = B.night_label_rows(B.table(spark, sf, "events"))
    path = S.scratch_path(spark, "labels-csv")
    (rows.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return S.load_model_data(spark, path, S.LABEL_FILE_SCHEMA, ["date"]).select(
        "subject_id", "date", "fatigue_label", "ingest_seq", "sort_key")


@register("read_table_or_empty", op_ids="S3", sql=B.LABEL_ROWS_SQL)
def q_or_empty(spark, sf):
    rows = B.night_label_rows(B.table(spark, sf, "events"))
    path = S.scratch_path(spark, "labels-parquet")
    rows.write.mode("overwrite").parquet(path)
    present = S.read_table_or_empty(spark, path, S.LABEL_FILE_SCHEMA)
    absent = S.read_table_or_empty(spark, path + "-absent", S.LABEL_FILE_SCHEMA)
    return present.unionByName(absent)
