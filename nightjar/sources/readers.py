"""Sources and sinks with declared schemas.

S1 read_health_records (XML), S2 split_record_streams, S3
read_table_or_empty, S4 read_sensor_text, S8 read_feature_json, S9
load_model_data, S10 write_outputs, A1 record_type_counts, K7 preview.

Every reader declares its schema (no inference pass over the data) and
keeps file order as a column when it matters; no reader depends on one
file per task beyond what the format forces (a single XML file is split by
Spark's XML source on row tags).
"""
from __future__ import annotations

import itertools
import os
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.clean import to_numeric_or_null
from ..session import delete_folder

# Record type of each stream.
RECORD_TYPES = {
    "sleep": "HKCategoryTypeIdentifierSleepAnalysis",
    "hr": "HKQuantityTypeIdentifierHeartRate",
    "hrv": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "resp": "HKQuantityTypeIdentifierRespiratoryRate",
    "spo2": "HKQuantityTypeIdentifierOxygenSaturation",
}

RECORD_XML_SCHEMA = StructType([
    StructField("_type", StringType()), StructField("_uuid", StringType()),
    StructField("_sourceName", StringType()), StructField("_unit", StringType()),
    StructField("_creationDate", StringType()), StructField("_startDate", StringType()),
    StructField("_endDate", StringType()), StructField("_value", StringType()),
    StructField("MetadataEntry", ArrayType(StructType([StructField("_key", StringType()),
                                                        StructField("_value", StringType())]))),
])


_CORRUPT = "_corrupt_record"


#: Tasks that list the folders of an export; Spark takes one for each folder, up to 10,000.
LISTING = 200


def _raw_records(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([*RECORD_XML_SCHEMA.fields, StructField(_CORRUPT, StringType())])
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(min(LISTING, int(before))))
    try:  # files are listed here, not when the rows are read
        return (spark.read.format("xml").option("rowTag", "Record").option("attributePrefix", "_")
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
                .option("recursiveFileLookup", True).schema(schema).load(path))
    finally:
        spark.conf.set(tasks, before)


def _subject(subject_id: str | None):
    """Given, or from the path: a ``subject_id=`` folder, else the file's name."""
    if subject_id:
        return F.lit(subject_id)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"/subject_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/]+)\.xml$", 1))


def read_health_records(spark: SparkSession, path: str, subject_id: str | None = None) -> DataFrame:
    """Every ``Record`` element's attributes (all text) plus its metadata
    entries; the subject comes from the path unless given. Records that do not
    parse are not among them (``read_quarantine``)."""
    raw = _raw_records(spark, path).where(F.col(_CORRUPT).isNull())
    return raw.select(
        _subject(subject_id).alias("subject_id"), F.col("_type").alias("record_type"), F.col("_uuid").alias("uuid"),
        F.col("_sourceName").alias("source_name"), F.col("_unit").alias("unit"),
        F.col("_startDate").alias("start_raw"), F.col("_endDate").alias("end_raw"),
        F.col("_creationDate").alias("created_raw"), F.col("_value").alias("value_raw"),
        F.transform(F.coalesce(F.col("MetadataEntry"), F.array()),
                    lambda m: F.named_struct(F.lit("key"), m["_key"], F.lit("value"), m["_value"])).alias("metadata"))


def read_quarantine(spark: SparkSession, path: str, subject_id: str | None = None) -> DataFrame:
    """The text of every ``Record`` element that does not parse, with its
    subject and file, so that a broken record does not stop an import. Spark's
    XML reader does not go on behind it: later records of that file are in
    neither table, so a file that is named here has to be mended and read again."""
    return _raw_records(spark, path).where(F.col(_CORRUPT).isNotNull()).select(
        _subject(subject_id).alias("subject_id"), F.col("_metadata.file_path").alias("path"), F.col(_CORRUPT).alias("record"),
        F.col("_type").alias("record_type"))  # Spark refuses to read the broken text alone


#: Records of a subject that one task writes.
SUBJECT_RECORDS = 100_000


def write_health_records(records: DataFrame, path: str) -> None:
    """Writes records as export-style XML, for round trips: attributes, metadata
    entries as nested elements, one folder for each subject. A subject's records
    meet in one task, a large one's in several: files are about as many as
    subjects, not subjects times tasks. Tasks write each file under a hidden name
    and put it in place themselves, by Arrow where it knows the store: Spark's
    committer takes far longer over many small folders than the records do."""
    spark = records.sparkSession
    entries = (F.transform("metadata", lambda m: F.struct(m["key"].alias("_key"), m["value"].alias("_value")))
               if "metadata" in records.columns else F.lit(None).cast(RECORD_XML_SCHEMA["MetadataEntry"].dataType))
    out = records.select(
        "subject_id", F.col("record_type").alias("_type"), F.col("uuid").alias("_uuid"),
        F.col("source_name").alias("_sourceName"),
        F.col("unit").alias("_unit"), F.col("created_raw").alias("_creationDate"),
        F.col("start_raw").alias("_startDate"), F.col("end_raw").alias("_endDate"),
        F.col("value_raw").alias("_value"), entries.alias("MetadataEntry"))
    large = records.groupBy(F.col("subject_id").alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > SUBJECT_RECORDS)
    out = out.join(F.broadcast(large), F.col("subject_id").eqNullSafe(F.col("_large")), "left")
    share = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("_uuid", "_type", "_value"), F.ceil(F.col("_n") / SUBJECT_RECORDS)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = _arrow_uri(spark, path)
    if target is None:
        out = out.repartition(tasks, "subject_id", share).drop("_large", "_n")
        (out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("subject_id").format("xml").option("rootTag", "HealthData")
         .option("rowTag", "Record").option("attributePrefix", "_").save(path))
        return
    delete_folder(spark, path)
    record = F.to_xml(F.struct(*[c for c in out.columns if c not in ("subject_id", "_large", "_n")]),
                      {"rowTag": "Record", "attributePrefix": "_"})
    rows = out.select(F.col("subject_id").cast("string").alias("subject"), F.coalesce(share, F.lit(0)).cast("long").alias("share"),
                      record.alias("record"))
    rows = rows.repartition(tasks, "subject", "share").sortWithinPartitions("subject", "share")

    def write(batches):
        store, folder = fs.FileSystem.from_uri(target)
        files, key, to = 0, None, None
        hidden = f".{uuid.uuid4().hex}.xml"

        def finish():
            to.write(b"\n</HealthData>\n")
            to.close()
            store.move(f"{key[0]}/{hidden}", f"{key[0]}/part-{key[1]:05d}.xml")
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for (subject, part), lines in itertools.groupby(zip(keys, b.column(2).to_pylist()), lambda x: x[0]):
                here = (f"{folder}/subject_id={_folder_name(subject)}", part)
                if here != key:
                    if key:
                        finish()
                    key, files = here, files + 1
                    store.create_dir(key[0])
                    to = store.open_output_stream(f"{key[0]}/{hidden}", compression=None)
                    to.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<HealthData>')
                to.write("".join(f"\n{x}" for _, x in lines).encode())
        if key:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _arrow_uri(spark: SparkSession, path: str) -> str | None:
    """The address of a Hadoop path for Arrow; None where Arrow does not know its store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    uri = re.sub(r"^file:/+", "file:///", uri)
    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # no such store, or its library is not there
        return None
    return uri


def _folder_name(value: str | None) -> str:
    """As Spark names the folder of a partition's value."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def stream_of_type() -> F.Column:
    """Record type -> stream name as one map lookup (no five-way loop)."""
    m = F.create_map(*[x for k, v in RECORD_TYPES.items() for x in (F.lit(v), F.lit(k))])
    return m[F.col("record_type")]


def split_record_streams(records: DataFrame) -> DataFrame:
    """Exact-type routing to the five streams; other types dropped."""
    return records.withColumn("metric", stream_of_type()).filter(F.col("metric").isNotNull())


def write_streams(streams: DataFrame, path: str) -> None:
    """One table partitioned by stream (partition pruning for readers)."""
    streams.write.mode("overwrite").partitionBy("metric").parquet(path)


def land_export(spark: SparkSession, xml_path: str, out_path: str, subject_id: str | None = None) -> DataFrame:
    """S1 + S2 + S10: parse the export once and land every record to Parquet
    partitioned by stream (types outside the five streams under 'other').
    Type counts (A1) and previews (K7) then read the landed table; a stream
    read prunes to its partition."""
    rec = read_health_records(spark, xml_path, subject_id)
    landed = rec.withColumn("metric", F.coalesce(stream_of_type(), F.lit("other")))
    write_streams(landed, out_path)
    return spark.read.parquet(out_path)


def record_type_counts(records: DataFrame) -> DataFrame:
    """A1: records per type, most frequent first."""
    return records.groupBy("record_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "record_type")


def preview(streams: DataFrame, n: int = 20, order_cols: list[str] | None = None) -> DataFrame:
    """K7: first ``n`` rows per stream. ``row_number() <= n`` is planned with a
    per-partition group limit before the shuffle, so a big stream is not
    moved whole to one task."""
    order = order_cols or ["start_raw", "uuid"]
    w = Window.partitionBy("metric").orderBy(*order)
    return streams.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def read_table_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                        **options) -> DataFrame:
    """S3: declared-schema read; an absent input is an empty table with the
    same schema (no special cases downstream)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hpath)) and len(fs.globStatus(hpath)) > 0


def read_sensor_text(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """Delimited numeric samples (whitespace, comma, tab or semicolon),
    ``#`` comment lines and header lines dropped; columns declared per
    stream (e.g. time,x,y,z) instead of sniffed per file. One comma or
    semicolon, with the space around it, ends one field, so an empty field is
    a missing value; a short line lacks its last values; fields beyond the
    declared ones are ignored. Each row keeps its
    file path (for S5/S6) and its line position is not relied upon."""
    lines = spark.read.text(glob).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    body = lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split(line, r"\s*[,;]\s*|\s+")
    cols = [to_numeric_or_null(F.try_element_at(parts, F.lit(i + 1))).alias(c) for i, c in enumerate(columns)]
    out = body.select("path", *cols)
    # A header line has a non-numeric first field.
    return out.filter(F.col(columns[0]).isNotNull())


def read_feature_json(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """One object per line, or (``multiline``) one object or a list."""
    return spark.read.option("multiLine", multiline).schema(schema).json(path)


LABEL_FILE_SCHEMA = StructType([StructField("subject_id", LongType()), StructField("date", StringType()),
                                StructField("fatigue_label", StringType()), StructField("ingest_seq", LongType())])


def load_model_data(spark: SparkSession, path: str, schema: StructType, date_cols: list[str]) -> DataFrame:
    """Declared-schema CSV, dates parsed with bad -> null; the sort key is
    the first available of label_date, night_date, date, sleep_start, kept
    as a column (never row position)."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.withColumns({c: F.try_to_date(F.col(c)) for c in date_cols if c in df.columns})
    key = next((c for c in ["label_date", "night_date", "date", "sleep_start"] if c in df.columns), None)
    return df.withColumn("sort_key", F.col(key) if key else F.lit(None).cast("date"))


def write_outputs(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Overwrite a table (parquet / json / csv) and return its path."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster; tests set the folder when it is unset)."""
    from ..session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, "nightjar-io", f"{name}-{uuid.uuid4().hex[:12]}")
