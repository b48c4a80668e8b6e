"""Operator 2, exact dedup as a stateful stream.

Documents stream in by files; each task lower-cases A-Z and takes the SHA-256
of the text's bytes (no text leaves the JVM), and a streaming aggregation keeps, in disk-backed keyed
state (RocksDB) that never expires, one entry per digest: the stable
identifier that stays (largest id), the locator of its content (file and row
number) and the number of rows. Map-side combining makes a digest's rows of
one task one row before they are shuffled, so a hot digest stays cheap. New
files that reach the same checkpoint continue the same state.

The state is then read back as a table and joined to the rows' digests. On
every hit (a digest with several rows) the full bytes are checked: of the
rows of such digests the smallest and largest text are compared, both found
by aggregation with map-side combining, so a hot group never meets in one
task. Digests with different texts (which a sound digest never gives) are
grouped anew by the texts themselves.

Defined results: null text counts as empty; of equal texts with equal largest
ids the one with the last locator stays; a null id stays only in a group
without other ids; an empty table gives an empty result; other columns are
ignored. Texts of any length are taken whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, landed, scratch_dir

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Digests with several rows are sent to the texts up to this number (32 bytes
#: each; counted first), beyond it texts and digests are joined by shuffling.
BROADCAST_DIGESTS = 500_000
#: Input of one micro-batch.
BATCH_BYTES = 64 << 30
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no megabytes set aside for each store's log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text):
    """Digest of a text column, worked out in the JVM."""
    return F.unhex(F.sha2(text, 256))


def _plain(text: str = "text"):
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def _digests(rows: DataFrame, digest) -> DataFrame:
    """id, file, row, digest of each row. ``digest``: from a column of normalised
    texts to a binary column."""
    return rows.select("id", "file", "row", digest(_plain()).alias("digest"))


def _located(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def update_state(spark: SparkSession, path: str, checkpoint: str, *, id_col: str = "doc_id",
                 text_col: str = "text", batch_bytes: int = BATCH_BYTES, digest=sha256) -> None:
    """Run the stream over the files of ``path`` that ``checkpoint`` has not
    seen yet, and stop."""
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (spark.readStream.schema(spark.read.parquet(path).schema)
                  .option("maxBytesPerTrigger", str(batch_bytes)).parquet(_as_pattern(path)))
        state = (_digests(_located(stream, id_col, text_col), digest).groupBy("digest")
                 .agg(F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("order"), "file", "row", "id")).alias("last"),
                      F.count("*").alias("n")))
        query = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _as_pattern(path: str) -> str:
    """A pattern that only this path fits: the file source takes a single
    file only by pattern, and a folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep_id, keep_file, keep_row, n: what the stream retains."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType
    last, n = value.names
    return state.select("key.digest", F.col(f"value.`{last}`.id").alias("keep_id"),
                        F.col(f"value.`{last}`.file").alias("keep_file"),
                        F.col(f"value.`{last}`.row").alias("keep_row"), F.col(f"value.`{n}`").alias("n"))


def exact_duplicates(spark: SparkSession, path: str, *, checkpoint: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", batch_bytes: int = BATCH_BYTES, digest=sha256) -> DataFrame:
    """Per row of the table at ``path``: id_col, keep_id, group_size, kept, digest."""
    checkpoint = checkpoint or scratch_dir(spark, "dedup_state")
    names = dict(id_col=id_col, text_col=text_col)
    if not spark.read.parquet(path).select(id_col).take(1):
        return _digests(_located(spark.read.parquet(path), **names), digest).select(
            F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "digest")
    update_state(spark, path, checkpoint, batch_bytes=batch_bytes, digest=digest, **names)
    state = landed(read_state(spark, checkpoint), "dedup_entries")
    rows = landed(_digests(_located(spark.read.parquet(path), **names), digest), "dedup_digests")
    assigned = rows.join(state, "digest").select(
        "id", "keep_id", F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest")
    # full bytes of every hit
    hits = state.where("n > 1").select("digest")
    if hits.count() <= BROADCAST_DIGESTS:  # texts stay where they are, and equal ones are reduced there
        hits = F.broadcast(hits)
    texts = _located(spark.read.parquet(path), **names).withColumn("text", _plain()).withColumn("digest", digest(F.col("text")))
    full = texts.join(hits, "digest").select("digest", "id", "file", "row", "text")
    split = (full.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
             .where("a <> b").select("digest"))
    split = landed(split, "dedup_split")
    if not split.take(1):
        return assigned.withColumnRenamed("id", id_col)
    mixed = full.join(split, "digest")
    groups = mixed.groupBy("digest", "text").agg(
        F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("order"), "file", "row", "id")).alias("last"),
        F.count("*").alias("group_size"))
    anew = mixed.join(groups, ["digest", "text"]).select(
        "id", F.col("last.id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("last.file")) & (F.col("row") == F.col("last.row"))).alias("kept"), "digest")
    return assigned.join(split, "digest", "left_anti").select(anew.columns).unionByName(anew).withColumnRenamed("id", id_col)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
