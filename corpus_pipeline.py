"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that its predecessor kept, as written Parquet,
and all but the last return the columns of ``documents``:

1. language ID: documents without a recognisable language go;
2. line dedup: boilerplate lines go from all documents but one (``n_chars`` is
   counted anew); a document that this leaves without any word goes, as all of
   its long lines stand in their homes. A document that came without a word
   stays as it is, and a near copy keeps the lines that differ, as a document
   of its own;
3. near duplicates: of each group of documents linked by five-word shingles
   with a Jaccard similarity of 0.8 or more, one row stays: that of the smallest
   id (null last; of rows that share it, one by hash). Rows are judged each, also
   where ids are null or repeated; of rows with one id and one text, one stays;
4. benchmark decontamination: documents that hold a test window go;
5. best-fit packing: the pieces of all that is left, with their sequences.

Null and repeated ids, null and empty texts and empty tables follow the rules
that the operators' modules state; extra columns are not carried.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm import decontamination, language_id, line_dedup, ngram_join, packing
from nightjar.llm.common import landed, scratch, scratch_dir, table
from nightjar.llm.queries import tokenizer_path
from nightjar.session import delete_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: What the near-duplicate stage takes for a word holds one of these.
WORD = r"[^\x20\x09-\x0D]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("_had_words", F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    cleaned = line_dedup.drop_boilerplate(docs)
    cleaned = cleaned.where(~(F.col("_had_words") & (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    # rows are told apart by id and text: ids may be null or repeated
    key = F.xxhash64("doc_id", "text")
    keyed = docs.withColumn("_key", key)
    classed = ngram_join.similar_documents(keyed, id_col="_key", size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    ids = landed(keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "row_keys")
    placed = landed(classed.select("_key", "component_id").distinct().join(ids, "_key"), "row_components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first")
    stays = placed.groupBy("component_id").agg(first).select("first._key")
    gone = placed.join(stays, "_key", "left_anti").select(F.col("_key").alias("_gone"))
    kept = docs.join(landed(gone, "near_duplicates"), key == F.col("_gone"), "left_anti")
    # only where rows share id and text do texts travel
    return kept.dropDuplicates(["doc_id", "text"]) if ids.where("n > 1").take(1) else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("NOT contamination.contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]

#: SQL has no tokenizer and no trained text model; tests/llm compares the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote besides its result, and the result that it
    read, go when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"stage_{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
