"""One registered query per operator, over its whole table, and its DuckDB
SQL where SQL can say it. ``__spark_entry__`` adds them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, exact_dedup, language_id, line_dedup, ngram_join, packed_ids, packing, pii,
               ranked_search, simhash, spelling, url_filter, warc)
from .common import scratch_dir, table

#: Where the public vocabularies lie; None: where their package says.
TOKENIZER_FOLDER: str | None = None
#: The secret that surrogates depend on; a real run passes its own.
SURROGATE_KEY = b"nightjar surrogate key"


def tokenizer_path(name: str) -> str:
    if TOKENIZER_FOLDER is not None:
        return f"{TOKENIZER_FOLDER}/{name}"
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, SURROGATE_KEY)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("class_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                              keep=["doc_id"])
    return rows.select("doc_id", *[f"contamination.{c}" for c in
                                   ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "n_lines", "n_removed"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is their metadata's, the host their source."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_text_model(docs, text_col="text", label_col="lang")
    return language_id.identify(docs, model, id_col="doc_id", text_col="text", declared_col="lang", host_col="source",
                                suffix_col=None).drop("row_key")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over web pages, with all four kinds of evidence."""
    pages = language_id.page_columns(table(spark, sf_dir, "pages"))
    model = language_id.fit_text_model(pages, text_col="text_", label_col="declared_")
    return language_id.identify(pages, model, id_col="page_id", text_col="text_", declared_col="declared_",
                                host_col="host_", suffix_col="suffix_").drop("row_key")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.labelled_by_rules(pages, url_filter.RULES))
    return url_filter.judge_urls(pages, url_filter.RULES, model)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packed_ids.write_ids(table(spark, sf_dir, "documents"), scratch_dir(spark, "ids"),
                                    tokenizer_path("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return packed_ids.read_ids(spark, manifest)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(F.col("record_id").alias("page_id"), "payload_bytes",
                                                   "payload_digest", "record_type", "refers_to")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii_surrogates, op2_exact_dedup, op3_ngram_join, op4_decontamination, op5_packing, op6_line_dedup,
    op7_language_id, op8_url_filter, op9_token_ids, op10_warc, op11_simhash, op12_ranked_search,
    op13_spelling_variants, page_language)}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_ngram_join": f"WITH RECURSIVE {ngram_join.oracle_sql()} SELECT * FROM joined",
    "op4_decontamination": f"WITH {decontamination.oracle_ctes()} SELECT * FROM verdicts",
    "op6_line_dedup": line_dedup.oracle_sql() + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE c.clean_text END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN clean c USING (doc_id)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                  coalesce(html, '') AS body FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> winner THEN winner END AS refers_to
FROM w""",
    "op12_ranked_search": ranked_search.ORACLE_SQL,
}
