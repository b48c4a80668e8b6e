"""Operator 6, line dedup by distinct-site spread.

A line (trimmed of spaces, at least ``min_chars`` characters) that occurs on
``min_sites`` or more distinct sites is boilerplate. It stays in its home, the
document with the smallest id that holds it, and goes from every other one,
so no content is lost from the corpus.

Spread is estimated by one HyperLogLog sketch per line hash, merged by the
aggregation; lines whose estimate lies within ``margin`` (relative, at least
one site) of the threshold get an exact distinct count instead. Built-in
functions only.

Every document comes back, also one whose text becomes empty. Defined
results: null text stays null and has no lines; a null site counts as no site;
rows that share an id are cleaned alike, and a null id is an id of its own;
an empty table gives an empty result; shorter lines are never touched. Other
columns stay as they are, but for ``n_lines`` and ``n_removed``, which are
replaced.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, landed, pick

MIN_SITES, MIN_CHARS = 5, 20
LG_K, MARGIN = 12, 0.1


def _key(line):
    return F.xxhash64(F.trim(line))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("id", "site", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length(F.trim("line")) >= min_chars).select("id", "site", _key(F.col("line")).alias("line_hash"))


def boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K,
                margin: float = MARGIN) -> DataFrame:
    """line_hash, home (smallest id), for every boilerplate line."""
    lines = _lines(pick(docs, id=id_col, site=site_col, text=text_col), min_chars)
    band = max(1.0, margin * min_sites)
    spread = (lines.groupBy("line_hash")
              .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
                   F.min("id").alias("home"))
              .where(F.col("sites") >= min_sites - band))
    spread = landed(spread, "line_spread")
    sure = spread.where(F.col("sites") > min_sites + band)
    near = spread.where(F.col("sites") <= min_sites + band)
    exact = (lines.join(near.select("line_hash"), "line_hash", "left_semi")
             .groupBy("line_hash").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites))
    return sure.select("line_hash", "home").unionByName(
        near.join(exact.select("line_hash"), "line_hash", "left_semi").select("line_hash", "home"))


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K,
                     margin: float = MARGIN) -> DataFrame:
    """The rows of docs with boilerplate lines taken out of the text column,
    plus ``n_lines`` and ``n_removed`` (long)."""
    bad = landed(boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites,
                             min_chars=min_chars, lg_k=lg_k, margin=margin), "boilerplate")
    lines = _lines(pick(docs, id=id_col, site=site_col, text=text_col), min_chars)
    bad_, hit_id, kept_ = fresh(docs.columns, "_bad", "_hit_id", "_kept")
    hits = (lines.join(bad, "line_hash").where(~F.col("id").eqNullSafe(F.col("home")))
            .groupBy("id").agg(F.collect_set("line_hash").alias(bad_)).withColumnRenamed("id", hit_id))
    text = F.col(f"`{text_col}`")
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda x: ~((F.length(F.trim(x)) >= min_chars) & F.array_contains(F.col(bad_), _key(x))))
    return (docs.join(hits, docs[f"`{id_col}`"].eqNullSafe(hits[hit_id]), "left")
            .withColumn(kept_, F.when(F.col(bad_).isNull(), parts).otherwise(kept))
            .withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long"))
            .withColumn("n_lines", F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
            .withColumn("n_removed", F.when(text.isNull(), F.lit(0).cast("long"))
                        .otherwise(F.col("n_lines") - F.size(kept_).cast("long")))
            .withColumn(text_col, F.when(F.col(bad_).isNull(), text).otherwise(F.array_join(kept_, "\n")))
            .drop(kept_, bad_, hit_id))


def oracle_sql(relation: str = "documents", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """DuckDB: every document with its cleaned text, by exact distinct counts."""
    return f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM {relation} WHERE text IS NOT NULL
), bad AS (
  SELECT trim(line) AS key, min(doc_id) AS home FROM lines WHERE length(trim(line)) >= {min_chars}
  GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites}
), marked AS (
  SELECT l.doc_id, l.line, l.pos, (b.key IS NOT NULL AND l.doc_id <> b.home) AS gone
  FROM lines l LEFT JOIN bad b ON trim(l.line) = b.key
), clean AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean_text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id
)"""
