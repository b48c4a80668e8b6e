"""Operator 7, language ID by Bayesian evidence fusion.

For every language l the log posterior of a document is

    text likelihood + log P(declared | l) + log P(suffix | l) + log P(l | host)

* text: byte trigrams of letters and spaces under a multinomial model per
  language, tempered because neighbouring trigrams overlap (numbers, hashes
  and punctuation are of no language and are left out);
* declared: the language that markup or metadata declares, with a confusion
  table of declared values against what the texts alone say;
* suffix: the last label of the address, likewise;
* host: a prior smoothed towards the host's domain, the domain's towards the
  whole corpus; each document's own vote is left out of its host's counts.

All counts are grouped aggregations over all documents; the trigram model is
fitted on a bounded sample of distinct labelled texts: ``fit_rows`` expected,
an equal share for each language, chosen by the hash of the text and label, the
same at every layout. Labels are counted over all rows: every label of
``MIN_ROWS`` rows is a language, on small tables also one of ``MIN_SHARE``. A further class, unknown, has
uniform trigrams and the prior ``UNKNOWN_PRIOR``; documents it wins, and
documents without any letter, are rejected (language ``und``). The other
evidence counts for the unknown class as for its best language, so it is the
text that decides on rejection.

Defined results: null or empty text has no letter; a text with letters but no
trigram goes by the other evidence; null declared value, suffix or host adds no evidence; rows that share an id are
judged each; without labelled rows every document is rejected; an empty table
gives an empty result. Whole texts are scored. Other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import landed, map_arrow, pick, schema_of
from .textblocks import blocks, column_bytes

FIT_ROWS = 20_000
#: Labels of fewer rows are taken for noise.
MIN_ROWS = 10
BUCKETS = 1 << 14
SMOOTH, TEMPER = 0.5, 3.0
UNKNOWN, UNKNOWN_PRIOR = "und", 1e-3
HOST_WEIGHT, DOMAIN_WEIGHT = 10.0, 100.0
#: Evidence tables of at most so many rows (counted first) are broadcast.
BROADCAST_VALUES = 50_000
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_USED = _LETTER.copy()
_USED[32] = True


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of every trigram of letters and spaces."""
    b, used = _LOWER[raw], _USED[raw]
    at = np.flatnonzero(used[:-2] & used[1:-1] & used[2:])
    x = b[at] | (b[at + 1] << np.uint32(8)) | (b[at + 2] << np.uint32(16))
    return at, ((x * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # [languages, buckets]

    def score(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters and trigrams of each row, log likelihood of each language
        and row."""
        raw, off = column_bytes(col)
        n = len(off) - 1
        letters, grams, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((len(self.languages), n))
        for i, j in blocks(off):
            lo, hi = int(off[i]), int(off[j])
            sums = np.concatenate(([0], np.cumsum(_LETTER[raw[lo:hi]])))
            letters[i:j] = np.diff(sums[off[i:j + 1] - lo])
            at, g = _grams(raw[lo:hi])
            # trigrams that start in a text's last two bytes are not its own
            first = np.searchsorted(at, off[i:j] - lo)
            last = np.maximum(np.searchsorted(at, off[i + 1:j + 1] - lo - 2), first)
            grams[i:j] = last - first
            for k in range(len(self.languages)):
                acc = np.concatenate(([0.0], np.cumsum(self.log_p[k][g], dtype=np.float64)))
                score[k, i:j] = acc[last] - acc[first]
        return letters, grams, score


def fit_text_model(rows: DataFrame, *, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> TextModel:
    own = pick(rows, text=text_col, label=label_col).where("label IS NOT NULL AND octet_length(text) >= 3")
    own = own.select("text", "label", F.xxhash64("text", "label").alias("key"))
    labels = landed(own.groupBy("label", "key").agg(F.count("*").alias("n"))
                    .groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "labels")
    known = labels.where(F.col("n") >= MIN_ROWS)
    quota = max(MIN_ROWS, fit_rows // max(1, known.count()))
    limits = known.select("label", F.least(F.lit(1 << 30), F.lit(quota << 30) / F.col("texts")).cast("long").alias("limit"))

    def once(batches):
        """A text that many rows share goes on once from a task."""
        seen: set[int] = set()
        for b in batches:
            new = []
            for r, key in enumerate(b.column(2).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(r)
            yield b.take(pa.array(new, pa.int64()))

    sample = (own.join(F.broadcast(limits), "label").where(F.pmod("key", F.lit(1 << 30)) < F.col("limit"))
              .select("text", "label", "key").transform(map_arrow, once, "text string, label string, key long")
              .dropDuplicates(["key"]).select("text", "label"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            raw, off = column_bytes(b.column(0))
            for r, label in enumerate(b.column(1).to_pylist()):
                text = raw[off[r]:off[r + 1]]
                if len(text) >= 3:
                    total.setdefault(label, np.zeros(BUCKETS, np.int64))
                    total[label] += np.bincount(_grams(text)[1], minlength=BUCKETS)
                    seen[label] = seen.get(label, 0) + 1
        for label, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * (len(at) + 1), pa.string()),
                                              "bucket": pa.array(np.append(at, -1), pa.int32()),
                                              "n": pa.array(np.append(counts[at], seen[label]), pa.int64())})

    counts = landed(sample.transform(map_arrow, count, "label string, bucket int, n long")
                    .groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    seen = {r["label"]: r["n"] for r in counts.where("bucket = -1").collect()}
    languages = sorted(seen)
    table = np.full((len(languages), BUCKETS), SMOOTH)
    index = {x: k for k, x in enumerate(languages)}
    for r in counts.where("bucket >= 0").collect():
        table[index[r["label"]], r["bucket"]] += r["n"]
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _domain(host):
    """The host's last two labels (an address without dots is its own domain)."""
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def identify(docs: DataFrame, model: TextModel, *, id_col: str, text_col: str, declared_col: str | None,
             host_col: str | None, suffix_col: str | None) -> DataFrame:
    """id_col, row_key, language, confidence, text_language, accepted."""
    rows = pick(docs, id=id_col, text=text_col, declared=declared_col, host=host_col, suffix=suffix_col)
    k = len(model.languages)
    rows = rows.select("id", row_key_of("text", "declared", "host", "suffix").alias("row_key"), "declared",
                       "host", "suffix", F.col("text").cast("string").alias("text"))
    if not k:
        return rows.select(F.col("id").alias(id_col), "row_key", F.lit(UNKNOWN).alias("language"),
                           F.lit(1.0).alias("confidence"), F.lit(UNKNOWN).alias("text_language"),
                           F.lit(False).alias("accepted"))
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]
    kept = rows.schema.fields[:5]
    out = T.StructType(kept + schema_of("letters long, grams long, best int").fields + [T.StructField(c, T.DoubleType()) for c in names])

    def score(batches):
        m = share.value
        for b in batches:
            letters, grams, s = m.score(b.column(5))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(letters), pa.array(grams), pa.array(s.argmax(axis=0).astype(np.int32)),
                 *[pa.array(x / TEMPER) for x in s]], names=out.names)

    scored = landed(rows.transform(map_arrow, score, out), "language_scores")
    votes = scored.where("grams > 0")
    ones = [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(k)]
    total = votes.agg(*[F.coalesce(c, F.lit(0)).alias(f"n{i}") for i, c in enumerate(ones)]).first()
    total = np.array([total[f"n{i}"] for i in range(k)], float)
    prior = (total + 1) / (total + 1).sum()

    def small(t: DataFrame, n: int) -> DataFrame:
        """A table of few values goes to the rows, so that a value that most
        rows share is no hot key; a larger one is joined by shuffling."""
        return F.broadcast(t) if n <= BROADCAST_VALUES else t

    def given(column: str) -> DataFrame:
        """log P(column's value | language), add-one smoothed."""
        t = landed(votes.where(F.col(column).isNotNull()).groupBy(column).agg(*ones), f"given_{column}")
        kinds = t.count()
        return small(t.select(F.col(column).alias(f"_{column}"), *[
            F.log((F.col(f"n{i}") + 1) / float(kinds + total[i])).alias(f"{column}_{i}") for i in range(k)]), kinds)

    hosts = votes.where("host IS NOT NULL").withColumn("domain", _domain(F.col("host"))).groupBy("host", "domain").agg(*ones)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"m{i}") for i in range(k)])
    hosts = hosts.join(domains, "domain").select(
        F.col("host").alias("_host"), *[f"n{i}" for i in range(k)], *[f"m{i}" for i in range(k)])
    hosts = landed(hosts, "hosts")
    hosts = small(hosts, hosts.count())
    joined = (scored.join(given("declared"), F.col("declared") == F.col("_declared"), "left")
              .join(given("suffix"), F.col("suffix") == F.col("_suffix"), "left")
              .join(hosts, F.col("host") == F.col("_host"), "left"))
    own = lambda i: F.when((F.col("grams") > 0) & (F.col("best") == i), 1).otherwise(0)
    voted = F.when(F.col("grams") > 0, 1).otherwise(0)
    n_host = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0")) - voted
    n_domain = sum((F.col(f"m{i}") for i in range(1, k)), F.col("m0")) - voted
    evidence = []
    for i in range(k):
        domain = (F.col(f"m{i}") - own(i) + DOMAIN_WEIGHT * float(prior[i])) / (n_domain + DOMAIN_WEIGHT)
        host = F.log((F.col(f"n{i}") - own(i) + HOST_WEIGHT * domain) / (n_host + HOST_WEIGHT))
        evidence.append(F.coalesce(host, F.lit(float(np.log(prior[i]))))
                        + F.coalesce(F.col(f"declared_{i}"), F.lit(0.0)) + F.coalesce(F.col(f"suffix_{i}"), F.lit(0.0)))
    most = F.greatest(*evidence) if k > 1 else evidence[0]
    unknown = F.col("grams") * float(-np.log(BUCKETS) / TEMPER) + float(np.log(UNKNOWN_PRIOR)) + most
    scores = F.array(*[F.struct((F.col(f"s{i}") + evidence[i]).alias("score"), F.lit(x).alias("language"))
                       for i, x in enumerate(model.languages)],
                     F.struct(unknown.alias("score"), F.lit(UNKNOWN).alias("language")))
    best = F.array_max("scores")
    named = joined.select("id", "row_key", "letters", "grams", "best", scores.alias("scores")).withColumn("top", best)
    weight = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - F.col("top.score")))
    accepted = (F.col("letters") > 0) & (F.col("top.language") != UNKNOWN)
    texts = F.array(*[F.lit(x) for x in model.languages])
    return named.select(
        F.col("id").alias(id_col), "row_key",
        F.when(accepted, F.col("top.language")).otherwise(UNKNOWN).alias("language"),
        (1.0 / weight).alias("confidence"),
        F.when(F.col("grams") > 0, F.element_at(texts, F.col("best") + 1)).otherwise(UNKNOWN).alias("text_language"),
        accepted.alias("accepted"))


def row_key_of(*columns):
    """Identical rows have one key, and one result."""
    return F.xxhash64(*columns)


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
                    host_col: str = "source") -> DataFrame:
    """The rows of docs that are not rejected."""
    model = fit_text_model(docs, text_col=text_col, label_col=declared_col)
    found = identify(docs, model, id_col=id_col, text_col=text_col, declared_col=declared_col, host_col=host_col,
                     suffix_col=None)
    gone = landed(found.where(~F.col("accepted")).select(F.col(id_col).alias("_gone_id"), F.col("row_key").alias("_gone_key"))
                  .distinct(), "rejected")
    key = row_key_of(*[docs[f"`{c}`"] for c in (text_col, declared_col, host_col)], F.lit(None).cast("string"))
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"]), "left_anti")


def page_columns(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds visible text, declared markup language, host and address suffix of
    pages: text_, declared_, host_, suffix_."""
    html, url = pages[f"`{html_col}`"], pages[f"`{url_col}`"]
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return (pages.withColumn("text_", bare)
            .withColumn("declared_", F.when(declared != "", declared))
            .withColumn("host_", F.when(host != "", host))
            .withColumn("suffix_", F.when(host != "", F.regexp_extract(host, r"([^.]*)$", 1))))
