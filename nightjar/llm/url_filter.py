"""Operator 8, URL filters: host and path rules, and gradient-boosted trees on
lexical features for urls that no rule judges.

Built-in functions and Spark ML only; no Python runs on the executors.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and goes to the model (its features are zeros and the global
block rate). Repeated rows are judged alike, each once. An empty table gives
an empty result. With no labelled url the model's verdict is ``allow``; with
labels of one class it is that class. Other columns of the input are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, landed, pick

BLOCK, ALLOW = "block", "allow"
#: At most so many labelled urls are fitted (those with the smallest hash of
#: the url, so the choice does not depend on the layout of the table).
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 11
FEATURES = ["n_chars", "n_path", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels",
            "has_fragment", "is_secure", "suffix_rate"]


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the url's path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query is asked to apply.
RULES = [Rule("net", "/", BLOCK), Rule("example.net", "/en/", ALLOW), Rule("example.com", "/de/", BLOCK),
         Rule("org", "/fr/", ALLOW)]


def host_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substr(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return (urls.withColumn("_rest", rest)
            .withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
            .drop("_rest"))


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (text of the longest rule that fits, else null) and
    ``ruled`` (its verdict). Rules are looked up by the host's suffixes, so a
    row's cost is its number of labels, not the number of rules."""
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    table = F.create_map(*[x for host, own in by_host.items() for x in (
        F.lit(host), F.array(*[F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"),
                                        F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in own]))])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<struct<n:int,rule:string,path:string,verdict:string>>")
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), none))),
                    lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)  # structs compare by their first field, the rule's length
    return (urls.withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.verdict")).drop("_best"))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features, and ``suffix`` (the host's last label)."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    some = F.greatest(n, F.lit(1))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / some
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    count = lambda c: (n - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    host = F.col("host")
    return (urls
            .withColumn("suffix", F.element_at(F.split(host, r"\."), -1))
            .withColumn("n_chars", n.cast("double"))
            .withColumn("n_path", F.length("path").cast("double"))
            .withColumn("depth", (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"))
            .withColumn("digit_ratio", (n - F.length(F.translate(text, "0123456789", ""))) / some)
            .withColumn("entropy", entropy)
            .withColumn("n_params", count("="))
            .withColumn("n_hyphens", (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"))
            .withColumn("n_labels", F.size(F.split(host, r"\.")).cast("double"))
            .withColumn("has_fragment", F.when(F.instr(text, "#") > 0, 1.0).otherwise(0.0))
            .withColumn("is_secure", F.when(F.startswith(text, F.lit("https:")), 1.0).otherwise(0.0)))


@dataclass
class UrlModel:
    """``rates``: suffix -> smoothed block rate, of every labelled url; ``prior``:
    the global rate; ``trees``: None where the labels have fewer than two classes."""
    rates: DataFrame
    prior: float
    trees: object | None

    def judge(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """Adds ``model_verdict`` to rows that have ``host`` and ``path``."""
        if self.trees is None:
            return urls.withColumn("model_verdict", F.lit(BLOCK if self.prior > 0.5 else ALLOW))
        keep = urls.columns
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(
            _rated(lexical(urls, url), self.rates, self.prior))
        return (self.trees.transform(rows)
                .withColumn("model_verdict", F.when(F.col("_prediction") > 0.5, BLOCK).otherwise(ALLOW))
                .select(*keep, "model_verdict"))


def _rated(rows: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    return rows.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(prior)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", fit_rows: int = FIT_ROWS) -> UrlModel:
    """Train on labelled urls (label 1: block). Suffix statistics cover all of
    them; the trees are fitted on at most ``fit_rows``. A suffix's rate leaves
    the row's own label out while fitting, so a suffix seen once says nothing."""
    rows = host_path(pick(labelled, url=url, label=label).where(F.col("label").isNotNull()), "url")
    rows = lexical(rows).withColumn("label", F.col("label").cast("double"))
    total = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    prior = float(total["p"] or 0.0)
    counts = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    counts = landed(counts, "suffix_counts")
    rates = counts.select("suffix", ((F.col("s") + 5 * prior) / (F.col("n") + 5)).alias("suffix_rate"))
    if not 0.0 < prior < 1.0:
        return UrlModel(rates, prior, None)
    sample = rows.orderBy(F.xxhash64("url"), "url").limit(fit_rows)
    own = (sample.join(counts, "suffix", "left").withColumn(
        "suffix_rate", (F.col("s") - F.col("label") + 5 * prior) / (F.col("n") - 1 + 5)))
    own = landed(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(own)
                 .select("_features", "label"), "url_fit")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction",
                          maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    return UrlModel(rates, prior, trees.fit(own))


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, key: str = "page_id",
               url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict: the longest rule's verdict, else the model's."""
    rows = with_rule(host_path(pick(pages, _key=key, url=url)), rules)
    return (model.judge(rows)
            .select(F.col("_key").alias(key), "host", "path", "rule",
                    F.coalesce("ruled", "model_verdict").alias("verdict")))


def labelled_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Urls that a rule judges, as labelled examples for those that none does."""
    rows = with_rule(host_path(pick(pages, url=url)), rules)
    return rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == BLOCK).cast("int").alias("label"))
