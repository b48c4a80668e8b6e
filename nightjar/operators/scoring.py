"""Scoring with portable linear contracts and decision thresholds.

R1 score_linear_contract, R5 apply_threshold, R6 threshold_sweep, R7
deployment_threshold_gate, R8 export_linear_contract (see ``models``),
plus the long-format scorer for many contracts at once.

A contract scores as one generated column expression (no UDF):
``logit = intercept + sum_i coef_i * (coalesce(x_i, median_i) - mean_i) / scale_i``
with scale 0 -> 1, ``p1 = 1 / (1 + exp(-logit))``, label = ``p1 >= threshold``.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.clean import to_numeric_or_null
from .metrics import classification_metrics


@dataclass
class LinearContract:
    feature_order: list[str]
    imputer_median: list[float]
    scaler_mean: list[float]
    scaler_scale: list[float]
    coef: list[float]
    intercept: float
    classes: list[int] = field(default_factory=lambda: [0, 1])
    decision_threshold: float | None = None
    contract_type: str = "binary_linear_classifier"

    @staticmethod
    def from_mapping(d: dict) -> "LinearContract":
        order = list(d["feature_order"])

        def vec(key):
            v = d[key]
            return [float(v[f]) for f in order] if isinstance(v, dict) else [float(x) for x in v]
        t = d.get("decision_threshold")
        return LinearContract(order, vec("imputer_median"), vec("scaler_mean"), vec("scaler_scale"), vec("coef"),
                              float(d["intercept"]), list(d.get("classes", [0, 1])),
                              None if t is None else float(t), d.get("contract_type", "binary_linear_classifier"))

    @staticmethod
    def from_json(text: str) -> "LinearContract":
        return LinearContract.from_mapping(json.loads(text))

    def to_json(self) -> str:
        d = {"contract_type": self.contract_type, "feature_order": self.feature_order}
        for key in ("imputer_median", "scaler_mean", "scaler_scale", "coef"):
            d[key] = dict(zip(self.feature_order, getattr(self, key)))
        d.update({"intercept": self.intercept, "classes": self.classes})
        if self.decision_threshold is not None:
            d["decision_threshold"] = self.decision_threshold
        return json.dumps(d, indent=2)

    def to_rows(self, spark: SparkSession, contract_id: str) -> DataFrame:
        """One row per feature; the size is the contract's length, known here."""
        schema = StructType([StructField("contract_id", StringType()), StructField("feature", StringType()),
                             StructField("median", DoubleType()), StructField("mean", DoubleType()),
                             StructField("scale", DoubleType()), StructField("coef", DoubleType())])
        rows = [(contract_id, f, m, mu, s, c) for f, m, mu, s, c in
                zip(self.feature_order, self.imputer_median, self.scaler_mean, self.scaler_scale, self.coef)]
        return spark.createDataFrame(rows, schema)


def contract_logit(df: DataFrame, c: LinearContract) -> Column:
    """R1 logit as one expression; absent feature columns count as missing."""
    expr = F.lit(c.intercept)
    for f, med, mu, sc, w in zip(c.feature_order, c.imputer_median, c.scaler_mean, c.scaler_scale, c.coef):
        x = to_numeric_or_null(f) if f in df.columns else F.lit(None).cast("double")
        scale = sc if sc != 0 else 1.0
        expr = expr + F.lit(w) * ((F.coalesce(x, F.lit(med)) - F.lit(mu)) / F.lit(scale))
    return expr


def score_linear_contract(df: DataFrame, c: LinearContract, threshold: float | None = None,
                          prefix: str = "") -> DataFrame:
    """Adds ``logit``, ``p1`` and ``predicted_label`` (threshold: explicit,
    else the contract's, else 0.5; ``>=``)."""
    t = threshold if threshold is not None else (c.decision_threshold if c.decision_threshold is not None else 0.5)
    logit = contract_logit(df, c)
    return df.withColumn(f"{prefix}logit", logit).withColumns({
        f"{prefix}p1": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"{prefix}logit"))),
    }).withColumn(f"{prefix}predicted_label", (F.col(f"{prefix}p1") >= F.lit(t)).cast("int"))


def score_contracts_long(features_long: DataFrame, contracts: DataFrame, intercepts: DataFrame,
                         row_key: list[str]) -> DataFrame:
    """R1 for many contracts at once, in long form.

    ``features_long``: ``(row_key..., feature, value)``; ``contracts``:
    ``(contract_id, feature, median, mean, scale, coef)``; ``intercepts``:
    ``(contract_id, intercept)``. One equi-join on ``feature`` and one
    aggregate per (row, contract). A feature a row lacks contributes
    ``coef * (median - mean) / scale``: that all-missing total is computed per
    contract and each present feature replaces its share. Every row is scored
    by every contract, also one without any known feature (on medians alone):
    each row and each contract enter the join with one null feature.
    Join sides are left to AQE's measured sizes.
    """
    scale = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    c = contracts.withColumn("_miss", F.col("coef") * (F.col("median") - F.col("mean")) / scale)
    base = c.groupBy("contract_id").agg(F.sum("_miss").alias("_all_missing")).join(intercepts, "contract_id")
    terms = c.select("contract_id", F.col("feature").alias("_feature"), "median", "mean", scale.alias("scale"), "coef", "_miss")
    none = F.lit(None).cast("double")
    terms = terms.unionByName(base.select("contract_id", F.lit(None).cast("string").alias("_feature"),
                                          *[none.alias(x) for x in ("median", "mean", "scale", "coef", "_miss")]))
    values = features_long.where(F.col("feature").isNotNull()).select(*row_key, "feature", to_numeric_or_null("value").alias("value"))
    values = values.unionByName(features_long.select(*row_key).distinct().select(
        *row_key, F.lit(None).cast("string").alias("feature"), none.alias("value")))
    delta = (F.col("coef") * (F.coalesce("value", "median") - F.col("mean")) / F.col("scale") - F.col("_miss"))
    per = (values.join(terms, F.col("feature").eqNullSafe(F.col("_feature")))
           .groupBy(*row_key, "contract_id").agg(F.coalesce(F.sum(delta), F.lit(0.0)).alias("_delta")))
    out = per.join(base, "contract_id", "inner").withColumn(
        "logit", F.col("intercept") + F.col("_all_missing") + F.col("_delta"))
    return out.withColumn("p1", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))).drop(
        "_delta", "_all_missing", "intercept")


def apply_threshold(df: DataFrame, p_col: str, threshold: Column | float | None,
                    label_col: str | None = None, out: str = "decision") -> DataFrame:
    """``p(class 1) >= t -> 1``; without a threshold the model's own label."""
    if threshold is None:
        return df.withColumn(out, F.col(label_col))
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.withColumn(out, (F.col(p_col) >= t).cast("int"))


# The sweep grid 0.20 .. 0.80 in steps of 0.01 (61 thresholds).
GRID_LO, GRID_HI = 20, 80


def sweep_bucket(p: Column) -> Column:
    """Grid bucket of a probability: floor(round(p*100, 9)) clipped to
    [GRID_LO-1, GRID_HI]; ``p >= T/100`` iff bucket >= T for grid T."""
    b = F.floor(F.round(p * F.lit(100.0), 9)).cast("int")
    return F.least(F.greatest(b, F.lit(GRID_LO - 1)), F.lit(GRID_HI))


def threshold_sweep(df: DataFrame, p_col: str, y_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Metrics at every grid threshold from ONE pass over the data.

    Rows are counted by (group, label, bucket) — partial aggregation, so the
    shuffle carries at most 62 x labels rows per group and task. The full
    bucket range is generated per (group, label) with ``sequence`` (no join
    against a grid), and a running sum from the top bucket down gives, for
    each grid threshold T, the rows predicted positive. The best threshold
    per group maximises weighted F1, then kappa, then closeness to 0.5, then
    comes first in the grid.
    """
    g = group_cols or []
    counts = df.groupBy(*g, F.col(y_col).cast("int").alias("y"), sweep_bucket(F.col(p_col)).alias("bucket")) \
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    labels = counts.select(*g, "y").distinct()
    full = labels.withColumn("bucket", F.explode(F.sequence(F.lit(GRID_LO - 1), F.lit(GRID_HI))))
    full = full.join(counts, [*g, "y", "bucket"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0.0)))
    part = Window.partitionBy(*g, "y")
    down = part.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"pos": F.sum("n").over(down), "tot": F.sum("n").over(part)})
    full = full.filter(F.col("bucket") >= GRID_LO).withColumnRenamed("bucket", "t_int")
    cm = full.select(*g, "t_int", "y", F.lit(1).alias("yhat"), F.col("pos").alias("n")).unionByName(
        full.select(*g, "t_int", "y", F.lit(0).alias("yhat"), (F.col("tot") - F.col("pos")).alias("n")))
    m = classification_metrics(cm.filter(F.col("n") > 0), [*g, "t_int"])
    m = m.withColumn("threshold", F.col("t_int") / F.lit(100.0))
    w = Window.partitionBy(*g).orderBy(F.col("weighted_f1").desc(), F.col("kappa").desc(),
                                       F.abs(F.col("t_int") - F.lit(50)).asc(), F.col("t_int").asc())
    return m.withColumn("is_best", F.row_number().over(w) == 1).drop("n_rows")


# Gate for adopting a tuned threshold.
MIN_GAIN, MAX_SHIFT, DEFAULT_THRESHOLD = 0.02, 0.1, 0.5


def deployment_threshold_gate(sweep: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Keep the tuned threshold only when it gains >= 0.02 weighted F1 over
    0.5 and lies within 0.1 of 0.5; otherwise 0.5, with the reason. The upper
    end of that range is open: the grid's value for 0.60 is a trace above it.
    Without groups an empty sweep gives one row, ``fallback_no_tuning``; so
    does a group without a best or a default threshold."""
    g = group_cols or []
    best, default = F.col("is_best"), F.col("t_int") == 50
    pick = lambda where, c: F.max(F.when(where, F.col(c)))
    j = (sweep.groupBy(*g) if g else sweep.groupBy()).agg(
        pick(best, "threshold").alias("tuned_threshold"), pick(best, "t_int").alias("_tuned_int"),
        pick(best, "weighted_f1").alias("tuned_weighted_f1"), pick(default, "weighted_f1").alias("default_weighted_f1"))
    gain = F.col("tuned_weighted_f1") - F.col("default_weighted_f1")
    lowest, above = round(100 * (DEFAULT_THRESHOLD - MAX_SHIFT)), round(100 * (DEFAULT_THRESHOLD + MAX_SHIFT))
    near = (F.col("_tuned_int") >= lowest) & (F.col("_tuned_int") < above)
    reason = (F.when(gain.isNull(), F.lit("fallback_no_tuning"))
              .when(gain < F.lit(MIN_GAIN), F.lit(f"fallback_gain_lt_{MIN_GAIN:.2f}"))
              .when(~near, F.lit(f"fallback_shift_gt_{MAX_SHIFT:.2f}"))
              .otherwise(F.lit("accepted_tuned_threshold")))
    return j.withColumn("delta_weighted_f1", gain).withColumn("reason", reason).withColumn(
        "deployment_threshold",
        F.when(F.col("reason") == "accepted_tuned_threshold", F.col("tuned_threshold")).otherwise(F.lit(DEFAULT_THRESHOLD))
    ).drop("_tuned_int")
