"""Preprocessing fitted on Spark aggregates.

A10 column_profile, A11 column_medians (exact, 0.0 for all-missing when
asked), A12 column_mean_scale (population std, 0 -> 1), M2
impute_and_scale (parameters from train only), F5-F7 PCA window encoder,
A18 explained variance, S7 nested-array flattening.

Parameters are one aggregate row (3 numbers per column) — the only thing
that reaches the driver; data never does.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quantiles import exact_quantiles


PROFILE = ("column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, "
           "max double, unique long, top string, freq long")


def column_profile(df: DataFrame, numeric: list[str], text: list[str] | None = None) -> DataFrame:
    """A10: one row per column: count, mean, sample std, minimum, exact
    quartiles and maximum of numbers; count, number of distinct values, the
    most frequent one (the smallest of several) and its count of texts."""
    spark = df.sparkSession
    aggs = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in numeric
            for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp))]
    one = df.agg(*aggs).first() if numeric else None
    q = exact_quantiles(df, numeric, [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = [(c, one[f"{c}__count"], one[f"{c}__mean"], one[f"{c}__std"], *[q[c, x] for x in (0.0, 0.25, 0.5, 0.75, 1.0)],
             None, None, None) for c in numeric]
    for c in text or []:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        t = counts.agg(F.sum("n").alias("n"), F.count("*").alias("unique"),
                       F.max(F.struct("n")).alias("most")).first()
        freq = t["most"]["n"] if t["most"] else None
        top = counts.where(F.col("n") == F.lit(freq)).agg(F.min("v")).first()[0] if freq else None
        rows.append((c, t["n"] or 0, *[None] * 7, t["unique"], top, freq))
    return spark.createDataFrame(rows, PROFILE)


def median_values(df: DataFrame, cols: list[str], all_missing_fill: float | None = None) -> dict[str, float | None]:
    """Exact median per column, by distributed selection (no task holds a
    column). Not ``ml.feature.Imputer``: its median of 1,2,4,9 is 2.0
    (approximate, lower) and it fails on an all-missing column."""
    found = exact_quantiles(df, cols, [0.5])
    return {c: all_missing_fill if found[c, 0.5] is None else found[c, 0.5] for c in cols}


def column_medians(df: DataFrame, cols: list[str], all_missing_fill: float | None = None) -> DataFrame:
    """A11 as a table of one row."""
    found = median_values(df, cols, all_missing_fill)
    schema = StructType([StructField(c, DoubleType()) for c in cols])
    return df.sparkSession.createDataFrame([tuple(found[c] for c in cols)], schema)


def column_mean_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column in long form; scale 0 -> 1."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std")).alias("scale"))
                     for c in cols])
    return wide.select(F.inline(rows))


@dataclass
class Preprocess:
    cols: list[str]
    median: list[float]
    mean: list[float]
    scale: list[float]

    def only(self, cols: list[str]) -> "Preprocess":
        """The parameters of some of the columns."""
        at = [self.cols.index(c) for c in cols]
        return Preprocess(list(cols), *([v[i] for i in at] for v in (self.median, self.mean, self.scale)))

    def columns(self, prefix: str = ""):
        """Impute -> standardise as column expressions (no UDF)."""
        out = []
        for c, med, mu, sc in zip(self.cols, self.median, self.mean, self.scale):
            x = F.coalesce(F.col(c).cast("double"), F.lit(med))
            out.append(((x - F.lit(mu)) / F.lit(sc)).alias(prefix + c))
        return out


def fit_preprocess(train: DataFrame, cols: list[str], all_missing_fill: float = 0.0) -> Preprocess:
    """M2: median impute then standardise, parameters from ``train`` only.
    The scaler sees the imputed column (as in an impute -> scale pipeline)."""
    found = median_values(train, cols, all_missing_fill)
    meds = [float(found[c]) for c in cols]
    imputed = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(cols, meds)])
    stats = {r["feature"]: r for r in column_mean_scale(imputed, cols).collect()}
    means = [float(stats[c]["mean"]) if stats[c]["mean"] is not None else 0.0 for c in cols]
    scales = [float(stats[c]["scale"]) if stats[c]["scale"] is not None else 1.0 for c in cols]
    return Preprocess(cols, meds, means, scales)


def impute_and_scale(df: DataFrame, p: Preprocess, keep: list[str]) -> DataFrame:
    return df.select(*keep, *p.columns())


# ---------------------------------------------------------------- S7
def flatten_nested_samples(df: DataFrame, array_col: str, width: int, keep: list[str],
                           prefix: str | None = None) -> DataFrame:
    """A fixed-width array column -> indexed columns ``{prefix}_{i}``
    (``element_at``; the array is not exploded, so rows stay rows)."""
    p = prefix or array_col
    return df.select(*keep, *[F.element_at(F.col(array_col), i + 1).cast("double").alias(f"{p}_{i}")
                              for i in range(width)])


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs -> prefixed flat columns (``a.b.c`` -> ``a_b_c``),
    decided from ``df.schema`` only (no data pass)."""
    from pyspark.sql.types import StructType

    def walk(dtype, path):
        if isinstance(dtype, StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path

    cols = []
    for f in df.schema.fields:
        for path in walk(f.dataType, [f.name]):
            cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
    return df.select(*cols)


# Names of a payload's time array, in order of preference.
TIME_KEYS = ["time", "times", "timestamp", "timestamps", "t", "sec", "seconds"]


def parallel_arrays_to_rows(df: DataFrame, arrays: list[str], keep: list[str], time_col: str | None = None) -> DataFrame:
    """Parallel 1-D arrays -> one row per position (``arrays_zip`` +
    ``posexplode``); time = the named array, else the first of the usual time
    names, else the position. A payload's rows are as many as its time array
    has values, without one as most of its arrays have (of equally common
    lengths the first); arrays of another length are dropped (null)."""
    time_col = time_col or next((t for t in TIME_KEYS if t in arrays), None)
    if time_col:
        n = F.size(time_col)
    else:
        alike = lambda a: sum(((F.size(a) == F.size(b)).cast("int") for b in arrays), F.lit(0))
        n = F.array_max(F.array(*[F.struct(alike(a).alias("often"), F.lit(-i).alias("place"), F.size(a).alias("n"))
                                  for i, a in enumerate(arrays)]))["n"]
    z = F.arrays_zip(*[F.when(F.size(a) == n, F.col(a)).otherwise(
        F.array_repeat(F.lit(None), n).cast(df.schema[a].dataType)).alias(a) for a in arrays])
    out = df.select(*keep, F.posexplode(z).alias("_pos", "_z"))
    cols = [F.col(f"_z.{a}").alias(a) for a in arrays]
    t = F.col(f"_z.{time_col}") if time_col else F.col("_pos").cast("double")
    return out.select(*keep, t.alias("time_s"), *[c for a, c in zip(arrays, cols) if a != time_col])


# ---------------------------------------------------------------- F5-F7 / A18
@dataclass
class WindowEncoder:
    pre: Preprocess
    pca_model: object
    k: int

    def signs(self) -> list[float]:
        """Eigenvector signs are arbitrary: fix each component so that its
        largest-magnitude loading is positive (k numbers on the driver)."""
        pc = self.pca_model.pc.toArray()  # columns x k
        out = []
        for j in range(pc.shape[1]):
            col = pc[:, j]
            out.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)
        return out

    def explained_variance(self, spark) -> DataFrame:
        """Per component and cumulative explained variance ratio."""
        ev = [float(v) for v in self.pca_model.explainedVariance.toArray()]
        rows, cum = [], 0.0
        for i, v in enumerate(ev):
            cum += v
            rows.append((i + 1, v, cum))
        return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")


def fit_window_encoder(df: DataFrame, cols: list[str], latent: int = 8) -> WindowEncoder:
    """median impute -> standardise -> PCA with
    ``k = max(1, min(latent, columns, rows - 1))``; needs >= 2 rows. Columns
    that are entirely missing are dropped first (P15). Spark's PCAModel does
    not centre, so the input is centred by the scaler step."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols]).first()
    rows = counts["_rows"]
    if rows < 2:
        raise ValueError("encoder needs at least two rows")
    usable = [c for c in cols if counts[c] > 0]
    k = max(1, min(latent, len(usable), rows - 1))
    pre = fit_preprocess(df, usable)
    scaled = df.select(*pre.columns())
    vec = VectorAssembler(inputCols=usable, outputCol="_x").transform(scaled)
    model = PCA(k=k, inputCol="_x", outputCol="_z").fit(vec)
    return WindowEncoder(pre, model, k)


def encoder_overlap(df: DataFrame, enc: WindowEncoder) -> tuple[int, int]:
    """How many of the encoder's inputs the table has, and how many there are."""
    return sum(c in df.columns for c in enc.pre.cols), len(enc.pre.cols)


def component_names(k: int) -> list[str]:
    return [f"public_enc_{i:02d}" for i in range(k)]


def latent_names(k: int) -> list[str]:
    """names of the components in the latent table."""
    return [f"latent_{i + 1}" for i in range(k)]


def apply_encoder(df: DataFrame, enc: WindowEncoder, keep: list[str], names=component_names,
                  fill_from_table: bool = True) -> DataFrame:
    """align to the encoder's inputs (absent -> missing), fill with
    THIS table's medians (0.0 when a column has none), standardise with the
    encoder's parameters and project; components named by ``names``."""
    cols = enc.pre.cols
    inside = [f"_in_{c}" for c in cols]  # apart from columns of the same name that are kept
    aligned = df.select(*keep, *[(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(i)
                                 for c, i in zip(cols, inside)])
    if fill_from_table:
        med = median_values(aligned, inside, all_missing_fill=0.0)
        aligned = aligned.select(*keep, *[F.coalesce(F.col(i), F.lit(float(med[i]))).alias(i) for i in inside])
    pre = Preprocess(inside, enc.pre.median, enc.pre.mean, enc.pre.scale)
    scaled = aligned.select(*keep, *pre.columns("_scaled"))
    vec = VectorAssembler(inputCols=[f"_scaled{i}" for i in inside], outputCol="_x").transform(scaled)
    z = enc.pca_model.transform(vec).select(*keep, vector_to_array("_z").alias("_z"))
    sg = enc.signs()
    return z.select(*keep, *[(F.col("_z")[i] * F.lit(sg[i])).alias(n) for i, n in enumerate(names(enc.k))])
