"""Robustness: E2 bootstrap CI, E3 missingness corruption, E4 noise
corruption, E5 robustness curve.

Randomness is hash-keyed (md5 of row key, column, replicate and seed), so the
result does not depend on partitioning or executor loss and a DuckDB oracle
reproduces it exactly. The reference draws with numpy's generator; the law is
the same (Poisson bootstrap counts instead of multinomial ones), the draws are
not.
"""
from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrand import GOLDEN_32, MASK_32, MIX_MUL, TWO_POW_32, hash_words, mix_uniform, poisson1_cdf
from .metrics import classification_metrics, confusion_matrix


def row_key(cols: list[str]) -> Column:
    """The key as text; a null is written out, so that keys that differ only
    in where a null stands stay apart."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])


def poisson_span(n: Column) -> Column:
    """How far from its mean a Poisson draw is looked for: 12 standard
    deviations (a chance of 1e-31 beyond) and a few for small means."""
    return F.ceil(12 * F.sqrt(n)) + 16


def poisson_draws(cells: DataFrame, key_cols: list[str], n_col: str, n_boot: int, seed: int) -> DataFrame:
    """key_cols, replicate, draw: for every cell and replicate one
    Poisson(``n_col``) number, by inversion of a hash-keyed uniform.

    The distribution function of a cell is summed up from ratios of neighbouring
    chances (lambda / k), relative to the largest, over ``poisson_span``: about
    24 sqrt(n) rows for a cell of n. Uniforms are placed among its values by one
    sort within the cell."""
    k, n = F.col("_k"), F.col(n_col).cast("double")
    span = poisson_span(n)
    low = F.greatest(F.lit(0), (n - span).cast("long"))
    ks = cells.select(*key_cols, n_col, F.explode(F.sequence(low, (n + span).cast("long"))).alias("_k"))
    upto = Window.partitionBy(*key_cols).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = Window.partitionBy(*key_cols)
    ks = ks.withColumn("_log", F.sum(F.when(k > F.min("_k").over(cell), F.log(n) - F.log(k)).otherwise(0.0)).over(upto))
    ks = ks.withColumn("_w", F.exp(F.col("_log") - F.max("_log").over(cell)))
    ks = ks.withColumn("_v", F.sum("_w").over(upto) / F.sum("_w").over(cell))
    words = hash_words(F.concat_ws("|", row_key(key_cols), F.lit(str(seed))))
    reps = cells.select(*key_cols, low.alias("_k"), words[0].alias("_low"), words[1].alias("_high"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    reps = reps.select(*key_cols, "_k", "replicate", mix_uniform((F.col("_low"), F.col("_high")), F.col("replicate")).alias("_v"))
    both = ks.select(*key_cols, F.lit(None).cast("long").alias("_k"), F.lit(None).cast("int").alias("replicate"), "_v")
    placed = Window.partitionBy(*key_cols).orderBy("_v", F.col("replicate").asc_nulls_first())
    below = F.sum(F.col("replicate").isNull().cast("long")).over(
        placed.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.unionByName(reps).withColumn("draw", F.col("_k") + below).where("replicate IS NOT NULL")
            .select(*key_cols, "replicate", "draw"))


def bootstrap_replicates(df: DataFrame, y: str, yhat: str, n_boot: int = 1000, seed: int = 42,
                         key_cols: list[str] | None = None) -> DataFrame:
    """E2, per-replicate metrics. With ``key_cols`` each row gets a Poisson(1)
    weight per replicate; rows with weight 0 drop out. One md5 per row (key|seed)
    gives a 64-bit seed, mixed with the replicate number by an integer hash, so
    the per-(row, replicate) cost is a few integer operations. Tasks sum up the
    weights to (replicate, y, yhat) cells: the shuffle is B x classes^2 rows per
    task whatever the table size.

    Without ``key_cols`` rows have no weights of their own: within a confusion
    cell of n rows they would add up to one Poisson(n) number, which each
    (cell, replicate) draws."""
    if key_cols is None:
        cm = confusion_matrix(df, y, yhat)
        drawn = poisson_draws(cm, ["y", "yhat"], "n", n_boot, seed).where("draw > 0")
        return classification_metrics(drawn.select("replicate", "y", "yhat", F.col("draw").cast("double").alias("n")), ["replicate"])
    low, high = hash_words(F.concat_ws("|", row_key(key_cols), F.lit(str(seed))))
    base = df.select(y, yhat, low.alias("_low"), high.alias("_high"))
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < tasks:
        base = base.repartition(tasks)
    kinds = ", ".join(f"`{n}` {df.schema[c].dataType.simpleString()}" for n, c in (("y", y), ("yhat", yhat)))
    weighted = base.mapInArrow(_weight_sums(n_boot), f"replicate int, {kinds}, w long").filter(F.col("w") > 0)
    return classification_metrics(confusion_matrix(weighted, "y", "yhat", ["replicate"], weight="w"), ["replicate"])


def _weight_sums(n_boot: int, rows: int = 1 << 15):
    """Of a task's rows (y, yhat, low, high), by replicate and (y, yhat): the sum
    of the rows' Poisson(1) weights, the draws of ``mix_uniform`` and
    ``poisson1_from_uniform``."""
    bounds = [math.ceil(c * TWO_POW_32) for c in poisson1_cdf()[:-1]]
    bounds = [np.uint32(b) for b in bounds if b <= MASK_32]

    def mixed(x):
        for _ in range(2):
            x = ((x >> np.uint32(16)) ^ x) * np.uint32(MIX_MUL)
        return (x >> np.uint32(16)) ^ x

    def run(batches):
        sums: dict = {}
        for b in batches:
            codes = [b.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1)]
            wide = max(1, len(codes[1].dictionary))
            cell = codes[0].indices.to_numpy().astype(np.int64) * wide + codes[1].indices.to_numpy()
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            low, high = (b.column(i).to_numpy()[order].astype(np.uint32) for i in (2, 3))
            for at in range(0, len(cell), rows):
                here, lo, hi = cell[at:at + rows], low[at:at + rows], high[at:at + rows]
                starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                drawn = np.empty((n_boot, len(starts)), np.int64)
                for r in range(n_boot):
                    x = mixed(mixed(lo ^ np.uint32((r * GOLDEN_32) & MASK_32)) ^ hi)
                    w = np.zeros(len(x), np.uint8)
                    for bound in bounds:
                        w += x >= bound
                    drawn[r] = np.add.reduceat(w, starts, dtype=np.int64)
                for i, c in enumerate(here[starts].tolist()):
                    key = tuple(d.dictionary[k].as_py() for d, k in zip(codes, divmod(c, wide)))
                    sums[key] = sums[key] + drawn[:, i] if key in sums else drawn[:, i]
        for (a, c), w in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot, dtype=np.int32)), pa.array([a] * n_boot, kinds[0]),
                                              pa.array([c] * n_boot, kinds[1]), pa.array(w)], names=["replicate", "y", "yhat", "w"])

    def tasks(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            kinds[:] = [first.column(i).type for i in (0, 1)]
            yield from run(chain([first], batches))
    kinds: list = [None, None]
    return tasks


def bootstrap_ci(df: DataFrame, y: str, yhat: str, n_boot: int = 1000, seed: int = 42,
                 metric: str = "weighted_f1", key_cols: list[str] | None = None) -> DataFrame:
    """Mean, population std and 2.5 / 97.5 percentiles (linear
    interpolation) of the metric over replicates — one row."""
    reps = bootstrap_replicates(df, y, yhat, n_boot, seed, key_cols)
    return reps.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                    F.percentile(metric, 0.025).alias("ci95_low"), F.percentile(metric, 0.975).alias("ci95_high"),
                    F.count(F.lit(1)).alias("replicates"))


# Per-cell uniforms: one md5 of (row key | seed) per row, mixed with the
# column's stream number (2i for the mask / first normal draw, 2i+1 for the
# second draw) by the integer hash — a few integer operations per cell.
def cell_uniforms(key: Column, seed: int, cols: list[str]) -> dict[str, tuple[Column, Column]]:
    h = hash_words(F.concat_ws("|", key, F.lit(str(seed))))
    return {c: (mix_uniform(h, F.lit(2 * i)), mix_uniform(h, F.lit(2 * i + 1))) for i, c in enumerate(cols)}


def missing_expr(c: str, level: Column, u: Column) -> Column:
    return F.when(u < level, F.lit(None).cast("double")).otherwise(F.col(c).cast("double"))


def noise_expr(c: str, level: Column, u1: Column, u2: Column, std: Column) -> Column:
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    s = F.when(std.isNull() | F.isnan(std) | (std == 0), F.lit(1.0)).otherwise(std)
    return F.col(c).cast("double") + z * s * level


def corrupt_missing(df: DataFrame, cols: list[str], level: Column | float, key_cols: list[str],
                    seed: int = 42) -> DataFrame:
    """Null each listed cell with probability ``level`` (same cells are
    hit at a higher level: masks are nested)."""
    lvl = level if isinstance(level, Column) else F.lit(float(level))
    us = cell_uniforms(row_key(key_cols), seed, cols)
    return df.withColumns({c: missing_expr(c, lvl, us[c][0]) for c in cols})


def column_pop_std(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Population std per column: ONE aggregate pass, a handful of numbers
    back to the driver, used as literals."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: F.lit(row[c]).cast("double") for c in cols}


def corrupt_noise(df: DataFrame, cols: list[str], level: Column | float, key_cols: list[str],
                  seed: int = 42, stds: dict[str, Column] | None = None) -> DataFrame:
    """Add N(0, (level * pop. std)^2); a zero or non-finite std counts as 1.
    Normal draws by Box-Muller on two hash-uniforms per cell."""
    lvl = level if isinstance(level, Column) else F.lit(float(level))
    stds = stds or column_pop_std(df, cols)
    us = cell_uniforms(row_key(key_cols), seed, cols)
    return df.withColumns({c: noise_expr(c, lvl, us[c][0], us[c][1], stds[c]) for c in cols})


# Corruption levels of the robustness curve.
CURVE_LEVELS = [0.0, 0.1, 0.3, 0.5]


def robustness_curve(df: DataFrame, cols: list[str], key_cols: list[str], score, y: str,
                     levels: list[float] = CURVE_LEVELS, seed: int = 42) -> DataFrame:
    """E5: weighted F1 under each (kind, level) of E3 and E4.

    ``score(df) -> df`` adds ``predicted_label``. Rows are replicated over the
    8 (kind, level) pairs with ``explode`` (a fixed, small fan-out), corrupted
    with column expressions and scored once; the metrics come from one
    confusion aggregate grouped by (kind, level).
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(lv)).alias("level"))
                      for k in ("missingness", "noise") for lv in levels])
    stds = column_pop_std(df, cols)
    # Uniforms depend on (row, column, seed) only — not on the level — so they
    # are computed once per row before the 8-way fan-out.
    us = cell_uniforms(row_key(key_cols), seed, cols)
    pre = df.withColumns({f"_u1_{c}": us[c][0] for c in cols}).withColumns({f"_u2_{c}": us[c][1] for c in cols})
    rep = pre.withColumn("_p", F.explode(pairs)).withColumns({"kind": F.col("_p.kind"), "level": F.col("_p.level")}) \
        .drop("_p")
    lvl = F.col("level")
    corrupted = rep.withColumns({
        c: F.when(F.col("kind") == "missingness", missing_expr(c, lvl, F.col(f"_u1_{c}")))
            .otherwise(noise_expr(c, lvl, F.col(f"_u1_{c}"), F.col(f"_u2_{c}"), stds[c]))
        for c in cols})
    scored = score(corrupted)
    m = classification_metrics(confusion_matrix(scored, y, "predicted_label", ["kind", "level"]), ["kind", "level"])
    return m.select("kind", "level", "weighted_f1")


def bootstrap_ci_multinomial(df: DataFrame, y: str, yhat: str, n_boot: int = 1000, seed: int = 42,
                             metric: str = "weighted_f1") -> DataFrame:
    """E2, scalable form with the reference's exact law: resampling n rows with
    replacement only changes the confusion counts, which are
    Multinomial(n, cell shares). One data pass builds the (classes^2) cell
    table; the B replicates are drawn in tasks (``mapInPandas`` over a
    B-row range, numpy generator seeded per replicate), so neither the rows
    nor the replicates pass through the driver."""
    import numpy as np
    import pandas as pd

    cells = [(r["y"], r["yhat"], float(r["n"])) for r in confusion_matrix(df, y, yhat).collect()]  # <= classes^2
    counts = np.array([c[2] for c in cells])
    n = int(counts.sum())
    probs = counts / counts.sum() if n else counts

    def draw(batches):
        for b in batches:
            out = []
            for r in b["id"].tolist():
                rng = np.random.default_rng([seed, int(r)])
                k = rng.multinomial(n, probs) if n else np.zeros(len(cells))
                out += [(int(r), cells[i][0], cells[i][1], float(k[i])) for i in range(len(cells))]
            yield pd.DataFrame(out, columns=["replicate", "y", "yhat", "n"])

    spark = df.sparkSession
    y_type = df.schema[y].dataType.simpleString()
    reps = spark.range(n_boot).mapInPandas(draw, f"replicate long, y {y_type}, yhat {y_type}, n double")
    m = classification_metrics(reps.filter(F.col("n") > 0), ["replicate"])
    return m.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                 F.percentile(metric, 0.025).alias("ci95_low"), F.percentile(metric, 0.975).alias("ci95_high"),
                 F.count(F.lit(1)).alias("replicates"))
