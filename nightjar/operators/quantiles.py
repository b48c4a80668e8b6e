"""Exact quantiles without gathering a column in one task.

``median`` and ``percentile`` keep every distinct value of a group in one
buffer. Here each wanted rank is narrowed down by passes over the data: rows
inside the current value range are counted in equal-width buckets (partial
aggregation, at most as many rows as buckets per range and task), the bucket
that holds the rank gives the next range by its smallest and largest value,
until the range is one value. All columns, groups and ranks share the passes,
and ranks that are still in the same range share its counts. Exact for any
size; the driver holds a range and a rank per target.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite_or_null

BUCKETS = 1024
#: Buckets of all ranges of a pass over columns without groups, which share them
#: out: at least ``BUCKETS`` each, so that few columns need few passes.
PASS_BUCKETS = 1 << 16
#: Groups are labels (models, kinds), not keys: more are refused.
MAX_GROUPS = 1000


def _bucket(v, low, high, wide):
    """Bucket of a value in its range. ``wide``: the range's width is beyond the
    largest double; halves then."""
    share = F.when(wide, (v * 0.5 - low * 0.5) / (high * 0.5 - low * 0.5)).otherwise((v - low) / (high - low))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _counted(x: DataFrame, groups: list[str], open_: list) -> DataFrame:
    """range, bucket, n, lo, hi: the values inside each open range by bucket, in
    one pass; each range is a condition."""
    marks = []
    for k, (g, c, low, high) in enumerate(open_):
        v = F.col(c)
        here = v.between(low, high)
        for name, value in zip(groups, g):
            here = here & F.col(name).eqNullSafe(F.lit(value))
        bucket = _bucket(v, F.lit(low), F.lit(high), F.lit(not math.isfinite(high - low)))
        marks.append(F.when(here, F.struct(F.lit(k).alias("range"), bucket.alias("bucket"), v.alias("v"))))
    return (x.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.range", "m.bucket")
            .agg(F.count("*").alias("n"), F.min("m.v").alias("lo"), F.max("m.v").alias("hi")))


def _counted_columns(x: DataFrame, cols: list[str], open_: list) -> DataFrame:
    """The same without groups: tasks count a column's values at a time."""
    place = {c: i for i, c in enumerate(cols)}
    ranges = [(place[c], float(low), float(high)) for _, c, low, high in open_]
    wanted = sorted({i for i, _, _ in ranges})
    size = max(BUCKETS, PASS_BUCKETS // len(ranges))

    def count(batches):
        n = np.zeros((len(ranges), size), np.int64)
        lo, hi = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for b in batches:
            held = {}
            for j, i in enumerate(wanted):
                v = b.column(j).to_numpy(zero_copy_only=False)
                held[i] = v[~np.isnan(v)]
            for k, (i, low, high) in enumerate(ranges):
                v = held[i]
                v = v[(v >= low) & (v <= high)]
                if math.isfinite(high - low):
                    share = (v - low) / (high - low)
                else:  # the range's width is beyond the largest double
                    share = (v * 0.5 - low * 0.5) / (high * 0.5 - low * 0.5)
                at = np.minimum((share * size).astype(np.int64), size - 1)
                n[k] += np.bincount(at, minlength=size)
                np.minimum.at(lo[k], at, v)
                np.maximum.at(hi[k], at, v)
        k, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[k, at]),
                                          pa.array(lo[k, at]), pa.array(hi[k, at])], names=["range", "bucket", "n", "lo", "hi"])
    parts = x.select(*[F.col(cols[i]) for i in wanted]).mapInArrow(count, "range int, bucket int, n long, lo double, hi double")
    return parts.groupBy("range", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float],
                    group_cols: list[str] | None = None) -> dict[tuple, float | None]:
    """(group..., column, q) -> quantile with linear interpolation (None
    without values). Null, NaN and infinite values are missing."""
    groups = group_cols or []
    x = df.select(*groups, *[finite_or_null(F.col(c).cast("double")).alias(c) for c in cols])
    start = x.groupBy(*groups).agg(*[f(c).alias(f"{t}_{i}") for i, c in enumerate(cols)
                                     for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    rows = start.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    targets: dict[tuple, list] = {}  # (group, column, rank) -> [low, high, values below low]
    for r in rows:
        g = tuple(r[c] for c in groups)
        for i, c in enumerate(cols):
            for q in qs if r[f"n_{i}"] else []:
                at = q * (r[f"n_{i}"] - 1)
                for rank in {math.floor(at), math.ceil(at)}:
                    targets[g, c, rank] = [r[f"lo_{i}"], r[f"hi_{i}"], 0]
    while True:
        inside: dict[tuple, list] = {}  # (group, column, low, high) -> targets still in this range
        for key, t in targets.items():
            if t[0] < t[1]:
                inside.setdefault((key[0], key[1], t[0], t[1]), []).append((key[2], t))
        if not inside:
            break
        open_ = list(inside)
        found = _counted(x, groups, open_) if groups else _counted_columns(x, cols, open_)
        counts: dict[int, list] = {}
        for r in found.collect():
            counts.setdefault(r["range"], []).append((r["bucket"], r["n"], r["lo"], r["hi"]))
        for k, span in enumerate(open_):
            held = sorted(counts[k])
            if len(held) == 1 and held[0][2:] == span[2:]:
                raise ArithmeticError(f"a pass over {span[1]} left the range from {span[2]} to {span[3]} as it was")
            for rank, t in inside[span]:
                for _, n, low, high in held:
                    if rank < t[2] + n:
                        t[0], t[1] = low, high
                        break
                    t[2] += n
    out: dict[tuple, float | None] = {}
    for r in rows:
        g = tuple(r[c] for c in groups)
        for i, c in enumerate(cols):
            for q in qs:
                if not r[f"n_{i}"]:
                    out[(*g, c, q)] = None
                    continue
                at = q * (r[f"n_{i}"] - 1)
                a, b = targets[g, c, math.floor(at)][0], targets[g, c, math.ceil(at)][0]
                out[(*g, c, q)] = a if a == b else a + (at - math.floor(at)) * (b - a)
    if not rows:
        out = {(c, q): None for c in cols for q in qs} if not groups else {}
    return out
