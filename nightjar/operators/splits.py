"""W6 chronological_split and W7 walk_forward_folds.

Both are cuts of one total order (time, then tie-breaks) of rows that are
written once in that order (``positions.OrderedRows``): no window over data
rows beyond the partitions that a cut falls into, and no hot key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import OrderedRows


def chronological_split(df: DataFrame, order_cols: list[str], train_fraction: float = 0.7,
                        out: str = "split") -> DataFrame:
    """First ``int(train_fraction * n)`` rows in order -> 'train', rest 'test'."""
    rows = OrderedRows(df, order_cols)
    blocks = rows.blocks({"_blk": [int(rows.n * train_fraction)]})
    return blocks.withColumn(out, F.when(F.col("_blk") == 0, F.lit("train")).otherwise(F.lit("test"))).drop("_blk")


def fold_cuts(n: int, k: int) -> list[int]:
    """Start positions of the k test blocks, each of size n // (k+1)."""
    ts = n // (k + 1)
    return [n - (k - i) * ts for i in range(k)]


def walk_forward_folds(df: DataFrame, order_cols: list[str], label_col: str,
                       candidates: tuple[int, ...] = (5, 4, 3), out: str = "test_fold") -> DataFrame:
    """Ordered k-fold (expanding window) assignment.

    Fold f tests block f (size n // (k+1)); its train part is every earlier
    row, i.e. ``test_fold < f`` (the head block is -1). The largest k in
    ``candidates`` for which every train and test part holds both classes
    (>= 2 distinct labels) is used; rows carry ``test_fold`` and ``n_folds``
    (both null when no k is valid).

    Class presence per (k, block) is ONE global aggregate row (min and max of
    the label per block — partial aggregates, no distinct expansion) over the
    ordered rows, which the result then reads again; nothing is cut twice.
    """
    rows = OrderedRows(df, order_cols)
    res = rows.blocks({f"_b{k}": fold_cuts(rows.n, k) for k in candidates})
    agg_exprs = []
    for k in candidates:
        blk = F.col(f"_b{k}") - 1
        for f in range(k):
            for tag, cond in (("t", blk == f), ("r", blk < f)):
                v = F.when(cond, F.col(label_col))
                agg_exprs += [F.min(v).alias(f"_k{k}_{tag}{f}_lo"), F.max(v).alias(f"_k{k}_{tag}{f}_hi")]
    presence = res.agg(*agg_exprs).first().asDict()
    chosen = None
    for k in sorted(candidates, reverse=True):
        ok = all(presence[f"_k{k}_{tag}{f}_lo"] is not None and
                 presence[f"_k{k}_{tag}{f}_lo"] < presence[f"_k{k}_{tag}{f}_hi"]
                 for f in range(k) for tag in ("t", "r"))
        if ok:
            chosen = k
            break
    if chosen:
        res = rows.blocks({"_b": fold_cuts(rows.n, chosen)})
        return res.withColumns({out: (F.col("_b") - 1).cast("int"), "n_folds": F.lit(chosen)}).drop("_b")
    return res.withColumns({out: F.lit(None).cast("int"), "n_folds": F.lit(None).cast("int")}).drop(
        *[f"_b{k}" for k in candidates])
