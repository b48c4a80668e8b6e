"""Exact cuts of a total order without a window over the whole table.

``OrderedRows`` writes the rows once to the shared folder, range-partitioned
by the full order. The order is made total by a hash of the row and, for rows
that are equal in everything, by a number given while writing, so no key
(a date that holds a third of the table, one value of a single order column)
can weigh down one partition: Spark splits it by the tie-breaks. The count
per partition (one row per partition) places every partition in the order;
a partition between two cuts is labelled without ranking, and only the
partitions that a cut falls into, at most one for each cut, rank their rows.

Writing first also fixes the boundaries: they come from a sample and could
move if the exchange were computed again.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_PART, _TIE, _NUMBER = "_order_part", "_order_tie", "_order_number"


class OrderedRows:
    """``rows`` in ascending order of ``order_cols`` (nulls first)."""

    def __init__(self, df: DataFrame, order_cols: list[str], partitions: int | None = None):
        spark = df.sparkSession
        self.columns, self.order = df.columns, [*order_cols, _TIE, _NUMBER]
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = (df.withColumn(_TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
                 .withColumn(_NUMBER, F.monotonically_increasing_id()))
        placed = keyed.repartitionByRange(n, *self.order).withColumn(_PART, F.spark_partition_id())
        path = f"{checkpoint_dir(spark).rstrip('/')}/ordered-{uuid.uuid4().hex}"
        placed.write.parquet(path)
        self.rows = spark.read.schema(placed.schema).parquet(path)
        counts = {r[_PART]: r["n"] for r in self.rows.groupBy(_PART).agg(F.count("*").alias("n")).collect()}
        self.first, at = {}, 0
        for part in sorted(counts):
            self.first[part] = (at, at + counts[part])
            at += counts[part]
        self.n = at

    def blocks(self, cuts: dict[str, list[int]]) -> DataFrame:
        """For each ``name -> cuts`` a column with the number of cuts at or
        below the row's 0-based position (with ``[k]``, positions 0..k-1 get 0)."""
        inside = sorted({p for p, (a, b) in self.first.items() for own in cuts.values() for c in own if a < c < b})
        if not self.first:
            return self.rows.withColumns({name: F.lit(0) for name in cuts}).select(*[f"`{c}`" for c in self.columns], *cuts)
        # by partition number: one array, indexed, whatever the number of partitions
        first = F.lit([self.first.get(p, (0, 0))[0] for p in range(max(self.first) + 1)]).cast("array<long>")
        start = F.get(first, F.col(_PART))
        whole = self.rows.filter(~F.col(_PART).isin(inside)).withColumn("_position", start)
        split = self.rows.filter(F.col(_PART).isin(inside)).withColumn(
            "_position", start + F.row_number().over(Window.partitionBy(_PART).orderBy(*self.order)) - 1)
        rows = whole.unionByName(split) if inside else whole
        return rows.select(*[f"`{c}`" for c in self.columns],
                           *[_count(own).alias(name) for name, own in cuts.items()])


def _count(cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (F.col("_position") >= F.lit(c)).cast("int")
    return out
