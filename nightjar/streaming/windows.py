"""Structured Streaming form of the tumbling window statistics (A5) and of
contract scoring (R1).

The batch operator groups by ``floor(time_s / w)``; on a stream the same
groups are event-time ``window(ts, w)`` buckets, finalised once the
watermark passes their end (append mode), so state stays bounded by the
allowed lateness instead of growing with the history.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import LinearContract, score_linear_contract
from ..operators.sensors import WINDOW_STATS, _stat


def stream_window_stats(stream: DataFrame, ts_col: str, channels: list[str], window_sec: int, prefix: str,
                        group: list[str], watermark: str = "10 minutes",
                        stats: list[str] = WINDOW_STATS) -> DataFrame:
    """A5 on a streaming DataFrame: per (group, event-time window) stats named
    ``{prefix}{col}_{stat}`` plus ``window_index`` (= floor(epoch / w)), as in
    the batch operator."""
    w = f"{int(window_sec)} seconds"
    aggs = [_stat(s, F.col(c).cast("double")).alias(f"{prefix}{c}_{s}") for c in channels for s in stats]
    out = (stream.withWatermark(ts_col, watermark)
           .groupBy(*group, F.window(F.col(ts_col), w).alias("_w")).agg(*aggs))
    idx = F.floor(F.unix_micros(F.col("_w.start").cast("timestamp")) / F.lit(window_sec * 1_000_000)).cast("long")
    return out.withColumn("window_index", idx).drop("_w")


def stream_scores(stream: DataFrame, contract: LinearContract, threshold: float | None = None) -> DataFrame:
    """R1 on a stream: the same generated expression, no state."""
    return score_linear_contract(stream, contract, threshold)
