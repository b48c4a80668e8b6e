"""Registry of named queries (one per operator in the inventory) and their
DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables. Its
output goes through ``presentable`` so Spark and the oracle agree on types:
doubles rounded to 6 decimals (summation order differs between engines),
instants shown as UTC wall clock.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType, TimestampType

ROUND_DIGITS = 6


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op_ids: str = ""
    bench: bool = False
    notes: str = ""
    extra: dict = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, op_ids: str = "", bench: bool = False, notes: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, op_ids, bench, notes)
        return fn
    return deco


def presentable(df: DataFrame) -> DataFrame:
    """One ``selectExpr`` (a single call into the JVM however wide the table)."""
    exprs = []
    for f in df.schema.fields:
        q = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(f"round(CAST({q} AS DOUBLE), {ROUND_DIGITS}) AS {q}")
        elif isinstance(f.dataType, TimestampType):
            exprs.append(f"CAST({q} AS TIMESTAMP_NTZ) AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)


def oracle_wrap(inner_sql: str, doubles: list[str]) -> str:
    """Round the listed double columns of an oracle query the same way."""
    if not doubles:
        return inner_sql
    rep = ", ".join(f"round(CAST(\"{c}\" AS DOUBLE), {ROUND_DIGITS}) AS \"{c}\"" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner_sql}\n) q"
