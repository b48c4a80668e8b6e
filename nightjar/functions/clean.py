"""P7 to_numeric_or_null, P8 sanitize_numeric, P9 safe_divide, P22 finite_only.

pandas treats NaN as missing and skips it in aggregates; Spark does not
(avg(1, NaN, 2) is NaN). Every numeric boundary therefore maps NaN and
+-inf to null, and division uses ``try_divide`` (ANSI mode raises on /0).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _finite_sql(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR abs({x}) = double('Infinity') THEN NULL ELSE {x} END"


def finite_or_null(c) -> Column:
    """NaN, +inf, -inf -> null; other values unchanged (as double).

    A column name becomes one SQL expression (one call into the JVM instead of
    a dozen when plans carry hundreds of such columns)."""
    if isinstance(c, str):
        return F.expr(_finite_sql(f"CAST(`{c}` AS DOUBLE)"))
    x = _col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def to_numeric_or_null(c) -> Column:
    """Coerce text or numbers to double; unparseable, NaN and inf -> null."""
    if isinstance(c, str):
        return F.expr(_finite_sql(f"TRY_CAST(`{c}` AS DOUBLE)"))
    return finite_or_null(_col(c).try_cast("double"))


def safe_divide(num, den) -> Column:
    """num / den with a zero or missing denominator -> null, inf -> null."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(_finite_sql(f"try_divide(CAST(`{num}` AS DOUBLE), CAST(`{den}` AS DOUBLE))"))
    return finite_or_null(F.try_divide(_col(num).cast("double"), _col(den).cast("double")))


def sanitize_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One ``select`` that coerces the given (default: numeric) columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    wanted = set(columns)
    return df.select([
        to_numeric_or_null(c).alias(c) if c in wanted else F.col(c) for c in df.columns
    ])
