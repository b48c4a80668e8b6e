"""Hash-keyed randomness.

``rand(seed)`` depends on partitioning, so results would change with the
cluster layout. A uniform in [0, 1) derived from md5 of a key string is the
same on every layout and in DuckDB:
``conv(substring(md5(key), 1, 8), 16, 10) / 2^32``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def hash_uniform(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def poisson1_cdf(max_k: int = 16) -> list[float]:
    """CDF of Poisson(1) at 0..max_k, from the formula e^-1 * sum 1/j!."""
    out, acc = [], 0.0
    for k in range(max_k + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson1_from_uniform(u: Column, max_k: int = 16) -> Column:
    """Inverse CDF of Poisson(1): smallest k with CDF(k) > u."""
    cdf = poisson1_cdf(max_k)
    expr = F.lit(max_k)
    for k in range(max_k - 1, -1, -1):
        expr = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr.cast("int")


def poisson1_sql(u_sql: str, max_k: int = 16) -> str:
    """Same inverse CDF as a SQL CASE (used by the DuckDB oracle)."""
    cdf = poisson1_cdf(max_k)
    arms = " ".join(f"WHEN {u_sql} < {cdf[k]!r} THEN {k}" for k in range(max_k))
    return f"(CASE {arms} ELSE {max_k} END)"


# Integer mixer for many draws per row: one md5 per row gives a 64-bit seed as
# two 32-bit words. Each replicate r is mixed into the low word with a 32-bit
# integer hash, the high word into that result (multiply / xor-shift, all
# intermediate values < 2^59, so no overflow in 64-bit arithmetic in Spark or
# DuckDB). Rows share a draw sequence only where all 64 bits agree.
GOLDEN_32 = 0x9E3779B9
MIX_MUL = 0x45D9F3B
MASK_32 = 0xFFFFFFFF


def hash_words(key: Column) -> tuple[Column, Column]:
    """Low and high word: the first and second 32 bits of md5(key)."""
    md5 = F.md5(key.cast("string"))
    return tuple(F.conv(F.substring(md5, at, 8), 16, 10).cast("long") for at in (1, 9))


def _mixed(x: Column) -> Column:
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX_MUL)).bitwiseAND(F.lit(MASK_32))
    return F.shiftright(x, 16).bitwiseXOR(x)


def mix_uniform(words: tuple[Column, Column], r: Column) -> Column:
    """Uniform in [0, 1) from a row's hash words and a replicate number."""
    low, high = words
    x = _mixed(low.bitwiseXOR((r.cast("long") * F.lit(GOLDEN_32)).bitwiseAND(F.lit(MASK_32))))
    return _mixed(x.bitwiseXOR(high)).cast("double") / F.lit(TWO_POW_32)


def hash_words_sql(key_sql: str) -> tuple[str, str]:
    return tuple(f"CAST(('0x' || substr(md5({key_sql}), {at}, 8)) AS BIGINT)" for at in (1, 9))


def draws_sql(source: str, low: str, high: str, r: str, out: str = "u") -> str:
    """``source`` with column ``out``: the same uniform, one step per level (the
    text of a step names the one before it twice)."""
    q = f"SELECT *, xor({low}, (CAST({r} AS BIGINT) * {GOLDEN_32}) & {MASK_32}) AS m0 FROM ({source}) d"
    for word in (f"xor(m0, {high})", None):
        for _ in range(2):
            q = f"SELECT * REPLACE ((xor(m0 >> 16, m0) * {MIX_MUL}) & {MASK_32} AS m0) FROM ({q}) d"
        q = f"SELECT * REPLACE (xor(m0 >> 16, m0) AS m0) FROM ({q}) d"
        if word:
            q = f"SELECT * REPLACE ({word} AS m0) FROM ({q}) d"
    return f"SELECT * EXCLUDE (m0), CAST(m0 AS DOUBLE) / {TWO_POW_32!r} AS {out} FROM ({q}) d"
