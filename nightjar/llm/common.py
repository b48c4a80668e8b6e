"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, delete_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_ROOT: ContextVar[str | None] = ContextVar("scratch_root", default=None)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared folder of the cluster."""
    root = _ROOT.get() or checkpoint_dir(spark).rstrip("/")
    return f"{root}/llm-{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch(spark: SparkSession):
    """Everything that operators write inside goes when the block ends: use
    their results (write them elsewhere, count, collect) before."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _ROOT.set(root)
    try:
        yield root
    finally:
        _ROOT.reset(token)
        delete_folder(spark, root)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives
    the loss of executors, and makes later reads see the same rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str | None) -> DataFrame:
    """Only the named columns, under the operator's own names (so that other
    columns of the input, whatever their names, cannot clash); a column given
    as None becomes a null string."""
    out = []
    for name, source in columns.items():
        out.append(F.lit(None).cast("string").alias(name) if source is None
                   else df[_quoted(source)].alias(name))
    return df.select(*out)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many more underscores as keep it apart from the
    columns (Spark compares names without case)."""
    have = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Texts that go to a Python worker at a time; a longer text goes alone.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def map_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, so that a worker's memory
    does not depend on how long texts are on average."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()
    return rows.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on after their task."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
