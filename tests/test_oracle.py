"""The correctness gate, locally: every registered query with an oracle
against DuckDB on the smallest driver tables."""
import pytest

from conftest import SF_SMALL
from nightjar.plans.verify import check


def test_all_oracles_sf0001(spark):
    import __spark_entry__ as E
    names = sorted(E.oracle_sql())
    res = check(spark, SF_SMALL, names, verbose=False)
    bad = {k: v[1] for k, v in res.items() if not v[0]}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["subject_id", "night_date", "sleep_start", "sleep_end"]
