"""Operator 2 against brute force, with colliding digests and later files."""
import hashlib

import pytest

from pyspark.sql import functions as F

from nightjar.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, id string, digest int, file int, n long"


def write(spark, rows, path, mode="append"):
    wide = [(i, t, "clash", 1, 2, 3) for i, t in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.mode(mode).parquet(path)


def brute(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own)))
    return sorted(out, key=str)


ROWS = ([(i, f"Text {i % 7}") for i in range(60)] + [(100 + i, "TEXT 3") for i in range(200)]
        + [(500, None), (501, ""), (502, " "), (503, "É"), (504, "é"), (None, "no id"), (None, "no id"), (505, "NO ID"),
           (506, "twice"), (506, "twice"), (507, "long " * 100_000), (508, "LONG " * 100_000), (None, "alone")])


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == brute(rows)
    by = {}
    for r in got:
        by.setdefault((r.digest, r.keep_id, r.group_size), []).append(r)
    for (_, keep, n), own in by.items():
        assert sum(r.kept for r in own) == 1 and len(own) == n
        assert next(r.doc_id for r in own if r.kept) == keep


def test_brute_force(spark, tmp_path):
    write(spark, ROWS, f"{tmp_path}/t.parquet")
    df = X.exact_duplicates(spark, f"{tmp_path}/t.parquet")
    check(df, ROWS)
    one = df.where("doc_id = 503").first()
    assert bytes(one.digest) == hashlib.sha256("É".encode()).digest()


def test_colliding_digests_are_told_apart_by_full_bytes(spark, tmp_path):
    write(spark, ROWS, f"{tmp_path}/t.parquet")
    check(X.exact_duplicates(spark, f"{tmp_path}/t.parquet", digest=lambda t: F.substring(t.cast("binary"), 1, 1)), ROWS)


def test_small_batches_and_later_files_continue_the_state(spark, tmp_path):
    path, state = f"{tmp_path}/t.parquet", f"{tmp_path}/state"
    write(spark, ROWS[:150], path)
    X.update_state(spark, path, state, batch_bytes=1)  # one file a batch
    assert X.read_state(spark, state).agg({"n": "sum"}).first()[0] == 150
    write(spark, ROWS[150:], path)
    check(X.exact_duplicates(spark, path, checkpoint=state), ROWS)


def test_empty_table(spark, tmp_path):
    write(spark, [], f"{tmp_path}/t.parquet")
    df = X.exact_duplicates(spark, f"{tmp_path}/t.parquet")
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"] and df.count() == 0


@pytest.mark.parametrize("conf", list(X._CONF))
def test_session_settings_are_put_back(spark, conf, tmp_path):
    before = spark.conf.get(conf, None)
    write(spark, ROWS[:3], f"{tmp_path}/t.parquet")
    if conf == list(X._CONF)[0]:
        X.exact_duplicates(spark, f"{tmp_path}/t.parquet").count()
    assert spark.conf.get(conf, None) == before


def test_digests_stay_in_the_jvm(spark, tmp_path):
    write(spark, ROWS, f"{tmp_path}/t.parquet")
    df = X.exact_duplicates(spark, f"{tmp_path}/t.parquet")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
