"""Findings of round 3: what each of them named, on rows made here."""
import datetime as dt

from pyspark.sql import functions as F

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def lineitem(spark, path, flags):
    """One line a day with the given flags, in the folder of a query's tables."""
    rows = [(i, i % 7, i % 5, 1, float(i % 50), 900.0 + 13 * i, (i % 11) / 100, (i % 9) / 100, f, "O",
             dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, LINE)
    df.write.parquet(f"{path}/lineitem.parquet")
    return df


def test_unseen_labels_takes_the_rows_behind_the_chronological_split(spark, tmp_path):
    import __spark_entry__ as E
    lineitem(spark, tmp_path, ["A", "R"] * 35 + ["A", "N", "R"] * 10)  # 70 % of 100: the train part has no N
    assert [tuple(r) for r in E.queries()["unseen_labels"](spark, str(tmp_path)).collect()] == [("N",)]
    assert E.oracle_sql()["unseen_labels"].count("lineitem") == 2


def test_bootstrap_weighs_every_row(spark):
    import hashlib

    from nightjar.functions.hashrand import GOLDEN_32, MASK_32, MIX_MUL, poisson1_cdf
    from nightjar.operators import robust as E

    def mixed(x):
        for _ in range(2):
            x = (x >> 16 ^ x) * MIX_MUL & MASK_32
        return x >> 16 ^ x

    def weight(key, r):
        h = hashlib.md5(f"{key}|42".encode()).hexdigest()
        u = mixed(mixed(int(h[:8], 16) ^ r * GOLDEN_32 & MASK_32) ^ int(h[8:16], 16)) / 2**32
        return sum(u >= c for c in poisson1_cdf()[:-1])
    df = spark.range(300).selectExpr("id", "cast(id % 2 as int) as y", "if(id % 7 = 0, null, cast(id % 3 = 0 as int)) as yhat")
    got = E.bootstrap_ci(df, "y", "yhat", 20, metric="accuracy", key_cols=["id"]).first()
    want = []
    for r in range(20):
        w = [weight(i, r) for i in range(300)]
        want.append(sum(x for i, x in enumerate(w) if i % 7 and i % 2 == (i % 3 == 0)) / sum(w))
    assert got["replicates"] == 20 and abs(got["mean"] - sum(want) / 20) < 1e-12


def test_health_records_are_one_file_a_subject(spark, tmp_path, monkeypatch):
    from nightjar.sources import readers as S
    rows = spark.range(0, 400, 1, 8).selectExpr(
        "if(id < 200, 9, id % 4) as subject_id", "'T' as record_type", "cast(id as string) as uuid", "'s' as source_name",
        "cast(null as string) as unit", "'a' as start_raw", "'b' as end_raw", "'c' as created_raw", "cast(id as string) as value_raw")
    monkeypatch.setattr(S, "SUBJECT_RECORDS", 60)  # subject 9 is a large one
    S.write_health_records(rows, f"{tmp_path}/x")
    files = {i: len(list((tmp_path / "x" / f"subject_id={i}").glob("part-*"))) for i in (0, 1, 2, 3, 9)}
    assert all(files[i] == 1 for i in range(4)) and 2 <= files[9] <= 4
    got = S.read_health_records(spark, f"{tmp_path}/x").selectExpr("int(subject_id) as s", "int(uuid) as u").collect()
    assert sorted((r["s"], r["u"]) for r in got) == sorted((9 if i < 200 else i % 4, i) for i in range(400))


def test_student_of_one_class_learns_the_true_labels(spark):
    """The reference's fallback; before, Newton steps went on for hundreds of passes."""
    from nightjar.operators import models as ML
    df = spark.range(200).selectExpr("cast(id as double) as x", "cast((id * 7) % 200 > 120 as int) as target", "0 as student_label")
    got = ML.fit_student(df, ["x"], "target", 2.0, "student").model
    want = ML.fit_logistic(df, ["x"], "target", C=2.0).model
    assert got == want
    both = df.withColumn("student_label", (F.col("x") > 90).cast("int"))
    assert ML.fit_student(both, ["x"], "target", 2.0, "student").model == ML.fit_logistic(both, ["x"], "student_label", C=2.0).model


def test_cut_rows_come_back_by_column(spark):
    from nightjar.session import cut_lineage
    df = spark.range(50).selectExpr("id", "id / 3 as v", "array(id) as a", "timestamp_seconds(id) as t")
    cut = cut_lineage(df)
    assert sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
    assert "FileScan parquet" in cut.select("v")._jdf.queryExecution().executedPlan().toString()
    void = cut_lineage(spark.range(3).selectExpr("id", "null as n"))  # Parquet has no such type
    assert [r["n"] for r in void.collect()] == [None] * 3
