"""The reference's own regression cases, as behaviours of the operators."""
import pytest
from pyspark.sql import functions as F

from nightjar.operators import labels as L

NIGHTS = [(1, "2026-03-01", 420.0), (1, "2026-03-02", 390.0)]


def _nights(spark):
    return spark.createDataFrame(NIGHTS, "subject_id long, night_date string, total_sleep_minutes double") \
        .withColumn("night_date", F.to_date("night_date"))


def test_night_date_alias_and_integer_stats(spark):
    labels = spark.createDataFrame([(1, "2026-03-02", 0), (1, "2026-03-03", 1)],
                                   "subject_id long, night_date string, fatigue_label int")
    v = L.require_valid(L.validate_labels(labels))
    merged = L.join_next_day_labels(_nights(spark), v.filter("is_valid"))
    assert sorted(r["label"] for r in merged.collect()) == [0, 1]
    rep = L.label_check_report(merged).first()
    assert rep["nights_total"] == 2 and rep["labels_present"] == 2 and isinstance(rep["labels_present"], int)


def test_missing_label_fails_and_reports(spark):
    labels = spark.createDataFrame([(1, "2026-03-02", "1")], "subject_id long, date string, fatigue_label string")
    v = L.validate_labels(labels).filter("is_valid")
    missing = L.missing_label_report(_nights(spark), v)
    assert [str(r["label_date"]) for r in missing.collect()] == ["2026-03-03"]
    with pytest.raises(L.LabelError, match="Missing fatigue labels"):
        L.require_labels(missing)


def test_non_binary_label_fails(spark):
    labels = spark.createDataFrame([(1, "2026-03-02", "Low"), (1, "2026-03-03", "1")],
                                   "subject_id long, date string, fatigue_label string")
    with pytest.raises(L.LabelError, match="binary 0/1"):
        L.require_valid(L.validate_labels(labels))


def test_label_encoding_of_seen_classes(spark):
    train = spark.createDataFrame([(0,), (1,), (0,), (1,)], "y int")
    test = spark.createDataFrame([(1,), (0,)], "y int")
    idx = {r["y"]: r["label_index"] for r in L.label_index(train, "y").collect()}
    assert idx == {0: 0, 1: 1}
    assert L.unseen_labels(train, test, "y").count() == 0
    coded = test.join(L.label_index(train, "y"), "y").count()
    assert coded == 2


def test_unseen_test_class_is_an_error(spark):
    train = spark.createDataFrame([(0,), (0,), (0,)], "y int")
    test = spark.createDataFrame([(0,), (1,)], "y int")
    with pytest.raises(L.LabelError, match="unseen y classes"):
        L.require_seen(L.unseen_labels(train, test, "y"), "y")
