"""Readers, path rules and nested payloads on small files written here."""
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from nightjar.operators import prep as P
from nightjar.operators import sensors as Z
from nightjar.sources import readers as S


def test_sensor_text_reader(spark):
    d = tempfile.mkdtemp(prefix="nightjar-text-")
    with open(os.path.join(d, "7_acceleration.txt"), "w") as fh:
        fh.write("# recorded by a watch\ntime,x,y,z\n0.0 1.0 2.0 2.0\n1.5,0,3;4\n\n2.0\tnan\t0\t0\n")
    df = S.read_sensor_text(spark, os.path.join(d, "*.txt"), ["time_s", "x", "y", "z"])
    rows = sorted((r["time_s"], r["x"], r["y"], r["z"]) for r in df.collect())
    assert rows == [(0.0, 1.0, 2.0, 2.0), (1.5, 0.0, 3.0, 4.0), (2.0, None, 0.0, 0.0)]
    mag = df.select(Z.vector_magnitude().alias("m")).orderBy("m").collect()
    assert [r["m"] for r in mag] == [0.0, 3.0, 5.0]
    subj = df.select(Z.subject_from_path(F.col("path")).alias("s")).distinct().collect()
    assert [r["s"] for r in subj] == ["7"]


def test_path_rules(spark):
    paths = ["/root/motion/12_acceleration.txt", "/root/heart_rate/12_heartrate.csv", "/root/12/data.csv",
             "/root/labels/3-labels.txt", "/root/steps/3_steps.txt", "/root/hr/11.txt", "/root/x/1_motion.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    root = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == F.lit("root")
    out = {r["path"]: (r["s"], r["k"]) for r in df.select(
        "path", Z.subject_from_path(F.col("path")).alias("s"), Z.classify_stream_file(F.col("path"), root).alias("k")
    ).collect()}
    assert out["/root/motion/12_acceleration.txt"] == ("12", "motion")
    assert out["/root/heart_rate/12_heartrate.csv"] == ("12", "heart_rate")
    assert out["/root/12/data.csv"] == ("12", None)          # generic stem -> parent folder
    assert out["/root/labels/3-labels.txt"] == ("3", "labels")
    assert out["/root/hr/11.txt"] == ("11", "heart_rate")     # parent folder token
    files = df.select("path", Z.subject_from_path(F.col("path")).alias("subject_id"),
                      Z.classify_stream_file(F.col("path"), root).alias("kind")).filter("kind IS NOT NULL")
    m = {(r["subject_id"], r["kind"]) for r in Z.match_subject_files(files).collect()}
    assert ("1", "motion") in m and ("11", "heart_rate") in m   # exact ids: '1' never takes '11'


def test_nested_payloads(spark):
    schema = StructType([
        StructField("subject", StringType()),
        StructField("signal", StructType([StructField("wrist", StructType([StructField("acc", DoubleType())])),
                                          StructField("chest", DoubleType())])),
    ])
    df = spark.createDataFrame([("a", ((1.0,), 2.0))], schema)
    assert P.flatten_struct(df).columns == ["subject", "signal_wrist_acc", "signal_chest"]
    arr = spark.createDataFrame([("a", [0.0, 0.5, 1.0], [10.0, 11.0, 12.0])], "subject string, t array<double>, hr array<double>")
    rows = P.parallel_arrays_to_rows(arr, ["t", "hr"], ["subject"], time_col="t").collect()
    assert [(r["time_s"], r["hr"]) for r in rows] == [(0.0, 10.0), (0.5, 11.0), (1.0, 12.0)]
    odd = spark.createDataFrame([("a", [1.0, 2.0], [5.0, 6.0], [7.0]), ("b", [1.0], [5.0, 6.0], [7.0, 8.0])],
                                "subject string, x array<double>, y array<double>, z array<double>")
    rows = P.parallel_arrays_to_rows(odd, ["x", "y", "z"], ["subject"]).orderBy("subject", "time_s").collect()
    assert [tuple(r) for r in rows] == [("a", 0.0, 1.0, 5.0, None), ("a", 1.0, 2.0, 6.0, None),
                                        ("b", 0.0, None, 5.0, 7.0), ("b", 1.0, None, 6.0, 8.0)]
    timed = P.parallel_arrays_to_rows(odd.withColumnRenamed("x", "t"), ["t", "y", "z"], ["subject"]).orderBy("subject", "time_s")
    assert [tuple(r) for r in timed.collect()] == [("a", 1.0, 5.0, None), ("a", 2.0, 6.0, None), ("b", 1.0, None, None)]


def test_sensor_text_blanks_and_short_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\ntime x y\n0.0,,2.0,3.0\n1.0 2.0\n 2.0 ; 3.0;\n3.0\t4.0\t5.0 6.0 7.0\n\n4.0\n")
    got = sorted(tuple(r)[1:] for r in S.read_sensor_text(spark, str(tmp_path), ["time", "x", "y"]).collect())
    assert got == [(0.0, None, 2.0), (1.0, 2.0, None), (2.0, 3.0, None), (3.0, 4.0, 5.0), (4.0, None, None)]


def test_table_or_empty_and_json(spark):
    schema = StructType([StructField("k", StringType()), StructField("v", DoubleType())])
    empty = S.read_table_or_empty(spark, "/nonexistent/nightjar/table", schema)
    assert empty.count() == 0 and empty.schema == schema
    d = tempfile.mkdtemp(prefix="nightjar-json-")
    with open(os.path.join(d, "one.json"), "w") as fh:
        fh.write('[{"k": "a", "v": 1.5}, {"k": "b", "v": null}]')
    rows = S.read_feature_json(spark, os.path.join(d, "one.json"), schema, multiline=True).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("a", 1.5), ("b", None)]


def test_land_export_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="nightjar-xml-")
    xml = os.path.join(d, "export.xml")
    with open(xml, "w") as fh:
        fh.write('<?xml version="1.0"?>\n<HealthData>\n'
                 '<Record type="HKQuantityTypeIdentifierHeartRate" uuid="u1" sourceName="Apple Watch" unit="count/min" '
                 'startDate="2024-06-18 23:10:00 -0400" endDate="2024-06-18 23:10:00 -0400" value="61"/>\n'
                 '<Record type="HKCategoryTypeIdentifierSleepAnalysis" uuid="u2" sourceName="Phone" '
                 'startDate="2024-06-18 23:00:00 -0400" endDate="2024-06-19 06:00:00 -0400" '
                 'value="HKCategoryValueSleepAnalysisAsleepCore">\n'
                 '  <MetadataEntry key="HKWasUserEntered" value="1"/>\n</Record>\n'
                 '<Record type="HKQuantityTypeIdentifierStepCount" uuid="u3" sourceName="Phone" unit="count" '
                 'startDate="2024-06-18 10:00:00 -0400" endDate="2024-06-18 10:05:00 -0400" value="120"/>\n'
                 '</HealthData>\n')
    table = S.land_export(spark, xml, os.path.join(d, "landed"), subject_id="me")
    got = {r["uuid"]: r["metric"] for r in table.collect()}
    assert got == {"u1": "hr", "u2": "sleep", "u3": "other"}
    sleep = table.filter("metric = 'sleep'").first()
    assert sleep["metadata"][0]["key"] == "HKWasUserEntered" and sleep["metadata"][0]["value"] == "1"
    counts = {r["record_type"]: r["n"] for r in S.record_type_counts(table).collect()}
    assert sum(counts.values()) == 3
    assert S.preview(table.filter("metric <> 'other'"), n=1).count() == 2


def test_broken_records_are_quarantined(spark, tmp_path):
    # last in its file: Spark's reader leaves what follows a broken record unread
    from nightjar.sources import readers as R
    (tmp_path / "anna.xml").write_text("""<HealthData>
<Record type="T" uuid="1" value="60"><MetadataEntry key="HKWasUserEntered" value="1"/></Record>
<Record type="T" uuid="3" value="62"/>
<Record type="T" uuid="2" value=broken></Record>
</HealthData>""")
    path = f"file:{tmp_path}/anna.xml"
    good = {r["uuid"]: r for r in R.read_health_records(spark, path).collect()}
    assert set(good) == {"1", "3"} and good["1"]["subject_id"] == "anna"
    assert [tuple(m) for m in good["1"]["metadata"]] == [("HKWasUserEntered", "1")] and good["3"]["metadata"] == []
    bad = R.read_quarantine(spark, path).collect()
    assert len(bad) == 1 and "broken" in bad[0]["record"] and bad[0]["subject_id"] == "anna"
