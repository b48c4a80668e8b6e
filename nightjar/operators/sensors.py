"""Sensor time series -> fixed windows with as-of labels.

P10 standardize_columns, P11 to_relative_seconds, P12 resolve_label_column,
P17 vector_magnitude, P25 window_bounds, A5/A6 tumbling window stats,
J5 as-of window labels, J6 assemble windows, J7 target window, J8 match
subject files, S5 subject_from_path, S6 classify_stream_files, U1 union, A9 dataset
summary, K1 order, F8/F9.

Samples are ``(dataset_name, subject_id, time_s, channels...)``; all
operators run over every subject at once (no per-subject driver loop).
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.clean import to_numeric_or_null

SUBJECT, DATASET, WINDOW, TIME = "subject_id", "dataset_name", "window_index", "time_s"
GROUP = [SUBJECT, DATASET]

# Candidate names (first present wins).
TIME_CANDIDATES = ["time_s", "time", "timestamp", "seconds", "second", "sec", "t"]
LABEL_CANDIDATES = ["label", "labels", "stage", "sleep_stage", "value"]
TARGET_CANDIDATES = ["hr", "heart_rate", "label", "target", "y"]
WINDOW_STATS = ["mean", "std", "min", "max", "median", "count"]
STEP_STATS = ["mean", "std", "min", "max", "sum", "count"]


# ---------------------------------------------------------------- P10 / P12 / P14
def clean_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def standardize_columns(df: DataFrame, keep_non_numeric: bool = False) -> tuple[DataFrame, str]:
    """P10: trim/lower/spaces->_ names; pick the time column from the
    candidates (else the first column) and name it ``time_s``; drop
    non-numeric columns unless asked. Schema metadata only — no data pass."""
    renamed = df.toDF(*[clean_name(c) for c in df.columns])
    time_col = next((c for c in TIME_CANDIDATES if c in renamed.columns), renamed.columns[0])
    keep = [f.name for f in renamed.schema.fields
            if f.name == time_col or keep_non_numeric or isinstance(f.dataType, NumericType)
            or f.name in GROUP]
    out = renamed.select(*keep)
    if time_col != TIME:
        out = out.withColumnRenamed(time_col, TIME)
    return out, time_col


def resolve_label_column(df: DataFrame) -> DataFrame:
    """label = first of the candidates, else the second column; rows
    missing time or label dropped; label as text."""
    cols = [c for c in df.columns if c not in GROUP]
    label = next((c for c in LABEL_CANDIDATES if c in df.columns), cols[1] if len(cols) > 1 else None)
    if label is None:
        raise ValueError("no label column")
    out = df.select(*[c for c in GROUP if c in df.columns], to_numeric_or_null(TIME).alias(TIME),
                    F.col(label).cast("string").alias("label"),
                    *(["ingest_seq"] if "ingest_seq" in df.columns else []))
    return out.dropna(subset=[TIME, "label"])


def numeric_channels(df: DataFrame, exclude: set[str] | None = None) -> list[str]:
    ex = set(exclude or ()) | {TIME, SUBJECT, DATASET, WINDOW, "ingest_seq"}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


# ---------------------------------------------------------------- P11 / P17 / P25
def to_relative_seconds(df: DataFrame, time_col: str, scope: list[str]) -> DataFrame:
    """Numeric time passes through; text time is parsed as UTC and made
    relative to the scope's earliest time (the reference uses the first in
    file order; Spark has no file order, so the minimum)."""
    as_num = F.col(time_col).try_cast("double")
    parsed = F.unix_micros(F.try_to_timestamp(F.col(time_col).cast("string"))) / F.lit(1e6)
    out = df.withColumn("_num", as_num).withColumn("_abs", parsed)
    first = out.groupBy(*scope).agg(F.min("_abs").alias("_first"))
    out = out.join(first, scope, "left")
    return out.withColumn(TIME, F.coalesce(F.col("_num"), F.col("_abs") - F.col("_first"))).drop(
        "_num", "_abs", "_first", *([time_col] if time_col != TIME else []))


def vector_magnitude(x: str = "x", y: str = "y", z: str = "z", cols: list[str] | None = None) -> Column:
    """sqrt(x^2 + y^2 + z^2) with an absent axis counted as 0."""
    present = set(cols or [x, y, z])
    parts = [F.coalesce(F.col(a), F.lit(0.0)) if a in present else F.lit(0.0) for a in (x, y, z)]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def window_bounds(df: DataFrame, window_sec: float) -> DataFrame:
    """P25: window start/end seconds from the index."""
    return df.withColumns({"window_start_s": F.col(WINDOW) * F.lit(float(window_sec)),
                           "window_end_s": F.col(WINDOW) * F.lit(float(window_sec)) + F.lit(float(window_sec))})


# ---------------------------------------------------------------- A5 / A6 / J7
def _stat(stat: str, c: Column) -> Column:
    return {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "median": F.median(c),
            "count": F.count(c), "sum": F.coalesce(F.sum(c), F.lit(0.0))}[stat]


def window_index(window_sec: float) -> Column:
    return F.floor(F.col(TIME) / F.lit(float(window_sec))).cast("long")


def tumbling_window_stats(df: DataFrame, channels: list[str], window_sec: float, prefix: str,
                          stats: list[str] = WINDOW_STATS, extra: dict[str, tuple[list[str], list[str]]] | None = None,
                          group: list[str] = GROUP) -> DataFrame:
    """A5 (A6 with ``stats`` containing 'sum'): ``floor(time / w)`` groups with
    per-channel stats named ``{prefix}{col}_{stat}`` (sample std; count of
    non-missing; all-missing sum = 0). ``extra`` adds other prefixes' stats in
    the SAME aggregation (J7's target columns), so there is no second pass
    and no join."""
    clean = df.filter(F.col(TIME).isNotNull()).withColumn(WINDOW, window_index(window_sec))
    aggs = [_stat(s, F.col(c).cast("double")).alias(f"{prefix}{c}_{s}") for c in channels for s in stats]
    for pfx, (cols, sts) in (extra or {}).items():
        aggs += [_stat(s, F.col(c).cast("double")).alias(f"{pfx}{c}_{s}") for c in cols for s in sts]
    return clean.groupBy(*group, WINDOW).agg(*aggs)


def target_column(df: DataFrame) -> str | None:
    """The first numeric candidate column is the window target."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return next((c for c in TARGET_CANDIDATES if c in numeric), None)


# ---------------------------------------------------------------- J5
def next_time(df: DataFrame, part: list[str], time_col: str, order_tie: str, bucket_sec: float,
              out: str = "_next") -> DataFrame:
    """Time of the following row per ``part`` without sorting a whole
    partition in one task: ``lead`` within (part, time bucket), and the last
    row of a bucket takes the first time of the next non-empty bucket from a
    per-bucket table (one row per bucket)."""
    b = F.floor(F.col(time_col) / F.lit(float(bucket_sec))).cast("long")
    d = df.withColumn("_bucket", b)
    inner = Window.partitionBy(*part, "_bucket").orderBy(time_col, order_tie)
    d = d.withColumn(out, F.lead(time_col).over(inner))
    firsts = d.groupBy(*part, "_bucket").agg(F.min(time_col).alias("_first"))
    firsts = firsts.withColumn("_next_first", F.lead("_first").over(Window.partitionBy(*part).orderBy("_bucket")))
    d = d.join(firsts.select(*part, "_bucket", "_next_first"), [*part, "_bucket"], "inner")
    return d.withColumn(out, F.coalesce(F.col(out), F.col("_next_first"))).drop("_bucket", "_next_first")


def _labels_and_range(labels: DataFrame, w: float) -> tuple[DataFrame, DataFrame]:
    """One label per (subject, time), and each subject's window range."""
    lab = labels.select(*GROUP, TIME, F.col("label").cast("string").alias("label"),
                        F.coalesce(F.col("ingest_seq"), F.lit(0)).cast("long").alias("ingest_seq")
                        if "ingest_seq" in labels.columns else F.lit(0).cast("long").alias("ingest_seq"))
    lab = lab.filter(F.col(TIME).isNotNull() & F.col("label").isNotNull())
    # Of labels with one time the last in ingest order (partial aggregate).
    lab = lab.groupBy(*GROUP, TIME).agg(F.max_by("label", "ingest_seq").alias("label"),
                                        F.max("ingest_seq").alias("ingest_seq"))
    rng = lab.groupBy(*GROUP).agg(F.floor(F.min(TIME) / w).cast("long").alias("_lo_all"),
                                  F.ceil(F.max(TIME) / w).cast("long").alias("_hi_all"))
    return lab, rng


def asof_labels_of_windows(windows: DataFrame, labels: DataFrame, window_sec: float,
                           bucket_sec: float = 86400.0) -> DataFrame:
    """J5 for windows that exist: the label that ``asof_window_labels`` gives
    each distinct (subject, window) of ``windows``; those without one (before
    the first label, beyond the labels' range) are not returned.

    Work follows the samples and labels, not the time between them: midpoints
    and label times stand in one table, in which the last label is carried
    forward within (subject, time bucket); a bucket without an earlier label of
    its own takes the last one of the buckets before it, from a table with one
    row per subject and bucket. No window is generated, and no task sorts a
    whole subject.
    """
    w = float(window_sec)
    lab, rng = _labels_and_range(labels, w)
    asked = (windows.select(*GROUP, WINDOW).distinct().join(rng, GROUP, "inner")
             .filter(F.col(WINDOW).between(F.col("_lo_all"), F.col("_hi_all"))))
    points = asked.select(*GROUP, (F.col(WINDOW) * F.lit(w) + F.lit(w / 2)).alias(TIME), WINDOW,
                          F.lit(None).cast("string").alias("label"))
    points = points.unionByName(lab.select(*GROUP, TIME, F.lit(None).cast("long").alias(WINDOW), "label"))
    points = points.withColumn("_bucket", F.floor(F.col(TIME) / F.lit(float(bucket_sec))).cast("long"))
    # a label at the midpoint itself counts: labels (no window) come first
    here = Window.partitionBy(*GROUP, "_bucket").orderBy(TIME, F.col(WINDOW).asc_nulls_first())
    before = Window.partitionBy(*GROUP).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (points.groupBy(*GROUP, "_bucket")
               .agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col(TIME))).alias("_last"))
               .withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last"))
    found = (points.withColumn("_label", F.last("label", ignorenulls=True).over(here))
             .filter(F.col(WINDOW).isNotNull()).join(carried, [*GROUP, "_bucket"], "inner"))
    label = F.coalesce("_label", "_carried")
    return found.select(*GROUP, WINDOW, label.alias("label")).filter(F.col("label").isNotNull())


def asof_window_labels(labels: DataFrame, window_sec: float, bucket_sec: float = 86400.0) -> DataFrame:
    """For every window ``floor(min/w) .. ceil(max/w)`` of a subject, the
    latest label at or before the window's midpoint (exact match allowed, no
    tolerance; with duplicate times the last by ``ingest_seq`` wins);
    windows before the first label are dropped; label as text.

    Each label owns the span up to the next label's time; the windows whose
    midpoint falls in the span are generated with ``sequence`` (bounded by
    the subject's own window range) and filtered with exact comparisons.
    """
    w = float(window_sec)
    lab, rng = _labels_and_range(labels, w)
    spans = next_time(lab, GROUP, TIME, "ingest_seq", bucket_sec).join(rng, GROUP, "inner")
    lo = F.greatest(F.col("_lo_all"), F.ceil((F.col(TIME) - w / 2) / w).cast("long") - 1)
    hi = F.least(F.col("_hi_all"),
                 F.when(F.col("_next").isNull(), F.col("_hi_all"))
                 .otherwise(F.ceil((F.col("_next") - w / 2) / w).cast("long") + 1))
    cand = spans.filter(hi >= lo).withColumn(WINDOW, F.explode(F.sequence(lo, hi)))
    mid = F.col(WINDOW) * F.lit(w) + F.lit(w / 2)
    ok = (mid >= F.col(TIME)) & (F.col("_next").isNull() | (mid < F.col("_next")))
    return cand.filter(ok).select(*GROUP, WINDOW, "label")


# ---------------------------------------------------------------- J6
def assemble_sensor_windows(motion_w: DataFrame, hr_w: DataFrame | None, steps_w: DataFrame | None,
                            label_w: DataFrame, window_sec: float,
                            label_subjects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Motion LEFT hr LEFT steps INNER labels on (subject, dataset,
    window) for all subjects at once; returns (windows, notes). Subjects
    lacking motion or labels are reported in ``notes`` (left anti joins).
    ``label_subjects``: rows of all subjects with labels, where ``label_w``
    covers existing windows only."""
    key = [*GROUP, WINDOW]
    merged = motion_w
    if hr_w is not None:
        merged = merged.join(hr_w, key, "left")
    if steps_w is not None:
        merged = merged.join(steps_w, key, "left")
    merged = window_bounds(merged.join(label_w, key, "inner"), window_sec)
    m_subj = motion_w.select(*GROUP).distinct()
    l_subj = (label_w if label_subjects is None else label_subjects).select(*GROUP).distinct()
    notes = (m_subj.join(l_subj, GROUP, "left_anti").withColumn("note", F.lit("missing labels"))
             .unionByName(l_subj.join(m_subj, GROUP, "left_anti").withColumn("note", F.lit("missing motion"))))
    return merged, notes


# ---------------------------------------------------------------- S5 / S6 / J8
# Stream-kind name tokens (first kind wins), generic stems,
# and subject-id suffix patterns.
KIND_TOKENS = [("motion", ["motion", "acceler", "accel"]), ("heart_rate", ["heart_rate", "heartrate", "hr"]),
               ("steps", ["steps"]), ("labels", ["labels", "labeled_sleep", "sleep_label", "stage"])]
GENERIC_STEMS = ["data", "sample", "samples", "recording", "recordings", "subject", "file", "output"]
SUBJECT_SUFFIX_PATTERNS = [
    r"(?i)^(.+?)(_acceleration|_accelerometer|_heartrate|_heart_rate|_steps|_labeled_sleep|_labels|_label|_motion)$",
    r"(?i)^(.+?)(-acceleration|-heartrate|-heart-rate|-steps|-labels|-label)$",
]


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def subject_from_path(path: Column) -> Column:
    """Id before a known stream suffix; else the stem unless generic;
    else the parent folder."""
    stem, parent = _stem(path), _parent(path)
    generic = F.lower(stem).isin(GENERIC_STEMS)
    out = F.when(~generic & (stem != ""), stem).otherwise(parent)
    for pat in reversed(SUBJECT_SUFFIX_PATTERNS):
        out = F.when(F.regexp_extract(stem, pat, 1) != "", F.regexp_extract(stem, pat, 1)).otherwise(out)
    return out


def classify_stream_file(path: Column, root_depth_parent: Column) -> Column:
    """Kind by name tokens in the file name, or in the parent folder
    unless the parent is the dataset root; first kind wins."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    parent = F.lower(_parent(path))
    out = F.lit(None).cast("string")
    for kind, tokens in reversed(KIND_TOKENS):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | F.contains(name, F.lit(t)) | (~root_depth_parent & F.contains(parent, F.lit(t)))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def match_subject_files(files: DataFrame) -> DataFrame:
    """Per (subject, kind) the first file in path order; subject ids
    match exactly (the reference's substring match lets '1' take '11')."""
    return files.groupBy(SUBJECT, "kind").agg(F.min("path").alias("path"))


# ---------------------------------------------------------------- U1 / A9 / K1
def union_window_tables(tables: list[DataFrame]) -> DataFrame:
    """Stack window tables with differing columns (missing -> null)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dataset_summary(windows: DataFrame, label_col: str | None = "label") -> DataFrame:
    """Rows and distinct subjects per dataset plus an overall row, and
    label cardinality.

    The window rows are reduced once, to counts by (dataset, subject, label);
    the distinct counts are folded from that table, level by level: its subjects
    by dataset and overall, its labels likewise."""
    by = [DATASET, SUBJECT] + ([label_col] if label_col and label_col in windows.columns else [])
    present = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))

    def folded(col: str, out: str) -> DataFrame:
        """Rows and distinct values by dataset, and overall."""
        own = present.groupBy(DATASET, col).agg(F.sum("rows").alias("rows"))
        total = [F.sum("rows").alias("rows"), F.count(col).alias(out)]
        per = own.groupBy(DATASET).agg(*total)
        whole = own.groupBy(col).agg(F.sum("rows").alias("rows")).agg(*total)
        return per.unionByName(whole.select(F.lit("__all__").alias(DATASET), "rows", out))
    out = folded(SUBJECT, "subjects")
    if len(by) == 3:
        labels = folded(label_col, "label_cardinality").drop("rows")
        out = (out.join(labels, out[DATASET].eqNullSafe(labels[DATASET]), "left")
               .select(out[DATASET], "rows", "subjects", "label_cardinality"))
    return out.withColumn(DATASET, F.coalesce(F.col(DATASET), F.lit("__all__"))).withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("long")))


def order_windows(windows: DataFrame) -> DataFrame:
    """K1: output order (dataset, subject, window) — a range-partitioned sort."""
    return windows.orderBy(DATASET, SUBJECT, WINDOW)
