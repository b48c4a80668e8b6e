"""Label operators: P18 validate, W5 keep first per key, J3 next-day join,
J4 missing-label report, A7 class balance, A8 label check report, P26
template, U2 unseen labels, M1 label index.

Strict variants raise like the reference scripts; the non-strict forms return
the offending rows as a DataFrame so a caller can write them out first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = "subject_id"
VALID_LABELS = ["0", "1"]  # fixed values: labels must be the text 0 or 1 after trimming


class LabelError(ValueError):
    pass


def validate_labels(df: DataFrame, date_col: str = "date", label_col: str = "fatigue_label") -> DataFrame:
    """Parse the date (bad -> null) and the trimmed label text.

    Adds ``label_date``, ``label`` (int, null when invalid), ``is_valid`` and
    ``problem`` ('bad_date' / 'bad_label'). A column named ``night_date`` is
    accepted as the label date without a shift (reference alias rule).
    """
    if date_col not in df.columns and "night_date" in df.columns:
        date_col = "night_date"
    trimmed = F.trim(F.col(label_col).cast("string"))
    d = F.try_to_date(F.col(date_col).cast("string"))
    good_label = F.coalesce(trimmed.isin(VALID_LABELS), F.lit(False))
    return df.withColumns({
        "label_date": d,
        "label": F.when(good_label, trimmed.cast("int")),
        "is_valid": d.isNotNull() & good_label,
        "problem": F.when(d.isNull(), F.lit("bad_date")).when(~good_label, F.lit("bad_label")),
    })


def invalid_label_values(validated: DataFrame, label_col: str = "fatigue_label") -> DataFrame:
    """Distinct bad label texts as rows (a distributed distinct, never one
    array in one task: free-text labels can have any number of values)."""
    bad = validated.filter(F.col("problem") == "bad_label")
    return bad.select(F.trim(F.col(label_col).cast("string")).alias("bad_value")).distinct()


def require_valid(validated: DataFrame, label_col: str = "fatigue_label") -> DataFrame:
    """Strict P18: raise when any row has a bad date or label."""
    if not validated.filter(F.col("problem") == "bad_date").isEmpty():
        raise LabelError("labels file has invalid date values; expected YYYY-MM-DD")
    bad_df = invalid_label_values(validated, label_col)
    shown = [r["bad_value"] for r in bad_df.orderBy("bad_value").limit(20).collect()]
    if shown:
        more = bad_df.count() - len(shown)
        tail = f" (+{more} more)" if more > 0 else ""
        raise LabelError(f"fatigue_label must be binary 0/1; found invalid values: {shown}{tail}")
    return validated


def keep_first_per_key(df: DataFrame, keys: list[str], order_col: str, value_cols: list[str]) -> DataFrame:
    """First row per key by an explicit order column (file order in the
    reference). ``min_by`` is a partial aggregate, so a hot key is reduced
    map-side instead of being ranked inside one task."""
    packed = F.struct(*[F.col(c) for c in [order_col, *value_cols]])
    first = df.groupBy(*keys).agg(F.min_by(packed, F.col(order_col)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [order_col, *value_cols]])


def with_label_date(nights: DataFrame) -> DataFrame:
    return nights.withColumn("label_date", F.date_add(F.col("night_date"), 1))


def join_next_day_labels(nights: DataFrame, labels: DataFrame) -> DataFrame:
    """``label_date = night_date + 1``, left join on (subject, label_date)."""
    lab = labels.select(SUBJECT, "label_date", "label")
    return with_label_date(nights).join(lab, [SUBJECT, "label_date"], "left")


def missing_label_report(nights: DataFrame, labels: DataFrame) -> DataFrame:
    """Nights whose next-day label is absent."""
    return (with_label_date(nights).select(SUBJECT, "night_date", "label_date")
            .join(labels.select(SUBJECT, "label_date"), [SUBJECT, "label_date"], "left_anti"))


def require_labels(missing: DataFrame) -> None:
    n = missing.count()
    if n:
        raise LabelError(f"Missing fatigue labels for {n} nights. Fill labels and rerun.")


def class_balance(df: DataFrame, label_col: str = "label", keep_missing: bool = True) -> DataFrame:
    """Rows per label (null group kept or dropped)."""
    src = df if keep_missing else df.filter(F.col(label_col).isNotNull())
    return src.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def label_check_report(merged: DataFrame, label_col: str = "label") -> DataFrame:
    """Totals, present/missing labels and the two class counts in one pass."""
    return merged.agg(
        F.count(F.lit(1)).alias("nights_total"),
        F.count(label_col).alias("labels_present"),
        F.count_if(F.col(label_col).isNull()).alias("labels_missing"),
        F.count_if(F.col(label_col) == 0).alias("class_0"),
        F.count_if(F.col(label_col) == 1).alias("class_1"),
    )


def label_template(nights: DataFrame) -> DataFrame:
    """Next-day date with a blank label, for a person to fill in."""
    return nights.select(SUBJECT, F.date_add("night_date", 1).alias("date"), F.lit("").alias("fatigue_label"))


def unseen_labels(train: DataFrame, test: DataFrame, label_col: str) -> DataFrame:
    """Labels in test that never occur in train (distinct set difference)."""
    return test.select(label_col).distinct().join(train.select(label_col).distinct(), label_col, "left_anti")


def require_seen(unseen: DataFrame, label_col: str) -> None:
    total = unseen.count()
    if total:
        some = [str(r[label_col]) for r in unseen.orderBy(label_col).limit(20).collect()]
        raise LabelError(f"unseen {label_col} classes: {total} occur only in the test part, first of them {some}")


def label_index(df: DataFrame, label_col: str, out: str = "label_index") -> DataFrame:
    """M1: classes sorted ascending -> 0..k-1. The window runs over the
    distinct class table only (a handful of rows)."""
    classes = df.select(label_col).distinct()
    return classes.withColumn(out, (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int"))


def filter_by_date(df: DataFrame, day: str, found_or_raise: bool = True) -> DataFrame:
    """The rows of one date: of the label's date where the table has such a
    column, else of the night's. A date without rows is an error (one row is
    looked for), unless ``found_or_raise`` is off."""
    col = next((c for c in ("label_date", "night_date") if c in df.columns), None)
    if col is None:
        raise LabelError("no date column: label_date or night_date")
    rows = df.filter(F.col(col).cast("date") == F.lit(day).cast("date"))
    if found_or_raise and rows.isEmpty():
        raise LabelError(f"No features found for date {day}")
    return rows
