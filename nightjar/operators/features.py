"""Feature spaces over the night table (one row per subject and night).

F1 calendar, P23 spread (ratio) features, A19 row missingness, A20 contract
missing quality, W1-W4 past-only rolling features, F2 baseline, F3 transfer,
F4 combined, J9 combine, P14-P16 column selection and alignment.

Rolling features are ROWS frames over ``partitionBy(subject).orderBy(date)``:
the night table holds one row per subject and night, so a partition is one
person's nights (bounded by the calendar), and all 91 rolling columns share
one window spec, i.e. one shuffle and one sort.
"""
from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.calendar import calendar_columns
from ..functions.clean import to_numeric_or_null
from .prep import apply_encoder, component_names, encoder_overlap

SUBJECT = "subject_id"
# Metadata columns that are never features, the rolling targets
# and windows, and the sort-column preference.
METADATA_COLUMNS = ["subject_id", "night_date", "sleep_start", "sleep_end", "label_date", "date", "label",
                    "fatigue_label"]
ROLLING_TARGETS = [
    "total_sleep_minutes", "sleep_efficiency", "rem_minutes", "deep_minutes", "core_minutes",
    "hr_mean", "hr_std", "hrv_mean", "hrv_std", "resp_mean", "resp_std", "spo2_mean", "spo2_std",
]
ROLLING_WINDOWS = (3, 7)
SORT_PREFERENCE = ["label_date", "night_date", "date", "sleep_start"]
MISSINGNESS_COLUMNS = ["observed_numeric_count", "missing_numeric_count", "missing_numeric_rate",
                       "observed_numeric_rate"]
RATIO_COLUMNS = ["sleep_gap_minutes", "sleep_to_bed_ratio", "sleep_efficiency_proxy", "rem_to_deep_ratio",
                 "deep_to_core_ratio", "rem_share", "deep_share", "core_share", "sleep_stage_balance",
                 "hrv_to_hr_ratio", "resp_to_hr_ratio", "spo2_deficit"]
CALENDAR_COLUMNS = ["day_of_week", "is_weekend", "month_sin", "month_cos"]


def infer_sort_column(df: DataFrame) -> str | None:
    for c in SORT_PREFERENCE:
        if c in df.columns:
            return c
    return None


# ---------------------------------------------------------------- P14-P16
def select_numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns minus an exclusion set (schema metadata only)."""
    ex = set(exclude if exclude is not None else METADATA_COLUMNS)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def non_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value, decided by ONE aggregate pass
    (a single row of counts reaches the driver). Raises when none is left."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first().asDict()
    keep = [c for c in columns if counts[c] > 0]
    if not keep:
        raise ValueError("no usable numeric feature columns (all missing)")
    return keep


def drop_all_null_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    kept = non_null_columns(df, columns)
    return df.select(*(keep or []), *kept)


def align_to_schema(df: DataFrame, order: list[str], keep: list[str] | None = None,
                    min_overlap: int = 1) -> DataFrame:
    """The model's column order; absent columns become null doubles,
    present ones are coerced. A table sharing fewer than ``min_overlap``
    columns with the model is rejected."""
    present = set(df.columns)
    overlap = sum(1 for c in order if c in present)
    if overlap < min_overlap:
        raise ValueError(f"input shares {overlap} of {len(order)} model columns")
    cols = [to_numeric_or_null(c).alias(c) if c in present else F.lit(None).cast("double").alias(c) for c in order]
    return df.select(*(keep or []), *cols)


# ---------------------------------------------------------------- P23 / A19 / F1
def _num_sql(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        return "CAST(NULL AS DOUBLE)"
    x = f"TRY_CAST(`{name}` AS DOUBLE)"
    return f"(CASE WHEN isnan({x}) OR abs({x}) = double('Infinity') THEN NULL ELSE {x} END)"


# P23 as (name, SQL template) pairs; {a}/{b} are the cleaned inputs.
_SPREAD = [
    ("sleep_gap_minutes", "{in_bed_minutes} - {asleep_minutes}"),
    ("sleep_to_bed_ratio", "div:{total_sleep_minutes}:{in_bed_minutes}"),
    ("sleep_efficiency_proxy", "div:{asleep_minutes}:{in_bed_minutes}"),
    ("rem_to_deep_ratio", "div:{rem_minutes}:{deep_minutes}"),
    ("deep_to_core_ratio", "div:{deep_minutes}:{core_minutes}"),
    ("rem_share", "div:{rem_minutes}:{total_sleep_minutes}"),
    ("deep_share", "div:{deep_minutes}:{total_sleep_minutes}"),
    ("core_share", "div:{core_minutes}:{total_sleep_minutes}"),
    ("sleep_stage_balance", "{rem_minutes} + {deep_minutes} - {core_minutes}"),
    ("hrv_to_hr_ratio", "div:{hrv_mean}:{hr_mean}"),
    ("resp_to_hr_ratio", "div:{resp_mean}:{hr_mean}"),
    ("spo2_deficit", "1.0 - {spo2_mean}"),
]
_SPREAD_INPUTS = ["in_bed_minutes", "asleep_minutes", "total_sleep_minutes", "rem_minutes", "deep_minutes",
                  "core_minutes", "hrv_mean", "hr_mean", "resp_mean", "spo2_mean"]


def spread_columns(df: DataFrame) -> list[Column]:
    """Twelve gap / ratio / share / balance columns (missing inputs ->
    null; a zero denominator or an infinite ratio -> null)."""
    v = {n: _num_sql(df, n) for n in _SPREAD_INPUTS}
    out = []
    for name, tpl in _SPREAD:
        if tpl.startswith("div:"):
            _, num, den = tpl.split(":")
            r = f"try_divide({num.format(**v)}, {den.format(**v)})"
            e = f"CASE WHEN isnan({r}) OR abs({r}) = double('Infinity') THEN NULL ELSE {r} END"
        else:
            e = tpl.format(**v)
        out.append(F.expr(f"CAST({e} AS DOUBLE)").alias(name))
    return out


def missingness_columns(columns: list[str]) -> list[Column]:
    """Per-row observed / missing counts and rates (horizontal, no shuffle)."""
    total = float(max(len(columns), 1))
    missing = F.expr(" + ".join(f"CAST(`{c}` IS NULL AS INT)" for c in columns) or "0")
    observed = F.lit(len(columns)) - missing
    return [observed.cast("long").alias("observed_numeric_count"), missing.cast("long").alias("missing_numeric_count"),
            (missing / F.lit(total)).alias("missing_numeric_rate"), (observed / F.lit(total)).alias("observed_numeric_rate")]


# Data-quality bands for missing contract features.
QUALITY_BANDS = [(2, "Good"), (8, "Fair")]


def contract_missing_quality(df: DataFrame, contract_columns: list[str], keep: list[str]) -> DataFrame:
    """Missing contract features -> Good (<= 2), Fair (<= 8), Poor."""
    missing = sum((F.col(c).isNull().cast("int") if c in df.columns else F.lit(1) for c in contract_columns),
                  F.lit(0))
    band = F.when(missing <= QUALITY_BANDS[0][0], F.lit(QUALITY_BANDS[0][1])) \
            .when(missing <= QUALITY_BANDS[1][0], F.lit(QUALITY_BANDS[1][1])).otherwise(F.lit("Poor"))
    return df.select(*keep, missing.cast("int").alias("missing_features"), band.alias("data_quality"))


# ---------------------------------------------------------------- W1-W4
def rolling_columns(targets: list[str], order_col: str, windows=ROLLING_WINDOWS,
                    part_cols: list[str] | None = None) -> list[Column]:
    """W1-W4 for each target: past-k mean / population std (current row
    excluded, >= 1 value), delta to the previous row, trend = value - mean."""
    part = part_cols if part_cols is not None else [SUBJECT]
    # Written as SQL window expressions sharing one spec text, so Catalyst
    # plans a single Window operator (one shuffle, one sort) and the driver
    # makes one JVM call per column.
    spec = f"PARTITION BY {', '.join(f'`{p}`' for p in part)} ORDER BY `{order_col}`"
    out = []
    for t in targets:
        v = f"`{t}`"
        for k in windows:
            frame = f"OVER ({spec} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            out.append(F.expr(f"avg({v}) {frame}").alias(f"{t}_past{k}_mean"))
            out.append(F.expr(f"stddev_pop({v}) {frame}").alias(f"{t}_past{k}_std"))
            if k == windows[0]:
                out.append(F.expr(f"{v} - lag({v}, 1) OVER ({spec})").alias(f"{t}_delta"))
            out.append(F.expr(f"{v} - avg({v}) {frame}").alias(f"{t}_past{k}_trend"))
    return out


def rolling_names(targets: list[str], windows=ROLLING_WINDOWS) -> list[str]:
    out = []
    for t in targets:
        for k in windows:
            out += [f"{t}_past{k}_mean", f"{t}_past{k}_std"]
            if k == windows[0]:
                out.append(f"{t}_delta")
            out.append(f"{t}_past{k}_trend")
    return out


# ---------------------------------------------------------------- F2-F4, J9
def baseline_features(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """every non-metadata numeric column, sanitised."""
    cols = select_numeric_columns(df)
    keep = keep if keep is not None else [c for c in METADATA_COLUMNS if c in df.columns]
    return df.select(*keep, *[to_numeric_or_null(c).alias(c) for c in cols]), cols


def _with_components(base: DataFrame, keep: list[str], columns: list, names: list[str], encoder) -> tuple[DataFrame, list[str]]:
    """``columns`` (with the given names), and the encoder's components of the
    base columns behind them where there is an encoder."""
    if encoder is None:
        return base.select(*keep, *columns), names
    aside = base.select(*keep, *[F.col(c).alias(f"_base_{c}") for c in base.columns if c not in keep], *columns)
    inputs = aside.select(*keep, *names, *[F.col(f"_base_{c}").alias(c) for c in base.columns
                                           if c not in keep and c not in names])
    parts = component_names(encoder.k)
    shared, total = encoder_overlap(inputs, encoder)
    if not shared:
        warnings.warn(f"the table has none of the encoder's {total} inputs: its components are constant", stacklevel=3)
    return apply_encoder(inputs, encoder, [*keep, *names]), [*names, *parts]


def transfer_features(df: DataFrame, keep: list[str] | None = None, encoder=None) -> tuple[DataFrame, list[str]]:
    """missingness 4 + ratios 12 + calendar 4 + rolling 7 per target, in
    one projection plus one window spec; with an ``encoder``
    (``prep.WindowEncoder``) its components follow."""
    base, base_cols = baseline_features(df, keep)
    keep = keep if keep is not None else [c for c in METADATA_COLUMNS if c in df.columns]
    sort_col = infer_sort_column(df)
    targets = [t for t in ROLLING_TARGETS if t in base_cols]
    if sort_col is None:
        raise ValueError("past-only features need a date column to order by")
    cols = (missingness_columns(base_cols) + spread_columns(base) + calendar_columns(sort_col)
            + rolling_columns(targets, sort_col))
    names = MISSINGNESS_COLUMNS + RATIO_COLUMNS + CALENDAR_COLUMNS + rolling_names(targets)
    return _with_components(base, keep, cols, names, encoder)


def combined_features(df: DataFrame, keep: list[str] | None = None, encoder=None) -> tuple[DataFrame, list[str]]:
    """Baseline and transfer (with the encoder's components, where one
    is given) side by side — one select, no join."""
    keep = keep if keep is not None else [c for c in METADATA_COLUMNS if c in df.columns]
    base, base_cols = baseline_features(df, keep)
    sort_col = infer_sort_column(df)
    targets = [t for t in ROLLING_TARGETS if t in base_cols]
    if sort_col is None:
        raise ValueError("past-only features need a date column to order by")
    transfer = (missingness_columns(base_cols) + spread_columns(base) + calendar_columns(sort_col)
                + rolling_columns(targets, sort_col))
    names = base_cols + MISSINGNESS_COLUMNS + RATIO_COLUMNS + CALENDAR_COLUMNS + rolling_names(targets)
    return _with_components(base, keep, [*[F.col(c) for c in base_cols], *transfer], names, encoder)
