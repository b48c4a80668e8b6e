"""Registered queries for labels (P18, P26, W5, J3, J4, A7, A8, U2, M1) and
ordered splits (W6, W7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import nights as N
from ..operators import splits as S
from . import bindings as B
from .q_nights import _nights_sql, _pct_sql, _segments
from .registry import oracle_wrap, presentable, register


def _validated(spark, sf):
    return L.validate_labels(B.night_label_rows(B.table(spark, sf, "events")))


def _labels(spark, sf):
    v = _validated(spark, sf).filter("is_valid")
    return L.keep_first_per_key(v, ["subject_id", "label_date"], "ingest_seq", ["label"])


def _nights(spark, sf):
    return N.night_sleep_summary(_segments(spark, sf))


@register("validate_labels", op_ids="P18",
          sql=f"SELECT subject_id, ingest_seq, date, fatigue_label, label_date, label, is_valid, problem "
              f"FROM ({B.VALID_LABELS_SQL}) v")
def q_validate(spark, sf):
    return _validated(spark, sf).select("subject_id", "ingest_seq", "date", "fatigue_label",
                                        "label_date", "label", "is_valid", "problem")


@register("invalid_label_values", op_ids="P18",
          sql=f"SELECT DISTINCT trim(fatigue_label) AS bad_value "
              f"FROM ({B.VALID_LABELS_SQL}) v WHERE problem = 'bad_label'")
def q_invalid_values(spark, sf):
    return L.invalid_label_values(_validated(spark, sf))


@register("keep_first_per_key", op_ids="W5", sql=B.DEDUP_LABELS_SQL)
def q_keep_first(spark, sf):
    return _labels(spark, sf).select("subject_id", "label_date", "label", "ingest_seq")


_J3_SQL = f"""
SELECT n.subject_id, n.night_date, CAST(n.night_date + INTERVAL 1 DAY AS DATE) AS label_date,
       n.total_sleep_minutes, l.label
FROM (SELECT *, {_pct_sql()} FROM ({_nights_sql()}) x) n
LEFT JOIN ({B.DEDUP_LABELS_SQL}) l
  ON l.subject_id = n.subject_id AND l.label_date = CAST(n.night_date + INTERVAL 1 DAY AS DATE)"""


@register("join_next_day_labels", op_ids="J3", sql=oracle_wrap(_J3_SQL, ["total_sleep_minutes"]))
def q_join_labels(spark, sf):
    j = L.join_next_day_labels(_nights(spark, sf), _labels(spark, sf))
    return presentable(j.select("subject_id", "night_date", "label_date", "total_sleep_minutes", "label"))


@register("missing_label_report", op_ids="J4",
          sql=f"SELECT subject_id, night_date, label_date FROM ({_J3_SQL}) j WHERE label IS NULL")
def q_missing(spark, sf):
    return L.missing_label_report(_nights(spark, sf), _labels(spark, sf))


@register("class_balance", op_ids="A7",
          sql=f"SELECT label, count(*) AS n FROM ({_J3_SQL}) j GROUP BY label")
def q_balance(spark, sf):
    return L.class_balance(L.join_next_day_labels(_nights(spark, sf), _labels(spark, sf)))


@register("label_check_report", op_ids="A8",
          sql=f"""SELECT count(*) AS nights_total, count(label) AS labels_present,
 count(*) FILTER (WHERE label IS NULL) AS labels_missing, count(*) FILTER (WHERE label = 0) AS class_0,
 count(*) FILTER (WHERE label = 1) AS class_1 FROM ({_J3_SQL}) j""")
def q_label_report(spark, sf):
    return L.label_check_report(L.join_next_day_labels(_nights(spark, sf), _labels(spark, sf)))


@register("label_template", op_ids="P26",
          sql=f"""SELECT subject_id, CAST(night_date + INTERVAL 1 DAY AS DATE) AS date, '' AS fatigue_label
 FROM ({_nights_sql()}) n""")
def q_template(spark, sf):
    return L.label_template(_nights(spark, sf))


# ------------------------------------------------------------------ splits
def _model(spark, sf):
    return B.model_rows(B.table(spark, sf, "lineitem"))


@register("chronological_split", op_ids="W6", bench=True,
          sql=f"""SELECT {', '.join(B.MODEL_KEYS)}, l_shipdate, target,
 CASE WHEN pos < floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM ({B.MODEL_POS_SQL}) p""")
def q_split(spark, sf):
    return S.chronological_split(_model(spark, sf), B.MODEL_ORDER).select(
        *B.MODEL_KEYS, "l_shipdate", "target", "split")


def _folds_sql(candidates=(5, 4, 3), cols: list[str] | None = None) -> str:
    parts = []
    for k in candidates:
        blk = f"(CASE WHEN pos >= n - {k} * (n // {k + 1}) THEN (pos - (n - {k} * (n // {k + 1}))) // (n // {k + 1}) ELSE -1 END)"
        parts.append(f"{blk} AS b{k}")
    base = f"SELECT *, {', '.join(parts)} FROM ({B.MODEL_POS_SQL}) p"
    checks = []
    for k in candidates:
        conds = []
        for f in range(k):
            conds.append(f"count(DISTINCT target) FILTER (WHERE b{k} = {f}) >= 2")
            conds.append(f"count(DISTINCT target) FILTER (WHERE b{k} < {f}) >= 2")
        checks.append(f"CASE WHEN {' AND '.join(conds)} THEN {k} END")
    choice = f"SELECT coalesce({', '.join(checks)}) AS n_folds FROM base"
    fold = "CASE " + " ".join(f"WHEN c.n_folds = {k} THEN b{k}" for k in candidates) + " END"
    return f"""WITH base AS ({base}), c AS ({choice})
SELECT {', '.join(cols or [*B.MODEL_KEYS, 'l_shipdate', 'target'])}, CAST({fold} AS INTEGER) AS test_fold, c.n_folds
FROM base, c"""


@register("walk_forward_folds", op_ids="W7", sql=_folds_sql())
def q_folds(spark, sf):
    return S.walk_forward_folds(_model(spark, sf), B.MODEL_ORDER, "target").select(
        *B.MODEL_KEYS, "l_shipdate", "target", "test_fold", "n_folds")


_SPLIT_SQL = f"""SELECT *, CASE WHEN pos < floor(n * 0.7) THEN 'train' ELSE 'test' END AS split
 FROM ({B.MODEL_POS_SQL}) p"""


@register("unseen_labels", op_ids="U2",
          sql=f"""SELECT DISTINCT l_returnflag FROM ({_SPLIT_SQL}) s WHERE split = 'test'
 EXCEPT SELECT DISTINCT l_returnflag FROM ({_SPLIT_SQL}) s WHERE split = 'train'""")
def q_unseen(spark, sf):
    sp = S.chronological_split(_model(spark, sf), B.MODEL_ORDER)
    return L.unseen_labels(sp.filter("split = 'train'"), sp.filter("split = 'test'"), "l_returnflag")


_UNSEEN_SQL = """SELECT DISTINCT o_orderstatus || '-' || strftime(o_orderdate, '%Y') AS status_year FROM orders
 WHERE CAST(o_orderdate AS DATE) {} DATE '1996-07-01'"""


@register("unseen_order_labels", op_ids="U2", sql=f"{_UNSEEN_SQL.format('>=')} EXCEPT {_UNSEEN_SQL.format('<')}")
def q_unseen_orders(spark, sf):
    """Orders labelled by status and year, cut at a date: the years behind the
    cut bring labels that the part before it does not have."""
    o = B.table(spark, sf, "orders").withColumn(
        "status_year", F.concat("o_orderstatus", F.lit("-"), F.date_format("o_orderdate", "yyyy")))
    cut = F.to_date("o_orderdate") < F.lit("1996-07-01").cast("date")
    return L.unseen_labels(o.where(cut), o.where(~cut), "status_year")


@register("label_index", op_ids="M1",
          sql="SELECT l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label_index "
              "FROM (SELECT DISTINCT l_returnflag FROM lineitem) d")
def q_label_index(spark, sf):
    return L.label_index(B.table(spark, sf, "lineitem"), "l_returnflag")
