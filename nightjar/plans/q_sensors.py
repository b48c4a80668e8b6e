"""Registered queries for the sensor branch (P10-P12, P17, P25, A5, A6,
A9, J5-J8, S5, S6, W8, W9, U1, K1, F8, F9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensors as Z
from . import bindings as B
from .registry import oracle_wrap, presentable, register

W = B.SENSOR_WINDOW_S
GK = "dataset_name, subject_id"


def _base(spark, sf):
    return B.sensor_base(B.table(spark, sf, "events"))


def _motion(spark, sf):
    b = _base(spark, sf)
    return b.withColumn("acc_mag", Z.vector_magnitude("x", "y", "z", cols=["x", "y"]))


def _stats_sql(prefix, cols, stats, src="d"):
    m = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
         "median": "median({c})", "count": "count({c})", "sum": "coalesce(sum({c}), 0.0)"}
    out = []
    for c in cols:
        for s in stats:
            e = m[s].format(c=f"CAST({c} AS DOUBLE)")
            out.append(f"{e} AS {prefix}{c}_{s}")
    return ", ".join(out)


def _names(prefix, cols, stats):
    return [f"{prefix}{c}_{s}" for c in cols for s in stats]


def _dbl(prefix, cols, stats):
    return [n for n in _names(prefix, cols, stats) if not n.endswith("_count")]


MOTION_SQL = f"SELECT *, sqrt(coalesce(x, 0.0) * coalesce(x, 0.0) + coalesce(y, 0.0) * coalesce(y, 0.0) + 0.0) AS acc_mag FROM ({B.SENSOR_BASE_SQL}) b"


def _win_sql(src_sql, prefix, cols, stats, where="", by=GK):
    return (f"SELECT {by}, CAST(floor(time_s / {W!r}) AS BIGINT) AS window_index, {_stats_sql(prefix, cols, stats)} "
            f"FROM ({src_sql}) d WHERE time_s IS NOT NULL {where} GROUP BY ALL")


ACC = ["x", "y", "acc_mag"]
MOTION_W_SQL = _win_sql(MOTION_SQL, "acc_", ACC, Z.WINDOW_STATS)
HR_W_SQL = _win_sql(f"SELECT {GK}, time_s, x AS hr FROM ({B.SENSOR_BASE_SQL}) b WHERE event_type IN ('view', 'click')",
                    "hr_", ["hr"], Z.WINDOW_STATS)
STEPS_W_SQL = _win_sql(f"SELECT {GK}, time_s, y AS steps FROM ({B.SENSOR_BASE_SQL}) b WHERE event_type = 'purchase'",
                       "steps_", ["steps"], Z.STEP_STATS)


def _motion_windows(spark, sf):
    return Z.tumbling_window_stats(_motion(spark, sf), ACC, W, "acc_")


def _hr_windows(spark, sf):
    hr = _base(spark, sf).filter(F.col("event_type").isin("view", "click")).select(*Z.GROUP, "time_s",
                                                                                  F.col("x").alias("hr"))
    return Z.tumbling_window_stats(hr, ["hr"], W, "hr_")


def _steps_windows(spark, sf):
    st = _base(spark, sf).filter(F.col("event_type") == "purchase").select(*Z.GROUP, "time_s",
                                                                          F.col("y").alias("steps"))
    return Z.tumbling_window_stats(st, ["steps"], W, "steps_", stats=Z.STEP_STATS)


def _labels(spark, sf):
    return _base(spark, sf).select(*Z.GROUP, "time_s", F.col("event_type").alias("label"), "ingest_seq")


@register("tumbling_window_stats", op_ids="A5 P17", bench=True,
          sql=oracle_wrap(MOTION_W_SQL, _dbl("acc_", ACC, Z.WINDOW_STATS)))
def q_windows(spark, sf):
    return presentable(_motion_windows(spark, sf))


@register("tumbling_window_sum", op_ids="A6",
          sql=oracle_wrap(STEPS_W_SQL, _dbl("steps_", ["steps"], Z.STEP_STATS)))
def q_window_sum(spark, sf):
    return presentable(_steps_windows(spark, sf))


LABEL_W_SQL = f"""
WITH l AS (SELECT {GK}, time_s, arg_max(event_type, ingest_seq) AS label FROM ({B.SENSOR_BASE_SQL}) b GROUP BY ALL),
r AS (SELECT {GK}, CAST(floor(min(time_s) / {W!r}) AS BIGINT) AS lo, CAST(ceil(max(time_s) / {W!r}) AS BIGINT) AS hi
      FROM l GROUP BY ALL),
w AS (SELECT DISTINCT {GK}, window_index, window_index * {W!r} + {W / 2!r} AS mid FROM ({MOTION_W_SQL}) m JOIN r USING ({GK})
      WHERE window_index BETWEEN lo AND hi)
SELECT w.dataset_name, w.subject_id, w.window_index, l.label
FROM w ASOF JOIN l ON w.dataset_name = l.dataset_name AND w.subject_id = l.subject_id AND w.mid >= l.time_s"""


@register("asof_window_labels", op_ids="J5 P12", bench=True, sql=LABEL_W_SQL)
def q_asof(spark, sf):
    return _window_labels(spark, sf, _motion_windows(spark, sf))


def _window_labels(spark, sf, windows):
    return Z.asof_labels_of_windows(windows, Z.resolve_label_column(_labels(spark, sf)), W)


_J6_DOUBLES = (_dbl("acc_", ACC, Z.WINDOW_STATS) + _dbl("hr_", ["hr"], Z.WINDOW_STATS)
               + _dbl("steps_", ["steps"], Z.STEP_STATS) + ["window_start_s", "window_end_s"])
J6_SQL = f"""
SELECT m.*, {', '.join('h.' + n for n in _names('hr_', ['hr'], Z.WINDOW_STATS))},
       {', '.join('s.' + n for n in _names('steps_', ['steps'], Z.STEP_STATS))}, l.label,
       m.window_index * {W!r} AS window_start_s, m.window_index * {W!r} + {W!r} AS window_end_s
FROM ({MOTION_W_SQL}) m
LEFT JOIN ({HR_W_SQL}) h USING (dataset_name, subject_id, window_index)
LEFT JOIN ({STEPS_W_SQL}) s USING (dataset_name, subject_id, window_index)
JOIN ({LABEL_W_SQL}) l USING (dataset_name, subject_id, window_index)"""


def _assembled(spark, sf):
    motion = _motion_windows(spark, sf)
    return Z.assemble_sensor_windows(motion, _hr_windows(spark, sf), _steps_windows(spark, sf),
                                     _window_labels(spark, sf, motion), W)


@register("assemble_sensor_windows", op_ids="J6 P25", sql=oracle_wrap(J6_SQL, _J6_DOUBLES))
def q_assemble(spark, sf):
    return presentable(_assembled(spark, sf)[0])


@register("assemble_sensor_notes", op_ids="J6",
          sql=f"""WITH m AS (SELECT DISTINCT {GK} FROM ({MOTION_W_SQL}) a),
l AS (SELECT DISTINCT 'events' AS dataset_name, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders WHERE o_orderstatus IS NOT NULL)
SELECT {GK}, 'missing labels' AS note FROM m ANTI JOIN l USING (dataset_name, subject_id)
UNION ALL SELECT {GK}, 'missing motion' AS note FROM l ANTI JOIN m USING (dataset_name, subject_id)""")
def q_notes(spark, sf):
    """Motion of the events with label files of the customers."""
    motion, labels = _motion_windows(spark, sf), B.order_labels(B.table(spark, sf, "orders"))
    return Z.assemble_sensor_windows(motion, None, None, Z.asof_labels_of_windows(motion, labels, W), W,
                                     label_subjects=labels)[1]


# ------------------------------------------------------------------ PPG-like archive (orders)
def _ppg_windows(spark, sf):
    s = B.order_samples(B.table(spark, sf, "orders"))
    chans = Z.numeric_channels(s)
    target = Z.target_column(s)
    extra = {"target_": ([target], Z.WINDOW_STATS)} if target else None
    # windows of a file are its own: two files of a subject never share one
    return Z.window_bounds(Z.tumbling_window_stats(s, chans, W, "sig_", extra=extra, group=[*Z.GROUP, "source_file"]), W)


PPG_SQL = (f"SELECT *, window_index * {W!r} AS window_start_s, window_index * {W!r} + {W!r} AS window_end_s FROM ("
           + _win_sql(B.ORDER_SAMPLES_SQL, "sig_", ["price"], Z.WINDOW_STATS, by=GK + ", source_file") + ") p")
_PPG_DOUBLES = _dbl("sig_", ["price"], Z.WINDOW_STATS) + ["window_start_s", "window_end_s"]


@register("ppg_window_table", op_ids="F9", sql=oracle_wrap(PPG_SQL, _PPG_DOUBLES))
def q_ppg(spark, sf):
    return presentable(_ppg_windows(spark, sf))


TARGET_SQL = _win_sql(f"SELECT {GK}, time_s, x AS hr, y FROM ({B.SENSOR_BASE_SQL}) b", "sig_", ["hr", "y"],
                      Z.WINDOW_STATS)
TARGET_SQL = TARGET_SQL.replace(" FROM (", ", " + _stats_sql("target_", ["hr"], Z.WINDOW_STATS) + " FROM (", 1)


@register("attach_target_window", op_ids="J7",
          sql=oracle_wrap(TARGET_SQL, _dbl("sig_", ["hr", "y"], Z.WINDOW_STATS) + _dbl("target_", ["hr"], Z.WINDOW_STATS)))
def q_target(spark, sf):
    s = _base(spark, sf).select(*Z.GROUP, "time_s", F.col("x").alias("hr"), "y")
    t = Z.target_column(s)
    return presentable(Z.tumbling_window_stats(s, ["hr", "y"], W, "sig_", extra={"target_": ([t], Z.WINDOW_STATS)}))


def _union(spark, sf):
    return Z.union_window_tables([_assembled(spark, sf)[0], _ppg_windows(spark, sf)])


UNION_SQL = f"SELECT * FROM ({J6_SQL}) a UNION ALL BY NAME SELECT * FROM ({PPG_SQL}) b"


@register("union_window_tables", op_ids="U1 F8",
          sql=oracle_wrap(UNION_SQL, _J6_DOUBLES + _dbl("sig_", ["price"], Z.WINDOW_STATS)))
def q_union(spark, sf):
    return presentable(_union(spark, sf))


@register("dataset_summary", op_ids="A9",
          sql=f"""SELECT coalesce(dataset_name, '__all__') AS dataset_name, count(*) AS rows,
 count(DISTINCT subject_id) AS subjects, count(DISTINCT label) AS label_cardinality
 FROM ({UNION_SQL}) u GROUP BY ROLLUP (dataset_name)""")
def q_summary(spark, sf):
    return Z.dataset_summary(_union(spark, sf))


@register("order_windows", op_ids="K1 F8",
          sql=f"SELECT dataset_name, subject_id, window_index FROM ({UNION_SQL}) u ORDER BY 1, 2, 3")
def q_order(spark, sf):
    return Z.order_windows(_union(spark, sf)).select("dataset_name", "subject_id", "window_index")


# ------------------------------------------------------------------ file names
# A file listing derived from events: each event names the file its stream
# would live in. Kind folders and name suffixes vary by event type and id.
def _paths(spark, sf):
    ev = B.table(spark, sf, "events")
    u = F.col("user_id").cast("string")
    kind = {"view": ("motion", "_acceleration"), "click": ("heart_rate", "_heartrate"),
            "purchase": ("steps", "-steps"), "signup": ("labels", "_labeled_sleep")}
    path = F.concat(F.lit("/archive/sleepaccel/subject_"), u, F.lit("/data.csv"))
    for ev_type, (folder, suffix) in kind.items():
        path = F.when(F.col("event_type") == ev_type,
                      F.concat(F.lit(f"/archive/sleepaccel/{folder}/"), u, F.lit(suffix),
                               F.when(F.col("event_id") % 2 == 0, F.lit(".txt")).otherwise(F.lit(".csv")))
                      ).otherwise(path)
    return ev.select(path.alias("path")).distinct()


PATHS_SQL = """
SELECT DISTINCT CASE event_type
  WHEN 'view' THEN '/archive/sleepaccel/motion/' || CAST(user_id AS VARCHAR) || '_acceleration' || CASE WHEN event_id % 2 = 0 THEN '.txt' ELSE '.csv' END
  WHEN 'click' THEN '/archive/sleepaccel/heart_rate/' || CAST(user_id AS VARCHAR) || '_heartrate' || CASE WHEN event_id % 2 = 0 THEN '.txt' ELSE '.csv' END
  WHEN 'purchase' THEN '/archive/sleepaccel/steps/' || CAST(user_id AS VARCHAR) || '-steps' || CASE WHEN event_id % 2 = 0 THEN '.txt' ELSE '.csv' END
  WHEN 'signup' THEN '/archive/sleepaccel/labels/' || CAST(user_id AS VARCHAR) || '_labeled_sleep' || CASE WHEN event_id % 2 = 0 THEN '.txt' ELSE '.csv' END
  ELSE '/archive/sleepaccel/subject_' || CAST(user_id AS VARCHAR) || '/data.csv' END AS path
FROM events"""


def _classified(spark, sf):
    p = _paths(spark, sf)
    root = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == F.lit("sleepaccel")
    return p.select("path", Z.subject_from_path(F.col("path")).alias("subject_id"),
                    Z.classify_stream_file(F.col("path"), root).alias("kind"))


_STEM = "regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '')"
_PARENT = "regexp_extract(path, '([^/]+)/[^/]+$', 1)"
_SUBJ_SQL = f"""CASE
  WHEN regexp_extract({_STEM}, '^(.+?)(_acceleration|_accelerometer|_heartrate|_heart_rate|_steps|_labeled_sleep|_labels|_label|_motion)$', 1, 'i') <> ''
    THEN regexp_extract({_STEM}, '^(.+?)(_acceleration|_accelerometer|_heartrate|_heart_rate|_steps|_labeled_sleep|_labels|_label|_motion)$', 1, 'i')
  WHEN regexp_extract({_STEM}, '^(.+?)(-acceleration|-heartrate|-heart-rate|-steps|-labels|-label)$', 1, 'i') <> ''
    THEN regexp_extract({_STEM}, '^(.+?)(-acceleration|-heartrate|-heart-rate|-steps|-labels|-label)$', 1, 'i')
  WHEN lower({_STEM}) NOT IN ({', '.join(repr(s) for s in Z.GENERIC_STEMS)}) AND {_STEM} <> '' THEN {_STEM}
  ELSE {_PARENT} END"""


def _kind_sql():
    name = "lower(regexp_extract(path, '([^/]+)$', 1))"
    parent = f"lower({_PARENT})"
    arms = []
    for kind, tokens in Z.KIND_TOKENS:
        conds = " OR ".join(f"contains({name}, '{t}') OR ({_PARENT} <> 'sleepaccel' AND contains({parent}, '{t}'))"
                            for t in tokens)
        arms.append(f"WHEN {conds} THEN '{kind}'")
    return "CASE " + " ".join(arms) + " END"


CLASSIFIED_SQL = f"SELECT path, {_SUBJ_SQL} AS subject_id, {_kind_sql()} AS kind FROM ({PATHS_SQL}) p"


@register("subject_from_path", op_ids="S5 S6", sql=CLASSIFIED_SQL)
def q_paths(spark, sf):
    return _classified(spark, sf)


@register("match_subject_files", op_ids="J8",
          sql=f"SELECT subject_id, kind, min(path) AS path FROM ({CLASSIFIED_SQL}) c WHERE kind IS NOT NULL GROUP BY ALL")
def q_match(spark, sf):
    return Z.match_subject_files(_classified(spark, sf).filter(F.col("kind").isNotNull()))


# ------------------------------------------------------------------ P10 / P11
@register("standardize_columns", op_ids="P10 P11",
          sql=f"""SELECT o_custkey AS subject_id, o_orderkey AS ingest_seq,
 epoch_us(o_orderdate) / 1e6 - min(epoch_us(o_orderdate) / 1e6) OVER (PARTITION BY o_custkey) AS time_s,
 o_totalprice AS total_price FROM orders""")
def q_standardize(spark, sf):
    o = B.table(spark, sf, "orders")
    messy = o.select(F.col("o_custkey").alias(" Subject_ID"), F.col("o_orderkey").alias("Ingest_Seq "),
                     F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
                     F.col("o_totalprice").alias("Total Price"), F.col("o_orderstatus").alias("Status"))
    std, time_col = Z.standardize_columns(messy)
    # Text timestamps become seconds relative to the subject's first record.
    return Z.to_relative_seconds(std, "time_s", ["subject_id"]).select("subject_id", "ingest_seq", "time_s",
                                                                        "total_price")
