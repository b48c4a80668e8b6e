"""Columns named like an operator's own, and folders that operators leave."""
import os

from pyspark.sql import functions as F

from nightjar.llm import common, decontamination, line_dedup, pii

LINE = "a line of boilerplate that many sites share"


def test_fresh_names_differ_without_case():
    assert common.fresh(["_Map", "__map", "x"], "_map", "_row") == ["___map", "_row"]


def test_pii_keeps_columns_named_like_its_own(spark):
    rows = [(1, "Mail anna@example.com", "m", 5, "r"), (2, "nothing", None, None, "R")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _map string, _row_key int, row_key string")
    got = {r.doc_id: r for r in pii.replace_pii(df, b"key").collect()}
    assert got[1].asDict().keys() == {"doc_id", "text", "_map", "_row_key", "row_key", "n_entities"}
    assert (got[1]["_map"], got[1]["_row_key"], got[1]["n_entities"]) == ("m", 5, 1) and "anna" not in got[1].text
    assert (got[2]["_map"], got[2].text) == (None, "nothing")


def test_line_dedup_keeps_columns_named_like_its_own(spark):
    rows = [(i, f"{LINE}\nown line {i}", f"s{i}", "b", f"k{i}", i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _bad string, _kept string, _hit_id long")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert all((r["_bad"], r["_kept"], r["_hit_id"]) == ("b", f"k{i}", i) for i, r in got.items())
    assert [LINE in got[i].text for i in range(6)] == [True] + [False] * 5


def test_decontamination_keeps_columns_named_like_its_own(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, item, "t", 1, 2), (2, "else", "u", 3, 4)], "doc_id long, text string, _text string, _spans int, _items int")
    bench = spark.createDataFrame([("a", item), ("b", " ".join(f"v{i}" for i in range(14)))], "item_id string, text string")
    for most in (1, 1000):  # several passes, and one
        got = decontamination.find_contamination(docs, bench, keep=["doc_id", "_text", "_spans", "_items"], max_windows=most)
        rows = {r.doc_id: r for r in got.collect()}
        assert (rows[1]["_text"], rows[1]["_spans"], rows[1]["_items"], rows[1].contamination.n_hit) == ("t", 1, 2, 12)
        assert not rows[2].contamination.contaminated and rows[2]["_text"] == "u"


def test_scratch_folders_go_with_their_block(spark):
    at = common.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    df = spark.createDataFrame([(i, LINE, f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    with common.scratch(spark) as root:
        assert line_dedup.drop_boilerplate(df).where(F.col("n_removed") > 0).count() == 8
        assert os.path.isdir(root.removeprefix("file:"))
    assert set(os.listdir(at)) == before
