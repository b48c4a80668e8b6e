"""The pipeline's stages against brute force on a planted corpus."""
import random

import pytest

import corpus_pipeline as C
from nightjar.llm.queries import ORACLES, QUERIES
from test_decontamination import words
from test_ngram_join import shingles

COMMON = {"en": "the and of thing water shore with wheel there which stone river",
          "de": "der und nicht schön über zwischen straße heit keit auch wald berg"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(9)
    folder = tmp_path_factory.mktemp("sf")
    say = lambda lang, n: " ".join(r.choice(COMMON[lang].split()) + r.choice(["", "s", "en"]) for _ in range(n))
    items = [(i, say("en", 25)) for i in range(4)]
    rows = [(i, say("en" if i % 2 else "de", 90), "en" if i % 2 else "de", f"s{i % 7}") for i in range(60)]
    rows += [(100 + i, say("en", 60) + "\n" + "a boilerplate line that stands everywhere", "en", f"s{i}") for i in range(8)]
    base = say("en", 200).split()
    for i in range(200, 215):  # near copies
        own = list(base)
        own[r.randrange(200)] = "changed"
        rows.append((i, " ".join(own), "en", "s1"))
    rows += [(300 + i, rows[5][1], "en", "s1") for i in range(5)]                     # exact copies
    rows += [(400 + i, say("en", 30) + " " + items[i][1].upper(), "en", "s2") for i in range(4)]  # leaks
    rows += [(500, None, "en", "s0"), (501, "", None, None), (502, "щдж ыыы " * 60, None, "s0"), (503, "99 !!", "de", "s3")]
    docs = [(k, t, lang, s, len(t) if t is not None else None) for k, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        seen.append((name, before, rows))
        if name != "packing":
            assert docs.columns == C.COLUMNS
    by = {name: (before, rows) for name, before, rows in seen}

    before, rows = by["language_id"]
    assert set(before) - {r.doc_id for r in rows} == {500, 501, 502, 503}

    before, rows = by["line_dedup"]
    assert len(rows) == len(before)
    for r in rows:
        gone = 101 <= r.doc_id <= 107
        want = before[r.doc_id].text.split("\n")[0] if gone else before[r.doc_id].text
        # copies in five or more places are spread lines too; their home keeps them
        assert r.text == want or r.text == "" and r.doc_id >= 200
        assert r.n_chars == len(r.text)

    before, rows = by["near_duplicates"]
    sets = {i: shingles(d.text, 5) for i, d in before.items()}
    left = {r.doc_id for r in rows}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = comp[i], comp[j]
                comp = {x: min(a, b) if c in (a, b) else c for x, c in comp.items()}
    assert left == {i for i in sets if comp[i] == i} and len(left) < len(before)

    before, rows = by["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)}
    clean = {i for i, d in before.items() if not any(tuple(words(d.text)[p:p + 10]) in windows for p in range(len(words(d.text))))}
    assert {r.doc_id for r in rows} == clean and not {400, 401, 402, 403} & clean

    before, rows = by["packing"]
    assert {r.doc_id for r in rows} == set(before)


def test_repeated_rows_stay_once(spark):
    rows = [(1, "one text of five words more", "en", "s", 3), (1, "one text of five words more", "en", "s", 3), (1, "another", "en", "s", 1),
            (2, "one text of five words more", "en", "s", 3), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "another"), (1, "one text of five words more"), (3, "")]


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    want = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in C.run(spark, sf).collect()) == want


def test_registry():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [n for n in names if n.startswith("op")] == [n for n in QUERIES if n.startswith("op")] and "pipeline" in names
    assert set(ORACLES) <= set(E.oracle_sql()) and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n[:2] == "op"}
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_copies_on_many_sources_do_not_reach_packing_empty(spark):
    body = "the first long line of the copied text\nand its second long line follows\nshort"
    long = body.rsplit("\n", 1)[0]
    rows = [(i, long, "en", f"s{i}") for i in range(8)]                                        # emptied copies
    rows += [(10 + i, f"{long}\nown line number {i} of this near copy", "en", f"s{i}") for i in range(3)]
    rows += [(20, body, "en", "s9"), (30, None, None, None), (31, "", None, "s1")]
    rows += [(40 + i, "\t" * 25, None, f"s{i}") for i in range(6)]                             # came without a word
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = C.dedup_lines(spark, docs, "")
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert cleaned.columns == C.COLUMNS and set(got) == {0, 10, 11, 12, 20, 30, 31, *range(40, 46)}
    assert got[0] == long and got[11] == "own line number 1 of this near copy" and got[20] == "short" and got[30] is None


def test_near_duplicates_are_judged_by_row(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, c = say("a"), say("b"), say("c")
    rows = [(1, a), (None, a + " more"), (None, say("clean")),      # one null id copied, one clean
            (2, b), (7, b + " more"), (7, say("own")),              # a repeated id, likewise
            (None, c), (None, c + " more"), (None, c), (None, None),  # near copies without any id
            (9, say("d")), (9, say("d") + " more")]                  # near copies of one id
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in C.drop_near_duplicates(spark, docs.repartition(3), "").collect()]
    left = sorted((str(i), (t or "").split(" ")[0], t) for i, t in got)
    assert [x[:2] for x in left] == [("1", "a0"), ("2", "b0"), ("7", "own0"), ("9", "d0"), ("None", ""), ("None", "c0"), ("None", "clean0")]
    assert {(1, a), (2, b)} <= set(got)
