"""Operator 12 against plain scoring of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from nightjar.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWERED))


def plain(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Éa", "éa", "the", "THE", "a1-b2"]
    share = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, share, k=r.randint(0, 60)))) for i in range(n)]
    rows += [(1000 + i, "the w3 w3 copy") for i in range(150)]  # ties in a third of the rows
    rows += [(2000, None), (2001, ""), (2002, "--- !!"), (None, "w5 w5 w5 w79"), (7, "w5 w79 again"),
             (2003, "w4 " * 3000 + "w78")]
    items = [(f"i{j}", " ".join(r.choices(words, k=r.randint(1, 12)))) for j in range(40)]
    items += [("none", "nowhere"), ("null", None), ("empty", " "), ("copy", "copy THE"), ("i1", "w5 w79 w5")]
    return rows, items


@pytest.mark.parametrize("how", [{}, {"segment_bytes": 2000, "window": 8}, {"block_terms": 30, "window": 16}])
def test_rows_against_plain_scoring(spark, how):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, query int, rank string")
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id string, text string, score int")
    got = R.rank_documents(docs.repartition(7), bench, 20, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, items, 20)


def test_every_mix_of_short_and_long_lists_and_thresholds():
    rows, items = corpus(2, 700)
    seg = R._Segment()
    names = sorted({t for _, x in items for t in plain_terms(x)})
    number = {t.encode(): i for i, t in enumerate(names)}
    for i, t in rows:
        seg.add(i, (t or "").encode(), number)
    ids, term, count, doc, tf, n, n_docs, n_terms = seg.row()
    df = dict(zip(term.tolist(), count.tolist()))
    for window in (4, 64, 4096):
        lists = R.Lists(term, count, doc, tf, n, n_docs, n_terms, window)
        for _, text in items:
            query = [(number[t.encode()], R.weight(n_docs, df[number[t.encode()]])) for t in set(plain_terms(text))
                     if number[t.encode()] in df]
            whole = None
            for share in (0.0, 0.05, 0.3, 100.0):
                docs, scores = lists.search(query, 15, 0, share)
                rows_ = sorted(zip((-scores).tolist(), docs.tolist()))
                whole = whole if whole is not None else rows_
                assert rows_ == whole
                if len(scores):
                    floor = int(np.sort(scores)[len(scores) // 2])
                    docs, scores = lists.search(query, 15, floor, share)
                    assert sorted(zip((-scores).tolist(), docs.tolist())) == [x for x in whole if -x[0] >= floor]


def test_parts_of_a_long_text_change_nothing(monkeypatch):
    text = (" ".join(random.Random(3).choices(["ab", "CD1", "é" * 20, "--"], k=2000)) + "?").encode()
    whole = [t for some in R.terms(text) for t in some]
    assert whole == [t.encode() for t in plain_terms(text.decode())]
    for size in (1, 9, 333):
        monkeypatch.setattr(R, "parts", lambda t, b, size=size, f=R.parts: f(t, b, size))
        assert [t for some in R.terms(text) for t in some] == whole
        monkeypatch.undo()


def test_rounds_grow():
    assert R._rounds({s: 10 for s in range(64)}, 20) == [[0, 1], list(range(2, 8)), list(range(8, 32)), list(range(32, 64))]
    assert R._rounds({}, 8) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert R.rank_documents(docs.limit(0), items).collect() == []
    assert R.rank_documents(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in R.rank_documents(docs, items).collect()] == [("x", 1, 1, 287 * (10**9 // 3000))]
