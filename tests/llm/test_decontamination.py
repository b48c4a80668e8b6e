"""Operator 4 against brute force over words."""
import hashlib
import random
import re

import numpy as np
import pytest

from nightjar.llm import decontamination as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            for i in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[i:i + k]:
                        hit.update(range(p, p + k))
                        found.add("null" if item is None else str(item))
        ids = ",".join(sorted(found))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    some = lambda n: [r.choice(["al", "be", "Ce", "dé", "e5", "f"]) + str(r.randrange(9)) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, "  ,. "), (None, "the null item has these words"), (22, items[5][1]), (10, "x y")]
    docs = [(i, ", ".join(some(r.randrange(0, 120)))) for i in range(30)]
    for i in range(30, 60):
        own = words(r.choice(items)[1])
        cut = own[:r.randint(1, len(own))] if own and r.random() < .5 else own
        docs.append((i, "-".join(some(5)) + " " + "; ".join(x.upper() for x in cut) + " tail " + " ".join(some(3))))
    docs += [(70, None), (71, ""), (72, "..."), (73, "x y"), (73, "x y"), (None, "X  Y"),
             (74, "pad " * 70_000 + "the null ITEM has these words " + "pad " * 300)]
    return docs, items


@pytest.mark.parametrize("seed,max_windows", [(1, 500_000), (2, 9)])
def test_brute_force(spark, seed, max_windows):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(k, t, 0, "x") for k, t in docs], "doc_id long, text string, n_words int, _text string").repartition(3)
    b = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, window int")
    got = D.find_contamination(d, b, keep=["doc_id", "n_words"], max_windows=max_windows).collect()
    assert all(r.n_words == 0 for r in got)
    rows = [(r.doc_id, *[r.contamination[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]) for r in got]
    assert sorted(rows, key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = D.find_contamination(d, none, keep=["doc_id"]).first()
    assert row.contamination.n_words == 3 and not row.contamination.contaminated
    assert D.find_contamination(d.limit(0), d.withColumnRenamed("doc_id", "item_id"), keep=["doc_id"]).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 10])
def test_search_finds_every_window_and_jumps(length):
    r = np.random.default_rng(length)
    vocabulary = [f"w{i}" for i in range(6 if length > 2 else 50)]
    text = [vocabulary[i] for i in r.integers(0, len(vocabulary), 3000)]
    windows = sorted({" ".join(text[p:p + length]) for p in r.integers(0, 2990, 20)} | {"zz " * (length - 1) + "zz"})
    wm = D.WuManber([w.encode() for w in windows], length)
    raw = np.frombuffer(" ".join(text).encode(), np.uint8)
    s, e, _ = D.word_spans(raw, np.array([0, len(raw)]), D.ALNUM)
    h = D.word_hashes(raw, s, e)
    first, end = np.array([0, 1000, 1000]), np.array([1000, 1000, 3000])  # three rows, one empty
    at, which = wm.search(h, first, end)
    got = sorted(zip(at.tolist(), which.tolist()))
    want = sorted((p, k) for p in range(3000 - length + 1) for k, w in enumerate(windows)
                  if " ".join(text[p:p + length]) == w and not p < 1000 < p + length)
    assert got == want and want
    assert wm.shift.max() == length - wm.b + 1
