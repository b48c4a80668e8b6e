"""Operator 5: plans against the optimum, pieces against the library."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from nightjar.llm import packing as P
from nightjar.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def optimum(items, room):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= room:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, bins + [items[i]])
    place(0, [])
    return best


def used(plan):
    total = Counter()
    for filling, n in plan:
        for length, k in filling:
            total[length] += k * n
    return total


@pytest.mark.parametrize("seed", range(60))
def test_small_plans_are_optimal(seed):
    r = random.Random(seed)
    items = sorted((r.randint(1, 20) for _ in range(r.randint(0, 10))), reverse=True)
    plan = P.plan(Counter(items), 20)
    assert used(plan) == Counter(items)
    assert all(sum(x * k for x, k in f) <= 20 for f, _ in plan)
    assert sum(n for _, n in plan) == optimum(items, 20)
    assert P.lower_bound(Counter(items), 20) <= optimum(items, 20)


def test_search_beats_best_fit_and_large_counts_stay_cheap():
    r = random.Random(5)
    counts = Counter(r.randint(900, 1400) for _ in range(1000))
    plan = P.plan(counts, 4096)
    assert used(plan) == counts and sum(n for _, n in plan) < sum(n for _, n in P.best_fit(counts, 4096))
    huge = {n: 10**9 + n for n in range(1, 4097, 7)}
    plan = P.plan(huge, 4096)
    assert used(plan) == huge and len(plan) < 20_000
    assert sum(n for _, n in plan) <= 1.001 * P.lower_bound(huge, 4096)


def test_the_search_holds_one_solution_not_one_a_level():
    import tracemalloc
    r = random.Random(1)
    counts = Counter(min(4096, int(r.lognormvariate(7.5, .9)) + 1) for _ in range(20_000))

    def peak(nodes):
        tracemalloc.start()
        assert used(P.plan(counts, 4096, max_nodes=nodes)) == counts
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top
    assert peak(24) - peak(6) < 4e6  # with a solution a level: 0.8 MB for each node


def test_fillings_are_undominated_and_fit():
    counts = {7: 1, 5: 2, 3: 2, 2: 1}
    got = P.fillings(counts, [7, 5, 3, 2], 10, 10)
    assert (7, 3) in got or (5, 5) in got
    assert all(sum(f) <= 10 for f in got)
    assert all(not P._dominates(a, b) for i, a in enumerate(got) for b in got[i + 1:])


ROWS = ([(i, "same words here") for i in range(300)] + [(400 + i, "tok en " * (i * 13 % 900)) for i in range(120)]
        + [(900, None), (901, ""), (902, "twice"), (902, "twice"), (None, "no id"), (903, "one two three " * 6000)])


def test_pieces_cover_every_document(spark):
    t = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, x, 5, 6) for i, x in ROWS], "doc_id long, text string, piece int, length int").repartition(5)
    got = P.pack_documents(docs, WORDS, end_id=1, rank_rows=100).collect()
    want = Counter()
    for key, text in ROWS:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s:s + 4096]
            want[key, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 4096) + 1


def test_empty_table(spark):
    df = P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS, end_id=1)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and df.count() == 0
