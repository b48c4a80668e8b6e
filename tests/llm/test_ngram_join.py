"""Operator 3 against brute force, with hot groups, chunked cells and trees."""
import random

import numpy as np
import pytest

from nightjar.llm import ngram_join as J
from nightjar.llm.components import components


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    comp[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = root(i)
            least[r] = min(least.get(r, key), key)
    return sorted(((key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n_near=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(80)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join([word() for _ in range(r.randint(1, 60))])))
    for i in range(40, 70):  # a shared passage in different texts
        rows.append((i, " ".join([word() for _ in range(40)] + passage)))
    for i in range(70, 70 + n_near):  # near copies of one base, in chains
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(300, 340):
        rows.append((i, " ".join(passage).upper()))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "solo"), (404, "SOLO"), (405, "solo"), (406, "a b"), (406, "a b"),
             (None, "a b"), (None, "no id at all here"), (407, "wide " * 30_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,cell_rows,rounds", [(4, 85, 4096, 6), (5, 80, 16, 1), (4, 85, 7, 0)])
def test_brute_force(spark, size, percent, cell_rows, rounds):
    rows = corpus(size)
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows],
                                 "doc_id long, text string, cid int, component string, n int").repartition(4)
    got = J.similar_documents(docs, size=size, percent=percent, cell_rows=cell_rows, rounds=rounds).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, size, percent)


def test_empty_and_unlinked(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.similar_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "only one text here"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_documents(one).collect()) == [(1, 1, 1), (2, 0, 2)]


def test_trees_lose_no_pair():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(5, 90))).astype(np.uint64) for _ in range(700)]
    sets += [np.unique(np.concatenate((s[:-2], r.integers(0, 400, 2).astype(np.uint64)))) for s in sets[:200]]
    sets += [np.arange(700, dtype=np.uint64) * np.uint64(977), np.arange(690, dtype=np.uint64) * np.uint64(977)]
    n = np.array([len(s) for s in sets])
    points = np.stack([J.counts_of(J.point(s), len(s)) for s in sets])
    assert (points.sum(axis=1) == n).all()
    label = np.arange(len(sets))
    tree = J.RTree(points, n)
    i, j = J.tree_join(tree, tree, label, label, 85)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    linked = set()
    for a in range(len(sets)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 85 * (n[a] + n[b] - k):
                linked.add((b, a))
    assert linked <= found and len(linked) > 30
    assert len(found) < len(sets) ** 2 / 20  # the bound does prune
    (partner, score), = J.tree_best(tree, tree, label, label, 85)
    assert {a for p in found for a in p} == set(np.flatnonzero(partner >= 0).tolist())  # who has one, proposes
    ub = lambda a, b: np.minimum(points[a], points[b]).sum()
    for a in np.flatnonzero(partner >= 0):
        b = partner[a]
        assert score[a] == max(ub(a, c) / (n[a] + n[c] - ub(a, c)) for p in found if a in p for c in [sum(p) - a])
        assert (min(a, b), max(a, b)) in found
    half = len(sets) // 2
    t, u = J.RTree(points[:half], n[:half]), J.RTree(points[half:], n[half:])
    i, j = J.tree_join(t, u, label[:half], label[half:], 85)
    (p, _), (q, _) = J.tree_best(t, u, label[:half], label[half:], 85)
    assert set(np.flatnonzero(p >= 0).tolist()) == set(i.tolist()) and set(np.flatnonzero(q >= 0).tolist()) == set(j.tolist())
    across = {(a, b + half) for a, b in zip(i.tolist(), j.tolist())}
    assert {p for p in linked if p[0] < half <= p[1]} <= across


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 3), (3, 9), (9, 7)] + [(4, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 600)}, 3: 3, 7: 3, 9: 3}


def test_texts_that_polynomial_hashes_mix_up_are_two(spark):
    bits = [i.bit_count() & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got = J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}
