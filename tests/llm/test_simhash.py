"""Operator 11 against plain Python."""
import random
import re

import numpy as np
import xxhash

from nightjar.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(marks, distance=2):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {m: find(m) for m in own}


def plain(rows, distance=2):
    marks = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(marks, distance)
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[comp[m]] = min(i, least.get(comp[m], i))
    return sorted(((i, f"{m:016x}", least.get(comp[m])) for (i, _), m in zip(rows, marks)), key=str)


def texts(seed=3):
    r = random.Random(seed)
    words = ["alpha", "BETA", "gärten", "delta", "x", "naïve", "zeta", "eta", "ÉTÉ", "iota"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(120)]
    base = r.choices(words, k=1500)
    for i in range(60):  # near copies of a long text
        own = list(base)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = "new"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "one two"), (2004, "one two"),
             (None, "no id"), (None, " ".join(base)), (5, "ONE TWO\x0bthree"), (2005, "a b c d e")]
    return rows


def test_rows_against_plain_python(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows],
                                 "doc_id long, text string, mark int, cell string, component int").repartition(4)
    got = S.near_duplicates(docs, cell_members=4)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_parts_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "CD", "e" * 30, "ü"], k=3000)) + "\n\n x"
    whole = plain_fingerprint(text)
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(S, "parts", lambda t, b, size=size, f=S.parts: f(t, b, size))
        assert S.fingerprint(text.encode()) == whole
        monkeypatch.undo()


def test_bound_and_meeting_cells():
    r = random.Random(2)
    for segments in (16, 32, 64):
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), r.randint(0, 2)):
                b ^= 1 << bit
            cell, of = S.cells(np.array([a, b], np.uint64), segments)
            assert set(cell[of == 0].tolist()) & set(cell[of == 1].tolist())  # partners meet
            assert np.bincount(of).max() <= 65


def links_of(spark, marks, **how):
    rows = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "mark long")
    got = S.links(rows, **how).collect()
    return [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in got]


def test_links_join_what_is_near_in_small_and_large_cells(spark):
    r = random.Random(4)
    marks = set()
    for _ in range(12):  # clusters around centres: large cells
        c = r.getrandbits(64)
        for _ in range(60):
            m = c
            for bit in r.sample(range(64), r.randint(0, 3)):
                m ^= 1 << bit
            marks.add(m)
    marks |= {r.getrandbits(64) for _ in range(200)}
    for distance in (1, 2):
        want = plain_components(marks, distance)
        for members in (2, 16, 10**6):
            got = links_of(spark, marks, distance=distance, cell_members=members)
            assert all((a ^ b).bit_count() <= distance for a, b in got)
            root = {m: m for m in marks}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for a, b in got:
                root[find(a)] = find(b)
            groups = lambda of: sorted(sorted(m for m in marks if of(m) == g) for g in {of(m) for m in marks})
            assert groups(find) == groups(want.get)


def test_links_of_a_large_group_stay_linear(spark):
    """All 2081 marks within 2 bits of one: over two million pairs near each other or not."""
    c = 0x0123456789ABCDEF
    marks = {c} | {c ^ 1 << i for i in range(64)} | {c ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    got = links_of(spark, marks)
    assert len(got) <= 65 * len(marks)
    assert {x for p in got for x in p} == marks


def test_empty_table_and_ids_of_other_types(spark):
    empty = S.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
    named = S.near_duplicates(spark.createDataFrame([("b", "x y z"), ("a", "X Y Z")], "name string, body string"),
                              id_col="name", text_col="body").collect()
    assert {(r.doc_id, r.component_id) for r in named} == {("a", "a"), ("b", "a")}
