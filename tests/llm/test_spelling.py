"""Operator 13 against plain Python."""
import random
import re
import zlib
from collections import Counter

import pytest

from nightjar.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def plain(docs):
    n = plain_words(docs)
    rows = {}
    for w in n:
        near = [v for v in n if v != w and one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        rows[w] = (best if best and n[best] >= 10 * n[w] else None, len(near))
    out = []
    for w, (form, count) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(out, key=str)


def variants(word, r):
    i = r.randrange(len(word))
    c = r.choice("abéßÿx")
    return r.choice((word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]))


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéÀ", k=r.randint(5, 11))) for _ in range(40)] + ["Aaaaaaa", "aaaaaaaa", "bbbbbbbbb"]
    pool = []
    for w in words:
        pool += [w] * r.choice((2, 30, 400))
        for _ in range(8):
            v = variants(w, r)
            pool += [v] * r.choice((1, 2, 3, 30))
            pool += [variants(v, r)] * 2
    r.shuffle(pool)
    docs = [(i, r.choice((" ", "\n", ", ", "1", "-", "Ā")).join(pool[i * 20:i * 20 + 20])) for i in range(len(pool) // 20 + 1)]
    return docs + [(9000, None), (9001, ""), (9002, "1234567 _______"), (None, "Aaaaaaa nullword nullword"), (3, docs[3][1]),
                   (9003, "x" * 5000 + " " + "x" * 5000), (9004, "x" * 5001 + " " + "x" * 5001)]


@pytest.mark.parametrize("max_words", [1, 8, 4096])
def test_rows_against_plain_python(spark, max_words):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n int, word string").repartition(6)
    got = S.spelling_variants(df, max_words=max_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] for x in want if x[1])


@pytest.mark.parametrize("seed", range(20))
def test_composition_lists_every_pair_once(seed):
    r = random.Random(seed)
    words = {"".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(40)} | {"".join(r.choices("abc", k=4)) for _ in range(20)}
    got = [frozenset(p) for p in S.Composition(S.Acceptor(sorted(words))).pairs(99)]
    want = {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    machine = S.Acceptor([a + b for a in ("ta", "to", "tu") for b in ("ps", "pping", "p")])
    assert len(machine.arcs) == 8  # t, vowel, p, ps-pping-end: all three vowels share the rest
    assert sum(machine.final) == 2


def test_pairs_of_a_hot_partition_are_found_once(spark):
    """A third and more of the words share nearly all letters."""
    r = random.Random(7)
    words = {"international" + "".join(r.choices("abcd", k=5)) for _ in range(500)}
    words |= {"".join(r.choices("abcdefgh", k=9)) for _ in range(300)} | {"internationa" + c for c in "lmn"}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b))
    for most in (3, 50):
        assert sorted(tuple(sorted(p)) for p in S.near_pairs(df, most).collect()) == want


def test_empty_table(spark):
    got = S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0
