"""Operator 6 against brute force; plan without Python."""
import pytest

from nightjar.llm import line_dedup as L

LINE = "this is a line of boilerplate {}"


def brute(rows, min_sites, min_chars):
    sites, home = {}, {}
    for key, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            k = line.strip(" ")
            if len(k) >= min_chars:
                sites.setdefault(k, set()).add(site)
                if key is not None:
                    home[k] = min(home.get(k, key), key)
    bad = {k for k, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for key, text, _ in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad or home.get(x.strip(" ")) == key]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rows = []
    for k in range(12):  # line k stands on k sites
        for s in range(k):
            rows.append((len(rows), f"own text {len(rows)}\n {LINE.format(k)} \nend", f"site{s}"))
    rows += [(200 + i, LINE.format(5), "site0") for i in range(50)]          # one hot site adds nothing
    rows += [(300 + i, "short line\n" + LINE.format(11), f"site{i}") for i in range(40)]
    rows += [(400, None, "site1"), (401, "", "site2"), (402, "\n\n", None), (403, LINE.format(4), None), (404, LINE.format(11), None),
             (None, LINE.format(11) + "\nkept", "site9"), (405, LINE.format(9), "site3"), (405, LINE.format(9), "site3"),
             (406, ("x" * 70 + "\n") * 20_000 + LINE.format(10), "site0")]
    return rows


@pytest.mark.parametrize("min_sites,margin", [(5, 0.1), (5, 0.9), (2, 0.0)])
def test_brute_force(spark, min_sites, margin):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_lines int, id int").repartition(4)
    df = L.drop_boilerplate(docs, min_sites=min_sites, margin=margin)
    assert df.columns[:3] == ["doc_id", "text", "source"] and "id" in df.columns
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)
    assert got == brute(rows, min_sites, L.MIN_CHARS)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketches_decide_far_lines_and_counts_near_ones(spark):
    rows = [(i, LINE.format("far"), f"s{i % 500}") for i in range(2000)] + [(5000 + i, LINE.format("near"), f"s{i % 99}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = L.boilerplate(docs, min_sites=100, lg_k=4)  # a coarse sketch: the near line needs its exact count
    assert bad.count() == 1
    assert L.boilerplate(docs, min_sites=99, lg_k=4, margin=1.0).count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.drop_boilerplate(docs).count() == 0
