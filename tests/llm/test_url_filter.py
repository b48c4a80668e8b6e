"""Operator 8: hosts, paths and rules against plain Python; held-out accuracy."""
import random

import pytest

from nightjar.llm import url_filter as U

URLS = ["http://A.Example.NET/en/1?x=1#y", "https://example.net/EN/", "http://net", "http://net/", "http://x.net?q=/en/", "b://example.com/de/#",
        "http://sub.example.com/de", "http://sub.example.com/de/x", "http://notexample.com/de/x", "ftp://a.org/fr/", "http://org/fr/a", "http://a.org/en",
        "no scheme", "", None, "://", "x://É.Net/", "http://a.net:80/", "http://a.net./", "http://h/p?u=http://b.net/", "http://example.net/en/",
        "http://example.net/en", "http://www.net/\n/x", "HTTP://U@EXAMPLE.ORG/fr/é", "http://example.net/en/", "x" * 100_000 + "://a.net/" + "p" * 100_000]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def rule_of(url):
    host, path = parts(url)
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "x", "y", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, n_chars double")


def test_rules(spark):
    p = pages(spark)
    df = U.judge_urls(p, U.RULES, U.fit(U.labelled_by_rules(p, U.RULES)))
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        rule = rule_of(url)
        assert (got[i].host, got[i].path, got[i].rule) == (*parts(url), rule.text if rule else None)
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("label", [None, 0, 1])
def test_few_labels(spark, label):
    rows = [("http://a.com/", label)] if label is not None else []
    model = U.fit(spark.createDataFrame(rows, "url string, label int"))
    got = U.judge_urls(pages(spark), [], model).collect()
    assert {r.verdict for r in got} == {"block" if label == 1 else "allow"} and all(r.rule is None for r in got)
    assert U.judge_urls(pages(spark, []), U.RULES, model).count() == 0


def test_features(spark):
    rows = U.lexical(U.host_path(pages(spark, ["https://a-b.c.org/x/y?k=1&m=22#f", None]).select("page_id", "url"))).orderBy("page_id").collect()
    a, b = rows
    assert (a.suffix, a.depth, a.n_params, a.n_hyphens, a.n_labels, a.has_fragment, a.is_secure) == ("org", 2, 2, 1, 3, 1, 1)
    assert a.digit_ratio == pytest.approx(3 / 32) and 3 < a.entropy < 5
    assert (b.n_chars, b.depth, b.entropy, b.digit_ratio) == (0, 0, 0, 0)


def test_held_out_accuracy(spark):
    r = random.Random(4)

    def url(bad):
        host = "".join(r.choice("abcdefgh") for _ in range(6))
        if bad:
            return f"http://{host}-win-{r.randrange(10**6)}.{r.choice(['top', 'com'])}/?a={r.randrange(999)}&b={r.randrange(999)}&c=1"
        return f"https://{host}.{r.choice(['org', 'com'])}/{host}/{host}"
    rows = [(url(i % 3 == 0), int(i % 3 == 0)) for i in range(1500)]
    model = U.fit(spark.createDataFrame(rows[:1000], "url string, label int"))
    test = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows[1000:])], "page_id long, url string, y int")
    got = U.judge_urls(test, [], model).join(test, "page_id").selectExpr("avg(cast((verdict = 'block') = (y = 1) as int)) as a").first()
    assert got.a > 0.95
