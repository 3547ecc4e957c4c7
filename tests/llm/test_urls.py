import pytest

from tessera.llm import graph, urls
from tessera.llm.graph import components


def test_aliases_and_precedence(spark):
    page = lambda head: f"<html><head>{head}</head><body>x</body></html>"
    rows = [
        (1, "http://bad.com/x", ""),
        (2, "http://a.org/1", page('<link rel="canonical" href="http://bad.com/x">')),
        (3, "https://A.org/2#top", page("<meta http-equiv=refresh content='0; url=/1'>")),
        (4, "http://good.net/ok/1", page('<link href="//c.org/p?utm_source=y" rel=canonical>')),
        (5, "http://c.org/p", page('<link rel="canonical" href="http://bad.com/z"/>')),
        (6, "http://free.org/", page('<a href="http://bad.com/x">no edge</a>')),
        (7, None, None),
        (8, "no-scheme", page('<link rel="canonical" href="http://bad.com/x">')),
        (8, "http://sub.good.net/ok/2?x#y", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as rule", "'x' as host")
    rules = [("bad.com", "/", "block"), ("good.net", "/ok/", "allow")]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(pages, rules).collect())
    assert got == [
        (1, "bad.com", "/x", "bad.com/", "block"),
        (2, "a.org", "/1", "", "block"),
        (3, "a.org", "/2", "", "block"),
        (4, "good.net", "/ok/1", "good.net/ok/", "allow"),
        (5, "c.org", "/p", "", "allow"),
        (6, "free.org", "/", "", "allow"),
        (7, "", "", "", "allow"),
        (8, "", "", "", "allow"),
        (8, "sub.good.net", "/ok/2", "good.net/ok/", "allow"),
    ]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_many_rules_agree_with_few(spark, monkeypatch):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/7", "block"), ("org", "", "allow"), ("b.org", "/x", "block")]
    frame = spark.createDataFrame([(h, p) for h in ("com", "example.com", "a.example.com", "xexample.com", "b.org", "org", "") for p in ("", "/en/7", "/en/", "/x1")], "host string, path string")
    few = sorted(map(tuple, urls.with_rule(frame, rules).select("host", "path", "rule", "action").collect()), key=str)
    monkeypatch.setattr(urls, "INLINE", 0)
    assert few == sorted(map(tuple, urls.with_rule(frame, rules).select("host", "path", "rule", "action").collect()), key=str)


@pytest.mark.parametrize("held", [200_000, 40])
def test_components_against_union_find(spark, monkeypatch, held):
    import random

    monkeypatch.setattr(graph, "HELD", held)

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(1, 200)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(None, 1), (5, 5)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == set(parent)
    groups: dict[int, set] = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
