"""URL rules and propagation over hosts."""

import numpy as np

from plotweave.llm import urls


def test_parts_and_rules(spark):
    rows = [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://h.com/fr/?q=/de/", "h.com", "/fr/", "com/fr/", "allow"),
        ("x://h.com/de/1://b.org/", "h.com", "/de/1://b.org/", "com/de/", "block"),
        ("x://h.com#frag/de/", "h.com", "", None, "allow"),
        ("//no.scheme.org/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://org", "org", "", None, "block"),
        ("http://\u00c9cole.net\n/x", "\u00c9cole.net\n", "/x", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None, "t", 1) for i, r in enumerate(rows)], "page_id long, url string, html string, host string, seed int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.url_filter(df).collect()}
    assert got == {i: r[1:4] for i, r in enumerate(rows)}
    verdicts = {r.page_id: r.verdict for r in urls.url_filter(df).collect()}
    assert all(verdicts[i] == r[4] for i, r in enumerate(rows) if r[3])
    assert urls.url_filter(df.where("false")).count() == 0


def rank(nodes, edges, seed, damping, rounds):
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, n in edges:
        m[nodes.index(b), nodes.index(a)] += n
    m = m / np.maximum(m.sum(0), 1e-300)
    base = np.array([seed.get(x, 0.0) for x in nodes])
    base = base / max(base.sum(), 1e-300) * (1 - damping)
    score = base
    for _ in range(rounds):
        score = damping * m @ score + base
    return dict(zip(nodes, score))


def test_propagation_equals_matrix_form(spark):
    rng = np.random.default_rng(0)
    nodes = [f"h{i}" for i in range(25)]
    edges = [(nodes[a], nodes[b], int(n)) for a, b, n in {tuple(x[:2]): tuple(x) for x in rng.integers(0, 25, (90, 3)).tolist()}.values() if a != b and n]
    seeds = [(x, int(a), int(b)) for x, a, b in zip(nodes, rng.integers(0, 3, 25), rng.integers(0, 2, 25))]
    got = {
        r.host: (r.trust, r.distrust)
        for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"), rounds=5).collect()
    }
    trust = rank(nodes, edges, {x: a for x, a, _ in seeds}, urls.DAMPING, 5)
    distrust = rank(nodes, [(b, a, n) for a, b, n in edges], {x: b for x, _, b in seeds}, urls.DAMPING, 5)
    for x in nodes:
        t, d = got.get(x, (0, 0))
        assert abs(t - trust[x]) < 1e-9 and abs(d - distrust[x]) < 1e-9


def test_settled_scores_equal_the_solution(spark):
    """A chain far longer than the rounds that settle a sum, and a ring, against the linear system."""
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(90)]
    ring = [(f"r{i}", f"r{(i + 1) % 4}", 2) for i in range(4)] + [("r0", "c88", 1)]
    edges, seeds = chain + ring, [("c90", 0, 3), ("r1", 2, 0)]
    nodes = sorted({x for e in edges for x in e[:2]})
    got = urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"))
    got = {r.host: (r.trust, r.distrust) for r in got.collect()}
    trust = rank(nodes, edges, {"r1": 2}, urls.DAMPING, 2000)
    distrust = rank(nodes, [(b, a, n) for a, b, n in edges], {"c90": 3}, urls.DAMPING, 2000)
    for x in nodes:
        t, d = got.get(x, (0, 0))
        assert abs(t - trust[x]) < 1e-5 and abs(d - distrust[x]) < 1e-5
        assert (t > 0) == (trust[x] > 0) and (d > 0) == (distrust[x] > 0)
    assert got["c0"][1] > 0


def test_links_to_blocked_hosts_spread_distrust(spark):
    html = '<a href="http://bad.com/de/1">x</a><A HREF = //bad.com/de/2><img src=\'http://bad.com/x\'>'
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/a", html), (3, "http://shop.net/a", None), (4, "http://ok.org/", '<a href="https://shop.net/a">'), (5, "http://alone.net/", "<a href='/x'>")]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
