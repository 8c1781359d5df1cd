"""URL rules and link trust against a plain power iteration."""

import collections

from fluxprint.llm import trust

SCHEMA = "page_id bigint, url string, html string"


def link(*hosts):
    return "".join(f'<a HREF = "{h}">x</a>' for h in hosts)


def test_hosts_paths_and_rules(spark, frame):
    urls = {
        1: ("HTTP://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        3: ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        4: ("http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
        5: ("http://notcom/", "notcom", "/", None, "allow"),
        6: (None, "", "", None, "allow"),
        7: ("mailto:x", "", "", None, "allow"),
        8: ("http://x.com?/a", "x.com", "", None, "allow"),
        9: ("a://b://c/d", "b:", "//c/d", None, "allow"),
        10: ("://ÄB.org/ä?", "Äb.org", "/ä", None, "allow"),
        11: ("", "", "", None, "allow"),
    }
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in trust.judged(frame([(i, u[0], None) for i, u in urls.items()], SCHEMA)).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}


def plain(edges, seeds, forward):
    to = collections.defaultdict(set)
    for a, b in edges:
        to[a if forward else b].add(b if forward else a)
    score = {h: (1 - trust.DAMPING) * s for h, s in seeds.items() if s}
    base = dict(score)
    for _ in range(trust.ROUNDS):
        now = dict(base)
        for h, s in score.items():
            for t in to[h]:
                now[t] = now.get(t, 0) + trust.DAMPING * s / len(to[h])
        score = now
    return score


def test_propagation_equals_power_iteration(spark, frame):
    pages = [(1, "http://good.com/a", link("http://friend.org/x", "//hub.org", "/inner")), (2, "http://bad.net/fr/", link("http://hub.org/")),
             (3, "http://hub.org/", link("https://bad.net/q", "http://good.com")), (4, "http://shady.org/", link("http://bad.net", "http://BAD.net/2")),
             (5, "http://friend.org/", None), (6, "http://shady.org/b", link("http://shady.org/c")), (6, "http://shady.org/b", link("http://shady.org/c"))]
    edges = {("good.com", "friend.org"), ("good.com", "hub.org"), ("bad.net", "hub.org"), ("hub.org", "bad.net"), ("hub.org", "good.com"), ("shady.org", "bad.net")}
    df = frame(pages, SCHEMA)
    assert {tuple(r) for r in trust.edges_of(df).collect()} == edges
    good, bad = plain(edges, {"good.com": 1.0}, True), plain(edges, {"bad.net": 1.0}, False)
    rows = trust.judged(df).collect()
    assert len(rows) == 7
    for r in rows:
        assert abs(r.trust - good.get(r.host, 0)) < 1e-9 and abs(r.distrust - bad.get(r.host, 0)) < 1e-9
    verdicts = {r.page_id: r.verdict for r in rows}
    assert verdicts[4] == "block" and verdicts[5] == "allow"


def test_empty_table(spark, frame):
    assert trust.judged(frame([], SCHEMA)).count() == 0
