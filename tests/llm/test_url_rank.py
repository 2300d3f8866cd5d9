import numpy as np

from tracelake.llm import url_rank as op

PAGES = "page_id long, url string, html string"


def test_rules(spark):
    urls = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://q.net", "q.net", "", None, "allow"), ("https://M.Example.NET/en/1?q", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"), ("x://example.com/de/9#t", "example.com", "/de/9", "example.com/de/", "block"),
        ("http://badexample.com/de/9", "badexample.com", "/de/9", None, "allow"), ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://É.org/fr/a?b", "É.org".replace("É", "É"), "/fr/a", "org/fr/", "allow"), ("http://h.com#a/b", "h.com", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    rows = [(i, u[0], None) for i, u in enumerate(urls)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "a", 1)]
    seeds = [("a", 0.5), ("d", 0.5)]
    got = {r["host"]: r["rank"] for r in op.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, seed double"), 9, 0.0).collect()}
    names = "abcd"
    move = np.zeros((4, 4))
    for s, d, n in edges:
        move[names.index(d), names.index(s)] = n
    move /= np.maximum(move.sum(0), 1)
    start = np.array([0.5, 0, 0, 0.5])
    rank = start
    for _ in range(9):
        rank = op.DAMPING * move @ rank + (1 - op.DAMPING) * start
    assert all(abs(got.get(n, 0) - rank[i]) < 1e-12 for i, n in enumerate(names))


def test_links_carry_distrust_backwards(spark):
    link = lambda u: f'<p><a class=x HREF="{u}">t</a> <a href="/own">o</a></p>'
    rows = [
        (1, "http://bad.net/x", None), (2, "http://farm.io/a", link("http://bad.net/x") * 3), (3, "http://hub.io/a", link("//farm.io/a")), (4, "http://fine.io/a", link("http://other.io/")),
        (5, "http://good.org/fr/1", link("https://fine.io/z") * 50), (5, "http://good.org/fr/1", link("https://fine.io/z") * 50), (6, "http://alone.io/", "<a href='http://alone.io/2'>"),
    ]
    got = {r["page_id"]: r for r in op.judge(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as rule")).collect()}
    assert got[2]["verdict"] == got[3]["verdict"] == "block"
    assert got[4]["trust"] > got[4]["distrust"] and got[4]["verdict"] == "allow" and got[6]["verdict"] == "allow"


def test_empty(spark):
    assert op.judge(spark.createDataFrame([], PAGES)).collect() == []


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    farms = [(10 + i, f"http://farm{i}.io/a", '<a href="http://bad.net/x">t</a>') for i in range(40)]
    rows = [(1, "http://bad.net/x", None), *farms, (60, "http://hub.io/a", '<a href="http://farm0.io/">t</a>')]
    small = {r["page_id"]: r["verdict"] for r in op.judge(spark.createDataFrame(rows, PAGES)).collect()}
    many = spark.range(100, 20_000_100).selectExpr("id as page_id", "'http://other.net/x' as url", "cast(null as string) as html")
    large = op.judge(spark.createDataFrame(rows, PAGES).union(many)).where("page_id < 100").collect()
    assert {r["page_id"]: r["verdict"] for r in large} == small and set(small.values()) == {"block"}


def brute_verdicts(pages):
    """The judgement in plain Python: rules, host graph, dense power iteration to its fixed point."""
    from collections import Counter
    from urllib.parse import urlsplit

    def host_of(url):
        return urlsplit(url).netloc.lower()

    def rule_of(host, path):
        fit = [(h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit, key=lambda f: len(f[0])) if fit else None

    ruled, links, per_host = [], Counter(), {}
    for _, url, html in pages:
        host, path = host_of(url), urlsplit(url).path
        ruled.append((host, rule_of(host, path)))
        per_host.setdefault(host, []).append(ruled[-1][1])
        for target in (html or "").split('href="')[1:]:
            to = host_of(target.split('"')[0])
            if to and to != host:
                links[host, to] += 1
    names = sorted(set(per_host) | {h for e in links for h in e})
    place = {h: i for i, h in enumerate(names)}

    def rank(edges, verdict):
        move = np.zeros((len(names), len(names)))
        for (a, b), n in edges.items():
            move[place[b], place[a]] = n
        move /= np.maximum(move.sum(0), 1)
        start = np.array([float(2 * sum(r is not None and r[1] == verdict for r in per_host.get(h, [])) > len(per_host.get(h, []))) for h in names])
        return np.linalg.solve(np.eye(len(names)) - op.DAMPING * move, (1 - op.DAMPING) * start)

    trust, doubt = rank(links, "allow"), rank({(b, a): n for (a, b), n in links.items()}, "block")
    out = {}
    for (page, *_), (host, rule) in zip(pages, ruled, strict=True):
        t, d = trust[place[host]], doubt[place[host]]
        out[page] = (rule[0] if rule else None, rule[1] if rule else "block" if d >= op.LEAST and d >= op.SHARE * (t + d) else "allow", t, d)
    return out


def graph():
    """Pages of a few hundred hosts: blocked, trusted, farms that link to blocked ones, ordinary ones."""
    rng = np.random.default_rng(3)
    pages = []
    hosts = [f"h{i}-0." + ("net" if i % 9 == 0 else "org" if i % 9 == 1 else "io") for i in range(240)]
    for i, host in enumerate(hosts):
        for k in range(int(rng.integers(1, 4))):
            to = [hosts[int(j)] for j in rng.integers(0, 240, int(rng.integers(0, 6)))]
            if i % 9 == 4:
                to += [hosts[9 * int(j)] for j in rng.integers(0, 26, 5)]
            html = "".join(f'<a href="http://{h}/fr/x">t</a>' for h in to) + '<a href="/own">o</a><a href="#x">a</a>'
            pages.append((len(pages), f"http://{host}/fr/{k}", html))
    return pages


def test_judge_against_brute_force(spark):
    pages = graph()
    got = {r["page_id"]: r for r in op.judge(spark.createDataFrame(pages, PAGES)).collect()}
    want = brute_verdicts(pages)
    for page, (rule, verdict, trust, doubt) in want.items():
        r = got[page]
        assert abs(r["trust"] - trust) < 1e-4 and abs(r["distrust"] - doubt) < 1e-4
        close = min(abs(doubt - op.LEAST), abs(doubt - op.SHARE * (trust + doubt))) < 1e-4
        assert (r["rule"], r["verdict"]) == (rule, verdict) or close
    free = [v for r, v, *_ in want.values() if r is None]
    assert 0.05 < free.count("block") / len(free) < 0.95  # the links decide


def test_a_copy_of_the_graph_changes_nothing(spark):
    pages = graph()
    twice = pages + [(p + len(pages), u.replace("-0.", "-1."), h.replace("-0.", "-1.")) for p, u, h in pages]
    one = {r["page_id"]: r["verdict"] for r in op.judge(spark.createDataFrame(pages, PAGES)).collect()}
    two = {r["page_id"]: r["verdict"] for r in op.judge(spark.createDataFrame(twice, PAGES)).collect()}
    assert all(two[p] == v == two[p + len(pages)] for p, v in one.items())


def test_links_of_a_base_and_other_schemes(spark):
    rows = [
        (1, "http://bad.net/x", None), (2, "http://mirror.io/", '<base href="http://bad.net/"><a href="page">t</a>'), (3, "http://mail.io/", '<a href="mailto:a@bad.net">m</a><a href="#bad.net">'),
        (4, "http://long.io/", "<p>word " * 200_000 + '<a href="http://bad.net/1">t</a>'),
    ]
    got = {r["page_id"]: r["verdict"] for r in op.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}
