"""What the template tree of URLs is, and what it learns from labels."""

import random
from collections import defaultdict
from math import sqrt

import pytest

from mergelens.llm import urls


def brute_tree(paths, z=2.6):
    """{(segs, ..): template} of one host's paths {segs: (n, labelled, bad)}, by recursion over whole groups."""
    out = {}

    def grow(rows, up):
        if len({s for s, _ in rows}) == 1:
            for s, _ in rows:
                out[s] = up + "".join("/" + x for x in rows[0][1])
            return
        heads = defaultdict(list)
        for s, rest in rows:
            heads[rest[0]].append((s, rest))
        total = lambda rs, k: sum(paths[s][k] for s, _ in rs)
        kids = lambda rs: _sums((rest[1] if len(rest) > 1 else "", paths[s][0]) for s, rest in rs)
        level, everyone = total(rows, 0), kids(rows)
        named = defaultdict(list)
        for head, rs in heads.items():
            own, rest = total(rs, 0), level - total(rs, 0)
            apart = False
            for child, n in kids(rs).items():
                p, q, both = n / own, (everyone[child] - n) / max(rest, 1), everyone[child] / level
                apart |= abs(p - q) > z * sqrt(both * (1 - both) * (1 / own + 1 / max(rest, 1))) + 1e-9
            l1, b1 = total(rs, 1), total(rs, 2)
            l2, b2 = total(rows, 1) - l1, total(rows, 2) - b1
            pool = (b1 + b2) / max(l1 + l2, 1)
            unlike = l1 > 0 and l2 > 0 and abs(b1 / max(l1, 1) - b2 / max(l2, 1)) > 1.9 * sqrt(pool * (1 - pool) * (1 / max(l1, 1) + 1 / max(l2, 1))) + 1e-9
            keep = len(heads) < 8 or apart or unlike or (l1 > 0) != (l2 > 0) or head == "" or head.startswith("{")
            named[head if keep else "*"] += rs
        for name, rs in named.items():
            if name == "":
                for s, _ in rs:
                    out[s] = up + "/"
            else:
                grow([(s, rest[1:]) for s, rest in rs], up + "/" + name)

    grow([(s, (*s, "")) for s in paths], "")
    return out


def _sums(pairs):
    out = defaultdict(int)
    for k, n in pairs:
        out[k] += n
    return out


def test_tree_by_recursion(spark):
    rng = random.Random(6)
    hosts, rows = {}, []
    for h in range(25):
        names = rng.sample(["news", "spam", "a", "b", "c", "d", "e", "f", "g", "h", "{n}", "{t}", "x.html"], rng.randint(1, 13))
        paths = {}
        for _ in range(rng.randint(1, 90)):
            segs = tuple(rng.choice(["p", "q"][: rng.randint(1, 2)] if d == 0 and rng.random() < 0.7 else names) for d in range(rng.randint(0, 5)))
            n = rng.randint(1, 40)
            labelled = rng.choice([0, 0, n // 2, n])
            paths[segs] = (n, labelled, labelled if "spam" in segs else rng.randint(0, labelled // 8))
        for i in range(rng.choice([0, 9, 15])):  # a level of many alike
            paths[("u", f"user-{i}", rng.choice(["{n}", "{n}", "about"]))] = (rng.randint(2, 6), *rng.choice([(0, 0), (0, 0), (2, 0), (2, 2)]))
        hosts[f"h{h}.net"] = paths
        rows += [(f"h{h}.net", list(s), *c) for s, c in paths.items()]
    got = urls.templates(spark.createDataFrame(rows, "host string, segs array<string>, n long, labelled long, bad long")).collect()
    assert len(got) == len(rows)
    want = {(h, s): up for h, paths in hosts.items() for s, up in brute_tree(paths).items()}
    assert {(r.host, tuple(r.segs)): r.up for r in got} == want
    assert sum("*" in up for up in want.values()) > 20


def test_a_long_common_path_takes_one_round(spark, monkeypatch):
    rounds = []
    kept = urls.materialise
    monkeypatch.setattr(urls, "materialise", lambda df, label: (rounds.append(label), kept(df, label))[1])
    deep = "s/" * 1500
    rows = [(1, f"http://trap.net/{deep}x/1"), (2, f"http://trap.net/{deep}y/2"), (3, f"http://trap.net/{deep}z")]
    got = {r.page_id: r.template for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got[3] == "trap.net" + "/s" * 1500 + "/z" and got[1] == "trap.net" + "/s" * 1500 + "/x/{n}" and len(rounds) < 20


def test_pages_of_a_template_share_a_verdict(spark, tmp_path):
    said = [f"http://h{i}.example.org/{s}/{200 + i}" for i in range(12) for s in ("es", "en")]  # es is blocked by rule, en allowed
    said += [f"http://h{i}.example.com/{s}/{i}" for i in range(12) for s in ("de", "fr", "en")]  # de blocked, fr allowed, en open
    open_ = [f"http://k{i}.example.net/{s}/{i}" for i in range(9) for s in ("es", "de", "fr", "en", "xx")]  # no rule fits
    rows = list(enumerate(said + open_))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {dict(rows)[r.page_id]: r for r in urls.op9_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    by_template = defaultdict(set)
    for r in got.values():
        if r.rule is None:
            by_template[r.template].add((r.verdict, r.bad_share))
    assert by_template and all(len(v) == 1 for v in by_template.values())
    # a folder that one site blocks and another allows tells nothing of a third, nor do a site's other folders that disagree
    assert all(got[u].rule is None and got[u].verdict == "allow" and got[u].evidence == "none" for u in open_)
    assert all(got[u].verdict == "allow" for u in said if "/en/" in u)


def test_labelled_sites(spark):
    """Sites with good and bad sections, a third of the pages labelled and some labels wrong: precision and recall on pages
    without a label, on sites without any, and of sections whose labels disagree."""
    rng = random.Random(3)
    rows, labels, truth = [], [], {}
    sections = {"news": 0, "blog": 0, "docs": 0, "cheap-pills": 1, "casino": 1}
    for h in range(40):
        host = f"www.site{h}.{rng.choice(['net', 'com.au', 'info'])}"
        for name, bad in sections.items():
            for _ in range(rng.randint(4, 25)):
                k = len(rows)
                rows.append((k, f"http://{host}/{name}/{rng.randrange(10**6)}"))
                truth[k] = bad
                if h < 30 and rng.random() < 0.34:  # the last ten sites have no label
                    labels.append((k, bad if rng.random() < 0.95 else 1 - bad))
    # a section that is bad on some sites and good on others says nothing elsewhere
    for h in range(12):
        for _ in range(10):
            k = len(rows)
            rows.append((k, f"http://www.mixed{h}.net/forum/{rng.randrange(10**6)}"))
            truth[k] = h % 2 if h < 10 else 0
            if h < 10 and rng.random() < 0.5:
                labels.append((k, h % 2))
    df, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(df, [], lab).collect()}
    seen = {k for k, _ in labels}
    for part in ([k for k in truth if k not in seen], [k for k, u in rows if any(f"site{h}." in u for h in range(30, 40))]):
        blocked = {k for k in part if got[k].verdict == "block"}
        bad = {k for k in part if truth[k]}
        assert len(blocked & bad) >= 0.9 * len(blocked) and len(blocked & bad) >= 0.9 * len(bad) > 20
    assert {got[k].evidence for k, u in rows if "site35." in u} == {"pattern"}
    assert {(got[k].evidence, got[k].verdict) for k, u in rows if "mixed11." in u} == {("none", "allow")}


def test_labels_of_deep_branches_stay_apart(spark):
    rows = [(i, f"http://host.net/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    rows += [(900, "http://host.net/a/b/c/d/spam/x/y/z/1/2/3"), (901, "http://host.net/" + "q/" * 60), (902, "http://host.net"), (903, None)]
    labels = [(i, i % 2) for i in range(0, 200, 3)]
    df, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(df, urls.RULES, lab).collect()}
    # what has no label of its own goes by the branch above it: all of /spam/ is bad, while the host's labels disagree
    assert len(got) == len(rows) and {i for i, r in got.items() if r.verdict == "block"} == {*range(1, 200, 2), 900}
    assert got[1].template == "host.net/a/b/c/d/spam/{n}" and got[0].template == "host.net/a/b/c/d/news/{n}"
    assert got[900].template == "host.net/a/b/c/d/spam/x/y/z/{n}/{n}/{n}" and got[901].template == "host.net" + "/q" * 60
    assert got[902].template == "host.net" and got[903].template == ""
    assert [got[i].evidence for i in (0, 900, 901, 903)] == ["template", "branch", "none", "none"]


@pytest.mark.parametrize(("host", "domain"), [("a.b.example.org", "example.org"), ("org", "org"), ("", ""), ("x.y", "x.y")])
def test_domains(spark, host, domain):
    from pyspark.sql import functions as F

    assert spark.range(1).select(urls.domain_of(F.lit(host)).alias("d")).head().d == domain
