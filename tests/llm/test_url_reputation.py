import math

from pyspark.sql import functions as F

from shardwright.llm import url_reputation as U

URLS = [
    ("http://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.example.net", "a.example.net", "", None, "allow"),
    ("http://a.example.net/", "a.example.net", "/", "net/", "block"),
    ("https://example.com/de/1#t", "example.com", "/de/1", "example.com/de/", "block"),
    ("https://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
    ("x://q.org/fr/?a://b", "q.org", "/fr/", "org/fr/", "allow"),
    ("x://q.org#/fr/", "q.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://ÄB.org\n/fr/x", "Äb.org\n", "/fr/x", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i if u else None, u[0], "h", "low") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "h", "low")], "page_id long, url string, html string, low string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = U.judge_urls(pages, none).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:]
    assert U.judge_urls(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows, marks = [], []
    for host, n, bad in (("evil.spam.com", 60, 57), ("fine.good.com", 60, 1), ("one.good.com", 1, 1), ("other.spam.com", 60, 55)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/p{i}"))
            marks.append((len(marks), int(i < bad)))
    marks += [(0, None), (None, 1), (0, 7)]
    rows += [(len(rows), "http://evil.spam.com/new"), (len(rows) + 1, "http://unseen.org/x")]
    out = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int"))
    verdict = {(r["host"], r["verdict"]) for r in out.collect()}
    assert verdict == {("evil.spam.com", "block"), ("other.spam.com", "block"), ("fine.good.com", "allow"), ("one.good.com", "allow"), ("unseen.org", "block")}  # 114 of 181 pages are bad, and nothing else is known of it


def spam(spark):
    """Five bad hosts of spam.com; many good hosts elsewhere; pages of hosts without a label."""
    hosts = [(f"h{i}.spam.com", 60, 60) for i in range(5)] + [(f"w{i}.site{i % 9}.com", 60, i % 2) for i in range(36)] + [(f"a{i}.fine.org", 60, 0) for i in range(6)]
    rows, marks = [], []
    for host, n, bad in hosts:
        for i in range(n):
            marks.append((len(rows), int(i < bad)))
            rows.append((len(rows), f"http://{host}/p{i}"))
    unseen = ("new.spam.com", "spam.com", "new.site1.com", "unseen.com", "unseen.org", "unseen.info")
    rows += [(len(rows) + i, f"http://{h}/x") for i, h in enumerate(unseen)]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")


def test_unlabelled_hosts_have_the_posterior_of_what_is_above_them(spark):
    out = U.judge_urls(*spam(spark))
    got = {r["host"]: (r["verdict"], r["low"]) for r in out.where("path = '/x'").collect()}
    assert {h: v for h, (v, _) in got.items()} == {
        "new.spam.com": "block", "spam.com": "block", "new.site1.com": "allow", "unseen.com": "allow", "unseen.org": "allow", "unseen.info": "allow"
    }
    assert all(low is not None for _, low in got.values()) and got["new.spam.com"][1] == got["spam.com"][1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 10 and "Python" not in plan and "Arrow" not in plan


def test_unlabelled_hosts_change_nothing_of_the_others(spark):
    pages, marks = spam(spark)
    h = pages.join(marks, "page_id", "left").select(U.host_of(F.col("url")).alias("host"), "bad")
    key = lambda df: {r["host"]: (r["n"], r["bad"], round(r["mean"], 9), round(r["low"], 9)) for r in df.collect()}
    every, labelled = key(U.host_reputation(h)), key(U.host_reputation(h.where("bad is not null")))
    assert len(every) == len(labelled) + 6 and {k: every[k] for k in labelled} == labelled


def test_posterior_matches_a_plain_restatement(spark):
    data = {"a.x.co.uk": (30, 20), "b.x.co.uk": (10, 1), "y.com": (40, 4), "z.y.com": (5, 5), "solo": (3, 0)}
    marks = [(h, int(i < b)) for h, (n, b) in data.items() for i in range(n)]
    got = {r["host"]: r for r in U.host_reputation(spark.createDataFrame(marks, "host string, bad int")).collect()}
    domain = {"a.x.co.uk": "x.co.uk", "b.x.co.uk": "x.co.uk", "y.com": "y.com", "z.y.com": "y.com", "solo": "solo"}
    suffix = {"x.co.uk": "co.uk", "y.com": "com", "solo": ""}

    def level(children, parent):
        s = sum((b - n * parent[k]) ** 2 - n * parent[k] * (1 - parent[k]) for k, (n, b) in children.items())
        w = sum(n * (n - 1) * parent[k] * (1 - parent[k]) for k, (n, b) in children.items())
        m = min(10_000.0, max(2.0, 1 / (s / w) - 1 if w and s / w > 0 else 10_000.0))
        return {k: ((b + m * parent[k]) / (n + m), n + m) for k, (n, b) in children.items()}

    def up(rows, to):
        out = {}
        for k, (n, b) in rows.items():
            x = out.get(to[k], (0, 0))
            out[to[k]] = (x[0] + n, x[1] + b)
        return out

    doms = up(data, domain)
    sufs = up(doms, suffix)
    rate = sum(b for _, b in data.values()) / sum(n for n, _ in data.values())
    s = level(sufs, dict.fromkeys(sufs, rate))
    d = level(doms, {k: s[suffix[k]][0] for k in doms})
    h = level(data, {k: d[domain[k]][0] for k in data})
    for host, (q, w) in h.items():
        assert got[host]["domain"] == domain[host]
        assert math.isclose(got[host]["mean"], q, rel_tol=1e-9)
        assert math.isclose(got[host]["low"], q - 1.645 * math.sqrt(q * (1 - q) / (w + 1)), rel_tol=1e-9, abs_tol=1e-12)
