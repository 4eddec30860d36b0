"""URL rules and reputations against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import url_filter as uf


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute_rule(host, path):
    found = [(n + p, v) for v, n, p in uf.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(found, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "a.net/x", "http://a.net", "http://a.net/", "http://A.NET/x?y#z", "http://net/", "http://xnet/", "ftp://example.net/en/1", "http://www.example.net/de/1",
    "http://example.com/de", "http://example.com/de/", "http://b.org/fr/9#a?b", "http://b.org?x/fr/", "http://u@h:80/p", "x://y://z/w", "http://É.Net/é\nb", "http://a.example.com/de/?q=://", "://", "http:///de/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = {r["id"]: r for r in uf.judge(df, outcomes).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u
    assert uf.judge(df.limit(0), outcomes).collect() == []


def brute_domain(host):
    name = host.rsplit("@", 1)[-1]
    name = re.sub(r":[0-9]*$", "", name)
    name = name.rstrip(".") if "." in name else name
    if re.fullmatch(r"[0-9.]+", name) or "[" in name:
        return "(address)", name
    labels = name.split(".")
    if len(labels) == 1:
        return "(name)", name
    n = 2 if ".".join(labels[-2:]) in uf.TWO_LABEL_SUFFIXES else 1
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


def brute_bounds(outcomes):
    """(host, bad) to the posterior bound of each host, level by level; the bound by counting on a fine grid of the beta density."""
    counts = defaultdict(lambda: [0, 0])
    for host, bad in outcomes:
        counts[host][0] += bad is not None
        counts[host][1] += bad or 0
    overall = (sum(b for _, b in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for host, (n, b) in counts.items():
            out[key(host)][0] += n
            out[key(host)][1] += b
        return out

    def shrunk(members, parent):
        """Member to (prior's weight, rate, posterior's weight); parent: member to (rate, weight)."""
        seen = {m: (n, b) for m, (n, b) in members.items() if n}
        s = sum((b - n * parent(m)[0]) ** 2 / n / (parent(m)[0] * (1 - parent(m)[0])) for m, (n, b) in seen.items())
        free = sum(n - 1 for n, _ in seen.values())
        rho = min(max((s - len(seen)) / free, uf.LEAST_CORRELATION), uf.MOST_CORRELATION) if seen and free else uf.MOST_CORRELATION
        out = {}
        for m, (n, b) in members.items():
            rate, weight = parent(m)
            prior = 1 / (rho + 1 / (weight + 1)) - 1
            out[m] = (prior, (b + prior * rate) / (n + prior), n + prior)
        return out

    tops = shrunk(summed(lambda h: brute_domain(h)[0]), lambda m: (overall, sum(n for n, _ in counts.values()) + 1))
    domains = shrunk(summed(brute_domain), lambda m: tops[m[0]][1:])
    hosts = shrunk(counts, lambda h: domains[brute_domain(h)][1:])
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = {}
    for host, (n, b) in counts.items():
        rate, prior = domains[brute_domain(host)][1], hosts[host][0]
        p, q = b + prior * rate, n - b + prior * (1 - rate)
        density = np.exp((p - 1) * np.log(grid) + (q - 1) * np.log1p(-grid) - np.max((p - 1) * np.log(grid) + (q - 1) * np.log1p(-grid)))
        total = np.cumsum(density)
        out[host] = grid[np.searchsorted(total, uf.TAIL * total[-1])]
    return out


def brute_outcomes(pages, labels):
    bad = defaultdict(bool)
    for i, quality, toxic in labels:
        bad[i] = bad[i] or quality == 0 or toxic == 1
    out = []
    for _, url in pages:
        host, path = brute_parts(url)
        number = re.search(r"/([0-9]{1,18})(?:\.html)?/?$", path)
        i = int(number.group(1)) if number else None
        out.append((host, int(bad[i]) if i in bad else None))
    return out


def brute_verdicts(pages, labels, max_bad):
    bounds = brute_bounds(brute_outcomes(pages, labels))
    out = {}
    for i, url in pages:
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        out[i] = (host, path, rule, verdict or ("block" if bounds[host] > max_bad else "allow"))
    return out, bounds


def close(bound, max_bad):
    return abs(bound - max_bad) < 1e-4


@pytest.mark.parametrize("own_limit", [True, False])
def test_verdicts_of_the_table_by_brute_force(spark, own_limit, monkeypatch):
    """At the query's own limit, and at one in the middle of the bounds, where the table's hosts differ."""
    from folioscan.llm.queries import op2_url_filter

    sf = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    free = sorted({host: b for host, b in brute_bounds(brute_outcomes(pages, labels)).items() if brute_rule(host, "/")[0] is None}.values())
    max_bad = uf.MAX_BAD if own_limit else max(zip(free[1:], free[:-1], strict=True), key=lambda x: x[0] - x[1])[1] + 1e-6
    max_bad = max_bad if own_limit else (max_bad + min(b for b in free if b > max_bad)) / 2
    want, bounds = brute_verdicts(pages, labels, max_bad)
    monkeypatch.setattr(uf.judge, "__defaults__", (*uf.judge.__defaults__[:3], max_bad, *uf.judge.__defaults__[4:]))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op2_url_filter(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i] == want[i] or close(bounds[want[i][0]], max_bad) for i in want)
    if not own_limit:
        assert len({v[3] for v in want.values() if v[2] is None}) == 2


def test_verdicts_with_bad_hosts_by_brute_force(spark, tmp_path):
    """A table in which all hosts of one domain show bad documents: the method blocks them, and a host of that domain that has no labels."""
    from folioscan.llm.queries import op2_url_filter

    rng = random.Random(7)
    labels = [(i, int(rng.random() < 0.5), 0) for i in range(2000)] + [(1, 1, 1)]
    bad = [i for i, q, t in labels if q == 0]
    good = [i for i, q, t in labels if q == 1 and i != 1]
    urls = [f"http://h{k}.spam.com/p/{rng.choice(bad)}.html" for k in range(6) for _ in range(40)] + ["http://new.spam.com/none", "https://h1.spam.com/a/b"]
    urls += [f"http://www.site{k}.co.uk/{rng.choice(good if rng.random() < 0.95 else bad)}" for k in range(8) for _ in range(25)]
    urls += [f"http://mixed{k}.com/x/{rng.randrange(2000)}/" for k in range(10) for _ in range(12)] + ["http://lone.com/5", f"http://one.org/fr/{bad[0]}", f"http://only.de/{bad[1]}", None, "x", "http://10.0.0.1/7", "http://intranet/8"] + ["http://big.com/about"] * 300
    pages = list(enumerate(urls))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    want, bounds = brute_verdicts(pages, labels, uf.MAX_BAD)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op2_url_filter(spark, f"file://{tmp_path}").collect()}
    assert not any(close(b, uf.MAX_BAD) for b in bounds.values()) and got == want
    by_method = {v[0]: v[3] for v in want.values() if v[2] is None}
    assert {by_method[h] for h in ("h0.spam.com", "h5.spam.com", "new.spam.com")} == {"block"} and {by_method[h] for h in ("www.site1.co.uk", "big.com")} == {"allow"}


def test_repeated_and_very_long_urls(spark):
    long = "http://a.com/" + "x/" * 200_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "b." * 5000 + "com/")], "page_id long, url string")
    rows = uf.judge(df, spark.createDataFrame([("a.com", 1)] * 3, "host string, bad int")).collect()
    assert len(rows) == 3 and {len(r["path"]) for r in rows if r["id"] == 1} == {len(long) - len("http://a.com")} and len({str(r) for r in rows}) == 2


def test_suffixes_from_a_list(spark, tmp_path):
    (tmp_path / "list").write_text("// names\ncom\nco.uk\ncom.sg // Singapore\n*.ck\n!www.ck\nplc.co.im\n\n", encoding="utf-8")
    suffixes = uf.read_suffixes(str(tmp_path / "list"))
    assert suffixes == ("*.ck", "co.uk", "com.sg", "plc.co.im")
    df = spark.createDataFrame([("a.b.com.sg",), ("x.co.uk",), ("a.b.c.plc.co.im",), ("q.w.e.ck",), ("n.com",), ("com.sg",)], "h string")
    got = [tuple(r) for r in df.select(*uf.suffix_and_domain(F.col("h"), suffixes)).collect()]
    assert got == [("com.sg", "b.com.sg"), ("co.uk", "x.co.uk"), ("plc.co.im", "c.plc.co.im"), ("e.ck", "w.e.ck"), ("com", "n.com"), ("com.sg", "com.sg")]


def test_beta_bound_against_counting():
    rng = np.random.default_rng(0)
    a, b = np.array([0.3, 2.0, 40.0, 700.0, 5.0]), np.array([0.7, 9.0, 3.0, 900.0, 0.2])
    for x, y, q in zip(a, b, uf.beta_bound(a, b), strict=True):
        assert abs((rng.beta(x, y, 200_000) < q).mean() - uf.TAIL) < 0.003


def test_reputation_blocks_the_bad_and_shrinks_the_rare(spark):
    rng = random.Random(1)
    rows = [("bad.spam.com", int(rng.random() < 0.95)) for _ in range(60)] + [("one.spam.com", 1)] + [("new.spam.com", None)]
    rows += [(f"h{i}.site{i % 7}.org", int(rng.random() < 0.1)) for i in range(40) for _ in range(20)] + [("lone.org", 1), ("", None), ("10.0.0.1", 0), ("x.co.uk", 0)]
    got = {r["host"]: r for r in uf.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.spam.com"]["bound"] > 0.8 > got["bad.spam.com"]["rate"] - 0.2
    assert got["lone.org"]["bound"] < 0.5 and got["lone.org"]["rate"] < 0.9
    assert got["new.spam.com"]["rate"] > got["h1.site1.org"]["rate"] and got["x.co.uk"]["domain"] == "x.co.uk"
    assert all(r["bound"] < 0.5 for h, r in got.items() if h.endswith(".org"))
