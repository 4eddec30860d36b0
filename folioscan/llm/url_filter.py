"""URL filters: listed rules, and host reputation by empirical Bayes.

Outcomes of labelled pages are counted by host, and hosts within registered
domains within suffixes. On each level the rates below one parent follow a beta
distribution around the parent's rate; its concentration is found by moments
from all members of the level, and each member's rate is shrunk towards its
parent accordingly, from the top down. What is not sure about the parent's rate
is not sure about its members': a prior is as wide as the level and the parent's
posterior together, so a name without labels below a large suffix has a wide one.
A host is blocked if the lower bound of its posterior lies above ``MAX_BAD``.

Counts are summed before they are moved, so a host with a third of all pages is
a row for each task; the members of a large domain or suffix are dealt over
several tasks where they meet its rate. Only blocked hosts meet the pages again.

Suffixes are a parameter: those of two labels and more below which names are
registered, a short list by default, or a published list read by
``read_suffixes``. Addresses and names without a dot share one suffix each.

Defined results: null URLs and those without ``://`` have an empty host and path
and are a host of their own; labels that are null don't count; repeated rows are
judged alike, each counting as a page; of rules that fit equally long the last by
name holds; very long URLs are matched whole; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import dealt_join, small_or_plain
from folioscan.workspace import persist_table

#: (verdict, host, path): a rule fits its host and all subdomains below that path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels below which names are registered; ``read_suffixes`` reads longer lists.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
MAX_BAD = 0.5
TAIL = 0.05
LEAST_CORRELATION, MOST_CORRELATION = 1e-3, 0.5

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def read_suffixes(path: str) -> tuple[str, ...]:
    """Suffixes of several labels of a list with one a line: comments (//) and exceptions (!) are left out, wildcards (*.) stand for their parent's names."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split("//")[0].strip().lower() for line in f]
    return tuple(sorted({line for line in lines if line.count(".") and not line.startswith("!")}))


def suffix_and_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain: one label more. Addresses and single labels are their own domain, and share a suffix each."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    labels = max((s.count(".") + 1 for s in suffixes), default=1)
    tail = lambda n: F.substring_index(name, ".", -n)
    address, single = name.rlike(r"^[0-9.]+$|\["), ~name.contains(".")
    suffix, domain = tail(1), tail(2)
    for n in range(2, labels + 1):  # the longest that is listed holds
        exact = [s for s in suffixes if s.count(".") == n - 1 and not s.startswith("*.")]
        wild = [s[2:] for s in suffixes if s.count(".") == n - 1 and s.startswith("*.")]
        listed = F.substring_index(tail(n), ".", -n).isin(*exact) if exact else F.lit(False)
        if wild:
            listed = listed | tail(n - 1).isin(*wild) & (tail(n) != tail(n - 1))
        suffix, domain = F.when(listed, tail(n)).otherwise(suffix), F.when(listed, tail(n + 1)).otherwise(domain)
    suffix = F.when(address, "(address)").when(single, "(name)").otherwise(suffix)
    return suffix, F.when(address | single, name).otherwise(domain)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Ties go to the first by name."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by the continued fraction of the smaller tail."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.max(np.abs(step - 1), initial=0) < 1e-12:
            break
    return np.where(flip, 1 - front * h, front * h)


def _lgamma(z: np.ndarray) -> np.ndarray:
    """By Stirling's series after shifting the argument beyond 8."""
    shift = np.zeros_like(z)
    z = z.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift + np.log(np.where(low, z, 1)), shift)
        z = np.where(low, z + 1, z)
    inv = 1 / (z * z)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - shift


def beta_bound(a: np.ndarray, b: np.ndarray, tail: float = TAIL) -> np.ndarray:
    """The point below which a beta distribution has ``tail`` of its mass, by bisection."""
    lo, hi = np.full(len(a), 1e-9), np.full(len(a), 1 - 1e-9)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = _beta_cdf(mid, a, b) < tail
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def _concentration(members: DataFrame) -> float:
    """(n, bad, parent_rate) to the concentration of the level, by moments; one number reaches the driver."""
    m = F.col("parent_rate")
    seen = members.where("n > 0")
    r = seen.agg(F.sum((F.col("bad") - F.col("n") * m) ** 2 / F.col("n") / (m * (1 - m))).alias("s"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") - 1).alias("free")).first()
    if not r["k"] or not r["free"]:
        return 1 / MOST_CORRELATION - 1
    rho = min(max((r["s"] - r["k"]) / r["free"], LEAST_CORRELATION), MOST_CORRELATION)
    return 1 / rho - 1


def reputation(outcomes: DataFrame, tail: float = TAIL, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, bad: 0, 1 or null for a page without a label; n: of how many such pages, one if absent) to host, domain, suffix, n, bad, rate, bound."""
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    times = F.col("n") if "n" in outcomes.columns else F.lit(1).cast("long")
    labelled = F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), times)), F.lit(0))
    hosts = outcomes.groupBy("host").agg(labelled.alias("n"), F.coalesce(F.sum(F.col("bad").cast("long") * times), F.lit(0)).alias("bad"))
    hosts = persist_table(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "hosts")
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    def shrink(members: DataFrame, label: str) -> DataFrame:
        """Members (n, bad, parent_rate, parent_weight) with their prior's weight, their rate, and the weight of their posterior, in pages."""
        prior = 1 / (1 / (F.lit(_concentration(members)) + 1) + 1 / (F.col("parent_weight") + 1)) - 1
        rate = (F.col("bad") + F.col("prior") * F.col("parent_rate")) / (F.col("n") + F.col("prior"))
        return persist_table(members.withColumn("prior", prior).withColumns({"rate": rate, "weight": F.col("n") + F.col("prior")}), label)

    def parent(table: DataFrame, *keys: str) -> DataFrame:
        return table.select(*keys, F.col("rate").alias("parent_rate"), F.col("weight").alias("parent_weight"))

    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = shrink(tops.withColumns({"parent_rate": F.lit(overall), "parent_weight": F.lit(float((total["n"] or 0) + 1))}), "suffixes")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = shrink(dealt_join(domains, parent(tops, "suffix"), ["suffix"], ["domain"]), "domains")
    members = shrink(dealt_join(hosts, parent(domains, "suffix", "domain"), ["suffix", "domain"], ["host"]), "host-rates")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = (f.bad + f.prior * f.parent_rate).to_numpy(float)
            b = (f.n - f.bad + f.prior * (1 - f.parent_rate)).to_numpy(float)
            yield f.assign(bound=beta_bound(a, b, tail))[["host", "domain", "suffix", "n", "bad", "rate", "bound"]]

    return members.mapInPandas(run, "host string, domain string, suffix string, n long, bad long, rate double, bound double")


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict. outcomes: (host, bad), see ``reputation``."""
    blocked = persist_table(reputation(outcomes, suffixes=suffixes).where(F.col("bound") > max_bad).select("host", F.lit(True).alias("blocked")), "blocked-hosts")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("found", rule_column(F.col("host"), F.col("path"), rules))
    small = small_or_plain(blocked)
    joined = rows.join(small, "host", "left") if small is not blocked else dealt_join(rows, blocked, ["host"], ["id", "path"], "left")
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select("id", "host", "path", "found.rule", F.coalesce("found.verdict", by_method).alias("verdict"))
