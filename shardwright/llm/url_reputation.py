"""Operator 5: URL filters by host reputation (DataFrame functions only).

Labelled page outcomes (0 good, 1 bad) are counted by host, registered domain and
suffix.  Shares are shrunk level by level through beta-binomial priors:

    suffix | all pages:   a_s = bad_s + m1 * rate,    n_s' = n_s + m1
    domain | its suffix:  a_d = bad_d + m2 * a_s/n_s', n_d' = n_d + m2
    host   | its domain:  a_h = bad_h + m3 * a_d/n_d', n_h' = n_h + m3

The prior strengths m1..m3 are estimated by the method of moments from how far the
children's shares lie from their parents' beyond binomial noise, over all labelled
pages.  A host is blocked when the lower bound of its bad share,
``mean - z * sqrt(mean * (1 - mean) / (n_h' + 1))`` (the posterior beta's mean and
deviation), exceeds ``max_bad``.  A host without a labelled page has n = bad = 0, so its mean is
its domain's, that of an unlabelled domain its suffix's, and that of an unlabelled suffix the rate
of all pages.  Fixed rules go first: the longest that fits decides.

Registered domain: the last two labels of the host, or three where the last two are a
suffix of ``SUFFIXES``; a host of one label is its own domain; suffix: what follows the
domain's first label ('' if nothing does).

Defined cases: a null url or one without ``://`` has empty host and path; pages of the
empty host form a host like any other; a null or unknown outcome is no label;
repeated pages are judged and counted row by row; with no outcomes at all the rate is 0
and every page without a rule is allowed.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import ascii_lower, stored

#: Public suffixes of two labels.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Bound:
    """``z``: deviations below the posterior mean; ``max_bad``: blocked above; ``strengths``: limits of m."""

    z: float = 1.645
    max_bad: float = 0.35
    least: float = 2.0
    most: float = 10_000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*SUFFIXES), three).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(F.contains(domain, F.lit(".")), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, its path first."""
    rule = verdict = F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(b: Bound) -> Column:
    """Method of moments for children(n, bad, p): p the parent's share.  With few or evenly
    spread children the estimate is the weakest prior or the strongest."""
    noise = F.col("p") * (1 - F.col("p"))
    spread = F.sum((F.col("bad") - F.col("n") * F.col("p")) ** 2 - F.col("n") * noise)
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * noise)
    rho = F.try_divide(spread, pairs)  # correlation of two pages of one child
    m = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(b.most))
    return F.greatest(F.lit(b.least), F.least(F.lit(b.most), F.coalesce(m, F.lit(b.most))))


def host_reputation(outcomes: DataFrame, bound: Bound | None = None) -> DataFrame:
    """outcomes(host, bad: 0, 1 or no label, one row per page) -> host, domain, n, bad, mean, low, a row per host.

    The counts are stored once, a row per host; every level is read from them.  What a level needs of
    all its rows (the rate, a strength) is one number, and goes into the next plan as a literal."""
    b = bound or Bound()
    marked = F.col("bad").isin(0, 1)
    counts = outcomes.groupBy("host").agg(F.count_if(marked).alias("n"), F.coalesce(F.sum(F.when(marked, F.col("bad"))), F.lit(0)).cast("bigint").alias("bad"))
    domain = domain_of(F.col("host"))
    hosts = stored(counts.withColumn("domain", domain).withColumn("suffix", suffix_of(F.col("domain"))), "host-counts")

    def level(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def one(df: DataFrame, number: Column) -> Column:
        return F.lit(df.agg(number.alias("x")).first()["x"])

    def shrunk(rows: DataFrame) -> DataFrame:
        """rows(n, bad, p: the parent's share) with the posterior share ``q`` and weight ``w``."""
        m = one(rows, _strength(b))
        return rows.withColumn("w", F.col("n") + m).withColumn("q", (F.col("bad") + m * F.col("p")) / F.col("w")).drop("p")

    rate = one(hosts, F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)))
    s = shrunk(level("suffix").withColumn("p", rate))
    d = shrunk(level("suffix", "domain").join(s.select("suffix", F.col("q").alias("p")), "suffix"))
    h = shrunk(hosts.join(d.select("domain", F.col("q").alias("p")), "domain"))
    low = F.col("q") - b.z * F.sqrt(F.col("q") * (1 - F.col("q")) / (F.col("w") + 1))
    return h.select("host", "domain", "n", "bad", F.col("q").alias("mean"), low.alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bound: Bound | None = None) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, low.

    Both joins are on keys: outcomes by page id, reputations (one row a host) by host; no side
    is broadcast by hand, so AQE sends the small side or splits the hot host as measured."""
    b = bound or Bound()
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    # rows and outcomes of one page id meet as counts, so that a repeated row isn't multiplied
    marks = outcomes.where(F.col("bad").isin(0, 1)).groupBy("page_id").agg(F.max("bad").alias("bad"))
    rep = host_reputation(rows.select("page_id", "host").join(marks, "page_id", "left").select("host", "bad"), b)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > b.max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.join(rep.select("host", "low"), "host", "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "low")
    )
