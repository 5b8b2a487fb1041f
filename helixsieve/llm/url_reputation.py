"""URL filter: fixed rules first, then host reputation by empirical Bayes. DataFrame operations only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. The suffix is
the longest fitting one of ``suffixes`` (of some labels, as co.uk; part of the plan, so thousands at most), or else the
last label; the domain is the suffix and the label before it.
Each level's bad rate is shrunk towards its parent's by a beta-binomial prior whose strength comes from the level's
own over-dispersion (method of moments). A host is blocked if the lower bound of its posterior bad rate,
``mean - z * sd``, reaches ``cut``; a host without outcomes inherits its domain's, suffix's or the overall rate.

For reputation, though not in what is returned, a host is taken without user and port, and an IPv4 address is its own
domain and suffix. A null url, or one without ``://``, has empty host and path, and is judged as the empty host. Hosts that are alike but
for A-Z in upper case are one. Of rules of equal length, block wins. A repeated row is judged as often as it occurs; of
several outcomes of one page, bad wins; null outcomes don't count. A url of any length is split whole. Empty tables
give an empty result, and without outcomes the rules alone block.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch

#: (verdict, host, path): fixed values of the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    out = F
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", -len(r[1]))):
        out = out.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def site(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _strength(level: DataFrame, name: str) -> DataFrame:
    """One row: the level's prior strength, as a count of outcomes between 1 and 1000 (10 if there is nothing to tell it
    by), and the overall bad rate under a weak prior of one in ten."""
    n, b = F.col("n"), F.col("b")
    sums = level.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(b * b / n).alias("bb"))
    m = b / n
    rho = ((F.col("bb") - n * m * m) / F.col("k") - m * (1 - m)) / (m * (1 - m) * (n / F.col("k") - 1))
    rho = F.when((n > F.col("k")) & (b > 0) & (b < n), rho)
    strength = F.when(rho > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / rho - 1))).when(rho <= 0, 1000.0).otherwise(10.0)
    return sums.select(strength.alias(name), ((F.coalesce(b, F.lit(0)) + 1) / (F.coalesce(n, F.lit(0)) + 10)).alias("overall"))


def host_reputation(hosts: DataFrame, *, z: float, cut: float, suffixes: Sequence[str] = ()) -> DataFrame:
    """From (host, n outcomes, b bad ones): host, rate, bound and verdict."""
    last = "|".join([*map(re.escape, sorted(suffixes)), "[^.]*"])
    address = F.col("host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    domain, suffix = F.regexp_extract("host", rf"([^.]*\.)?({last})$", 0), F.regexp_extract("host", rf"(?:^|\.)({last})$", 1)
    hosts = hosts.withColumns({"domain": F.when(address, F.col("host")).otherwise(domain), "suffix": F.when(address, F.col("host")).otherwise(suffix)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    k = [_strength(level, f"k{i}").first() for i, level in enumerate((by_suffix, domains, hosts))]
    shrunk = lambda strength, prior: (F.col("b") + strength * prior) / (F.col("n") + strength)
    by_suffix = by_suffix.select("suffix", shrunk(k[0][0], F.lit(k[0]["overall"])).alias("suffix_rate"))
    domains = domains.join(by_suffix, "suffix").select("domain", shrunk(k[1][0], F.col("suffix_rate")).alias("domain_rate"))
    rate = shrunk(k[2][0], F.col("domain_rate"))
    out = hosts.join(domains, "domain").withColumn("rate", rate)
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k[2][0] + 1))
    out = out.withColumn("bound", bound)
    return out.select("host", "rate", "bound", F.when(F.col("bound") >= cut, "block").otherwise("allow").alias("host_verdict"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, z: float = 1.645, cut: float = 0.5, suffixes: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and bound of every page. outcomes: page_id, bad (boolean)."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.coalesce("url", F.lit("")))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fits", match_rules(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", site(F.col("host")).alias("site"), "fits.rule", "fits.verdict")
    parts = scratch.save(parts, "parts")
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    counted = parts.join(known, "page_id", "left").groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    sites = scratch.save(counted.withColumnRenamed("site", "host"), "sites")
    judged = scratch.save(host_reputation(sites, z=z, cut=cut, suffixes=suffixes).withColumnRenamed("host", "site"), "judged")
    # Both sides are scans, so that adaptive execution can split a hot host.
    out = parts.join(judged, "site")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict").alias("verdict"), "rate", "bound")
