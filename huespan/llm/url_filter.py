"""2. URL filter: empirical-Bayes host reputation with explicit rules on top.

Labelled page outcomes (good or not) are counted by host, registered domain and public suffix. Each level's rate is shrunk
towards the one above through a beta prior: the suffix towards all outcomes, the domain towards its suffix's other domains, the host
towards its domain's other hosts. A prior's strength is fitted by moments from how much the rates of a level's members vary beyond what their
numbers explain. A host whose posterior, less Z standard deviations of it, still allows a rate over the bound is allowed; that is, it is
blocked if even the upper end of its posterior lies below the bound.

A rule (host, path) fits its host and all subdomains, if the url's path starts with the rule's; the longest decides before any reputation.

A name's levels come from its suffix: the longest of a list of suffixes of two and more labels that it ends in (a parameter; read_suffixes() reads a public list from a file), else its last label. IP
addresses (of either version) are domain and suffix of their own, as no name is shared; dots at the end of a name don't count.

Null urls, and urls without "://", have an empty host and path, which share the reputation of the host "". Null outcomes
don't count. Repeated rows, and null page ids, are judged each; outcomes count as often as they occur, with each page row of their id. Very long urls are cut by plain expressions. Equally long
rules: the one listed last decides. Columns with other names don't matter. An empty table gives an empty result. Without any outcome every host has the prior of the options.
Counts are aggregated before they are shuffled, so a host with a third of all pages is one row in the reputations;
the join back from pages splits it by adaptive execution. Nothing is broadcast but the fitted strengths, as literals.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huespan.llm.common import materialize

# The rules of the query, (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
# Suffixes of two labels under which names are registered, those of the query; a full list can be read from a file.
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "com.br", "com.cn", "com.mx", "com.ar", "com.tr", "co.in", "co.kr", "co.za", "com.sg", "com.hk", "com.tw"]
ADDRESS = r"^(\[.*\]|[0-9]{1,3}([.][0-9]{1,3}){3})$"  # fixed value: hosts that are addresses
#: Share of good outcomes that a host's posterior must allow, how many standard deviations above its mean count, and bounds of a prior's strength.
BOUND, Z, STRENGTH = 0.5, 1.64, (1.0, 200.0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """Suffixes of two and more labels, wildcards and exceptions from a file in the format of the public suffix list, which is metadata of some thousands of names."""
    line = F.lower(F.trim(F.regexp_replace("value", "//.*$", "")))
    rows = spark.read.text(path).select(line.alias("s")).where(F.col("s").contains(".") & ~F.col("s").rlike("\\s")).distinct().collect()
    return sorted(r.s for r in rows)


def name_levels(host: Column, suffixes: list[str] | None = None) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without port and user.

    A suffix "*.x" stands for every name of one label more than x, and "!a.x" takes a.x out of it: the suffix there is x."""
    plain: dict[int, list[str]] = {}
    wild: dict[int, list[str]] = {}
    excepted: dict[int, list[str]] = {}
    for s in TWO_PART_SUFFIXES if suffixes is None else suffixes:
        kind, name = (wild, s[2:]) if s.startswith("*.") else (excepted, s[1:]) if s.startswith("!") else (plain, s)
        kind.setdefault(s.count(".") + 1, []).append(name)
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    bare = F.regexp_replace(bare, "[.]+$", "")
    domain, suffix = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    for labels in sorted({*plain, *wild}):  # longer ones wrap shorter ones
        last = F.substring_index(bare, ".", -labels)
        hit = last.isin(plain.get(labels, []))
        if labels in wild:
            hit = hit | F.substring_index(bare, ".", 1 - labels).isin(wild[labels]) & (F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) >= labels - 1)
        domain, suffix = F.when(hit, F.substring_index(bare, ".", -labels - 1)).otherwise(domain), F.when(hit, last).otherwise(suffix)
    for labels in sorted(excepted):
        last = F.substring_index(bare, ".", -labels)
        hit = last.isin(excepted[labels])
        domain, suffix = F.when(hit, last).otherwise(domain), F.when(hit, F.substring_index(bare, ".", 1 - labels)).otherwise(suffix)
    address = bare.rlike(ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and verdict; null, null if none does. Rules are options, not data: keep them to a few hundred."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # longer ones wrap shorter ones
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _moments(level: DataFrame) -> Column:
    """Strength of the beta prior from rates s/n with prior means m, by moments: between-member variance against that of counts alone."""
    r, n, m = F.col("s") / F.col("n"), F.col("n"), F.col("m")
    seen = F.sum(n * (r - m) * (r - m))  # expected: sum of m(1-m) * (1 + (n-1)/(strength+1))
    base, extra = F.sum(m * (1 - m)), F.sum(m * (1 - m) * (n - 1))
    rho = F.when(extra > 0, (seen - base) / extra)
    low, high = STRENGTH
    return F.when(rho.isNull(), F.lit(low)).when(rho <= 1 / (high + 1), F.lit(high)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), 1 / rho - 1)))


def reputations(outcomes: DataFrame, suffixes: list[str] | None = None) -> tuple[DataFrame, float]:
    """From (host, good) rows: posteriors (level, name, a, b) of the hosts, domains and suffixes that have outcomes, and the overall rate."""
    good = F.col("good").cast("double")
    by_host = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.sum(good).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    domain, suffix = name_levels(F.col("host"), suffixes)
    by_host = materialize(by_host.withColumns({"domain": domain, "suffix": suffix}), "hosts")  # all levels and strengths are made of it
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = by_suffix.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    rate = (total.s + 1) / (total.n + 2) if total.n else 0.5

    def shrunk(level: DataFrame, mean: Column) -> tuple[DataFrame, float]:
        """The level with its prior means m and posteriors a, b; its prior's strength."""
        level = level.withColumn("m", mean)
        k = level.agg(_moments(level).alias("k")).first().k or STRENGTH[0]
        return level.withColumns({"a": F.col("s") + F.col("m") * k, "b": F.col("n") - F.col("s") + (1 - F.col("m")) * k}), k

    def others(up: Column, k: float) -> Column:
        """The level above, without the member's own outcomes, which else would count twice."""
        return (F.col("up_s") - F.col("s") + up * k) / (F.col("up_n") - F.col("n") + k)

    suffixes, k3 = shrunk(by_suffix, F.lit(rate))
    above = suffixes.select("suffix", F.col("s").alias("up_s"), F.col("n").alias("up_n"))
    domains, k2 = shrunk(by_domain.join(above, "suffix"), others(F.lit(rate), k3))
    above = domains.select("domain", F.col("s").alias("up_s"), F.col("n").alias("up_n"), F.col("m").alias("up_m"))
    hosts, _ = shrunk(by_host.join(above, "domain"), others(F.col("up_m"), k2))
    levels = [(hosts, "host"), (domains, "domain"), (suffixes, "suffix")]
    out = None
    for frame, name in levels:
        part = frame.select(F.lit(name).alias("level"), F.col(name).alias("name"), "a", "b")
        out = part if out is None else out.unionByName(part)
    return out, rate


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | None = None, bound: float = BOUND, z: float = Z, suffixes: list[str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (posterior mean), upper (its upper end).

    outcomes: (page_id, good), good 1 or 0. Pages that it doesn't name are judged all the same.
    """
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("int").alias("good")).where(F.col("page_id").isNotNull() & F.col("good").isNotNull())
    table, rate = reputations(urls.join(known, "page_id").select("host", "good"), suffixes)
    # Hosts of all pages, each with the nearest level that has outcomes.
    hosts = urls.select("host").distinct()
    domain, suffix = name_levels(F.col("host"), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    low = STRENGTH[0]
    for level in ("host", "domain", "suffix"):
        part = table.where(F.col("level") == level).select(F.col("name").alias(level), F.struct("a", "b").alias(f"{level}_ab"))
        hosts = hosts.join(part, level, "left")
    found = hosts.withColumn("ab", F.coalesce("host_ab", "domain_ab", "suffix_ab", F.struct(F.lit(rate * low).alias("a"), F.lit((1 - rate) * low).alias("b"))))
    a, b = F.col("ab.a"), F.col("ab.b")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    found = found.select("host", mean.alias("reputation"), F.least(F.lit(1.0), mean + z * sd).alias("upper"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    found = materialize(found, "reputations")  # so the join's sides are plain exchanges, and a hot host's pages can be split
    judged = urls.withColumns({"rule": rule, "said": verdict}).join(found, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("upper") < bound, "block").otherwise("allow")).alias("verdict"), "reputation", "upper")
