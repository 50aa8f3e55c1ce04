"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted for hosts, registered domains and suffixes. Each level is a beta-binomial around
the level above: the whole -> suffix -> registered domain -> host. A port is no part of the names; an IP address is its own
suffix and domain; under the suffixes of SECOND two labels make the suffix and three the domain. A level's strength k (prior pages) comes from how
much more its rates vary than chance would have it (moments), and a unit's mean is (good + k * mean above) / (pages + k).
A page is allowed if the lower bound of its host's posterior, mean - z * sd, reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule) with rule = host + path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LEVELS = ("suffix", "domain", "host")
#: Suffixes of two labels: these second labels under country codes of two letters. A fixed list; others count as domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty for a null or an url without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:  # noqa: ANN001
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes to stand first
        at = text.index("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def levels_of(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    ip = host.startswith("[") | bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    names = F.split(bare, r"\.")
    two = bare.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z]{{2}}$")
    last = lambda n: F.array_join(F.slice(names, F.greatest(F.size(names) - n + 1, F.lit(1)), n), ".")
    return F.when(ip, bare).when(two, last(2)).otherwise(last(1)), F.when(ip, bare).when(two, last(3)).otherwise(last(2))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = 1.64, threshold: float = 0.6) -> DataFrame:  # noqa: ANN001
    """(page_id, host, path, rule, verdict, reputation) of every row of pages(page_id, url).

    outcomes(page_id, good 0 or 1) are the labelled pages; rows with a null in either column don't count, and a page
    that stands there several times counts as often. A null url or one without `://` has an empty host and path. A host
    without labelled pages has its domain's mean, a domain without any its suffix's, and so on; without any
    outcomes at all the mean is 0.5. Repeated or null page_ids are judged by their urls. Other columns
    are ignored; an empty table gives no rows. A very common host is one row by the time its pages meet it: pages are counted by
    page and host before hosts are, and pages are joined to their host's reputation last (a skewed join that adaptive execution may split).
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parts = parts.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = lambda df: df.withColumn("suffix", levels_of(F.col("host"))[0]).withColumn("domain", levels_of(F.col("host"))[1])
    votes = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")).filter("page_id is not null and good is not null")
    hosts = parts.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("c")).join(votes, "page_id", "left")
    # one row for each host, read by the mean and by all three levels
    hosts = cut(named(hosts.groupBy("host").agg(F.sum(F.when(F.col("good").isNotNull(), F.col("c")).otherwise(0)).alias("n"), F.coalesce(F.sum(F.col("good") * F.col("c")), F.lit(0)).alias("g"))))
    whole = hosts.agg(F.sum("g"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else 0.5
    above = F.lit(float(mean))
    units = hosts
    for i, level in enumerate(LEVELS):
        keys = LEVELS[: i + 1] if i else (level,)
        counted = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        if i:
            counted = counted.join(units, list(LEVELS[:i]))
            above = F.col("above")
        rate = F.col("g") / F.col("n")
        spread = counted.filter("n > 0").agg(F.sum(F.col("n") * (rate - above) * (rate - above)).alias("ss"), F.sum(above * (1 - above)).alias("vk"), F.sum(F.col("n") * above * (1 - above)).alias("vn")).first()
        room = (spread["vn"] or 0) - (spread["vk"] or 0)
        rho = min(0.5, max(0.001, ((spread["ss"] or 0) - (spread["vk"] or 0)) / room)) if room > 0 else 0.5
        k = 1 / rho - 1
        posterior = (F.col("g") + k * above) / (F.col("n") + k)
        if level == "host":
            units = counted.select("host", (posterior - z * F.sqrt(posterior * (1 - posterior) / (F.col("n") + k + 1))).alias("reputation"))
        else:
            units = counted.select(*keys, posterior.alias("above"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.join(units, "host", "left")
    own = F.when(F.col("reputation") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "reputation")
