"""URL filter by rules and by the reputation of hosts, shrunk by empirical Bayes.

Outcomes of labelled pages are counted per host. A host's rate of bad pages has a
beta prior around the rate of its registered domain, a domain's one around the rate
of its suffix, and a suffix's one around the rate of all pages. How strongly each
level binds is fitted to the counts (moments of the beta-binomial), so a host with
few labelled pages is judged like its siblings and one with many by its own. A host
is blocked if the lower bound of its posterior lies above a limit.

Everything is DataFrame functions. Page rows are only counted map-side per host;
what is joined and shuffled for the priors is one row per host.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.shared import shared_folder, written

#: Pages that a level's prior counts for, at least and at most.
WEAKEST, STRONGEST = 0.5, 10_000.0
#: Standard deviations from the posterior's mean to its lower bound (one-sided 95 %).
DEVIATIONS = 1.645
#: Hosts whose rate of bad pages is above this, even by the lower bound, are blocked.
LIMIT = 0.5


class Rule(NamedTuple):
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


AUTHORITY = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _at_or_below(host: Column, name: str) -> Column:
    return (host == name) | F.endswith(host, F.lit(f".{name}"))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, blocks, rule) of the longest rule that fits, null if none does; of equal ones a blocking one."""
    fitting = [
        F.when(
            _at_or_below(host, r.host) & F.startswith(path, F.lit(r.path)),
            F.struct(
                F.lit(len(r.host) + len(r.path)).alias("length"),
                F.lit(r.verdict == "block").alias("blocks"),
                F.lit(r.host + r.path).alias("rule"),
            ),
        )
        for r in rules
    ]
    none = F.lit(None).cast("struct<length:int,blocks:boolean,rule:string>")
    return F.array_max(F.array(*fitting, none))


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The longest of ``suffixes`` that the host ends in, else its last label."""
    last = F.substring_index(host, ".", -1)
    longest_last = sorted(suffixes, key=len)
    return reduce(lambda rest, s: F.when(_at_or_below(host, s), F.lit(s)).otherwise(rest), longest_last, last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with the label before it; the host itself if it is a suffix."""
    before = F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    return F.when(host == suffix, host).otherwise(F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix))


def binding(n: Column, bad: Column, rate: Column) -> Column:
    """How many pages a level's prior counts for, from the spread of its members around their priors' rates.

    The squared deviations of binomial counts add up to about the number of pages;
    what is beyond that comes from members that differ.
    """
    spread = F.sum(F.try_divide((bad - n * rate) * (bad - n * rate), rate * (1 - rate))) - F.sum(F.when((rate > 0) & (rate < 1), n))
    overlap = F.try_divide(spread, F.sum(F.when((rate > 0) & (rate < 1), n * (n - 1))))
    strength = F.try_divide(F.lit(1.0), overlap) - 1
    return F.when(overlap > 0, F.least(F.greatest(strength, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))


def _strength(members: DataFrame) -> Column:
    """The level's strength as a scalar subquery over its labelled members (n, bad, prior)."""
    one = members.where("n > 0").agg(binding(F.col("n"), F.col("bad"), F.col("prior")).alias("strength"))
    return F.coalesce(one.scalar(), F.lit(STRONGEST))


def _posterior(members: DataFrame) -> DataFrame:
    """Adds ``strength`` and ``rate``, the posterior mean around ``prior``."""
    bound = members.withColumn("strength", _strength(members))
    rate = (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    return bound.withColumn("rate", rate)


def host_reputations(
    pages: DataFrame, outcomes: DataFrame, folder: str, suffixes: Sequence[str] = (), deviations: float = DEVIATIONS
) -> DataFrame:
    """host, domain, suffix, n, bad, rate, bound for every host of ``pages`` (page_id, host).

    ``outcomes`` (page_id, bad boolean) labels pages; a page labelled several times is
    bad if one of its labels says so, labels without a page, null ids and null labels
    count for nothing, a page_id on several rows counts for each. Without any labelled
    page every rate is 0. An empty host is a host of its own. The counts of hosts and the
    rates of domains are tables below ``folder``, as the priors read them several times.
    """
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("rows"))
    counted = rows.join(labelled, "page_id").groupBy("host").agg(
        F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("rows"))), F.lit(0)).alias("bad")
    )
    zero = F.lit(0).cast("bigint")
    hosts = pages.select("host").distinct().select("host", zero.alias("n"), zero.alias("bad"))
    hosts = hosts.unionByName(counted).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = written(hosts, f"{folder}/hosts")

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    by_suffix = domains.groupBy("suffix").agg(*sums)
    overall = by_suffix.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("rate")).scalar()

    top = _posterior(by_suffix.withColumn("prior", overall))
    middle = written(domains.join(top.select("suffix", F.col("rate").alias("prior")), "suffix"), f"{folder}/domains")
    middle = _posterior(middle)
    members = hosts.join(middle.select("domain", F.col("rate").alias("prior")), "domain")
    lowest = _posterior(written(members, f"{folder}/members"))
    rate, weight = F.col("rate"), F.col("n") + F.col("strength")
    bound = F.greatest(rate - deviations * F.sqrt(rate * (1 - rate) / (weight + 1)), F.lit(0.0))
    return lowest.select("host", "domain", "suffix", "n", "bad", "rate", bound.alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    suffixes: Sequence[str] = (),
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
    folder: str | None = None,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, bound.

    The longest rule that fits decides; without one the host's reputation does. A null
    url or one without ``://`` has an empty host and path, which no rule with a host
    fits. Rows stay as they are, also with null or repeated ids; other columns are
    ignored; an empty table gives no row. ``rules`` and ``suffixes`` are parameters of
    a bounded size that become part of the plan.
    """
    rows = pages.select(
        F.col("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path")
    )
    folder = folder or shared_folder(pages.sparkSession, "host-reputation")
    reputations = host_reputations(rows.select("page_id", "host"), outcomes, folder, suffixes, deviations)
    known = reputations.select(F.col("host").alias("_host"), "bound")
    judged = rows.join(known, F.col("host") == F.col("_host"), "left").withColumn(
        "_best", best_rule(F.col("host"), F.col("path"), rules)
    )
    blocked = F.coalesce(F.col("_best.blocks"), F.col("bound") > limit)
    verdict = F.when(blocked, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "bound")
