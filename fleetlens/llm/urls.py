"""URL filters: listed rules first, then the reputation of the host, shrunk to its domain and suffix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        own = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return own & F.col("path").startswith(self.path)


RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]
# Common suffixes of two labels, under which domains are registered.
LONG_SUFFIXES = """ac.uk co.uk gov.uk net.uk org.uk com.au net.au org.au co.nz co.za co.jp ne.jp or.jp co.kr co.in com.br com.mx
com.ar com.cn com.hk com.sg com.tr com.tw""".split()
#: Levels from the widest to the host, each shrunk to the one before.
LEVELS = ["everything", "suffix", "domain", "host"]
#: A host is blocked when its share of good pages is below MIN_GOOD with this many standard deviations to spare.
MIN_GOOD = 0.5
DEVIATIONS = 1.645
#: Bounds of the correlation within a group, so that a prior counts as at least 1 and at most 999 pages.
RHO_LOW, RHO_HIGH = 0.001, 0.5


def url_parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = kept_text(url)
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), UPPER, LOWER)
    return {"host": host, "path": F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)}


def _levels() -> dict[str, Column]:
    """User and port are no part of a name; a suffix may have two labels, the registered domain has one more."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    long = F.substring_index(name, ".", -2).isin(LONG_SUFFIXES)
    return {
        "everything": F.lit(""),
        "suffix": F.when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)),
        "domain": F.when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)),
    }


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior of the share of good pages of each host: mean and upper bound.

    ``outcomes`` has host and good (boolean) for each labelled page. Each level's groups get a beta prior around
    the posterior mean of the group above. The weight of the prior follows from how much the groups of the
    level differ beyond chance (moments of the beta-binomial). Every step works on one row per group.
    """
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    counts = counts.withColumns(_levels())
    keys: list[str] = []
    above = None
    for level in LEVELS:
        keys = [*keys, level]
        groups = counts.groupBy(keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            above = groups.select(*keys, ((F.col("k") + 1) / (F.col("n") + 2)).alias("mean"))
            continue
        groups = groups.join(above.withColumnRenamed("mean", "prior"), keys[:-1])
        n, k, p = F.col("n"), F.col("k"), F.col("prior")
        # without a group of two pages nothing tells how groups differ
        beyond = F.try_divide(F.sum((k - n * p) * (k - n * p) / (p * (1 - p)) - n), F.sum(n * (n - 1)))
        rho = F.greatest(F.lit(RHO_LOW), F.least(F.lit(RHO_HIGH), F.coalesce(beyond, F.lit(RHO_HIGH))))
        weight = groups.agg((1 / rho - 1).alias("weight"))
        a, size = p * F.col("weight") + k, F.col("weight") + n
        above = groups.crossJoin(F.broadcast(weight)).select(*keys, (a / size).alias("mean"), size.alias("weight"))
        if level != LEVELS[-1]:
            above = above.drop("weight")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return above.select("host", "mean", (F.col("mean") + DEVIATIONS * spread).alias("upper"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict and the posterior mean of the host.

    ``outcomes`` has url and good (boolean) of the labelled pages; rows with a null in good are left out. The
    longest fitting rule decides. Without one a page is blocked if the upper bound of its host's share of good
    pages is below ``MIN_GOOD``; a host without labelled pages is allowed. A null url, or one without ``://``, has
    host and path empty and is judged as a host of that name. Ids may be null or repeated. Other columns of
    ``pages`` are not read.
    """
    addressed = pages.select(F.col(f"`{id_col}`").alias("__id"), *(c.alias(n) for n, c in url_parts(F.col(f"`{url}`")).items()))
    known = reputations(outcomes.where("good is not null").select(url_parts(F.col("url"))["host"].alias("host"), "good"))
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def first_fit(value: str) -> Column:
        return reduce(lambda c, r: c.when(r.fits(), F.lit(getattr(r, value))), longest[1:], F.when(longest[0].fits(), F.lit(getattr(longest[0], value))))

    by_host = F.when(F.col("upper") < MIN_GOOD, "block").otherwise("allow")
    return addressed.join(known, "host", "left").select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        first_fit("name").alias("rule"),
        F.coalesce(first_fit("verdict"), by_host).alias("verdict"),
        "mean",
    )
