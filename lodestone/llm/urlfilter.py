"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Labelled pages give each host bad outcomes out of labelled ones. A host's bad rate is shrunk towards its registered
domain's, that towards its suffix's, that towards the rate of all: at each level the prior is a beta distribution whose
mean is the parent's posterior mean and whose strength is fitted by moments (Pearson's statistic of the level's counts
against the parents' means). A host is blocked when the lower bound of its posterior, ``z`` standard deviations below
the mean, is over ``threshold``. Listed rules come first.

Defined results: a null url or one without ``://`` has an empty host and path, and the empty host is a host like any
other; null labels are no labels; labels repeated for a page all count; empty tables give no rows, and without any label
the prior mean is 0.5, so nothing is blocked. The suffix is a host's last label, or the last two where these are one of
``SECOND`` under a country's two letters (co.uk); the registered domain has one label more. Other columns of the input are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which countries register domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Rules that one expression may hold.
MOST_RULES = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as a struct(rule, verdict); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _strength(level: DataFrame) -> float:
    """Strength of the beta prior of a level with columns n, k and the parents' mean m."""
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))
    got = level.where("n > 0 and m > 0 and m < 1").agg(
        F.sum(spread).alias("x"), F.count("*").alias("g"), F.sum(F.col("n") - 1).alias("d")
    ).first()
    if not got["d"]:
        return 100.0
    rho = min(0.5, max(1e-4, (got["x"] - got["g"]) / got["d"]))
    return 1 / rho - 1


def _shrunk(level: DataFrame, strength: float) -> Column:
    return (F.col("k") + strength * F.col("m")) / (F.col("n") + strength)


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645) -> DataFrame:
    """pages(page_id, host), labels(page_id, bad 0/1) -> host, n, k, mean, bound: a row for each host of pages."""
    outcome = pages.join(labels, "page_id", "left")
    hosts = written(
        outcome.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
        ),
        "hosts",
    )
    two = F.col("host").rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z]{{2}}$")
    last = [F.substring_index("host", ".", -n) for n in (1, 2, 3)]
    hosts = hosts.withColumn("suffix", F.when(two, last[1]).otherwise(last[0]))
    hosts = hosts.withColumn("domain", F.when(two, last[2]).otherwise(last[1]))
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    everything = hosts.agg(*add).first()
    mean = (everything["k"] + 1) / (everything["n"] + 2) if everything["n"] else 0.5
    suffixes = hosts.groupBy("suffix").agg(*add).withColumn("m", F.lit(mean))
    suffixes = suffixes.select("suffix", _shrunk(suffixes, _strength(suffixes)).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(*add).join(suffixes, "suffix")
    domains = domains.select("domain", _shrunk(domains, _strength(domains)).alias("m"))
    leaves = hosts.join(domains, "domain")
    s = _strength(leaves)
    mu, weight = _shrunk(leaves, s), F.col("n") + s
    return leaves.select(
        "host", "n", "k", mu.alias("mean"), (mu - z * F.sqrt(mu * (1 - mu) / (weight + 1))).alias("bound")
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    threshold: float = 0.5,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior bound; labels has page_id and bad (0/1)."""
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = host_reputation(split.select("page_id", "host"), labels, z).select("host", "bound")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return split.withColumn("__rule", rule).join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"),
        F.round("bound", 6).alias("posterior_bound"),
    )
