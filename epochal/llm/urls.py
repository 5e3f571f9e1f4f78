"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are counted by host. Beta-binomial priors shrink a suffix to the
whole, a registered domain to its suffix and a host to its domain; how strongly is found
from the spread at each level. A host is blocked if the lower bound of its posterior share
of bad pages, a quantile of the beta distribution, is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import beta_quantile, np_beta_quantile
from .common import LOWER, UPPER, keep

#: Suffixes of two labels under which names are registered; a fuller list can be given to judge().
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no ://."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url")))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule, else nulls; rules: (verdict, host/path)."""
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _levels(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> dict[str, Column]:
    """Host without user, port and closing dots, its registered domain and suffix. An address, of four numbers or in brackets, is
    its own domain and suffix: it shares no level with another but the whole."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    address = bare.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(address, bare).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(address, bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)
    return {"_bare": bare, "_domain": domain, "_suffix": suffix}


def _strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-counts of the prior, by the spread of bad pages around mean beyond the binomial one."""
    p = F.col(mean)
    got = groups.agg(F.sum((F.col("bad") - F.col("n") * p) ** 2 - F.col("n") * p * (1 - p)).alias("more"), F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("most")).first()
    rho = min(0.99, max(1e-3, got.more / got.most)) if got.most else 0.1
    return 1 / rho - 1


def reputations(outcomes: DataFrame, level: float = 0.05, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """outcomes: host, bad (0 or 1; null is no outcome). Tables of hosts (_bare, n, bad, rate, bound), domains and
    suffixes (with the mean that a host without outcomes takes, and its bound), the whole's rate, and the bound of
    a host without outcomes in the whole.
    """
    hosts = keep(outcomes.where("bad is not null").select(*[c.alias(k) for k, c in _levels(F.col("host"), two_label).items()], "bad").groupBy("_suffix", "_domain", "_bare").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    root = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("p")).first().p
    root = 0.5 if root is None else root
    add = lambda df, keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    shrunk = lambda mean, m: (F.col("bad") + m * F.col(mean)) / (F.col("n") + m)
    suffixes = add(hosts, ["_suffix"]).withColumn("_root", F.lit(root))
    at_suffix = _strength(suffixes, "_root")
    suffixes = suffixes.select("_suffix", shrunk("_root", at_suffix).alias("_suffix_rate"))
    domains = add(hosts, ["_suffix", "_domain"]).join(suffixes, "_suffix")
    at_domain = _strength(domains, "_suffix_rate")
    domains = domains.select("_domain", shrunk("_suffix_rate", at_domain).alias("_domain_rate"))
    hosts = hosts.join(domains, "_domain")
    m = _strength(hosts, "_domain_rate")
    hosts = hosts.withColumn("bad_rate", shrunk("_domain_rate", m)).withColumn("_n", F.col("n") + m)
    bound = lambda rate, n: beta_quantile(F.lit(level), rate * n, (1 - rate) * n)
    # a host without outcomes spreads around a known level as all levels below it do together
    below_suffix = _together(m, at_domain)
    none = _together(below_suffix, at_suffix)
    domains = domains.withColumn("_domain_bound", bound(F.col("_domain_rate"), F.lit(m)))
    suffixes = suffixes.withColumn("_suffix_bound", bound(F.col("_suffix_rate"), F.lit(below_suffix)))
    hosts = hosts.select("_bare", F.col("n").alias("n_labelled"), "bad_rate", bound(F.col("bad_rate"), F.col("_n")).alias("bad_bound"))
    return hosts, domains, suffixes, (root, float(np_beta_quantile(level, root * none, (1 - root) * none)))


def _together(a: float, b: float) -> float:
    """The strength of a prior whose mean has a prior of its own."""
    return 1 / (1 - (a / (a + 1)) * (b / (b + 1))) - 1


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, level: float = 0.05, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, bad (0 or 1). One row for each row of pages:
    page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_bound.

    A rule's verdict holds where one fits; else a host is blocked if bad_bound, which its share of bad pages exceeds with a
    probability of 1 - level, is above limit.
    Hosts without outcomes take rate and bound from their domain, else their suffix, else the whole. Null urls and urls without
    :// have an empty host and path. A page with several outcomes counts once, as bad if any is;
    outcomes of unknown pages don't count. Empty tables give empty results.
    """
    host, path = host_and_path(F.col("_url"))
    pages = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts, domains, suffixes, (root, none) = reputations(pages.join(known, "page_id").select("host", "bad"), level, two_label)
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    of = _levels(F.col("host"), two_label)
    pages = pages.withColumns({"rule": name, "_says": says, "_bare": of["_bare"]})
    every = pages.select(*[c.alias(k) for k, c in of.items()]).distinct().join(hosts, "_bare", "left").join(domains, "_domain", "left").join(suffixes, "_suffix", "left")
    rate, bound = F.coalesce("bad_rate", "_domain_rate", "_suffix_rate", F.lit(root)), F.coalesce("bad_bound", "_domain_bound", "_suffix_bound", F.lit(none))
    every = every.select("_bare", F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), rate.alias("bad_rate"), bound.alias("bad_bound"))
    verdict = F.coalesce("_says", F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return pages.join(every, "_bare").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_labelled", "bad_rate", "bad_bound")
