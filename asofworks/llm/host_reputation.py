"""URL filters: given rules first, else the reputation of the page's host.

A host's share of good pages is estimated from labelled outcomes of its pages
with a beta-binomial model in three steps: hosts are drawn around their
registered domain, domains around their suffix, suffixes around all outcomes.
How closely a level keeps to the one above it (the prior's weight, in pages) is
what makes that level's outcomes likeliest (empirical Bayes), so few outcomes
say little of a host and many decide. A group's prior leaves its own outcomes
out of the level above, so none counts twice. A host is blocked only if its
share of good pages lies below LEAST_SHARE with a posterior probability of
CERTAINTY: pages of hosts that little is known of stay.

Outcomes are counted once a host by partial aggregates; domains and suffixes
are sums of hosts. Pages meet their host's verdict in a broadcast below a
checked number of hosts, else in a salted join, as one host may hold a third of
all pages.

Defined results: a null URL and one without "://" have an empty host and path;
they are a host like any other. Of rules that fit the longest counts, of
equally long ones the one that blocks. User names and ports belong to the host
that rules are held against, but not to its name in the reputation. A host
without outcomes has its domain's prior, and without any outcome all priors are
even, so nothing is blocked. Repeated rows are pages each; an outcome of null is
none. A probability of exactly CERTAINTY blocks. An empty table gives an empty
result. Kept columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import looked_up, written

#: Below this share of good pages a host is bad; so sure must it be.
LEAST_SHARE = 1 / 3
CERTAINTY = 0.95
#: Weights of a prior, in pages.
WEIGHTS = tuple(2.0**k for k in range(-2, 15))
# Names that stand between a registered domain and a country's code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")

#: (host, path, verdict) as the rules of the query name them.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    found = []
    for name, start, verdict in rules:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        own = F.struct(F.lit(len(name + start)).alias("n"), F.lit(verdict == "block").alias("block"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found.append(F.when(fits, own))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<n: int, block: boolean, rule: string, verdict: string>")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Of a host's name: the registered domain and what follows its first part; a number address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    long = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    number = name.rlike(r"^[\d.]+$|\[")
    return F.when(number, name).when(long, last(3)).otherwise(last(2)), F.when(number, F.lit("")).when(long, last(2)).otherwise(last(1))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after steps up to 8 and more."""
    x, shift = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x[small] += 1
    y = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(share <= x) of Beta(a, b), by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turn = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side of the mean
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta(p, q)) / p
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / fix(1 - (p + q) * z / (p + 1))
    h = d.copy()
    m = 0
    while m < 100_000:
        m += 1
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / fix(1 + even * d), fix(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / fix(1 + odd * d), fix(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.clip(np.where(turn, 1 - front * h, front * h), 0, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def likelihoods(good: pd.Series, n: pd.Series, mean: pd.Series) -> pd.Series:
    """The logarithm of each weight's beta-binomial likelihood (but for the binomial factor, which no weight changes)."""
    w = np.array(WEIGHTS)[None]
    k, n, m = (np.asarray(v, float)[:, None] for v in (good, n, mean))
    return pd.Series(list(log_beta(w * m + k, w * (1 - m) + n - k) - log_beta(w * m, w * (1 - m))))


@F.pandas_udf(DoubleType())
def below(a: pd.Series, b: pd.Series) -> pd.Series:
    """The probability that a share is below LEAST_SHARE."""
    return pd.Series(beta_cdf(LEAST_SHARE, a.to_numpy(), b.to_numpy()))


def weight_of(level: DataFrame) -> float:
    """The prior's weight that makes a level's outcomes (good, n, mean) likeliest; of equals the smallest."""
    sums = level.where("n > 0").select(likelihoods("good", "n", "mean").alias("x")).agg(*[F.sum(F.col("x")[i]).alias(f"w{i}") for i in range(len(WEIGHTS))]).first()
    return WEIGHTS[max(range(len(WEIGHTS)), key=lambda i: (round(sums[i] or 0.0, 9), -i))]


def shrunk(level: DataFrame, key: str, above: DataFrame | None, above_key: str | None, base: tuple[float, float]) -> tuple[DataFrame, float]:
    """level (key, above's key, good, n) with mean, that of its prior, and the prior's weight.

    above: the level over it with its own mean and weight; the mean of a group's prior is
    that level's posterior mean without the group's own outcomes. base: good and n of all, for the top level.
    """
    if above is None:
        good, n = base
        out = level.withColumn("mean", (F.lit(good) - F.col("good") + 1.0) / (F.lit(n) - F.col("n") + 2.0))
    else:
        own = above.select(above_key, F.col("good").alias("_g"), F.col("n").alias("_n"), (F.col("mean") * F.col("weight")).alias("_a"), F.col("weight").alias("_w"))
        out = looked_up(level, own, above_key).withColumn("mean", (F.col("_g") - F.col("good") + F.col("_a")) / (F.col("_n") - F.col("n") + F.col("_w"))).drop("_g", "_n", "_a", "_w")
    out = written(out)
    weight = weight_of(out)
    return out.withColumn("weight", F.lit(weight)), weight


def fit(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, share, p_bad, verdict) of all hosts of outcomes (host, good: true, false or null where a page has none)."""
    hosts = outcomes.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.count_if(F.col("good")).cast("double").alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = written(domains.groupBy("suffix").agg(*sums))
    base = suffixes.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    suffixes, _ = shrunk(suffixes, "suffix", None, None, tuple(base))
    domains, _ = shrunk(domains, "domain", suffixes, "suffix", tuple(base))
    hosts, _ = shrunk(hosts, "host", domains.drop("suffix"), "domain", tuple(base))
    a, b = F.col("mean") * F.col("weight") + F.col("good"), (1 - F.col("mean")) * F.col("weight") + F.col("n") - F.col("good")
    told = hosts.select("host", F.col("n").cast("long").alias("n"), F.col("good").cast("long").alias("good"), (a / (a + b)).alias("share"), below(a, b).alias("p_bad"))
    return told.withColumn("verdict", F.when(F.col("p_bad") >= CERTAINTY, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, outcome: Column | None = None, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of pages), host, path, rule, verdict, share and p_bad of its host.

    outcome: true for a good page, false for a bad one, null for one without a
    label; default: what the rules say of the pages that one fits.
    """
    results = ("host", "path", "rule", "verdict", "share", "p_bad")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in results]
    url = F.col(f"`{url_col}`")
    told = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(url).alias("host"), path_of(url).alias("path"), (outcome if outcome is not None else F.lit(None).cast("boolean")).alias("_outcome"))
    told = told.withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    good = F.col("_outcome") if outcome is not None else F.col("_r.verdict") == "allow"
    hosts = written(fit(told.select("host", good.alias("good"))).select("host", "share", "p_bad", F.col("verdict").alias("_own")))
    both = looked_up(told.drop("_outcome"), hosts, "host")
    return both.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_own").alias("verdict"), "share", "p_bad")
