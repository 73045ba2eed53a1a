"""Rank information coefficients and their significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import saved


# Coefficients of a rational Chebyshev fit of erfc, good to 1.2e-7 of its value (Numerical Recipes, erfcc).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(t) -> Column:
    """P(|Z| >= |t|) of the normal distribution; null for no number."""
    z = F.abs(t) / math.sqrt(2)
    u = 1 / (1 + 0.5 * z)
    sum_ = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        sum_ = c + u * sum_
    return F.when(~F.isnan(t), u * F.exp(-z * z + sum_))


def average_rank(value: str, by: tuple[str, ...]):
    """Ranks from 1; equal values share their mean rank."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def pooled_ranks(values: DataFrame, pieces: int = 64) -> DataFrame:
    """(v, rank) of distinct values (v, n): mean ranks over all of them, found in ranges of values side by side."""
    borders = F.broadcast(values.agg(F.array_distinct(F.percentile_approx("v", [k / pieces for k in range(1, pieces)], 10_000)).alias("_borders")))  # one row
    dealt = values.crossJoin(borders).select("v", "n", F.size(F.filter("_borders", lambda x: x < F.col("v"))).alias("_piece"))
    sums = dealt.groupBy("_piece").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    own = F.coalesce(F.sum("n").over(W.partitionBy("_piece").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(sums.select("_piece", "_before")), "_piece").select("v", (F.col("_before") + F.col("_own") + (F.col("n") + 1) / 2).alias("rank"))


def pooled_ic(df: DataFrame, signal: str, outcome: str, least: int = 5, distinct: int = 2) -> DataFrame:
    """n and ic over all rows: pairs of values are counted first, so equal values are one row, and no task sorts the table."""
    own = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(signal).cast("double").alias("_s"), F.col(outcome).cast("double").alias("_o")).agg(F.count("*").alias("_n"))
    own = saved(own)  # read four times
    side = lambda c, out: pooled_ranks(own.groupBy(F.col(c).alias("v")).agg(F.sum("_n").alias("n"))).select(F.col("v").alias(c), F.col("rank").alias(out))
    both = own.join(side("_s", "_a"), "_s").join(side("_o", "_b"), "_o")
    n, mean = F.sum("_n"), lambda x: F.sum(F.col("_n") * x) / F.sum("_n")
    a, b = F.col("_a"), F.col("_b")
    found = both.agg(n.alias("n"), F.countDistinct("_s").alias("_k"), (mean(a * b) - mean(a) * mean(b)).alias("_ab"), (mean(a * a) - mean(a) * mean(a)).alias("_aa"), (mean(b * b) - mean(b) * mean(b)).alias("_bb"))
    ic = F.when((F.col("n") >= least) & (F.col("_k") >= distinct), F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))))
    return found.select(F.coalesce("n", F.lit(0)).alias("n"), ic.alias("ic"))


def rank_ic(df: DataFrame, signal: str, outcome: str, by: tuple[str, ...] = (), least: int = 5, distinct: int = 2) -> DataFrame:
    """by, n and ic (Spearman's correlation); null with fewer than `least` rows or `distinct` signal values, or where all outcomes are equal."""
    if not by:
        return pooled_ic(df, signal, outcome, least, distinct)
    own = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull())
    ranked = own.select(*by, F.col(signal).alias("_s"), average_rank(signal, by).alias("_a"), average_rank(outcome, by).alias("_b"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & (F.countDistinct("_s") >= distinct), F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("ic"))


def period_ic(df: DataFrame, signal: str, outcome: str) -> DataFrame:
    return rank_ic(df, signal, outcome, ("as_of",), least=4).where("ic IS NOT NULL")


def ic_summary(ics: DataFrame) -> DataFrame:
    """mean, deviation, t and share of positive periods."""
    return ics.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_pos")).withColumn("t", F.try_divide(F.col("mean_ic"), F.try_divide(F.col("sd_ic"), F.sqrt("n"))))


def ic_ttest(ics: DataFrame) -> DataFrame:
    return ic_summary(ics).withColumn("p", two_sided_p(F.col("t")))


def residual(df: DataFrame, y: str, x: str, out: str = "resid") -> DataFrame:
    """y less its regression on x in each period; y less its mean where x does not vary."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("as_of").agg(F.regr_slope(y, x).alias("_k"), F.avg(y).alias("_y"), F.avg(x).alias("_x"))
    return df.join(fit, "as_of").withColumn(out, F.col(y) - F.col("_y") - F.coalesce("_k", F.lit(0.0)) * (F.col(x) - F.col("_x"))).drop("_k", "_y", "_x")


def orthogonal_ic(df: DataFrame, signal: str, control: str, outcome: str) -> DataFrame:
    own = residual(df.where(F.col(control).isNotNull()), signal, control)
    return period_ic(own.withColumn("resid", F.round("resid", 9)), "resid", outcome)
