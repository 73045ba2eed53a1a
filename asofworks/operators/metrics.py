"""Performance figures of return series (as_of, ret), and what they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drawdowns(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, as_of, cum (growth of 1) and drawdown from its running maximum, which starts at the first value, not at 1."""
    w = W.partitionBy(*by).orderBy("as_of").rowsBetween(W.unboundedPreceding, 0)
    grown = returns.where("ret IS NOT NULL").withColumn("cum", F.product(1 + F.col("ret")).over(w))
    return grown.withColumn("drawdown", F.col("cum") / F.max("cum").over(w) - 1)


def metrics(returns: DataFrame, per_year: float = 4.0, by: tuple[str, ...] = ()) -> DataFrame:
    """total, ann, sharpe (null for a flat series), max_dd and n."""
    own = drawdowns(returns, by)
    total = F.max_by("cum", "as_of")
    spread = F.stddev_samp("ret")
    return own.groupBy(*by).agg((total - 1).alias("total"), (F.pow(total, per_year / F.count("*")) - 1).alias("ann"), F.when(spread > 0, F.avg("ret") / spread * F.sqrt(F.lit(per_year))).alias("sharpe"), F.min("drawdown").alias("max_dd"), F.count("*").alias("n"))


def jensen(strategy: DataFrame, benchmark: DataFrame, per_year: float = 12.0) -> DataFrame:
    """alpha (a year), beta, t of alpha (n - 2 degrees of freedom) and n, from the dates that both have."""
    both = strategy.select("as_of", F.col("ret").alias("_y")).join(benchmark.select("as_of", F.col("ret").alias("_x")), "as_of").where("_x IS NOT NULL AND _y IS NOT NULL")
    s = both.agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("a"))
    variance = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))) / F.when(F.col("n") > 2, F.col("n") - 2)
    error = F.sqrt(variance * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    return s.select((F.col("a") * per_year).alias("alpha"), "beta", F.try_divide(F.col("a"), error).alias("t_alpha"), "n")


def jackknife_sharpe(returns: DataFrame, per_year: float = 12.0) -> DataFrame:
    """(as_of, sharpe) with that period left out, from sums alone."""
    t = returns.agg(F.count("ret").alias("_n"), F.sum("ret").alias("_s"), F.sum(F.col("ret") * F.col("ret")).alias("_q"))
    n, s, q = F.col("_n") - 1, F.col("_s") - F.col("ret"), F.col("_q") - F.col("ret") * F.col("ret")
    variance = F.try_divide(q - F.try_divide(s * s, n), n - 1)
    return returns.crossJoin(F.broadcast(t)).select("as_of", F.when(variance > 1e-15, s / n / F.sqrt(variance) * F.sqrt(F.lit(per_year))).alias("sharpe"))


def by_regime(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    """Mean, number and share of gains of the periods of each regime."""
    return returns.join(regimes, "as_of").groupBy("regime").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def extremes(returns: DataFrame, k: int = 5) -> DataFrame:
    """The k best and k worst periods."""
    best = returns.orderBy(F.col("ret").desc(), "as_of").limit(k).select("as_of", "ret", F.lit("best").alias("side"))
    return best.unionByName(returns.orderBy(F.col("ret").asc(), "as_of").limit(k).select("as_of", "ret", F.lit("worst").alias("side")))


def attribution(book: DataFrame, returns: DataFrame) -> DataFrame:
    """Per symbol: gain, months held, share of all gain and whether it is one of the three largest."""
    own = book.join(returns.select("as_of", "symbol", "ret"), ["as_of", "symbol"]).where("ret IS NOT NULL").groupBy("symbol").agg(F.sum(F.col("w") * F.col("ret")).alias("pnl"), F.count("*").alias("months"))
    total = own.agg(F.sum("pnl").alias("_t"))
    top = own.orderBy(F.round("pnl", 9).desc(), "symbol").limit(3).select("symbol", F.lit(True).alias("_top"))  # three rows
    ranked = own.crossJoin(F.broadcast(total)).join(F.broadcast(top), "symbol", "left")
    return ranked.select("symbol", "pnl", "months", F.try_divide(F.col("pnl"), F.col("_t")).alias("share"), F.coalesce("_top", F.lit(False)).alias("top3"))


def sector_ranks(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(as_of, sector, ret, rank, n, norm_rank, beats): the rank of each sector's return, 1 the best."""
    w = W.partitionBy("as_of")
    ranked = returns.where("ret IS NOT NULL").withColumn("rank", F.row_number().over(w.orderBy(F.round("ret", 9).desc(), "sector"))).withColumn("n", F.count("*").over(w))
    joined = ranked.join(benchmark.select("as_of", F.col("ret").alias("_b")), "as_of", "left")
    return joined.select("as_of", "sector", "ret", "rank", "n", F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).alias("norm_rank"), (F.col("ret") > F.col("_b")).alias("beats"))


def pick_skill(ranks: DataFrame, picks: DataFrame) -> DataFrame:
    """Of picks (as_of, sector): mean normalised rank and share in the best third."""
    own = ranks.join(picks.select("as_of", "sector").distinct(), ["as_of", "sector"], "left_semi")
    return own.agg(F.count("*").alias("n"), F.avg("norm_rank").alias("mean_norm_rank"), F.avg((F.col("norm_rank") <= 1 / 3).cast("double")).alias("top_third"))


def heat_map(returns: DataFrame, sectors: list[str]) -> DataFrame:
    """as_of, a column a sector, and the share of a date's sectors above its mean."""
    wide = returns.groupBy("as_of").pivot("sector", sectors).agg(F.first("ret"))
    marked = returns.withColumn("_m", F.avg("ret").over(W.partitionBy("as_of"))).groupBy("as_of").agg(F.avg((F.col("ret") > F.col("_m")).cast("double")).alias("above_mean"))
    return wide.join(marked, "as_of")
