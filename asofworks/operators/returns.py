"""Daily returns, betas, trends and volatilities as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof


def daily_returns(series: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, date, ret) on the union of all dates: gaps are padded first, so a gap is a row of zeros and then one jump.

    Each value fills the places of its gap itself, and the first one those
    before it (null): no symbol meets a date but its own. A symbol without any
    value has no rows.
    """
    dates = series.select("date").distinct().withColumn("_n", F.row_number().over(W.orderBy("date")))  # a row a date
    order = W.partitionBy("symbol").orderBy("_n")
    own = series.where(F.col(value).isNotNull()).select("symbol", "date", F.col(value).alias("_v")).join(dates, "date")
    own = own.join(F.broadcast(dates.agg(F.max("_n").alias("_end")))).withColumns({"_before": F.lag("_v").over(order), "_first": F.row_number().over(order) == 1, "_to": F.coalesce(F.lead("_n").over(order) - 1, F.col("_end"))})
    filled = own.select("symbol", "_v", "_before", F.col("_n").alias("_own"), F.explode(F.sequence(F.when(F.col("_first"), 1).otherwise(F.col("_n")), F.col("_to"))).alias("_n"))
    before = F.when(F.col("_n") == F.col("_own"), F.col("_before")).when(F.col("_n") > F.col("_own"), F.col("_v"))
    return filled.withColumn("ret", F.try_divide(F.col("_v"), before) - 1).join(dates, "_n").select("symbol", "date", "ret")


def rolling_beta(returns: DataFrame, market: str, window: int) -> DataFrame:
    """(symbol, date, beta) against the returns of symbol `market`; null until the window is full."""
    base = returns.where(F.col("symbol") == market).select("date", F.col("ret").alias("_m"))
    w = W.partitionBy("symbol").orderBy("date").rowsBetween(1 - window, 0)
    both = returns.join(base, "date", "left").withColumn("_y", F.when(F.col("_m").isNotNull(), F.col("ret"))).withColumn("_x", F.when(F.col("ret").isNotNull(), F.col("_m")))
    full = F.count(F.col("_y") + F.col("_x")).over(w) == window
    return both.select("symbol", "date", F.when(full, F.try_divide(F.covar_samp("_y", "_x").over(w), F.var_samp("_x").over(w))).alias("beta"))


def latest_beta(betas: DataFrame) -> DataFrame:
    return betas.where("beta IS NOT NULL").groupBy("symbol").agg(F.max_by("beta", "date").alias("beta"))


def betas_as_of(betas: DataFrame, calendar: DataFrame) -> DataFrame:
    """Point-in-time betas: the last one known at each date."""
    return asof(betas, calendar, "beta").select("symbol", "as_of", "beta")


def trend(series: DataFrame, calendar: DataFrame, rows: int = 200, value: str = "close") -> DataFrame:
    """(symbol, as_of, trend): 1 at or above the mean of the last `rows` values, -1 below, 0 with fewer."""
    w = W.partitionBy("symbol").orderBy("date").rowsBetween(1 - rows, 0)
    marked = series.where(F.col(value).isNotNull()).select("symbol", "date", F.when(F.count(value).over(w) < rows, 0).when(F.col(value) >= F.avg(value).over(w), 1).otherwise(-1).alias("trend"))
    return asof(marked, calendar, "trend").select("symbol", "as_of", "trend")


def realised_vol(returns: DataFrame, calendar: DataFrame, rows: int = 60, least: int = 6, default: float = 0.20, per_month: int = 21) -> DataFrame:
    """(symbol, as_of, vol): monthly volatility from the last `rows` daily returns; the default with fewer than `least`."""
    w = W.partitionBy("symbol").orderBy("date").rowsBetween(1 - rows, 0)
    daily = returns.where("ret IS NOT NULL").select("symbol", "date", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(per_month))).otherwise(default).alias("vol"))
    return asof(daily, calendar, "vol").select("symbol", "as_of", "vol")


def basket_vol(returns: DataFrame, sectors: DataFrame, calendar: DataFrame, rows: int = 91, least: int = 20) -> DataFrame:
    """(sector, as_of, vol): volatility of each sector's equal-weight daily return over its last `rows` days; null with fewer than `least`."""
    daily = returns.where("ret IS NOT NULL").join(sectors, "symbol").groupBy("sector", "date").agg(F.avg("ret").alias("ret"))
    w = W.partitionBy("sector").orderBy("date").rowsBetween(1 - rows, 0)
    vols = daily.select(F.col("sector").alias("symbol"), "date", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w)).alias("vol"))
    return asof(vols, calendar, "vol").select(F.col("symbol").alias("sector"), "as_of", "vol")


def basket_members(universe: DataFrame, oi: DataFrame, floor: float, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(sector, symbol, as_of) of symbols whose open interest as of the date reaches the floor."""
    return oi.where(F.col("oi") >= floor).join(universe, "symbol").where(~F.col("symbol").isin(*excluded) if excluded else F.lit(True)).select("sector", "symbol", "as_of")


def basket_returns(members: DataFrame, returns: DataFrame) -> DataFrame:
    """(sector, as_of, ret, n): the mean of the members' returns that are known."""
    return members.join(returns, ["symbol", "as_of"]).groupBy("sector", "as_of").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))


def relative_momentum(trailing: DataFrame, benchmark: str) -> DataFrame:
    """(symbol, as_of, days, rel): trailing return less the benchmark's."""
    base = trailing.where(F.col("symbol") == benchmark).select("as_of", "days", F.col("ret").alias("_b"))
    return trailing.join(base, ["as_of", "days"]).select("symbol", "as_of", "days", (F.col("ret") - F.col("_b")).alias("rel"))


def regime(trailing: DataFrame, benchmark: str, days: int = 91, up: float = 0.15, down: float = -0.10) -> DataFrame:
    """(as_of, regime) by the benchmark's trailing return."""
    own = trailing.where((F.col("symbol") == benchmark) & (F.col("days") == days))
    return own.select("as_of", F.when(F.col("ret") > up, "bull").when(F.col("ret") < down, "bear").otherwise("sideways").alias("regime"))


def universe(symbols: DataFrame, floor: float, excluded: tuple[str, ...] = (), always: tuple[str, ...] = ()) -> DataFrame:
    """Symbols with open interest (missing: 0) at the floor or above and not excluded, and those that always belong."""
    liquid = symbols.where((F.coalesce("oi", F.lit(0.0)) >= floor) & ~F.col("symbol").isin(*excluded or ("",))).select("symbol")
    return liquid.union(symbols.where(F.col("symbol").isin(*always or ("",))).select("symbol")).distinct()
