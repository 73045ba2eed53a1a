"""Realised returns of books, benchmarks, and the walk-forward over all dates as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import portfolio as P
from .asof import asof, forward_returns
from .calendar import with_next


def period_funding(funding: DataFrame, pairs: DataFrame) -> DataFrame:
    """(symbol, as_of, funding): the sum of rates (percent) over (as_of, next_as_of], as a fraction, of symbols with a rate in that span.

    Spans are differences of running sums, looked up as of both their ends, so
    dates and timestamps of any density cost no more. Sums are exact decimals of
    12 places. Rates of one symbol and date count together.
    """
    daily = funding.where("rate IS NOT NULL").groupBy("symbol", "date").agg(F.sum(F.col("rate").cast("decimal(28,12)")).alias("rate"))
    sums = daily.select("symbol", "date", F.sum("rate").over(W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)).cast("decimal(38,12)").alias("total"))
    spans = pairs.where("next_as_of > as_of").select("as_of", "next_as_of").distinct()
    ends = spans.select(F.col("as_of")).union(spans.select("next_as_of")).distinct()
    known = asof(sums, ends, "total")
    then = known.select("symbol", F.col("as_of").alias("next_as_of"), F.col("total").alias("_to"), F.col("total_date").alias("_last")).join(spans, "next_as_of")
    both = then.where(F.col("_last") > F.col("as_of")).join(known.select("symbol", "as_of", F.col("total").alias("_from")), ["symbol", "as_of"], "left")
    return both.select("symbol", "as_of", ((F.col("_to") - F.coalesce("_from", F.lit(0))).cast("double") / 100.0).alias("funding"))


def realize(book: DataFrame, returns: DataFrame, funding: DataFrame | None = None, cost_bps: float = 10.0) -> DataFrame:
    """(as_of, ret): sum of w * (r - sign(w) * f), less costs on the gross book; a missing return counts nothing but its cost."""
    own = book.join(returns.select("as_of", "symbol", "ret"), ["as_of", "symbol"], "left")
    own = own.join(funding, ["as_of", "symbol"], "left") if funding is not None else own.withColumn("funding", F.lit(0.0))
    gain = F.col("w") * (F.col("ret") - F.signum("w") * F.coalesce("funding", F.lit(0.0)))
    return own.groupBy("as_of").agg((F.coalesce(F.sum(gain), F.lit(0.0)) - cost_bps / 1e4 * F.sum(F.abs("w"))).alias("ret"))


STRATEGIES = ("sector_ls", "long_only", "token_ls", "intra_sector", "token_vs_sector", "both")


def targets(strategy: str, live: DataFrame, baskets: DataFrame, **options) -> DataFrame:
    make = getattr(P, strategy if strategy in STRATEGIES else "sector_ls")
    return make(live, **options) if strategy == "token_ls" else make(live, baskets, **options)


def walk_forward(live: DataFrame, dates: DataFrame, prices: DataFrame, baskets: DataFrame, hedge: str, strategy: str = "sector_ls", hedge_mode: str = "none", betas: DataFrame | None = None, funding: DataFrame | None = None, trends: DataFrame | None = None, risk: DataFrame | None = None, cost_bps: float = 10.0, **options) -> DataFrame:
    """(as_of, ret) of the strategy at every date with live rows and a next date; an empty book returns 0.

    hedge_mode: none; neutral (net beta 0); council (0 where risk says hedge);
    quant, consensus, combined (half a beta by trend, stance or both).
    """
    pairs = with_next(dates).where("next_as_of IS NOT NULL")
    book = targets(strategy, live, baskets, **options)
    if betas is not None and hedge_mode == "neutral":
        book = P.hedge_to(book, betas, hedge)
    elif betas is not None and hedge_mode == "council":
        book = P.neutralise_when(book, betas, hedge, risk.withColumnRenamed("stance", "decision"))
    elif betas is not None and hedge_mode in ("quant", "consensus", "combined"):
        book = P.hedge_to(book, betas, hedge, P.target_beta(trends, risk, hedge_mode))
    realized = realize(book, forward_returns(prices, pairs), funding, cost_bps)
    periods = live.select("as_of").distinct().join(pairs.select("as_of"), "as_of")
    return periods.join(realized, "as_of", "left").select("as_of", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def benchmark(returns: DataFrame, symbol: str | None = None) -> DataFrame:
    """(as_of, ret): one symbol's returns with missing ones as 0, or the mean over all symbols."""
    if symbol is None:
        return returns.groupBy("as_of").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    dates = returns.select("as_of").distinct()
    own = returns.where(F.col("symbol") == symbol).select("as_of", "ret")
    return dates.join(own, "as_of", "left").select("as_of", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def gated_rotation(convictions: DataFrame, baskets: DataFrame, returns_1m: DataFrame, returns_3m: DataFrame, hedge: str, dates: DataFrame, k: int = 3, gate: float = 0.0, bear: float = -0.10, betas: DataFrame | None = None) -> DataFrame:
    """The book of the gated rotation: the k bullish sectors of most conviction whose baskets beat the hedge symbol over one and three months.

    Dates without such sectors hold the hedge symbol; where that fell by more
    than `bear` over three months the book's beta is hedged away.
    returns_1m, returns_3m: (symbol, as_of, ret), the hedge symbol's included.
    """

    def relative(trailing: DataFrame, out: str) -> DataFrame:
        mean = baskets.join(trailing, ["symbol", "as_of"]).groupBy("sector", "as_of").agg(F.avg("ret").alias("_m"))
        base = trailing.where(F.col("symbol") == hedge).select("as_of", F.col("ret").alias("_h"))
        return mean.join(base, "as_of").select("sector", "as_of", (F.col("_m") - F.col("_h")).alias(out))

    fit = convictions.join(relative(returns_1m, "r1"), ["sector", "as_of"]).join(relative(returns_3m, "r3"), ["sector", "as_of"]).where((F.col("r1") >= gate) & (F.col("r3") >= gate))
    chosen = P.equal_baskets(P.top_sectors(fit, k), baskets)
    # a date without a sector has one row, the hedge symbol's own
    whole = dates.select("as_of").distinct().join(chosen, "as_of", "left").select("as_of", F.coalesce("symbol", F.lit(hedge)).alias("symbol"), F.coalesce("w", F.lit(1.0)).alias("w"), F.col("w").isNotNull().alias("_chosen"))
    if betas is None:
        return whole.drop("_chosen")
    falling = returns_3m.where((F.col("symbol") == hedge) & (F.col("ret") < bear)).select("as_of", F.lit("hedge").alias("decision"))
    return P.neutralise_when(whole, betas, hedge, falling, "_chosen")


def choose_by_past(returns: DataFrame, objective: str = "total", least: int = 12, per_year: int = 12) -> DataFrame:
    """(as_of, combo, ret): at each date after `least` others, the combination that did best before it (anchored walk-forward)."""
    past = W.partitionBy("combo").orderBy("as_of").rowsBetween(W.unboundedPreceding, -1)
    if objective == "total":
        score = F.sum(F.log1p("ret")).over(past)
    else:
        score = F.when(F.stddev_samp("ret").over(past) > 0, F.avg("ret").over(past) / F.stddev_samp("ret").over(past) * F.sqrt(F.lit(per_year))).otherwise(-9.0)
    scored = returns.withColumn("_s", F.round(score, 9)).withColumn("_n", F.count("*").over(past)).where(F.col("_n") >= least)
    best = F.row_number().over(W.partitionBy("as_of").orderBy(F.col("_s").desc_nulls_last(), "combo"))
    return scored.withColumn("_k", best).where("_k = 1").select("as_of", "combo", "ret")


def splice(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two return series as one; where both have a date the first's return counts."""
    tagged = first.select("as_of", "ret", F.lit(0).alias("_k")).unionByName(second.select("as_of", "ret", F.lit(1).alias("_k")))
    return tagged.groupBy("as_of").agg(F.min_by("ret", "_k").alias("ret"))


def open_interest(series: DataFrame, calendar: DataFrame) -> DataFrame:
    return asof(series, calendar, "oi").select("symbol", "as_of", "oi")
