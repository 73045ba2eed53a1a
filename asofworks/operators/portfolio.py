"""Target books from live panel rows, for all dates at once.

live: (as_of, item, item_type, parent_sector, stance_sign, conviction);
baskets: (sector, symbol, as_of). A book is (as_of, symbol, w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights that differ by less than this are ties, which go by symbol.
DIGITS = 9


def merge(raw: DataFrame) -> DataFrame:
    return raw.groupBy("as_of", "symbol").agg(F.sum("w").alias("w"))


def finalize(raw: DataFrame, gross: float = 1.0, cap: int | None = None) -> DataFrame:
    """Weights of a symbol added up, the `cap` largest of a date kept, and their absolute sum scaled to gross; empty where it is 0."""
    book = merge(raw)
    if cap:
        rank = F.row_number().over(W.partitionBy("as_of").orderBy(F.round(F.abs("w"), DIGITS).desc(), "symbol"))
        book = book.withColumn("_n", rank).where(F.col("_n") <= cap).drop("_n")
    total = F.sum(F.abs("w")).over(W.partitionBy("as_of"))
    return book.select("as_of", "symbol", (F.try_divide(F.col("w"), total) * gross).alias("w")).where("w IS NOT NULL")


def size(conviction_weighted: bool) -> Column:
    return F.col("conviction") / 100.0 if conviction_weighted else F.lit(1.0)


def with_basket(live: DataFrame, baskets: DataFrame, sector: Column) -> DataFrame:
    """Live rows, a row for each member of their sector's basket, with the basket's size."""
    sized = baskets.withColumn("_members", F.count("*").over(W.partitionBy("sector", "as_of")))
    return live.withColumn("sector", sector).join(sized, ["sector", "as_of"])


def sector_ls(live: DataFrame, baskets: DataFrame, fade: bool = False, conviction_weighted: bool = True, cap: int | None = None) -> DataFrame:
    """Long bullish sectors' baskets and short bearish ones (fade: the reverse), by conviction."""
    own = with_basket(live.where("item_type = 'sector' AND stance_sign <> 0"), baskets, F.col("item"))
    sign = F.col("stance_sign") * (-1 if fade else 1)
    return finalize(own.select("as_of", "symbol", (sign * size(conviction_weighted) / F.col("_members")).alias("w")), cap=cap)


def long_only(live: DataFrame, baskets: DataFrame, fade: bool = False, conviction_weighted: bool = True, cap: int | None = None) -> DataFrame:
    """Only the favoured side, held long."""
    own = with_basket(live.where(f"item_type = 'sector' AND stance_sign = {-1 if fade else 1}"), baskets, F.col("item"))
    return finalize(own.select("as_of", "symbol", (size(conviction_weighted) / F.col("_members")).alias("w")), cap=cap)


def token_ls(live: DataFrame, conviction_weighted: bool = True, cap: int | None = None) -> DataFrame:
    own = live.where("item_type = 'token' AND stance_sign <> 0")
    return finalize(own.select("as_of", F.col("item").alias("symbol"), (F.col("stance_sign") * size(conviction_weighted)).alias("w")), cap=cap)


def intra_sector(live: DataFrame, baskets: DataFrame, cap: int | None = None, default: int = 50) -> DataFrame:
    """In each bullish sector of two members and more: long the member of most conviction (of equals the first by name), short the others."""
    convictions = live.where("item_type = 'token'").select("as_of", F.col("item").alias("symbol"), F.col("conviction").alias("_c"))
    own = with_basket(live.where("item_type = 'sector' AND stance_sign > 0"), baskets, F.col("item")).where("_members >= 2")
    ranked = own.join(convictions, ["as_of", "symbol"], "left").withColumn("_n", F.row_number().over(W.partitionBy("as_of", "sector").orderBy(F.coalesce("_c", F.lit(default)).desc(), "symbol")))
    return finalize(ranked.select("as_of", "symbol", F.when(F.col("_n") == 1, 1.0).otherwise(-1.0 / (F.col("_members") - 1)).alias("w")), cap=cap)


def token_vs_sector(live: DataFrame, baskets: DataFrame, conviction_weighted: bool = True, cap: int | None = None) -> DataFrame:
    """A token against the others of its parent's basket; nothing where there are no others."""
    own = live.where("item_type = 'token' AND stance_sign <> 0 AND parent_sector IS NOT NULL").select("as_of", "item", (F.col("stance_sign") * size(conviction_weighted)).alias("_w"), F.col("parent_sector").alias("sector"))
    others = own.join(baskets, ["sector", "as_of"]).where("symbol <> item").withColumn("_n", F.count("*").over(W.partitionBy("as_of", "item", "sector", "_w")))
    short = others.select("as_of", "symbol", (-F.col("_w") / F.col("_n")).alias("w"))
    long = others.select("as_of", F.col("item").alias("symbol"), (F.col("_w") / F.col("_n")).alias("w"))  # adds up to the whole
    return finalize(short.unionByName(long), cap=cap)


def both(live: DataFrame, baskets: DataFrame, fade: bool = False, conviction_weighted: bool = True, cap: int | None = None) -> DataFrame:
    return finalize(sector_ls(live, baskets, fade, conviction_weighted).unionByName(token_ls(live, conviction_weighted)), cap=cap)


def net_beta(book: DataFrame, betas: DataFrame, hedge: str) -> DataFrame:
    """(as_of, net): sum of weight times beta without the hedge's own; a symbol without a beta counts 1. betas: (symbol, beta) or (symbol, as_of, beta)."""
    keys = ["symbol", "as_of"] if "as_of" in betas.columns else ["symbol"]
    own = book.join(betas, keys, "left").withColumn("_b", F.when(F.col("symbol") != hedge, F.col("w") * F.coalesce("beta", F.lit(1.0))))
    return own.groupBy("as_of").agg(F.coalesce(F.sum("_b"), F.lit(0.0)).alias("net"))


def hedge_to(book: DataFrame, betas: DataFrame, hedge: str, target: DataFrame | float = 0.0) -> DataFrame:
    """The book with an overlay of the hedge symbol that brings its net beta to the target ((as_of, target) or one number)."""
    own = book.withColumn("_on", F.lit(True))
    own = own.withColumn("target", F.lit(float(target))) if isinstance(target, float) else own.join(target, "as_of", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    return overlaid(own, betas, hedge)


def overlaid(book: DataFrame, betas: DataFrame, hedge: str) -> DataFrame:
    """book (as_of, symbol, w, target, _on), read once: where _on, with one more row a date that brings the net beta to the target."""
    keys = ["symbol", "as_of"] if "as_of" in betas.columns else ["symbol"]
    date = W.partitionBy("as_of")
    own = book.join(betas, keys, "left").withColumn("_b", F.when(F.col("symbol") != hedge, F.col("w") * F.coalesce("beta", F.lit(1.0))))
    own = own.withColumn("_net", F.coalesce(F.sum("_b").over(date), F.lit(0.0))).withColumn("_n", F.row_number().over(date.orderBy("symbol")))
    line = lambda symbol, w: F.struct(symbol.alias("symbol"), w.alias("w"))
    rows = F.array(line(F.col("symbol"), F.col("w")), F.when(F.col("_on") & (F.col("_n") == 1), line(F.lit(hedge), F.col("target") - F.col("_net"))))
    both = own.select("as_of", "_on", F.explode(rows).alias("x")).where("x IS NOT NULL").groupBy("as_of", "_on", "x.symbol").agg(F.sum("x.w").alias("w"))
    return both.where(~F.col("_on") | (F.col("symbol") != hedge) | (F.abs("w") >= 1e-12)).select("as_of", "symbol", "w")


def target_beta(trends: DataFrame, risk: DataFrame, mode: str) -> DataFrame:
    """(as_of, target): half a beta by the hedge's trend (quant), by the risk stance (consensus), or their mean (combined)."""
    quant, said = 0.5 * F.coalesce("trend", F.lit(0)), F.when(F.col("stance") == "risk_on", 0.5).when(F.col("stance") == "risk_off", -0.5).otherwise(0.0)
    value = {"quant": quant, "consensus": said, "combined": (quant + said) / 2}[mode]
    return trends.select("as_of", "trend").join(risk, "as_of", "full").select("as_of", value.alias("target"))


def neutralise_when(book: DataFrame, betas: DataFrame, hedge: str, decisions: DataFrame, only: str | None = None) -> DataFrame:
    """The hedge only at dates (as_of, decision) that say "hedge" (and, with `only`, in rows where that column holds)."""
    said = decisions.where("decision = 'hedge'").select("as_of").distinct().withColumn("_said", F.lit(True))
    on = F.coalesce("_said", F.lit(False))
    flagged = book.join(said, "as_of", "left").withColumn("_on", on if only is None else on & F.col(only)).withColumn("target", F.lit(0.0))
    return overlaid(flagged.select("as_of", "symbol", "w", "target", "_on"), betas, hedge)


def capacity(book: DataFrame, oi: DataFrame, hedge: str, aum: float, share: float = 0.05, days: int = 5) -> DataFrame:
    """Weights cut to days * share of the symbol's open interest; what is cut goes to the hedge symbol."""
    most = days * share * F.coalesce("oi", F.lit(0.0)) / aum
    own = book.join(oi, ["as_of", "symbol"], "left").withColumn("_c", F.when(F.col("symbol") == hedge, F.col("w")).otherwise(F.signum("w") * F.least(F.abs("w"), most)))
    spill = own.groupBy("as_of").agg(F.sum(F.abs("w") - F.abs("_c")).alias("w")).where("w > 1e-9").select("as_of", F.lit(hedge).alias("symbol"), "w")
    return merge(own.select("as_of", "symbol", F.col("_c").alias("w")).unionByName(spill))


def top_sectors(scores: DataFrame, k: int, floor: float | None = None, value: str = "conviction") -> DataFrame:
    """The k sectors of a date with most of value (ties by name), with their rank."""
    own = scores if floor is None else scores.where(F.col(value) >= floor)
    return own.withColumn("rank", F.row_number().over(W.partitionBy("as_of").orderBy(F.col(value).desc(), "sector"))).where(F.col("rank") <= k)


def equal_baskets(sectors: DataFrame, baskets: DataFrame) -> DataFrame:
    """Equal weight for each sector, and in it for each member."""
    sized = baskets.withColumn("_members", F.count("*").over(W.partitionBy("sector", "as_of")))
    return finalize(sectors.select("as_of", "sector").join(sized, ["sector", "as_of"]).select("as_of", "symbol", (1.0 / F.col("_members")).alias("w")))


def long_short(scores: DataFrame, k: int, value: str = "conviction") -> DataFrame:
    """(as_of, sector, w): half the book in the k best, half short in the k worst; a sector on both sides nets out."""
    best = F.row_number().over(W.partitionBy("as_of").orderBy(F.col(value).desc(), "sector"))
    worst = F.row_number().over(W.partitionBy("as_of").orderBy(F.col(value).asc(), "sector"))
    ranked = scores.select("as_of", "sector", best.alias("_b"), worst.alias("_w"))
    n = F.least(F.lit(k), F.max("_b").over(W.partitionBy("as_of")))
    w = F.when(F.col("_b") <= n, 0.5 / n).otherwise(0.0) - F.when(F.col("_w") <= n, 0.5 / n).otherwise(0.0)
    return ranked.select("as_of", "sector", w.alias("w")).where("w <> 0")


SCHEMES = ("ew", "cw", "cw2", "invvol", "cw_invvol", "rankdecay")


def allocations(chosen: DataFrame, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """(scheme, as_of, sector, w) of chosen (as_of, sector, conviction, vol), all schemes in one pass.

    Where a volatility is missing the inverse-volatility schemes use the
    median of the known volatilities itself; a sum of 0 gives equal weights.
    """
    w = W.partitionBy("as_of")
    conviction = F.col("conviction").cast("double")
    inverse = F.coalesce(1.0 / F.col("vol"), F.percentile("vol", F.lit(0.5)).over(w))
    place = F.row_number().over(w.orderBy(F.col("conviction").desc(), "sector"))
    own = chosen.select("as_of", "sector", conviction.alias("_c"), inverse.alias("_i"), F.count("*").over(w).alias("_k"), place.alias("_p"))
    c, i = F.col("_c"), F.col("_i")
    raw = {"ew": F.lit(1.0), "cw": c, "cw2": c * c, "invvol": i, "cw_invvol": c * i, "rankdecay": (F.col("_k") - F.col("_p") + 1).cast("double")}
    told = own.select("as_of", "sector", "_k", F.inline(F.array(*[F.struct(F.lit(s).alias("scheme"), F.coalesce(raw[s], F.lit(0.0)).alias("_r")) for s in schemes])))
    total = F.sum("_r").over(W.partitionBy("scheme", "as_of"))
    return told.select("scheme", "as_of", "sector", F.when(total == 0, 1.0 / F.col("_k")).otherwise(F.try_divide(F.col("_r"), total)).alias("w"))


def allocation(chosen: DataFrame, scheme: str) -> DataFrame:
    """(as_of, sector, w) by one scheme of `allocations`."""
    return allocations(chosen, (scheme,)).drop("scheme")


def scaled(book: DataFrame, gross: DataFrame) -> DataFrame:
    """Weights times a date's own gross exposure (as_of, gross)."""
    return book.join(gross, "as_of").select("as_of", "symbol", (F.col("w") * F.col("gross")).alias("w"))


def conviction_gross(items: DataFrame, normal: float = 70.0, most: float = 1.2) -> DataFrame:
    """(as_of, gross): the items' mean conviction over a normal one, up to `most`."""
    return items.groupBy("as_of").agg(F.least(F.lit(most), F.avg("conviction") / normal).alias("gross"))


def vol_gross(vols: DataFrame, target: float = 0.15, floor: float = 0.05) -> DataFrame:
    """(as_of, gross): the target over a volatility (as_of, vol), the floor at least; never above 1."""
    return vols.select("as_of", F.least(F.lit(1.0), target / F.greatest("vol", F.lit(floor))).alias("gross"))


def scaled_unless_alone(book: DataFrame, gross: DataFrame, hedge: str) -> DataFrame:
    """Weights times a date's gross exposure (1 where there is none), but not where the hedge symbol is all of the book."""
    others = F.max((F.col("symbol") != hedge).cast("int")).over(W.partitionBy("as_of")) == 1
    own = book.withColumn("_others", others).join(gross, "as_of", "left")
    return own.select("as_of", "symbol", F.when(F.col("_others"), F.col("w") * F.coalesce("gross", F.lit(1.0))).otherwise(F.col("w")).alias("w"))


def avoided(bullish: DataFrame, bearish: DataFrame) -> DataFrame:
    """(as_of, item) of bullish that are not bearish too."""
    return bullish.select("as_of", "item").distinct().join(bearish.select("as_of", "item"), ["as_of", "item"], "left_anti")
