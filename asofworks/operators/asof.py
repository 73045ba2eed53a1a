"""Point-in-time look-ups: the last value at or before a date.

Two plan shapes give the same rows. `asof_by_calendar` deals each value to the
first date of the calendar that may know it, by an equal join on days, keeps the
latest value of each symbol and date in a partial aggregate and carries it on;
`asof_by_merge` puts probes and values into one stream per symbol and takes the
last value before each probe: for probes that differ from symbol to symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day_map(calendar: DataFrame, probe: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a calendar of dates or timestamps: (probe, _pos) in order; of each day from the first to the last its probes (_own) and the place of the next one after it (_next); and its bounds (_first, _end: a place more than there are).

    A row a day of the span, whatever the number of values.
    """
    w = W.orderBy(probe)  # a row a date of the calendar
    numbered = calendar.select(probe).where(F.col(probe).isNotNull()).distinct().withColumn("_pos", F.row_number().over(w))
    by_day = numbered.groupBy(F.to_date(probe).alias("_at")).agg(F.sort_array(F.collect_list(F.struct(F.col(probe).alias("at"), F.col("_pos").alias("pos")))).alias("_probes"))
    d = W.orderBy("_at")
    by_day = by_day.withColumns({"_before": F.lag("_at").over(d), "_later": F.lead(F.col("_probes")[0]["pos"]).over(d)})
    spread = by_day.select("_at", "_probes", "_later", F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), F.col("_at")), F.col("_at"))).alias("_day"))
    there = F.col("_day") == F.col("_at")
    days = spread.select("_day", F.when(there, F.col("_probes")).alias("_own"), F.when(there, F.col("_later")).otherwise(F.col("_probes")[0]["pos"]).alias("_next"))
    return numbered, days, numbered.agg(F.to_date(F.min(probe)).alias("_first"), (F.max("_pos") + 1).alias("_end"))


def asof_by_calendar(series: DataFrame, calendar: DataFrame, value: str = "close", key: str = "symbol", day: str = "date", probe: str = "as_of") -> DataFrame:
    """(key, probe, value, value's day) for every key with a value at or before the probe date; no limit of staleness.

    Each value goes to the first probe at or after it (an equal join on days),
    the latest of each (key, probe) is a partial aggregate, and what a key has at
    one probe holds until its next one, or to the calendar's end.
    """
    numbered, days, bounds = day_map(calendar, probe)
    live = series.where(F.col(value).isNotNull() & F.col(day).isNotNull()).select(key, F.col(value).alias("_v"), F.col(day).alias("_d"))
    met = live.join(F.broadcast(bounds)).withColumn("_day", F.greatest(F.to_date("_d"), F.col("_first"))).join(F.broadcast(days), "_day")  # bounds: one row; days: 3.7 million at most, for all years that a date can have
    mine = F.filter("_own", lambda x: x["at"] >= F.col("_d"))
    placed = met.withColumn("_pos", F.coalesce(F.try_element_at(mine, F.lit(1))["pos"], F.col("_next"))).where("_pos IS NOT NULL")
    found = placed.groupBy(key, "_pos", "_end").agg(F.max_by("_v", "_d").alias(value), F.max("_d").alias(f"{value}_date"))
    until = F.coalesce(F.lead("_pos").over(W.partitionBy(key).orderBy("_pos")), F.col("_end"))
    spread = found.withColumn("_until", until).select(key, value, f"{value}_date", F.explode(F.sequence(F.col("_pos"), F.col("_until") - 1)).alias("_pos"))
    return spread.join(numbered, "_pos").select(key, probe, value, f"{value}_date")


def asof_by_merge(series: DataFrame, probes: DataFrame, value: str = "close", key: str = "symbol", day: str = "date", probe: str = "as_of") -> DataFrame:
    """The same for probes (key, probe) of any number."""
    a = series.where(F.col(value).isNotNull()).select(key, F.col(day).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v"), F.col(day).alias("d")).alias("_hit"))
    b = probes.select(key, F.col(probe).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_hit"].dataType).alias("_hit")).distinct()
    before = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_hit", ignorenulls=True).over(before)).where("_kind = 1 AND _last IS NOT NULL")
    return found.select(key, F.col("_at").alias(probe), F.col("_last.v").alias(value), F.col("_last.d").alias(f"{value}_date"))


def asof(series: DataFrame, calendar: DataFrame, value: str = "close", key: str = "symbol", day: str = "date", probe: str = "as_of") -> DataFrame:
    """Values of all keys at all calendar dates."""
    return asof_by_calendar(series, calendar, value, key, day, probe)


HORIZONS = (7, 30, 91, 182, 365, 730)


def with_horizons(calendar: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """as_of: the calendar's dates, and those so many days before them: what one look-up for all returns needs."""
    days = F.explode(F.array(F.col("as_of"), *[F.date_sub("as_of", h) for h in horizons]))
    return calendar.select(days.alias("as_of")).distinct()


def forward_returns(series: DataFrame, pairs: DataFrame, value: str = "close", known: DataFrame | None = None) -> DataFrame:
    """(symbol, as_of, next_as_of, ret): value(next) / value(as_of) - 1; null where a price is missing or 0, or the first is not positive.

    known: values as of all these dates, where they have been looked up already.
    """
    days = pairs.select("as_of").union(pairs.select("next_as_of")).where("as_of IS NOT NULL").distinct()
    prices = asof(series, days, value) if known is None else known
    now = prices.select("symbol", "as_of", F.col(value).alias("_p0")).join(pairs, "as_of")
    then = prices.select("symbol", F.col("as_of").alias("next_as_of"), F.col(value).alias("_p1"))
    fine = (F.col("_p0") > 0) & (F.col("_p1") != 0)
    return now.join(then, ["symbol", "next_as_of"]).select("symbol", "as_of", "next_as_of", F.when(fine, F.col("_p1") / F.col("_p0") - 1).alias("ret"))


def trailing_returns(series: DataFrame, calendar: DataFrame, horizons: tuple[int, ...] = HORIZONS, value: str = "close", known: DataFrame | None = None) -> DataFrame:
    """(symbol, as_of, days, ret) over the given numbers of calendar days; all horizons in one look-up. Null where a price is missing or 0, or the first is not positive.

    known: values as of with_horizons(calendar, horizons), where they have been looked up already.
    """
    dates = calendar.select("as_of").distinct()
    prices = asof(series, with_horizons(dates, horizons), value) if known is None else known
    spans = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("days")
    now = prices.select("symbol", "as_of", F.col(value).alias("_p1")).join(dates, "as_of").select("*", spans).withColumn("_from", F.date_sub("as_of", F.col("days")))
    then = prices.select("symbol", F.col("as_of").alias("_from"), F.col(value).alias("_p0"))
    fine = (F.col("_p0") > 0) & (F.col("_p1") != 0)
    return now.join(then, ["symbol", "_from"]).select("symbol", "as_of", "days", F.when(fine, F.col("_p1") / F.col("_p0") - 1).alias("ret"))


def snapshot(panel: DataFrame, calendar: DataFrame, day: str = "as_of", probe: str = "t") -> DataFrame:
    """Panel rows of the latest panel date at or before each probe date."""
    dates = panel.select(F.col(day).alias("_at"), F.col(day).alias("_d")).distinct()
    both = dates.unionByName(calendar.select(F.col(probe).alias("_at"), F.lit(None).cast(dates.schema["_d"].dataType).alias("_d")).distinct())
    # in order of dates, and at one date the panel's own first: a row a date
    latest = both.withColumn(day, F.last("_d", ignorenulls=True).over(W.orderBy("_at", F.col("_d").asc_nulls_last()))).where("_d IS NULL").select(F.col("_at").alias(probe), day)
    return panel.join(latest.where(F.col(day).isNotNull()), day)
