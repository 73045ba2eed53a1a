"""Rebalance calendars, as Spark date sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def month_ends(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """as_of: the month ends within [start, end] of each row of spans."""
    firsts = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    days = spans.select(start, end, F.explode(firsts).alias("_first")).withColumn("as_of", F.last_day("_first"))
    return days.where(F.col("as_of").between(F.col(start), F.col(end))).select("as_of").distinct()


def quarter_ends(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """as_of: the ends of March, June, September and December within [start, end]."""
    return month_ends(spans, start, end).where(F.month("as_of") % 3 == 0)


def rebalance_dates(spans: DataFrame, start: str = "start", end: str = "end", every: str = "month") -> DataFrame:
    """month: all month ends of the span, the last month's included even if the span ends before it; quarter: snapped to 3/6/9/12."""
    whole = spans.select(F.col(start), F.last_day(end).alias(end))
    return (month_ends if every == "month" else quarter_ends)(whole, start, end)


def with_next(dates: DataFrame, day: str = "as_of", out: str = "next_as_of") -> DataFrame:
    """Each date and the one after it (null for the last). The calendar is small: one ordered window."""
    return dates.select(day).distinct().withColumn(out, F.lead(day).over(W.orderBy(day)))


def span(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("start"), F.max(day).alias("end"))


def one_row(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def in_window(day: Column, t: Column, months: int) -> Column:
    """t - months < day <= t."""
    return (day > F.add_months(t, -months)) & (day <= t)


def held_out(day: Column, t: Column, months: int) -> Column:
    """t < day <= t + months; days of the month are clamped."""
    return (day > t) & (day <= F.add_months(t, months))
