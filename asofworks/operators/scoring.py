"""How judged answers came out: tallies, rates, lifts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blind(views: DataFrame, by: str = "as_of", name: str = "item", kept: tuple[str, ...] = ("conviction",), hidden: tuple[str, ...] = ("member",)) -> DataFrame:
    """(by, views): what each group says, as an array of (name, kept) in order of names, with nothing that tells whose it is.

    A group's views are few: one answer's.
    """
    known = [c for c in (name, *kept) if c not in hidden]
    return views.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*known))).alias("views"))


def missing_tasks(done: DataFrame, members: DataFrame, periods: DataFrame, member: str = "member", period: str = "as_of") -> DataFrame:
    """(member, period) of all members and periods that are not done. Each member writes out the calendar, an array of its dates."""
    calendar = periods.agg(F.collect_set(period).alias("_all"))  # one row, a date an element
    every = members.select(member).distinct().join(F.broadcast(calendar)).select(member, F.explode("_all").alias(period))
    return every.join(done.select(member, period).distinct(), [member, period], "left_anti")


def lift(scores: DataFrame, by: str, score: str, full: Column) -> DataFrame:
    """(by, lift): the mean of the whole arm less that of the ablated one; null where an arm has none."""
    mean = lambda arm: F.avg(F.when(arm, F.col(score)))
    return scores.groupBy(by).agg((mean(full) - mean(~full)).alias("lift"))


def coverage(rows: DataFrame, by: str, flags: dict[str, Column], mean: str | None = None) -> DataFrame:
    """(by, n, a count for each flag, rate: the mean of a column)."""
    counts = [F.count_if(own).alias(name) for name, own in flags.items()]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *counts, *([F.avg(mean).alias("rate")] if mean else []))


def tally(answers: DataFrame, by: str, guess: str, truth: str, confidence: str) -> DataFrame:
    """(by, n, correct, accuracy, mean_confidence) of blind answers; a confidence that is no number does not count."""
    right = F.coalesce(F.col(guess) == F.col(truth), F.lit(False))
    own = answers.select(by, right.alias("_right"), F.col(confidence).try_cast("double").alias("_c"))
    return own.groupBy(by).agg(F.count("*").alias("n"), F.count_if("_right").alias("correct"), F.avg(F.col("_right").cast("double")).alias("accuracy"), F.avg("_c").alias("mean_confidence"))


def confirm_rate(judged: DataFrame, by: str, confirmed: Column, contradicted: Column) -> DataFrame:
    """(by, confirmed, contradicted, confirm_rate): confirmed among those that are either; null where none is."""
    own = judged.groupBy(by).agg(F.count_if(confirmed).alias("confirmed"), F.count_if(contradicted).alias("contradicted"))
    return own.withColumn("confirm_rate", F.try_divide(F.col("confirmed"), F.col("confirmed") + F.col("contradicted")))


def list_union(rows: DataFrame, key: str, lists: tuple[str, ...], order: str) -> DataFrame:
    """One row a key: list columns united, each value once and in order, all other fields as in the row of the smallest order."""
    others = [c for c in rows.columns if c not in (key, *lists)]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_f"))
    for c in lists:
        united = rows.select(key, F.explode(c).alias("_x")).where("_x IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("_x")).alias(c))
        first = first.join(united, key, "left").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return first.select(key, "_f.*", *lists).select(*rows.columns)


def common_dates(a: DataFrame, b: DataFrame, day: str = "as_of") -> DataFrame:
    """The dates that both have, each once."""
    return a.select(day).distinct().intersect(b.select(day).distinct())
