"""Dispersion and agreement of members' views on items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dispersion(views: DataFrame, order: str = "member") -> DataFrame:
    """Per (as_of, item): entries, their share of the period's members, spread and means of sign and conviction, first type and parent.

    Entries count, not members: a member with an item twice counts twice.
    """
    members = views.groupBy("as_of").agg(F.countDistinct("member").alias("_members"))
    own = views.groupBy("as_of", "item").agg(F.count("*").alias("coverage"), F.stddev_pop("stance_sign").alias("stance_dispersion"), F.stddev_pop("conviction").alias("conviction_spread"), F.avg("stance_sign").alias("mean_stance_sign"), F.avg("conviction").alias("mean_conviction"), F.min_by("item_type", order).alias("item_type"), F.min_by("parent_sector", order).alias("parent_sector"))
    return own.join(members, "as_of").withColumn("coverage_frac", F.col("coverage") / F.col("_members")).drop("_members")


def coverage_band(share, thin: float = 0.2, broad: float = 0.4):
    return F.when(share <= thin, "thin").when(share >= broad, "broad").otherwise("middle")


def signed_conviction(items: DataFrame) -> DataFrame:
    """Per (as_of, sector): the sum of sign times conviction over its items, whether they name the sector or a part of it."""
    sector = F.when(F.col("item_type") == "sector", F.col("item")).otherwise(F.col("parent_sector"))
    return items.withColumn("sector", sector).where("sector IS NOT NULL").groupBy("as_of", "sector").agg(F.sum(F.col("stance_sign") * F.col("conviction")).alias("score"))


def zscore(df: DataFrame, value: str, by: str = "as_of", out: str = "z") -> DataFrame:
    """Cross-sectional z-score with the population's deviation; 0 where that is 0 or there are under two values."""
    w = W.partitionBy(by)
    spread = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when((F.count(value).over(w) < 2) | (spread == 0), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / spread))


def blend(a: DataFrame, b: DataFrame, weight: float, keys: tuple[str, ...] = ("as_of", "sector")) -> DataFrame:
    """z(a) + weight * z(b); a side that lacks a key counts 0."""
    za = zscore(a, "score").select(*keys, F.col("z").alias("_a"))
    zb = zscore(b, "score").select(*keys, F.col("z").alias("_b"))
    return za.join(zb, list(keys), "full").select(*keys, (F.coalesce("_a", F.lit(0.0)) + weight * F.coalesce("_b", F.lit(0.0))).alias("score"))
