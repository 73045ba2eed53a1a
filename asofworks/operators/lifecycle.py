"""Period-over-period lifecycle of panel items: NEW, SUSTAINED, FLIPPED, EXITED."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


EXIT_HORIZON = "structural"


def last_entries(items: DataFrame, order: str) -> DataFrame:
    """One row for each (as_of, item): the one of the greatest order, which says what was written last."""
    w = W.partitionBy("as_of", "item").orderBy(F.col(order).desc())
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lifecycle(items: DataFrame, periods: DataFrame, order: str | None = None) -> DataFrame:
    """items (as_of, item, item_type, parent_sector, stance_sign, conviction, horizon) with stance, state, changes and age, and EXITED rows.

    periods (as_of) is the whole calendar: a period without items still ends
    those of the one before. A flip is a change of sign through no zero;
    re-entry is NEW, and NEW items have changes of 0; an exit is told once, in
    the period after the last entry, as neutral, with the EXIT_HORIZON. Items
    without a horizon get null. order: the column that tells which of several
    entries of an item and period was written last; without it items have one each.
    """
    if "horizon" not in items.columns:
        items = items.withColumn("horizon", F.lit(None).cast("string"))
    numbered = periods.select("as_of").distinct().withColumn("_p", F.row_number().over(W.orderBy("as_of")))
    w = W.partitionBy("item").orderBy("_p")
    rows = (items if order is None else last_entries(items, order)).join(numbered, "as_of")
    rows = rows.withColumns({"_before": F.lag("_p").over(w), "_sign": F.lag("stance_sign").over(w), "_conv": F.lag("conviction").over(w), "_after": F.lead("_p").over(w)})
    rows = rows.withColumn("_new", F.coalesce(F.col("_before") != F.col("_p") - 1, F.lit(True)))
    rows = rows.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("age", F.row_number().over(W.partitionBy("item", "_island").orderBy("_p")))
    state = F.when(F.col("_new"), "NEW").when(F.col("stance_sign") * F.col("_sign") < 0, "FLIPPED").otherwise("SUSTAINED")
    change = lambda now, before: F.when(~F.col("_new"), F.col(now) - F.col(before)).otherwise(0).cast("int")
    stance = F.when(F.col("stance_sign") > 0, "bullish").when(F.col("stance_sign") < 0, "bearish").otherwise("neutral")
    live = rows.select("as_of", "item", "item_type", "parent_sector", stance.alias("stance"), "stance_sign", "conviction", "horizon", state.alias("lifecycle_state"), change("stance_sign", "_sign").alias("delta_stance"), change("conviction", "_conv").alias("delta_conviction"), F.col("age").cast("int").alias("age"))
    gone = rows.where(F.col("_after").isNull() | (F.col("_after") > F.col("_p") + 1)).drop("as_of").withColumn("_p", F.col("_p") + 1).join(numbered, "_p")
    gone = gone.select("as_of", "item", "item_type", "parent_sector", F.lit("neutral").alias("stance"), F.lit(0).alias("stance_sign"), F.lit(0).alias("conviction"), F.lit(EXIT_HORIZON).alias("horizon"), F.lit("EXITED").alias("lifecycle_state"), (-F.col("stance_sign")).cast("int").alias("delta_stance"), (-F.col("conviction")).cast("int").alias("delta_conviction"), F.lit(0).alias("age"))
    return live.unionByName(gone)


def live_rows(panel: DataFrame) -> DataFrame:
    return panel.where("lifecycle_state <> 'EXITED'")


def persistent(picks: DataFrame, periods: DataFrame) -> DataFrame:
    """Picks (as_of, item) that were picks in the period before too; all picks of a period where none were."""
    numbered = periods.select("as_of").distinct().withColumn("_p", F.row_number().over(W.orderBy("as_of")))
    rows = picks.join(numbered, "as_of").withColumn("_kept", F.coalesce(F.lag("_p").over(W.partitionBy("item").orderBy("_p")) == F.col("_p") - 1, F.lit(False)))
    some = F.max(F.col("_kept").cast("int")).over(W.partitionBy("as_of"))
    return rows.withColumn("_some", some).where("_kept OR _some = 0").select("as_of", "item")
