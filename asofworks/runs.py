"""Whole runs, put together from the operators: a panel from answers, the reconciliation of panels, and how much a panel tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofworks.functions import answers as A
from asofworks.operators import asof, audit, backtest, lifecycle, reconcile, returns, stats
from asofworks.operators.calendar import with_next
from asofworks.operators.storage import saved
from asofworks.sources import committed
from asofworks.sources.published import read

#: What is kept of each period: an item's first entry by place, with its citations.
PERIODS = f"as_of date, item string, item_type string, parent_sector string, stance_sign int, conviction int, horizon string, place int, citations array<{A.CITATION}>"
SIGNALS = ("stance_sign", "signal", "delta_stance")


def period_items(answers: DataFrame, registry: DataFrame) -> DataFrame:
    """PERIODS of answers (as_of, answer: JSON of four arrays), their items under the names of the registry (name, canonical) or new ones."""
    told = answers.select("as_of", F.posexplode(A.view_items(F.col("answer"))).alias("place", "x")).select("as_of", "place", "x.*")
    names = reconcile.canonical(told.select(F.col("item").alias("name")).distinct(), registry).select("name", "canonical")
    own = told.join(names, told["item"] == names["name"]).withColumn("item", F.col("canonical"))
    sign = F.when(F.col("stance") == "bullish", 1).when(F.col("stance") == "bearish", -1).otherwise(0)
    return own.select("as_of", "item", "item_type", "parent_sector", sign.alias("stance_sign"), "conviction", "horizon", "place", "citations")


def build_panel(answers: DataFrame, registry: DataFrame, periods: DataFrame, root: str, batch: str, corpus: DataFrame | None = None) -> DataFrame:
    """The lifecycle panel of all periods that are known after this run; it is published with the audit of its quotes in one commit.

    Periods that an earlier run published stay as they are and are not parsed
    again, so a run that was stopped goes on where it was. corpus (doc_id, day,
    text): quotes are held against it; a quote from after its period is leaked.
    """
    spark = answers.sparkSession
    done = read(spark, root, "periods", PERIODS).select("as_of").distinct()
    new = period_items(answers.join(done, "as_of", "left_anti"), registry)
    committed.commit({"periods": new}, root, f"periods of {batch}")
    kept = read(spark, root, "periods", PERIODS)
    panel = lifecycle.lifecycle(kept.drop("citations", "_commit"), periods, order="place")
    tables = {"signal_panel": panel}
    if corpus is not None:
        tables["audit"] = audited(kept, corpus)
    committed.save_signals(tables, root, batch)
    return committed.signals(spark, root, "signal_panel", panel.schema)


def audited(kept: DataFrame, corpus: DataFrame) -> DataFrame:
    """(as_of, checked, matched, leaked, hallucinated): quotes of each period in the corpus, by the first day that has them."""
    quotes = saved(kept.select("as_of", F.explode("citations").alias("c")).select("as_of", F.col("c.quote").alias("quote")).withColumn("quote_id", F.xxhash64("quote")))
    each = quotes.select("quote_id", "quote").dropDuplicates(["quote_id"])
    first = audit.contained(each, corpus).join(corpus.select("doc_id", "day"), "doc_id").groupBy("quote_id").agg(F.min("day").alias("first_day"))
    judged = quotes.join(first, "quote_id", "left").withColumn("verdict", F.when(F.col("first_day").isNull(), "hallucinated").when(F.col("first_day") > F.col("as_of"), "leaked").otherwise("matched"))
    return audit.report(judged, ("as_of",))


def run_reconciliation(panels: dict[str, DataFrame], groups: DataFrame, root: str, batch: str) -> int:
    """Copies of panels under canonical names, with the map of all ids and the corrections of types, in one commit; sources are only read.

    groups (id, canonical, canonical_type): what belongs together. Ids that no
    group names map to themselves. Tables: <panel>_reconciled,
    reconciliation_map (id, canonical), type_corrections (id, old_type, new_type).
    """
    ids = None
    for rows in panels.values():
        own = reconcile.distinct_ids(rows)
        ids = own if ids is None else ids.unionByName(own)
    ids = ids.groupBy("id").agg(F.min("item_type").alias("item_type"))
    every = ids.join(groups, "id", "left").select("id", "item_type", F.coalesce("canonical", "id").alias("canonical"), "canonical_type")
    fixed = every.where(F.col("canonical_type").isNotNull() & (F.col("canonical_type") != F.col("item_type")))
    tables = {f"{name}_reconciled": reconcile.apply_map(rows, groups) for name, rows in panels.items()}
    tables |= {"reconciliation_map": every.select("id", "canonical"), "type_corrections": fixed.select(F.col("canonical").alias("id"), F.col("item_type").alias("old_type"), F.col("canonical_type").alias("new_type"))}
    return committed.save_signals(tables, root, batch)


def evaluation(panel: DataFrame, dates: DataFrame, sectors: DataFrame, prices: DataFrame, oi: DataFrame, floor: float, forward: DataFrame | None = None) -> DataFrame:
    """(as_of, item, item_type, stance_sign, signal, delta_stance, ret): live rows with their return to the next date, tokens their own, sectors their basket's.

    Rows without a return, and those of the last date, have no place in it.
    forward: returns that are known already.
    """
    ret = asof.forward_returns(prices, with_next(dates).where("next_as_of IS NOT NULL")) if forward is None else forward
    ret = ret.where("ret IS NOT NULL")
    baskets = returns.basket_members(sectors, backtest.open_interest(oi, dates), floor)
    live = lifecycle.live_rows(panel)
    token = live.where("item_type = 'token'").join(ret.select(F.col("symbol").alias("item"), "as_of", "ret"), ["item", "as_of"])
    basket = returns.basket_returns(baskets, ret).where("ret IS NOT NULL").select(F.col("sector").alias("item"), "as_of", "ret")
    both = token.unionByName(live.where("item_type = 'sector'").join(basket, ["item", "as_of"]))
    return both.select("as_of", "item", "item_type", "stance_sign", (F.col("stance_sign") * F.col("conviction")).alias("signal"), "delta_stance", "ret")


def run_informativeness(table: DataFrame, label: str = "", signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(label, signal, n_rows, n, ic) of an evaluation table: each signal's rank correlation with what came after."""
    table = saved(table)  # read once a signal
    rows = table.count()
    out = None
    for name in signals:
        own = stats.rank_ic(table, name, "ret").select(F.lit(label).alias("label"), F.lit(name).alias("signal"), F.lit(rows).alias("n_rows"), "n", "ic")
        out = own if out is None else out.unionByName(own)
    return out
