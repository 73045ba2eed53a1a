"""Whole runs as queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from asofworks import runs
from asofworks.functions.answers import ARRAYS
from asofworks.operators.storage import shared_folder
from asofworks.sources import committed

from . import derived as D
from .derived import sql
from .market_queries import EVALS, RANKS
from .text_queries import ORACLES as TEXT_ORACLES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def answers(spark, d):
    """An answer of four arrays for each month, of all items that are bullish or bearish."""
    entry = F.to_json(F.struct(F.lower("item").alias("name"), "parent_sector", "conviction", "horizon"))
    side = lambda kind, s: F.concat(F.lit("["), F.array_join(F.collect_list(F.when((F.col("item_type") == kind) & (F.col("stance_sign") == s), entry)), ", "), F.lit("]"))
    parts = [F.concat(F.lit(f'"{name}": '), side(kind, 1 if stance == "bullish" else -1)) for name, (kind, stance) in ARRAYS.items()]
    return D.items(spark, d).groupBy("as_of").agg(F.concat(F.lit("Here it is: {"), F.concat_ws(", ", *parts), F.lit("}")).alias("answer"))


@query(sql("SELECT * FROM panel", "panel").replace("FROM items i JOIN numbered", "FROM (SELECT * FROM items WHERE stance_sign <> 0) i JOIN numbered"))
def panel_run(spark, d):
    """The panel of two runs: the first has the even months, the second finds them done."""
    root = f"{shared_folder(spark)}/run-{uuid4().hex}"
    told = answers(spark, d).withColumn("answer", F.regexp_extract("answer", r"(?s)(\{.*\})", 1))
    names = D.items(spark, d).select(F.lower("item").alias("name"), F.col("item").alias("canonical")).distinct()
    runs.build_panel(told.where("month(as_of) % 2 = 0"), names, D.months(spark, d), root, "first")
    spoiled = told.withColumn("answer", F.when(F.month("as_of") % 2 == 0, "{}").otherwise(F.col("answer")))
    return runs.build_panel(spoiled, names, D.months(spark, d), root, "second")


@query(TEXT_ORACLES["reconciled_panel"])
def reconciliation_run(spark, d):
    """reconciled_panel by a run that commits the copy with its map and its corrections."""
    root = f"{shared_folder(spark)}/run-{uuid4().hex}"
    groups = spark.createDataFrame([("NATION_1", "ALPHA", "token"), ("NATION_2", "ALPHA", "token"), ("ASIA", "EAST", "sector")], "id string, canonical string, canonical_type string")
    items = D.items(spark, d).select("as_of", "item", "item_type", "parent_sector")
    runs.run_reconciliation({"house": items}, groups, root, "one")
    return committed.signals(spark, root, "house_reconciled", items.schema)


def ic_of(signal: str) -> str:
    renamed = f"(SELECT * EXCLUDE (signal), {signal} AS signal FROM eval)" if signal != "signal" else "eval"
    ranks = RANKS.format(p="1", q="", t=renamed).removeprefix("ranks AS ")
    return f"SELECT 'house' AS label, '{signal}' AS signal, (SELECT count(*) FROM eval) AS n_rows, count(*) AS n, round(CASE WHEN count(*) >= 5 AND count(DISTINCT signal) >= 2 THEN corr(a, b) END, 6) AS ic FROM {ranks}"


@query(f"{EVALS.replace('eval AS (', 'evals AS (')}, eval AS (SELECT * FROM evals WHERE ret IS NOT NULL) " + " UNION ALL ".join(ic_of(s) for s in runs.SIGNALS))
def informativeness_run(spark, d):
    """How much stance, signed conviction and change of stance of the panel tell of the next month."""
    table = runs.evaluation(D.panel(spark, d), D.months(spark, d), D.sectors(spark, d), D.prices(spark, d), D.market(spark, d), D.FLOOR, D.monthly(spark, d))
    return runs.run_informativeness(table, "house").withColumn("ic", F.round("ic", 6))
