"""The library's tables as whole commits (see `published`): price series, period views, signal tables, evidence with identities, passages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import ITEM, PASSAGES
from .published import NUMBER, commit, compact, newest, read, replaced
from .sinks import missing

SERIES = "series string, symbol string, date date, value double"
VIEWS = f"member string, as_of date, items array<{ITEM}>"
EVIDENCE = "slug string, timestamp timestamp, source_type string, id string, text string, context string, weight double"
IDENTITY = "slug string, identity string"
PASSAGE_LINES = f"object_id string, passages {PASSAGES}, place long"


def save_series(frames: DataFrame, root: str, series: str, batch: str) -> int:
    """frames (symbol, date, value) as a series; all rows of the symbols at hand take the place of earlier ones."""
    return commit({"series": frames.select(F.lit(series).alias("series"), "symbol", "date", "value")}, root, batch)


def series(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(symbol, date, value) of a series, of each symbol as it was last saved."""
    return replaced(read(spark, root, "series", SERIES).where(F.col("series") == name), ["series", "symbol"]).drop("series")


def save_views(views: DataFrame, root: str, batch: str) -> int:
    """views (member, as_of, items); what is published of a member and period stays."""
    done = read(views.sparkSession, root, "views", VIEWS)
    return commit({"views": missing(views.select("member", "as_of", "items"), done, ["member", "as_of"])}, root, batch)


def views(spark: SparkSession, root: str) -> DataFrame:
    """(member, as_of, items): of each member and period what was saved first."""
    rows = read(spark, root, "views", VIEWS)
    return rows.groupBy("member", "as_of").agg(F.min_by("items", NUMBER).alias("items"))


def save_signals(tables: dict[str, DataFrame], root: str, batch: str) -> int:
    """A run's tables (panel, dispersion, returns), known together or not at all."""
    return commit(tables, root, batch)


def signals(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table of the last run that has it."""
    rows = read(spark, root, name, schema)
    last = rows.agg(F.max(NUMBER).alias("_last"))
    return rows.join(F.broadcast(last), F.col(NUMBER) == F.col("_last")).drop(NUMBER, "_last")  # one row


def save_evidence(evidence: DataFrame, profiles: DataFrame, root: str, batch: str) -> int:
    """A subject's evidence, and its profile (slug, any fields) as JSON, in one commit; a subject that is saved again is replaced."""
    columns = [c.split()[0] for c in EVIDENCE.split(", ")]
    own = evidence.select(*[F.col(c) if c in evidence.columns else F.lit(None).alias(c) for c in columns])
    typed = own.select(*[F.col(c).cast(EVIDENCE.split(", ")[i].split()[1]).alias(c) for i, c in enumerate(columns)])
    told = profiles.select("slug", F.to_json(F.struct(*profiles.columns), {"ignoreNullFields": "false"}).alias("identity"))
    return commit({"evidence": typed, "identity": told}, root, batch)


def evidence(spark: SparkSession, root: str, t=None) -> DataFrame:
    """Evidence rows, those up to the day t where one is given: nothing later passes."""
    rows = replaced(read(spark, root, "evidence", EVIDENCE), ["slug"])
    return rows if t is None else rows.where(F.to_date("timestamp") <= t)


def identities(spark: SparkSession, root: str) -> DataFrame:
    return newest(read(spark, root, "identity", IDENTITY), ["slug"])


def append_passages(rows: DataFrame, root: str, batch: str, place: str) -> int:
    """rows (object_id, passages) behind all that is there; place orders those of one append."""
    return commit({"passages": rows.select("object_id", "passages", F.col(place).cast("long").alias("place"))}, root, batch)


def passages(spark: SparkSession, root: str) -> DataFrame:
    """(object_id, passages): a later append's line takes the place of an earlier one, however fast they followed each other."""
    return newest(read(spark, root, "passages", PASSAGE_LINES), ["object_id"], "place").drop("place")


def compact_passages(spark: SparkSession, root: str) -> int:
    """Lines that were replaced go."""
    return compact(spark, root, {"passages": (PASSAGE_LINES, partial(newest, keys=["object_id"], order="place"))})


def compact_series(spark: SparkSession, root: str) -> int:
    return compact(spark, root, {"series": (SERIES, partial(replaced, keys=["series", "symbol"]))})
