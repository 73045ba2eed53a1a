"""Vocabularies: ids of items, canonical names, and their use; nothing is ever dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofworks.functions.text import slug


def distinct_ids(panel: DataFrame, order: str = "as_of") -> DataFrame:
    """(id, item_type): items with their last type, and parents as sectors where they are no items themselves."""
    own = panel.groupBy(F.col("item").alias("id")).agg(F.max_by("item_type", order).alias("item_type"))
    parents = panel.where("parent_sector IS NOT NULL").select(F.col("parent_sector").alias("id")).distinct().join(own, "id", "left_anti")
    return own.unionByName(parents.select("id", F.lit("sector").alias("item_type")))


def apply_map(panel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items and parents by mapping (id, canonical, canonical_type); what it lacks keeps its own name, and a null parent stays null."""
    m = mapping.select(F.col("id").alias("_i"), F.col("canonical").alias("_c"), F.col("canonical_type").alias("_t"))
    own = panel.join(m, F.col("item") == F.col("_i"), "left").withColumn("item", F.coalesce("_c", "item")).withColumn("item_type", F.coalesce("_t", "item_type")).drop("_i", "_c", "_t")
    return own.join(m.drop("_t"), F.col("parent_sector") == F.col("_i"), "left").withColumn("parent_sector", F.coalesce("_c", "parent_sector")).drop("_i", "_c")


def canonical(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, canonical, minted): the registry's id for the name or for its slug, else the slug as a new one."""
    own = names.select("name", slug(F.col("name")).alias("_s"))
    r = registry.select(F.col("name").alias("_n"), F.col("canonical").alias("_c"))
    by_name = own.join(r, F.col("name") == F.col("_n"), "left").drop("_n").withColumnRenamed("_c", "_a")
    by_slug = by_name.join(r.select(F.col("_c").alias("_b")).distinct(), F.col("_s") == F.col("_b"), "left")
    return by_slug.select("name", F.coalesce("_a", "_b", "_s").alias("canonical"), (F.col("_a").isNull() & F.col("_b").isNull()).alias("minted"))


def replayed(calls: DataFrame, responses: DataFrame, default: str | None = None) -> DataFrame:
    """calls (key, prompt) with the recorded output of the same prompt; empty outputs count as none."""
    own = calls.withColumn("prompt_sha", F.sha2("prompt", 256))
    got = responses.where("trim(output) <> ''").select("prompt_sha", "output")
    return own.join(got, "prompt_sha", "left").withColumn("output", F.coalesce("output", F.lit(default))).drop("prompt")


def selected(passages: DataFrame, picks: DataFrame) -> DataFrame:
    """Passages (doc_id, idx, passage) whose numbers were picked (doc_id, idx), each text once; numbers out of range pick nothing."""
    return passages.join(picks.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_semi").groupBy("doc_id", "passage").agg(F.min("idx").alias("idx"))
