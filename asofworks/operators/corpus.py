"""Joins and filters that a dated corpus is put together with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calendar import in_window


def without_reposts(posts: DataFrame, kind: str = "type") -> DataFrame:
    """Posts that repeat no one else's; a post without a type stays."""
    return posts.where(~F.col(kind).eqNullSafe("retweet"))


def since(rows: DataFrame, day: str, floor: Column, text: str, least: int) -> DataFrame:
    """Rows of the floor's day or later with a text of `least` characters; a day that is none is no row."""
    return rows.where((F.try_to_date(F.col(day), "yyyy-MM-dd") >= floor) & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= least))


def attributed(segments: DataFrame, subject: str, least: float = 0.8) -> DataFrame:
    """Segments (slug, kept, confidence) of a subject that are kept and surely the subject's own."""
    return segments.where((F.col("slug") == subject) & F.col("kept") & (F.coalesce("confidence", F.lit(0.0)) >= least))


def article_passages(articles: DataFrame, distillates: DataFrame, t: Column, months: int) -> DataFrame:
    """articles (object_id, post_date, ...) with their passages (date, passage): article and passage both within the window that ends at t."""
    own = articles.where(in_window(F.col("post_date"), t, months))
    passages = distillates.select("object_id", F.inline("passages")).withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))
    return own.join(passages.where(in_window(F.col("date"), t, months)), "object_id")


def with_post_date(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """rows (object_id, ...) with their articles' post_date, null where there is none; the articles' key is object_id or object_id_join."""
    key = "object_id" if "object_id" in articles.columns else "object_id_join"
    own = articles.groupBy(F.col(key).cast("string").alias("object_id")).agg(F.max("post_date").alias("post_date"))
    return rows.join(own, "object_id", "left")


def with_content(metadata: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """All rows of metadata, with their content where it was fetched."""
    return metadata.join(content, key, "left")


def thread_texts(posts: DataFrame, roots: DataFrame, order: str, text: str = "text", between: str = "\n\n") -> DataFrame:
    """(root, n, text): the texts of each thread (roots: id, root), in their order, as one."""
    # a thread is one author's; its posts are the one group that has to come together
    own = posts.join(roots, "id").groupBy("root").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(order), F.col("id"), F.col(text).alias("t")))).alias("posts"))
    return own.select("root", "n", F.array_join(F.transform("posts", lambda x: x["t"]), between).alias("text"))


def leading_first(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """rows of a report with their place: the largest value first, rows without one last."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.col(value).desc_nulls_last(), tie)))


def merged_roster(cards: DataFrame) -> DataFrame:
    """(slug, title, sections) of cards (slug, title, section, place): the first card's title, and all sections in the page's order, each once."""
    firsts = cards.groupBy("slug", "section").agg(F.min("place").alias("_at"), F.min_by("title", "place").alias("_t"))
    merged = firsts.groupBy("slug").agg(F.min_by("_t", "_at").alias("title"), F.sort_array(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("_at", "section")))).alias("_s"))
    return merged.select("slug", "title", F.transform("_s", lambda x: x["section"]).alias("sections"))


def news(told: DataFrame, raw: DataFrame, between: str = "\n") -> DataFrame:
    """(day, news): a day's told lines (day, place, line), or its raw headlines where nothing was told."""
    both = told.withColumn("_k", F.lit(0)).unionByName(raw.withColumn("_k", F.lit(1)))
    # a day's headlines are few; the lines of the better kind are what is joined
    lines = both.groupBy("day", "_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), between).alias("news"))
    return lines.groupBy("day").agg(F.min_by("news", "_k").alias("news"))
