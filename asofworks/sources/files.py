"""Readers of the library's file layouts, as DataFrames.

Paths go through Spark's readers, so any file system that Spark knows will do.
A folder without matching files gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A post's columns, in their order.
POST_COLUMNS = {
    "id": "string",
    "created_at": "timestamp",
    "type": "string",
    "text": "string",
    "lang": "string",
    "author_id": "string",
    "author_username": "string",
    "author_name": "string",
    "reply_count": "long",
    "retweet_count": "long",
    "like_count": "long",
    "quote_count": "long",
    "view_count": "long",
    "bookmark_count": "long",
    "conversation_id": "string",
    "in_reply_to_id": "string",
    "in_reply_to_user_id": "string",
    "in_reply_to_username": "string",
    "quoted_id": "string",
    "retweeted_id": "string",
    "url": "string",
    "raw_json": "string",
}

PASSAGES = "array<struct<date: string, passage: string>>"
ITEM = "struct<name: string, item_type: string, parent_sector: string, stance: string, conviction: int>"
SEGMENTS = "array<struct<idx: long, slug: string, text: string, kept: boolean, confidence: double>>"
REGISTRY = "sectors array<string>, tokens array<string>, token_parent map<string, string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder? Asked of the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def close_panel(spark: SparkSession, folder: str, series: str = "ohlcv", value: str = "close", glob: str | None = None) -> DataFrame:
    """(symbol, date, value) from files or tables named <symbol>_<series>_1d.parquet; a row for each day of each file."""
    name = glob or f"*_{series}_1d.parquet"
    own = spark.read.schema(f"date date, {value} double").option("recursiveFileLookup", "true").parquet(folder)
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, rf"([^/]+)_{series}_1d\.parquet(?:/[^/]*)?$", 1)
    if glob is not None:
        own = own.where(path.rlike(name))
    return own.select(F.url_decode(found).alias("symbol"), "date", value).where("symbol <> ''")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at): lines that are not blank; at orders them: later files after earlier ones, and by place within a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string, at struct<modified: timestamp, file: string, block: long, row: long>")
    own = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    return own.where(F.trim("line") != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of schema of each line, and at."""
    return lines(spark, path).select(F.from_json("line", schema).alias("x"), "at").select("x.*", "at")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row that was written last."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "at")]), "at").alias("x"))
    return last.select(key, "x.*")


def distillates(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, passages) of a cache that only grows: a later line of an id takes the place of an earlier one."""
    return latest(json_lines(spark, path, f"object_id string, passages {PASSAGES}"), "object_id")


def kept_posts(spark: SparkSession, path: str) -> DataFrame:
    """(handle, date, text) of all kept posts of a cache of batches."""
    own = json_lines(spark, path, "handle string, batch int, kept array<struct<date: string, text: string>>")
    return own.select("handle", F.inline("kept"))


def member_views(spark: SparkSession, root: str) -> DataFrame:
    """(member, as_of, items) from files <member>/periods/<date>.json."""
    own = spark.read.schema(f"as_of date, items array<{ITEM}>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    path, place = F.col("_metadata.file_path"), r"([^/]+)/periods/(\d{4}-\d{2}-\d{2})\.json"
    return own.select(F.url_decode(F.regexp_extract(path, place, 1)).alias("member"), F.try_to_date(F.nullif(F.regexp_extract(path, place, 2), F.lit("")), "yyyy-MM-dd").alias("as_of"), "items").where("as_of IS NOT NULL")


def podcast(spark: SparkSession, path: str, subject: str, least: float = 0.8) -> DataFrame:
    """(id, day, text, context) of the segments that the subject speaks, that are kept, and whose attribution has a confidence of `least`.

    context: what someone else said just before.
    """
    own = json_lines(spark, path, f"object_id string, post_date string, participants array<string>, segments {SEGMENTS}")
    turns = own.where(F.array_contains("participants", subject)).select("object_id", F.to_date(F.try_to_timestamp("post_date")).alias("day"), "segments", F.posexplode("segments").alias("place", "s"))
    before = F.when(F.col("place") > 0, F.col("segments")[F.col("place") - 1])
    told = turns.where((F.col("s.slug") == subject) & F.col("s.kept") & (F.coalesce("s.confidence", F.lit(0.0)) >= least))
    return told.select(F.concat_ws(":", "object_id", F.col("s.idx").cast("string")).alias("id"), "day", F.col("s.text").alias("text"), F.when(F.coalesce(before["slug"], F.lit("")) != subject, before["text"]).alias("context"))


def registry(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """(sectors, tokens, token_parent): the saved registry, or the seed where none is saved."""
    return spark.read.schema(REGISTRY).option("multiLine", "true").json(path) if exists(spark, path) else seed


def minted(current: DataFrame, tokens: DataFrame) -> DataFrame:
    """The registry with tokens (token, parent_sector) added behind those it has; a named parent replaces the old one."""
    new = tokens.groupBy("token").agg(F.max("parent_sector").alias("parent"))
    told = new.agg(F.sort_array(F.collect_list("token")).alias("_t"), F.map_from_entries(F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("token", "parent")))).alias("_p"))
    both = current.crossJoin(F.broadcast(told))  # one row each
    parents = F.map_concat(F.map_filter("token_parent", lambda k, _: ~F.array_contains(F.map_keys("_p"), k)), "_p")
    return both.select("sectors", F.array_union("tokens", "_t").alias("tokens"), parents.alias("token_parent"))


PERSON = "slug string, name string, x_handle string, linkedin_url string"


def roster(spark: SparkSession, path: str) -> DataFrame:
    """(slug, name, x_handle, linkedin_url, linkedin_file) of YAML rosters: lists of people, at the top or under `people`, a document a file; needs PyYAML.

    A person without a name is named by the slug. Files are parsed where they are read.
    """

    def people(batches):
        import pandas as pd
        import yaml

        columns = [c.split()[0] for c in PERSON.split(", ")]
        for batch in batches:
            for text in batch["value"]:
                told = yaml.safe_load(text) or []
                own = told["people"] if isinstance(told, dict) else told
                yield pd.DataFrame([[p["slug"], p.get("name") or p["slug"], p.get("x_handle"), p.get("linkedin_url")] for p in own], columns=columns)

    own = spark.read.text(path, wholetext=True).mapInPandas(people, PERSON)
    return own.withColumn("linkedin_file", vanity_file(F.col("linkedin_url")))


def vanity_file(url: Column) -> Column:
    """The name of a profile's file: the last part of its address."""
    last = F.regexp_extract(url, r"([^/]+)/*$", 1)
    return F.when(last != "", F.concat(last, F.lit(".json")))


def subject(people: DataFrame, slug: str) -> DataFrame:
    """The one person; KeyError if there is none."""
    found = people.where(F.col("slug") == slug).limit(1)
    if not found.count():
        raise KeyError(f"no subject {slug!r}")
    return found


def posts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table of posts with its typed columns, or those named: only they are read. A column that the files lack is null."""
    kind = ", ".join(f"{c} {t}" for c, t in POST_COLUMNS.items() if columns is None or c in columns)
    return spark.read.schema(kind).parquet(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, title, status, post_date, text) of articles or transcripts that have a text; the day is null where it is none."""
    kind = "object_id string, title string, status string, post_date string, transcript string, acf_content string, extracted_text string"
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    text = F.coalesce(filled("transcript"), filled("acf_content"), filled("extracted_text"))
    own = spark.read.schema(kind).parquet(path).where(F.coalesce("status", F.lit("ok")) == "ok")
    return own.select("object_id", "title", "status", F.try_to_date(F.substring("post_date", 1, 10), "yyyy-MM-dd").alias("post_date"), text.alias("text")).where("text IS NOT NULL")
