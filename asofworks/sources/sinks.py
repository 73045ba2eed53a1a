"""Writers of the library's file layouts. Each can be run again: what is there stays, or is replaced whole, as its docstring says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import POST_COLUMNS, exists


def save_series(frames: DataFrame, folder: str, series: str) -> None:
    """frames (symbol, date, ...) as a table for each symbol, folder/<symbol>_<series>_1d.parquet; those of the symbols at hand are replaced.

    One job writes all symbols: rows are dealt by symbol, and each symbol's
    folder is then named.
    """
    spark = frames.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged = f"{folder}/_staged_{series}"
    frames.withColumn("_name", F.col("symbol")).repartition("_name").write.partitionBy("_name").mode("overwrite").parquet(staged)
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(conf)
    for status in fs.listStatus(path(staged)):  # a folder a symbol
        name = status.getPath().getName()
        if name.startswith("_name="):
            to = path(f"{folder}/{name[6:]}_{series}_1d.parquet")
            fs.delete(to, True)
            fs.rename(status.getPath(), to)
    fs.delete(path(staged), True)


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not done: what is left to do after a stop."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def save_once(rows: DataFrame, path: str, keys: list[str], kind: str = "parquet", order: str | None = None) -> int:
    """Appends the rows whose keys the table at path lacks, one for each key, and says how many; nothing that is there is written again.

    Of several rows of a key that with the least order stays (a column that is
    not written); without an order they must be equal, else any one stays.
    """
    spark = rows.sparkSession
    if order:
        first = F.min_by(F.struct(*[c for c in rows.columns if c != order]), F.struct(F.col(order).isNull(), order))  # rows without an order last
        own = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_x")).select("_x.*")
        rows = rows.drop(order)
    else:
        own = rows.dropDuplicates(keys)
    if exists(spark, path):
        own = missing(own, spark.read.format(kind).schema(rows.schema).load(path), keys)
    before = count(spark, path, rows, kind)
    own.write.format(kind).mode("append").save(path)
    return count(spark, path, rows, kind) - before


def count(spark: SparkSession, path: str, rows: DataFrame, kind: str) -> int:
    return spark.read.format(kind).schema(rows.schema).load(path).count() if exists(spark, path) else 0


def append_lines(rows: DataFrame, path: str) -> None:
    """Each row as a JSON line, behind what is there."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def save_views(views: DataFrame, root: str) -> None:
    """views (member, as_of, items) as root/<member>/periods/<date>.json; files that are there stay."""
    spark = views.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    staged = f"{root}/_staged"
    named = views.select("items", F.col("as_of").cast("string").alias("as_of"), F.col("member").alias("_m"), F.col("as_of").cast("string").alias("_t"))
    named.repartition("_m", "_t").write.partitionBy("_m", "_t").mode("overwrite").json(staged)
    fs = path(staged).getFileSystem(conf)
    for member in fs.listStatus(path(staged)):
        if not member.getPath().getName().startswith("_m="):
            continue
        home = f"{root}/{member.getPath().getName()[3:]}/periods"
        fs.mkdirs(path(home))
        for day in fs.listStatus(member.getPath()):
            to = path(f"{home}/{day.getPath().getName()[3:]}.json")
            for part in fs.listStatus(day.getPath()):
                if part.getPath().getName().startswith("part-") and not fs.exists(to):
                    fs.rename(part.getPath(), to)
    fs.delete(path(staged), True)


def save_posts(posts: DataFrame, path: str) -> None:
    """Posts with typed columns in a fixed order; a missing column is null."""
    own = [(F.col(c) if c in posts.columns else F.lit(None)).cast(t).alias(c) for c, t in POST_COLUMNS.items()]
    posts.select(*own).write.mode("overwrite").parquet(path)


def save_reconciled(panel: DataFrame, source: str, target: str) -> None:
    """A panel's corrected copy beside it; the source is never written to."""
    jvm = panel.sparkSession.sparkContext._jvm
    conf = panel.sparkSession.sparkContext._jsc.hadoopConfiguration()
    full = []
    for x in (source, target):
        p = jvm.org.apache.hadoop.fs.Path(x)
        full.append(p.getFileSystem(conf).makeQualified(p).toString().rstrip("/") + "/")
    if full[0].startswith(full[1]) or full[1].startswith(full[0]):
        raise ValueError("the target would overwrite the source")
    panel.write.mode("overwrite").parquet(target)


def save_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON line, in place of the old one."""
    registry.coalesce(1).write.mode("overwrite").json(path)


def save_roster(people: DataFrame, path: str) -> None:
    """people (slug, name, x_handle, linkedin_url) as a YAML list, a person a line."""
    line = F.concat(F.lit("- "), F.to_json(F.struct("slug", "name", "x_handle", "linkedin_url")))  # JSON is YAML
    people.select(line.alias("value")).write.text(path)
