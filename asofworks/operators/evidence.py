"""Dated evidence: threads, contexts, attribution, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import running
from .storage import saved


def thread_roots(posts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) of posts (id, parent, author): up the replies of an author to themselves.

    Pointers double in length each round, so rounds grow with the logarithm of
    the longest thread.
    """
    own = posts.select("id", "parent", "author")
    up = posts.select(F.col("id").alias("parent"), F.col("author").alias("_a"))
    now = saved(own.join(up, "parent", "left").select("id", F.when(F.col("author") == F.col("_a"), F.col("parent")).otherwise(F.col("id")).alias("root")))
    for _ in range(most_rounds):
        further = now.select(F.col("id").alias("root"), F.col("root").alias("_r"))
        new = saved(now.join(further, "root").select("id", "root", "_r"))
        moved = new.where("_r <> root").limit(1).count()
        now = new.select("id", F.col("_r").alias("root"))
        if not moved:
            return now
    raise RuntimeError("a thread loops or is longer than any that can be followed")


def preceding(turns: DataFrame, thread: str, position: str, speaker: str, text: str) -> DataFrame:
    """Each turn with the one before it, if someone else spoke: context."""
    w = W.partitionBy(thread).orderBy(position)
    before = F.lag(F.struct(F.col(speaker).alias("s"), F.col(text).alias("t"))).over(w)
    return turns.withColumn("_b", before).withColumn("context", F.when(F.col("_b.s") != F.col(speaker), F.col("_b.t"))).drop("_b")


def quoted(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """posts (id, quoted_id) with the quoted text as context; context_missing where it is not there."""
    found = posts.join(texts.select(F.col("id").alias("quoted_id"), F.col("text").alias("context")), "quoted_id", "left")
    return found.withColumn("context_missing", F.col("quoted_id").isNotNull() & F.col("context").isNull())


def attribution(authors: Column, subject: Column) -> Column:
    """1 for the only author, one half for one of several; null for others."""
    return F.when(F.array_contains(authors, subject), F.when(F.size(authors) == 1, 1.0).otherwise(0.5))


def identity_as_of(profiles: DataFrame, t: Column, roles: str = "roles") -> DataFrame:
    """Profiles with roles (title, start, end) begun by t, and the current one: of those still open the latest, else the latest of all."""
    known = F.filter(roles, lambda x: x["start"].isNull() | (x["start"] <= t))
    keyed = lambda rows: F.transform(rows, lambda x: F.struct(x["start"].alias("start"), x["title"].alias("title")))
    active = F.filter("_known", lambda x: x["end"].isNull() | (x["end"] > t))
    own = profiles.withColumn("_known", known)
    return own.withColumn("current_role", F.coalesce(F.array_max(keyed(active))["title"], F.array_max(keyed(F.col("_known")))["title"])).withColumn("n_known", F.size("_known")).drop("_known")


def union_all(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the smallest order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def batches(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, order, batch): within a key a batch is filled in order until the next row would pass the budget.

    A batch's first row with a size goes in, however large it is. From running
    sums each row knows which row would begin the next batch if it began one;
    from a key's first row on these pointers are followed, twice as far each
    round, so a key of any size takes as many rounds as the logarithm of its
    batches, and no key has to fit one task.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.lit(1).alias("_one"))
    rows = saved(running(rows, ["_key"], ["_order"], {"_end": "_size", "_at": "_one"}))
    # how many rows end at or below a sum: rows and questions in one order
    start = F.col("_end") - F.col("_size")
    asked = F.explode(F.array(F.struct(start.alias("v"), F.lit("zero").alias("kind")), F.struct((start + budget).alias("v"), F.lit("full").alias("kind")), F.struct(F.col("_end").alias("v"), F.lit("").alias("kind"))))
    both = rows.select("_key", "_at", asked.alias("x")).select("_key", "_at", F.col("x.v").alias("_v"), F.col("x.kind").alias("_kind"), (F.col("x.kind") != "").cast("int").alias("_late"), (F.col("x.kind") == "").cast("int").alias("_is"))
    told = running(both, ["_key"], ["_v", "_late"], {"_n": "_is"}).where("_late = 1")
    upto = told.groupBy("_key", "_at").agg(F.max(F.when(F.col("_kind") == "zero", F.col("_n"))).alias("_zero"), F.max(F.when(F.col("_kind") == "full", F.col("_n"))).alias("_full"))
    # the first row with a size always goes in, the first one beyond the budget begins the next batch
    jump = saved(upto.select("_key", "_at", F.greatest(F.col("_zero") + 2, F.col("_full") + 1).alias("_next")))
    starts, step = saved(jump.where("_at = 1").select("_key", "_at", F.lit(0).alias("batch"))), 1
    while True:
        new = starts.join(jump, ["_key", "_at"]).select("_key", F.col("_next").alias("_at"), (F.col("batch") + step).alias("batch"))
        new = saved(new.join(rows.select("_key", "_at"), ["_key", "_at"], "left_semi"))
        if not new.limit(1).count():
            break
        starts = saved(starts.unionByName(new))
        further = jump.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
        jump, step = saved(jump.join(further, ["_key", "_next"]).select("_key", "_at", F.col("_then").alias("_next"))), 2 * step
    begun = rows.join(starts.select("_key", "_at", F.lit(1).alias("_begins")), ["_key", "_at"], "left").withColumn("_begins", F.coalesce("_begins", F.lit(0)))
    return running(begun, ["_key"], ["_at"], {"_b": "_begins"}).select(F.col("_key").alias(key), F.col("_order").alias(order), (F.col("_b") - 1).cast("int").alias("batch"))


def chunks(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / k).cast("int"))


def even_sample(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """At most k rows of a key, evenly spread from its first to its last."""
    own = df.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return own.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def anchors(dates: DataFrame, anchor_dates: DataFrame) -> DataFrame:
    """(as_of, anchor): the latest anchor at or before the date, else the first."""
    a = anchor_dates.select(F.col("anchor").alias("_at"), F.col("anchor")).distinct()
    both = a.unionByName(dates.select(F.col("as_of").alias("_at"), F.lit(None).cast(a.schema["anchor"].dataType).alias("anchor")).distinct())
    # in order of dates, anchors first: a row a date
    found = both.withColumn("_last", F.last("anchor", ignorenulls=True).over(W.orderBy("_at", F.col("anchor").asc_nulls_last()))).where("anchor IS NULL").select(F.col("_at").alias("as_of"), F.col("_last").alias("anchor"))
    first = anchor_dates.agg(F.min("anchor").alias("_first"))
    return found.crossJoin(F.broadcast(first)).select("as_of", F.coalesce("anchor", "_first").alias("anchor"))


def merged_identities(a: DataFrame, b: DataFrame, key: str = "slug") -> DataFrame:
    """Two sources of profiles (key, bio, title) as one; the longer biography, and the first source's title where there is one."""
    x = a.select(key, F.col("bio").alias("_ba"), F.col("title").alias("_ta"))
    y = b.select(key, F.col("bio").alias("_bb"), F.col("title").alias("_tb"))
    longer = F.when(F.coalesce(F.length("_bb"), F.lit(0)) > F.coalesce(F.length("_ba"), F.lit(0)), F.col("_bb")).otherwise(F.col("_ba"))
    return x.join(y, key, "full").select(key, longer.alias("bio"), F.coalesce("_ta", "_tb").alias("title"))
