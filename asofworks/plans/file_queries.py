"""Queries that write the library's file layouts and read them again, with DuckDB SQL for the same rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from asofworks.functions import text as X
from asofworks.operators import corpus, evidence
from asofworks.operators.storage import shared_folder
from asofworks.sources import committed, files, published, sinks

from . import derived as D
from .derived import sql, table
from .text_queries import DAY, STRIP, T, docs, t0

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def place(spark, name: str) -> str:
    """A new folder for what a query writes."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query(sql("SELECT symbol, date, close FROM market", "market"))
def close_panel_files(spark, d):
    folder = place(spark, "market")
    sinks.save_series(D.market(spark, d).select("symbol", "date", "close"), folder, "ohlcv")
    sinks.save_series(D.market(spark, d).select("symbol", "date", F.col("oi").alias("close")), folder, "oi")  # another series beside it
    return files.close_panel(spark, folder)


PASSAGES = f"SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST({DAY} AS VARCHAR) AS date, md5(text) AS passage FROM documents WHERE doc_id % 3 <> 0"


def cache(spark, d) -> str:
    """A cache of passages: all documents', then again those of every third with none, which therefore have none."""
    path = place(spark, "distillates")
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("object_id"), F.array(F.struct(F.col("day").cast("string").alias("date"), F.md5("text").alias("passage"))).alias("passages"), "doc_id")
    sinks.append_lines(own.select("object_id", "passages"), path)
    sinks.append_lines(own.where("doc_id % 3 = 0").select("object_id", F.expr("filter(passages, x -> false)").alias("passages")), path)
    return path


@query(PASSAGES)
def distillate_cache(spark, d):
    return files.distillates(spark, cache(spark, d)).select("object_id", F.inline("passages"))


@query(f"SELECT source AS handle, CAST({DAY} AS VARCHAR) AS date, md5(text) AS text FROM documents")
def kept_post_cache(spark, d):
    path = place(spark, "posts")
    own = docs(spark, d).withColumn("batch", F.pmod("doc_id", F.lit(50)).cast("int"))
    kept = own.groupBy(F.col("source").alias("handle"), "batch").agg(F.collect_list(F.struct(F.col("day").cast("string").alias("date"), F.md5("text").alias("text"))).alias("kept"))
    sinks.append_lines(kept, path)
    return files.kept_posts(spark, path)


@query(sql("SELECT member, as_of, item, stance_sign, conviction FROM views WHERE item_type = 'sector'", "views"))
def member_view_files(spark, d):
    root = place(spark, "members")
    stance = F.when(F.col("stance_sign") > 0, "bullish").when(F.col("stance_sign") < 0, "bearish").otherwise("neutral")
    own = D.views(spark, d).where("item_type = 'sector'")
    views = own.groupBy("member", "as_of").agg(F.collect_list(F.struct(F.col("item").alias("name"), "item_type", "parent_sector", stance.alias("stance"), "conviction")).alias("items"))
    sinks.save_views(views, root)
    sinks.save_views(views.withColumn("items", F.expr("filter(items, x -> false)")), root)  # what is there stays
    read = files.member_views(spark, root).select("member", "as_of", F.inline("items"))
    return read.select("member", "as_of", F.col("name").alias("item"), F.when(F.col("stance") == "bullish", 1).when(F.col("stance") == "bearish", -1).otherwise(0).alias("stance_sign"), "conviction")


@query("SELECT conv_id || ':' || turn AS id, md5(text) AS text, CASE WHEN lag(role) OVER w <> role THEN md5(lag(text) OVER w) END AS context, CAST(DATE '2020-01-01' + CAST(conv_id % 1500 AS INTEGER) AS DATE) AS day FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user' AND turn % 5 <> 3 AND turn % 7 <> 2")
def podcast_segments(spark, d):
    path = place(spark, "podcast")
    c = table(spark, d, "conversations")
    segment = F.struct("turn", F.struct(F.col("turn").cast("long").alias("idx"), F.col("role").alias("slug"), "text", (F.col("turn") % 5 != 3).alias("kept"), F.when(F.col("turn") % 7 == 2, 0.5).otherwise(0.9).alias("confidence")).alias("s"))
    talks = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(segment)), lambda x: x["s"]).alias("segments"), F.collect_set("role").alias("participants"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("conv_id", F.lit(1500)).cast("int"))
    sinks.append_lines(talks.select(F.col("conv_id").cast("string").alias("object_id"), day.cast("string").alias("post_date"), "participants", "segments"), path)
    said = files.podcast(spark, path, "user")
    return said.select("id", "day", F.md5("text").alias("text"), F.md5("context").alias("context"))


@query("SELECT s.sectors, t.tokens, p.parents FROM (SELECT array_agg(r_name ORDER BY r_name) AS sectors FROM region) s, (SELECT array_agg(n_name ORDER BY n_name) AS tokens FROM nation) t, (SELECT array_agg(n_name || '=' || r_name ORDER BY n_name) AS parents FROM nation JOIN region ON n_regionkey = r_regionkey) p")
def registry_file(spark, d):
    path = place(spark, "registry")
    sectors = table(spark, d, "region").agg(F.sort_array(F.collect_list("r_name")).alias("sectors"))
    seed = sectors.select("sectors", F.array().cast("array<string>").alias("tokens"), F.create_map().cast("map<string,string>").alias("token_parent"))
    own = D.sectors(spark, d).select(F.col("symbol").alias("token"), F.col("sector").alias("parent_sector"))
    sinks.save_registry(files.minted(files.registry(spark, path, seed), own.where("token < 'J'")), path)
    # the second round begins with what was saved, not with the seed
    whole = files.minted(files.registry(spark, path, seed.where("false")), own)
    parents = F.transform(F.array_sort(F.map_entries("token_parent")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return whole.select("sectors", F.array_sort("tokens").alias("tokens"), parents.alias("parents"))


@query("SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
def save_once_twice(spark, d):
    path = place(spark, "once")
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    sinks.save_once(own.where("key % 3 <> 0"), path, ["key"])
    again = own.select("key", F.lit(0).cast(own.schema["price"].dataType).alias("price"), F.lit(1).alias("round"))
    both = own.withColumn("round", F.lit(0)).unionByName(again)
    sinks.save_once(both.where("key % 3 = 0 OR price > 0"), path, ["key"], order="round")
    return spark.read.parquet(path)


@query("SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at, event_type AS type, CAST(user_id AS VARCHAR) AS author_id FROM events")
def post_table(spark, d):
    path = place(spark, "posts")
    e = table(spark, d, "events")
    sinks.save_posts(e.select(F.col("user_id").alias("author_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("type")), path)
    return spark.read.parquet(path).select("id", "created_at", "type", "author_id")


@query(f"SELECT d.doc_id, d.source, p.date AS day, p.passage FROM documents d JOIN ({PASSAGES}) p ON p.object_id = CAST(d.doc_id AS VARCHAR) WHERE {DAY} > DATE '2022-06-30' AND {DAY} <= DATE '{T}' AND CAST(p.date AS DATE) > DATE '2022-06-30' AND CAST(p.date AS DATE) <= DATE '{T}'")
def article_passages(spark, d):
    articles = docs(spark, d).select(F.col("doc_id").cast("string").alias("object_id"), "doc_id", "source", F.col("day").alias("post_date"))
    found = corpus.article_passages(articles, files.distillates(spark, cache(spark, d)), t0(), 6)
    return found.select("doc_id", "source", F.col("date").cast("string").alias("day"), "passage")


@query(f"SELECT object_id, {DAY} AS post_date FROM ({PASSAGES}) p JOIN documents ON CAST(doc_id AS VARCHAR) = object_id")
def post_dates(spark, d):
    articles = docs(spark, d).select(F.col("doc_id").cast("string").alias("object_id_join"), F.col("day").alias("post_date"))
    cached = files.distillates(spark, cache(spark, d)).where(F.size("passages") > 0)
    return corpus.with_post_date(cached, articles).select("object_id", "post_date")


THREADS = "posts AS (SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN lag(event_id) OVER w END AS parent, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), up AS (SELECT id, id AS root FROM posts WHERE parent IS NULL UNION ALL SELECT p.id, u.root FROM posts p JOIN up u ON p.parent = u.id)"


@query(f"WITH RECURSIVE {THREADS} SELECT root, count(*) AS n, md5(string_agg('post ' || id, chr(10) || chr(10) ORDER BY ts, id)) AS text FROM up JOIN posts USING (id) GROUP BY root")
def thread_texts(spark, d):
    from pyspark.sql import Window as W

    from asofworks.operators import evidence

    e = table(spark, d, "events")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    posts = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), before).alias("parent"), F.col("user_id").alias("author"), "ts", F.concat(F.lit("post "), F.col("event_id").cast("string")).alias("text"))
    merged = corpus.thread_texts(posts.select("id", "ts", "text"), evidence.thread_roots(posts), order="ts")
    return merged.select("root", "n", F.md5("text").alias("text"))


@query(f"SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'retweet' WHEN event_id % 11 = 0 THEN NULL ELSE 'original' END AS type, CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS said, repeat('x', CAST(event_id % 90 AS INTEGER)) AS body FROM events) WHERE coalesce(type, '') <> 'retweet' AND TRY_CAST(said AS DATE) >= (SELECT CAST(min(ts) AS DATE) + 2 FROM events) AND length(body) >= 50")
def post_filters(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.to_date("ts").cast("string"))
    own = e.select("event_id", F.when(F.col("event_type") == "signup", "retweet").when(F.col("event_id") % 11 != 0, "original").alias("type"), said.alias("said"), F.expr("repeat('x', cast(event_id % 90 as int))").alias("body"))
    floor = e.agg(F.date_add(F.to_date(F.min("ts")), 2).alias("_floor"))
    kept = corpus.since(corpus.without_reposts(own).crossJoin(F.broadcast(floor)), "said", F.col("_floor"), "body", 50)
    return kept.select("event_id")


@query("SELECT c_custkey AS permalink, c_mktsegment AS title, n, CAST(total AS DOUBLE) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def metadata_with_content(spark, d):
    content = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("permalink")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return corpus.with_content(table(spark, d, "customer").select(F.col("c_custkey").alias("permalink"), F.col("c_mktsegment").alias("title")), content, "permalink")


@query(f"SELECT source, n, row_number() OVER (ORDER BY ret DESC NULLS LAST, source) AS place FROM (SELECT source, count(*) AS n, CASE WHEN count_if({STRIP.format('text')} = '') = 0 AND count(*) % 2 = 0 THEN count(*) % 17 END AS ret FROM documents GROUP BY source)")
def digest_order(spark, d):
    own = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.trim(F.regexp_replace(F.regexp_replace("text", r"https?://\S+", ""), r"@\w+", "")) == "").alias("e"))
    own = own.select("source", "n", F.when((F.col("e") == 0) & (F.col("n") % 2 == 0), F.col("n") % 17).alias("ret"))
    return corpus.leading_first(own, "ret", "source").select("source", "n", F.col("place").cast("long").alias("place"))


@query(sql("SELECT symbol, date, close FROM market WHERE date < DATE '1996-01-01' OR sector <> 'REGION_0' UNION ALL SELECT symbol, date, oi FROM market WHERE sector = 'REGION_0' AND date >= DATE '1996-01-01'", "market"))
def series_committed(spark, d):
    """Closes, saved twice; then a job that stops before it is known; then other values of one sector's symbols; then merged."""
    root = place(spark, "series")
    own = D.market(spark, d).select("symbol", "sector", "date", F.col("close").alias("value"), "oi")
    for _ in range(2):
        committed.save_series(own, root, "close", "all closes")
    lost = own.withColumn("value", F.lit(0.0)).select(F.lit("close").alias("series"), "symbol", "date", "value")
    published.written(published.Log(spark, root), {"series": lost})
    value = F.when(F.col("date") < F.lit("1996-01-01").cast("date"), F.col("value")).otherwise(F.col("oi"))
    committed.save_series(own.where("sector = 'REGION_0'").withColumn("value", value), root, "close", "one sector")
    committed.compact_series(spark, root)
    return committed.series(spark, root, "close").withColumnRenamed("value", "close")


@query(sql("SELECT * FROM panel", "panel"))
def panel_committed(spark, d):
    """A run's panel, dispersion and returns in one commit; an earlier run stays behind it."""
    root = place(spark, "signals")
    tables = {"panel": D.panel(spark, d), "dispersion": D.dispersion(spark, d), "returns": D.monthly(spark, d)}
    committed.save_signals({name: rows.limit(0) for name, rows in tables.items()}, root, "first")
    committed.save_signals(tables, root, "second")
    committed.save_signals({"returns": tables["returns"]}, root, "returns alone")
    return committed.signals(spark, root, "panel", tables["panel"].schema)


@query(sql("SELECT member, as_of, count(*) AS n, CAST(sum(conviction) AS BIGINT) AS conviction FROM views GROUP BY ALL", "views"))
def views_committed(spark, d):
    """Views of each member and month with sectors and tokens, saved in two runs that overlap; what the first one saved stays."""
    root = place(spark, "views")
    v = D.views(spark, d)
    item = F.struct(F.col("item").alias("name"), "item_type", "parent_sector", F.when(F.col("stance_sign") > 0, "bullish").when(F.col("stance_sign") < 0, "bearish").otherwise("neutral").alias("stance"), "conviction")
    own = v.groupBy("member", "as_of").agg(F.collect_list(item).alias("items"))  # a member's items of a month
    committed.save_views(own.where("month(as_of) % 2 = 0"), root, "even months")
    again = own.withColumn("items", F.when(F.month("as_of") % 2 == 0, F.slice("items", 1, 0)).otherwise(F.col("items")))
    committed.save_views(again, root, "all months")
    sums = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["conviction"])
    return committed.views(spark, root).select("member", "as_of", F.size("items").cast("long").alias("n"), sums.alias("conviction"))


@query(f"SELECT source AS slug, 'document' AS source_type, CAST(doc_id AS VARCHAR) AS id, {DAY} AS day, md5(text) AS digest, source || ' itself' AS name FROM documents WHERE {DAY} <= DATE '{T}'")
def evidence_committed(spark, d):
    """Evidence of each source with its identity, saved anew for some, read as of a day."""
    root = place(spark, "evidence")
    own = docs(spark, d).select(F.col("source").alias("slug"), F.to_timestamp("day").alias("timestamp"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("id"), "text")
    people = own.select("slug").distinct().withColumn("name", F.concat("slug", F.lit(" itself"))).withColumn("bio", F.lit(None).cast("string"))
    early = F.col("slug") < "source_3"
    committed.save_evidence(own.where(early).withColumn("text", F.lit("old")), people.where(early).withColumn("name", F.lit("old")), root, "first")
    committed.save_evidence(own, people, root, "second")
    known = committed.evidence(spark, root, t0()).join(committed.identities(spark, root), "slug")
    return known.select("slug", "source_type", "id", F.to_date("timestamp").alias("day"), F.md5("text").alias("digest"), F.get_json_object("identity", "$.name").alias("name"))


@query(PASSAGES)
def distillates_numbered(spark, d):
    """The cache of passages as a numbered log: two appends at once, a repeated one, and a merge in between."""
    root = place(spark, "passages")
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("object_id"), F.array(F.struct(F.col("day").cast("string").alias("date"), F.md5("text").alias("passage"))).alias("passages"), "doc_id")
    committed.append_passages(own.withColumn("passages", F.expr("filter(passages, x -> false)")), root, "empty", "doc_id")
    committed.append_passages(own, root, "all", "doc_id")
    committed.compact_passages(spark, root)
    committed.append_passages(own.where("doc_id % 3 = 0").withColumn("passages", F.expr("filter(passages, x -> false)")), root, "every third", "doc_id")
    committed.append_passages(own, root, "all", "doc_id")  # it was there: not written again
    return committed.passages(spark, root).select("object_id", F.inline("passages"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at, event_type AS type, props AS text, CAST(NULL AS VARCHAR) AS lang, CAST(user_id AS VARCHAR) AS author_id, 'u' || user_id AS author_username, CAST(NULL AS VARCHAR) AS author_name, CAST(NULL AS BIGINT) AS reply_count, CAST(NULL AS BIGINT) AS retweet_count, CAST(floor(value) AS BIGINT) AS like_count, CAST(NULL AS BIGINT) AS quote_count, CAST(NULL AS BIGINT) AS view_count, CAST(NULL AS BIGINT) AS bookmark_count, CAST(user_id AS VARCHAR) AS conversation_id, CAST(NULL AS VARCHAR) AS in_reply_to_id, CAST(NULL AS VARCHAR) AS in_reply_to_user_id, CAST(NULL AS VARCHAR) AS in_reply_to_username, CAST(NULL AS VARCHAR) AS quoted_id, CAST(NULL AS VARCHAR) AS retweeted_id, 'https://x.example/' || user_id || '/' || event_id AS url, '{\"id\":' || event_id || '}' AS raw_json FROM events")
def post_table_whole(spark, d):
    """All columns of a post, written from rows that have some of them, in another order."""
    path = place(spark, "posts")
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    sinks.save_posts(e.select(F.concat(F.lit("https://x.example/"), user, F.lit("/"), F.col("event_id")).alias("url"), F.col("props").alias("text"), F.floor("value").alias("like_count"), user.alias("author_id"), F.concat(F.lit("u"), user).alias("author_username"), user.alias("conversation_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("type"), F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}")).alias("raw_json"), F.lit(1).alias("more")), path)
    return files.posts(spark, path)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS object_id, {DAY} AS post_date, md5(text) AS digest FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL AND trim(text) <> ''")
def article_table(spark, d):
    """Articles written and scanned: those of another status go, and a text is the first one that is not blank."""
    path = place(spark, "articles")
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("object_id"), F.lit("a title").alias("title"), F.when(F.col("doc_id") % 5 == 0, "unavailable").otherwise("ok").alias("status"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00")).alias("post_date"), F.lit("  ").alias("acf_content"), F.col("text").alias("extracted_text"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("transcript"))
    own.write.parquet(path)
    return files.articles(spark, path).select("object_id", "post_date", F.md5("text").alias("digest"))


@query("SELECT slug, bio, title FROM (SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN coalesce(length(b.bio), 0) > coalesce(length(a.bio), 0) THEN b.bio ELSE a.bio END AS bio, coalesce(a.title, b.title) AS title FROM (SELECT c_custkey AS slug, c_mktsegment AS bio, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS slug, substr(s_name || s_name, 1, CAST(s_suppkey % 17 AS INTEGER)) AS bio, s_name AS title FROM supplier) b ON a.slug = b.slug)")
def identity_merge(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("slug"), F.col("c_mktsegment").alias("bio"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.expr("substr(concat(s_name, s_name), 1, cast(s_suppkey % 17 as int))").alias("bio"), F.col("s_name").alias("title"))
    return evidence.merged_identities(a, b)


@query(sql("SELECT as_of, item, stance, CASE stance WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS sign FROM panel", "panel"))
def stance_signs(spark, d):
    return D.panel(spark, d).select("as_of", "item", "stance", X.stance_sign(F.col("stance")).alias("sign"))


@query("SELECT 's' || s_suppkey AS slug, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'h' || s_suppkey END AS x_handle, 'v' || s_suppkey || '.json' AS linkedin_file FROM supplier")
def roster_file(spark, d):
    """A roster of all suppliers, written as YAML and read again."""
    path = place(spark, "roster")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("h"), "s_suppkey")).alias("x_handle"), F.concat(F.lit("https://l.example/in/v"), "s_suppkey", F.lit("/")).alias("linkedin_url"))
    sinks.save_roster(s, path)
    return files.roster(spark, path).select("slug", "name", "x_handle", "linkedin_file")
