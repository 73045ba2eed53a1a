"""Queries of posts, addresses and rosters, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofworks.functions import posts as P
from asofworks.operators import corpus

from .derived import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'retweet' WHEN event_id % 3 = 0 THEN 'quote' WHEN event_id % 2 = 0 THEN 'reply' ELSE 'original' END AS type FROM events")
def post_precedence(spark, d):
    """Nested posts as JSON, read back and told apart."""
    e = table(spark, d, "events")
    inner = lambda n: F.when(F.col("event_id") % n == 0, F.struct(F.col("user_id").cast("string").alias("id")))
    said = e.select("event_id", F.to_json(F.struct(inner(5).alias("retweeted_tweet"), inner(3).alias("quoted_tweet"), F.when(F.col("event_id") % 2 == 0, True).alias("isReply"))).alias("j"))
    read = said.select("event_id", F.from_json("j", "retweeted_tweet struct<id: string>, quoted_tweet struct<id: string>, isReply boolean").alias("x"))
    return read.select("event_id", P.post_type(F.col("x.retweeted_tweet"), F.col("x.quoted_tweet"), F.col("x.isReply")).alias("type"))


@query("SELECT page_id, CASE WHEN contains(url, '://www.example.com/') THEN replace(url, '://www.example.com/', '://m.example.com/') WHEN contains(url, '://m.example.com/') THEN replace(url, '://m.example.com/', '://www.example.com/') END AS other FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://[^/]+/', 'https://www.example.com/') WHEN 1 THEN regexp_replace(url, '^[a-z]+://[^/]+/', 'https://m.example.com/') ELSE url END AS url FROM pages)")
def alternate_hosts(spark, d):
    to = lambda h: F.regexp_replace("url", "^[a-z]+://[^/]+/", f"https://{h}/")
    own = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, to("www.example.com")).when(F.col("page_id") % 3 == 1, to("m.example.com")).otherwise(F.col("url")).alias("url"))
    return own.select("page_id", P.alternate_host(F.col("url"), "www.example.com", "m.example.com").alias("other"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'farcaster' WHEN 2 THEN 'github' WHEN 3 THEN lower(c_mktsegment) ELSE 'other' END AS platform, 'user-' || c_custkey AS slug FROM customer")
def platforms(spark, d):
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, " Twitter ").when(k == 3, F.col("c_mktsegment"))
    host = F.when(k == 1, "WWW.warpcast.com").when(k == 2, "github.com").otherwise("nowhere.example")
    own = table(spark, d, "customer").select("c_custkey", label.alias("label"), F.concat(F.lit("https://"), host, F.lit("/in/user-"), F.col("c_custkey").cast("string"), F.lit("/")).alias("url"))
    return own.select("c_custkey", P.platform(F.col("label"), F.col("url")).alias("platform"), P.vanity_slug(F.col("url")).alias("slug"))


@query("SELECT event_id, round(8 * power(2.5, event_id % 4) * (0.7 + 0.6 * CAST('0x' || substr(sha1(user_id || '-' || event_id % 4), 1, 4) AS INTEGER) / 65535), 6) AS seconds FROM events")
def retry_delays(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(P.retry_delay(F.col("user_id").cast("string"), F.col("event_id") % 4), 6).alias("seconds"))


SAID = "'„' || text || '‟ ‛a′ ― b″…'"
FOLD = "translate(" + SAID + ", '" + P.WIDE_MARKS + "', '" + P.WIDE_PLAIN.replace("'", "''") + "')"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(lower(replace({FOLD}, '…', '...')), '\s+', ' ', 'g'))) AS digest FROM documents")
def folded_text(spark, d):
    said = F.concat(F.lit("„"), "text", F.lit("‟ ‛a′ ― b″…"))
    return table(spark, d, "documents").select("doc_id", F.md5(P.folded(said)).alias("digest"))


@query("SELECT doc_id, lang, md5(text) AS body FROM documents")
def front_matter_parse(spark, d):
    said = F.concat(F.lit("---\ntitle: a\nlang:  "), F.coalesce("lang", F.lit("")), F.lit(" \n---\n"), "text")
    own = table(spark, d, "documents").select("doc_id", said.alias("t"))
    return own.select("doc_id", P.front_matter(F.col("t"), "lang").alias("lang"), F.md5(P.body(F.col("t"))).alias("body"))


@query("SELECT slug, min_by(title, n) AS title, string_agg(section, '/' ORDER BY first) AS sections FROM (SELECT c_nationkey AS slug, c_mktsegment AS section, min(c_custkey) AS first, min(c_custkey) AS n, 'card ' || min(c_custkey) AS title FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY slug")
def roster_sections(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("slug"), F.concat(F.lit("card "), F.col("c_custkey").cast("string")).alias("title"), F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("place"))
    merged = corpus.merged_roster(c)
    return merged.select("slug", "title", F.array_join("sections", "/").alias("sections"))


@query("SELECT c_mktsegment AS day, CASE WHEN count(*) FILTER (WHERE c_acctbal > 9000) > 0 THEN string_agg('! ' || c_custkey, chr(10) ORDER BY c_custkey) FILTER (WHERE c_acctbal > 9000) ELSE string_agg('- ' || c_custkey, chr(10) ORDER BY c_custkey) END AS news FROM customer GROUP BY c_mktsegment")
def news_or_headlines(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.col("c_mktsegment").alias("day"), F.col("c_custkey").alias("place"), F.concat(F.lit("- "), F.col("c_custkey").cast("string")).alias("line"))
    told = c.where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("day"), F.col("c_custkey").alias("place"), F.concat(F.lit("! "), F.col("c_custkey").cast("string")).alias("line"))
    return corpus.news(told, raw)
