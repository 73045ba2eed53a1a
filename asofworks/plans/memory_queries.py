"""Queries on the point-in-time memory, main texts as Markdown and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofworks.functions import pages, profiles
from asofworks.operators import memory

from .derived import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


DAY = "CAST(DATE '2020-01-01' + CAST(vec_id * 37 % 1500 AS INTEGER) AS DATE)"
WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def dated(spark, d):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") * 37 % 1500).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), day.alias("day"))


@query(f"WITH m AS (SELECT vec_id, {DAY} AS day, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {WHOLE}) SELECT q.vec_id AS query_id, m.vec_id AS id, round(list_cosine_similarity(q.v, m.v), 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, m.v) DESC, m.vec_id) AS INTEGER) AS rank FROM m q JOIN m ON m.day <= q.day WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10")
def memory_search(spark, d):
    """The ten most similar vectors that were known on a vector's own day, of every 50th; nothing is missed."""
    rows, cells = memory.index(dated(spark, d), memory.fit(dated(spark, d)))
    asked = dated(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.col("day").alias("t"))
    found = memory.search(asked, rows, cells, exact=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def page_markdown(spark, d):
    """Every page's main content as text and Markdown, with its title, author and date."""
    return table(spark, d, "pages").select("page_id", pages.content(F.col("html")).alias("x")).select("page_id", "x.*")


@query("SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS name, 'Head of ' || s_nationkey AS headline, CASE WHEN s_suppkey % 3 = 0 THEN 'Partner' ELSE 'Analyst' END AS title, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'Firm & ' || s_nationkey END AS company, CAST(1980 + s_suppkey % 40 AS VARCHAR) AS start, CASE WHEN s_suppkey % 2 = 0 THEN CAST(1985 + s_suppkey % 40 AS VARCHAR) END AS \"end\", 'School ' || s_suppkey % 9 AS school, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Physics' END AS field, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS restricted FROM supplier")
def profile_sections(spark, d):
    """A page of each supplier with sections in either order, read back."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    masked = lambda when, text: F.when(when, F.lit("******** ****")).otherwise(text)
    until = F.when(k % 2 == 0, (1985 + k % 40).cast("string")).otherwise("Present")
    dates = F.concat(F.lit("<span class='date-range'>"), (1980 + k % 40).cast("string"), F.lit(" - "), until, F.lit(" 5 years</span>"))
    work = F.concat(F.lit("<section><ul><li class='profile experience-item'><h3 class=experience-item__title>"), F.when(k % 3 == 0, "Partner").otherwise("Analyst"), F.lit("</h3><h4 class='experience-item__subtitle'><a href='/c'>"), masked(k % 7 == 0, F.concat(F.lit("Firm &amp; "), "s_nationkey")), F.lit("</a></h4>"), dates, F.lit("<p class='experience-item__description'>x</p></li></ul></section>"))
    study = F.concat(F.lit("<section><ul><li class='education__list-item'><h3><a>School "), (k % 9).cast("string"), F.lit("</a></h3><h4><span>BSc</span></h4>"), F.when(k % 4 == 0, "<h4> - </h4>").otherwise("<h4>Physics</h4>"), F.lit("</li></ul></section>"))
    html = F.concat(F.lit("<html><head><title>"), "s_name", F.lit(" - Head of "), "s_nationkey", F.lit(" | LinkedIn</title></head><body><h1>"), masked(k % 5 == 0, F.col("s_name")), F.lit("</h1>"), F.when(k % 2 == 0, F.concat(work, study)).otherwise(F.concat(study, work)))
    own = s.select(F.concat(F.lit("s"), k).alias("slug"), profiles.profile(html).alias("p"))
    job, school = F.col("p.experience")[0], F.col("p.education")[0]
    return own.select("slug", "p.name", "p.headline", job["title"].alias("title"), job["company"].alias("company"), job["start"].alias("start"), job["end"].alias("end"), school["school"].alias("school"), school["field"].alias("field"), "p.restricted")
