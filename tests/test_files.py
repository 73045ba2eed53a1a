"""Readers and writers of the file layouts, and the joins of a corpus."""

import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofworks.operators import corpus
from asofworks.plans import file_queries, memory_queries, parser_queries, registry, stream_queries
from asofworks.sources import files, sinks

SF = "/root/testdata/sf0.001"
D = date


def test_close_panel_of_single_files(spark, tmp_path):
    for symbol, days in (("BTC", [D(2024, 1, 1), D(2024, 1, 2)]), ("A_B", [D(2024, 1, 2)])):
        pd.DataFrame({"date": days, "close": [1.5 + k for k in range(len(days))], "open": 0.0}).to_parquet(tmp_path / f"{symbol}_ohlcv_1d.parquet", index=False)
    pd.DataFrame({"date": [D(2024, 1, 1)], "close": [7.0]}).to_parquet(tmp_path / "BTC_oi_1d.parquet", index=False)
    assert {tuple(r) for r in files.close_panel(spark, str(tmp_path)).collect()} == {("BTC", D(2024, 1, 1), 1.5), ("BTC", D(2024, 1, 2), 2.5), ("A_B", D(2024, 1, 2), 1.5)}
    assert [r["symbol"] for r in files.close_panel(spark, str(tmp_path), "oi").collect()] == ["BTC"]
    assert files.close_panel(spark, str(tmp_path), "none").count() == 0


def test_series_are_replaced_by_symbol(spark, tmp_path):
    rows = spark.createDataFrame([("a b", D(2024, 1, 1), 1.0), ("c", D(2024, 1, 1), 2.0)], "symbol string, date date, close double")
    sinks.save_series(rows, str(tmp_path), "ohlcv")
    sinks.save_series(rows.where("symbol = 'c'").withColumn("close", F.lit(9.0)), str(tmp_path), "ohlcv")
    assert {(r["symbol"], r["close"]) for r in files.close_panel(spark, str(tmp_path)).collect()} == {("a b", 1.0), ("c", 9.0)}


def test_later_lines_win(spark, tmp_path):
    path = tmp_path / "cache.jsonl"
    assert files.distillates(spark, str(path)).count() == 0
    line = lambda i, *p: json.dumps({"object_id": i, "passages": [{"date": "2024-01-01", "passage": x} for x in p]})
    path.write_text("\n".join([line("1", "old"), "", line("2", "two", "three"), line("1", "new"), "  "]))
    assert {r["object_id"]: [p["passage"] for p in r["passages"]] for r in files.distillates(spark, str(path)).collect()} == {"1": ["new"], "2": ["two", "three"]}


def test_podcast_segments(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    seg = lambda i, who, kept=True, conf=0.9: {"idx": i, "slug": who, "text": f"t{i}", "kept": kept, "confidence": conf}
    talk = {"object_id": "9", "post_date": "2024-03-01", "participants": ["x", "y"], "segments": [seg(0, "x"), seg(1, "y"), seg(2, "x"), seg(3, "x"), seg(4, "x", False), seg(5, "x", True, 0.79), seg(6, "x", True, 0.8)]}
    path.write_text(json.dumps(talk) + "\n" + json.dumps(talk | {"participants": ["y"], "object_id": "8"}))
    got = [tuple(r) for r in files.podcast(spark, str(path), "x").orderBy("id").collect()]
    assert got == [("9:0", D(2024, 3, 1), "t0", None), ("9:2", D(2024, 3, 1), "t2", "t1"), ("9:3", D(2024, 3, 1), "t3", None), ("9:6", D(2024, 3, 1), "t6", None)]


def test_views_stay(spark, tmp_path):
    views = spark.createDataFrame([("m 1", D(2024, 1, 31), [("a", "token", None, "bullish", 5)]), ("m2", D(2024, 2, 29), [])], f"member string, as_of date, items array<{files.ITEM}>")
    sinks.save_views(views, str(tmp_path))
    sinks.save_views(views.withColumn("items", F.lit(None).cast(views.schema["items"].dataType)), str(tmp_path))
    assert {(r["member"], r["as_of"], len(r["items"])) for r in files.member_views(spark, str(tmp_path)).collect()} == {("m 1", D(2024, 1, 31), 1), ("m2", D(2024, 2, 29), 0)}
    assert (tmp_path / "m2" / "periods" / "2024-02-29.json").exists()


def test_registry_and_roster(spark, tmp_path):
    seed = spark.createDataFrame([(["s"], ["t"], {"t": "s"})], files.REGISTRY)
    path = str(tmp_path / "r.json")
    assert files.registry(spark, path, seed).first()["tokens"] == ["t"]
    more = files.minted(seed, spark.createDataFrame([("t", "z"), ("u", None), ("v", "s")], "token string, parent_sector string"))
    sinks.save_registry(more, path)
    got = files.registry(spark, path, seed).first()
    assert (got["sectors"], got["tokens"], got["token_parent"]) == (["s"], ["t", "u", "v"], {"t": "z", "v": "s"})
    pytest.importorskip("yaml")
    (tmp_path / "people.yaml").write_text("people:\n- slug: a-b\n  name: A B\n  linkedin_url: https://www.example.com/in/ab/\n- slug: c\n")
    people = files.roster(spark, str(tmp_path / "people.yaml"))
    assert files.subject(people, "a-b").first()["linkedin_file"] == "ab.json" and files.subject(people, "c").first()["name"] == "c"
    with pytest.raises(KeyError):
        files.subject(people, "none")


def test_sources_are_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "panel.parquet")
    df.write.parquet(path)
    for bad in (path, path + "/", path + "/inner"):
        with pytest.raises(ValueError):
            sinks.save_reconciled(df, path, bad)
    sinks.save_reconciled(df, path, str(tmp_path / "panel_reconciled.parquet"))
    assert spark.read.parquet(path).count() == 3


def test_save_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    assert [sinks.save_once(rows, path, ["k"]), sinks.save_once(rows, path, ["k"]), sinks.save_once(rows.withColumn("k", F.col("k") + 1), path, ["k"])] == [2, 0, 1]


def test_save_once_takes_the_first_by_order(spark, tmp_path):
    rows = spark.createDataFrame([(k, n, f"{k} {n}") for k in range(200) for n in (3, None, 1, 2)] + [(None, 5, "x"), (None, 4, "y"), (900, None, "z")], "k long, n int, v string").repartition(7)
    path = str(tmp_path / "t")
    assert [sinks.save_once(rows, path, ["k"], order="n"), sinks.save_once(rows.where("k < 900"), path, ["k"], order="n")] == [202, 0]
    saved = spark.read.parquet(path)
    assert saved.columns == ["k", "v"]
    assert {tuple(r) for r in saved.collect()} == {(k, f"{k} 1") for k in range(200)} | {(None, "y"), (900, "z")}


def test_what_is_saved_does_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """The query's second round brings each third key twice: its own price stays, also where the other comes first."""
    orders = spark.createDataFrame([(k, float(k % 7 - 2)) for k in range(3000)], "o_orderkey long, o_totalprice double")
    orders.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["save_once_twice"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, orders.collect()))


def test_corpus_joins(spark):
    t = F.lit("2024-06-30").cast("date")
    articles = spark.createDataFrame([("1", D(2024, 6, 1)), ("2", D(2023, 1, 1)), ("3", D(2024, 6, 1))], "object_id string, post_date date")
    cached = spark.createDataFrame([("1", [("2024-06-02", "in"), ("2024-07-02", "late"), ("2022-01-01", "old"), ("soon", "none")]), ("2", [("2024-06-02", "article is old")])], f"object_id string, passages {files.PASSAGES}")
    assert [r["passage"] for r in corpus.article_passages(articles, cached, t, 6).collect()] == ["in"]
    posts = spark.createDataFrame([("1", "retweet"), ("2", None), ("3", "quote")], "id string, type string")
    assert {r["id"] for r in corpus.without_reposts(posts).collect()} == {"2", "3"}
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, root long")
    texts = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, 1, "c")], "id long, at long, text string")
    assert {tuple(r) for r in corpus.thread_texts(texts, roots, "at").collect()} == {(1, 2, "b\n\na"), (3, 1, "c")}
    segments = spark.createDataFrame([("x", True, 0.8), ("x", True, 0.79), ("x", False, 1.0), ("y", True, 1.0), ("x", True, None)], "slug string, kept boolean, confidence double")
    assert corpus.attributed(segments, "x").count() == 1
    ranked = corpus.leading_first(spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "k string, r double"), "r", "k")
    assert [r["k"] for r in ranked.orderBy("place").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("name", sorted(file_queries.QUERIES | parser_queries.QUERIES | stream_queries.QUERIES | memory_queries.ORACLES))
def test_files_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in "region nation customer supplier orders events documents pages conversations embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
