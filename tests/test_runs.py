"""Whole runs: resumable panels with audits, reconciliation, informativeness."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from asofworks import runs
from asofworks.operators import stats
from asofworks.plans import registry, run_queries
from asofworks.sources import committed, published

D = date
SF = "/root/testdata/sf0.001"


def answer(*entries):
    return json.dumps({"sectors_excited": [{"name": n, "conviction": c, "citations": [{"date": "x", "quote": q}] if q else []} for n, c, q in entries]})


def test_a_panel_goes_on_where_it_was_stopped(spark, tmp_path):
    root = str(tmp_path / "run")
    months = [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31)]
    periods = spark.createDataFrame([(t,) for t in months], "as_of date")
    names = spark.createDataFrame([("Deep Fi", "defi")], "name string, canonical string")
    rows = [(months[0], answer(("Deep Fi", 60, "was said early"), ("New One", 40, "never said"))), (months[1], answer(("deep-fi", 70, "was said late"), ("Deep Fi", 50, None))), (months[2], answer())]
    told = spark.createDataFrame(rows, "as_of date, answer string")
    corpus = spark.createDataFrame([(1, D(2024, 1, 2), "it was said early, too"), (2, D(2024, 3, 1), "It was  said late.")], "doc_id int, day date, text string")
    runs.build_panel(told.where("as_of < '2024-02-01'"), names, periods, root, "one", corpus)
    panel = runs.build_panel(told.withColumn("answer", F.when(F.col("as_of") < "2024-02-01", answer(("Spoiled", 1, None))).otherwise(F.col("answer"))), names, periods, root, "two", corpus)
    got = {(r["as_of"].month, r["item"], r["lifecycle_state"], r["delta_conviction"]) for r in panel.collect()}
    assert got == {(1, "defi", "NEW", 0), (1, "new-one", "NEW", 0), (2, "deep-fi", "NEW", 0), (2, "defi", "SUSTAINED", -10), (2, "new-one", "EXITED", -40), (3, "defi", "EXITED", -50), (3, "deep-fi", "EXITED", -70)}
    found = committed.signals(spark, root, "audit", "as_of date, checked long, matched long, leaked long, hallucinated long")
    assert sorted(map(tuple, found.collect())) == [(months[0], 2, 1, 0, 1), (months[1], 1, 0, 1, 0)]
    again = runs.build_panel(told, names, periods, root, "two", corpus)  # the same batch: nothing is written
    assert {(r["as_of"].month, r["item"]) for r in again.collect()} == {(m, i) for m, i, *_ in got} and len(published.Log(spark, root).numbers()) == 4


def test_reconciliation_leaves_sources_and_tells_what_it_changed(spark, tmp_path):
    root = str(tmp_path / "run")
    kind = "as_of date, item string, item_type string, parent_sector string"
    a = spark.createDataFrame([(D(2024, 1, 31), "btc", "sector", None), (D(2024, 1, 31), "x", "token", "def")], kind)
    b = spark.createDataFrame([(D(2024, 1, 31), "bitcoin", "token", "l1")], kind)
    groups = spark.createDataFrame([("btc", "bitcoin", "token"), ("def", "defi", "sector")], "id string, canonical string, canonical_type string")
    assert runs.run_reconciliation({"a": a, "b": b}, groups, root, "1") == runs.run_reconciliation({"a": a, "b": b}, groups, root, "1") == 1
    of = lambda name, schema: sorted(map(tuple, committed.signals(spark, root, name, schema).collect()), key=str)
    assert of("a_reconciled", kind) == [(D(2024, 1, 31), "bitcoin", "token", None), (D(2024, 1, 31), "x", "token", "defi")]
    assert of("b_reconciled", kind) == [(D(2024, 1, 31), "bitcoin", "token", "l1")]
    assert of("reconciliation_map", "id string, canonical string") == [("bitcoin", "bitcoin"), ("btc", "bitcoin"), ("def", "defi"), ("l1", "l1"), ("x", "x")]
    assert of("type_corrections", "id string, old_type string, new_type string") == [("bitcoin", "sector", "token")]


def test_informativeness_of_three_signals(spark):
    rows = [(D(2024, 1, 31), f"i{k}", "token", (k % 3) - 1, (k * 7) % 11, 0, k / 10 - (k % 4)) for k in range(12)]
    table = spark.createDataFrame(rows, "as_of date, item string, item_type string, stance_sign int, signal int, delta_stance int, ret double")
    got = {r["signal"]: r for r in runs.run_informativeness(table, "x").collect()}
    assert set(got) == set(runs.SIGNALS) and all(r["n_rows"] == r["n"] == 12 for r in got.values())
    assert got["delta_stance"]["ic"] is None  # one value only
    assert got["signal"]["ic"] == pytest.approx(stats.rank_ic(table, "signal", "ret").first()["ic"])


@pytest.mark.parametrize("name", sorted(run_queries.QUERIES))
def test_runs_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in "region nation customer orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
