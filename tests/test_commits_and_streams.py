"""Whole commits, the numbered log, and streams that give the rows of their batch forms."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofworks.operators import lifecycle
from asofworks.sources import committed, published
from asofworks.streaming import events as S
from asofworks.streaming.lifecycle import lifecycle_stream, next_month_end

D = date
ROWS = "k string, v int"


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_job_that_stops_before_it_is_known_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], ROWS)
    log = published.Log(spark, root)
    published.written(log, {"t": df})  # stopped here
    assert told(published.read(spark, root, "t", ROWS)) == []
    first = published.commit({"t": df}, root, "one")
    assert published.commit({"t": df}, root, "one") == first == 1  # run again: the same rows once
    assert told(published.read(spark, root, "t", ROWS)) == [("a", 1, 1), ("b", 2, 1)]


def test_of_two_writers_both_are_known(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], ROWS)
    log = published.Log(spark, root)
    entry = lambda batch: {"batch": batch, "tables": published.written(log, {"t": df}), "whole": False}
    one, two = entry("one"), entry("two")
    assert log.publish(one, 1) and not log.publish(two, 1) and log.publish(two, 2)
    assert [n for n, _ in log.entries()] == [1, 2] and log.of_batch("two") == 2 and log.of_batch("three") is None
    assert published.commit({"t": df}, root, "three") == 3
    assert sorted(r[2] for r in published.read(spark, root, "t", ROWS).collect()) == [1, 2, 3]


def test_later_commits_win_and_merging_keeps_them(spark, tmp_path):
    root = str(tmp_path / "t")
    for k in range(4):  # within one second
        published.commit({"t": spark.createDataFrame([("a", k), ("b", -k), (f"only {k}", k)], ROWS), "other": spark.createDataFrame([("x", k)], ROWS)}, root, f"batch {k}")
    want = [("a", 3), ("b", -3), *[(f"only {k}", k) for k in range(4)]]
    keep = lambda df: published.newest(df, ["k"])
    assert told(keep(published.read(spark, root, "t", ROWS))) == want
    assert published.compact(spark, root, {"t": (ROWS, keep)}) == 5
    assert told(published.read(spark, root, "t", ROWS)) == [(*r, 5) for r in want]
    assert len(published.read(spark, root, "other", ROWS).collect()) == 4  # tables that are not merged stay, with their numbers
    assert told(keep(published.read(spark, root, "other", ROWS))) == [("x", 3)]
    assert published.commit({"t": spark.createDataFrame([], ROWS)}, root, "batch 2") == 3  # known before the merge
    published.commit({"t": spark.createDataFrame([("b", 9)], ROWS)}, root, "later")
    assert told(keep(published.read(spark, root, "t", ROWS)))[1] == ("b", 9)


def test_a_series_is_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = lambda *own: spark.createDataFrame(own, "symbol string, date date, value double")
    committed.save_series(rows(("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 2), 2.0), ("b", D(2024, 1, 1), 5.0)), root, "close", "1")
    committed.save_series(rows(("a", D(2024, 1, 2), 7.0)), root, "close", "2")
    committed.save_series(rows(("a", D(2024, 1, 2), 0.0)), root, "oi", "3")
    want = [("a", D(2024, 1, 2), 7.0), ("b", D(2024, 1, 1), 5.0)]
    assert told(committed.series(spark, root, "close")) == want
    committed.compact_series(spark, root)
    assert told(committed.series(spark, root, "close")) == want and told(committed.series(spark, root, "oi")) == [("a", D(2024, 1, 2), 0.0)]
    assert told(committed.series(spark, root, "none")) == [] and told(committed.series(spark, str(tmp_path / "nothing"), "close")) == []


def test_evidence_and_identity_are_one_commit(spark, tmp_path):
    root = str(tmp_path / "e")
    item = lambda t, text: ("ann", datetime(2024, 1, t), "tweet", str(t), text)
    kind = "slug string, timestamp timestamp, source_type string, id string, text string"
    people = spark.createDataFrame([("ann", "Ann", None, D(2020, 1, 1))], "slug string, name string, bio string, since date")
    committed.save_evidence(spark.createDataFrame([item(1, "old")], kind), people.withColumn("name", F.lit("old")), root, "1")
    committed.save_evidence(spark.createDataFrame([item(2, "x"), item(9, "y")], kind), people, root, "2")
    assert [r["text"] for r in committed.evidence(spark, root, F.lit(D(2024, 1, 5))).collect()] == ["x"]
    assert told(committed.identities(spark, root)) == [("ann", '{"slug":"ann","name":"Ann","bio":null,"since":"2020-01-01"}')]
    assert committed.evidence(spark, root).columns == [c.split()[0] for c in committed.EVIDENCE.split(", ")]


ITEMS = "as_of date, item string, item_type string, parent_sector string, stance_sign int, conviction int, horizon string, n int"


def months(n):
    out = [D(2023, 1, 31)]
    while len(out) < n:
        out.append(next_month_end(out[-1]))
    return out


def test_next_month_end():
    assert months(14) == [D(2023, m, d) for m, d in zip(range(1, 13), (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), strict=True)] + [D(2024, 1, 31), D(2024, 2, 29)]


def run(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)


def test_lifecycle_by_a_stream_that_is_stopped_and_started(spark, tmp_path):
    """Shuffled micro-batches, several entries of a period, exits without input, a restart in the middle."""
    r = random.Random(8)
    days = months(9)
    rows = [(t, f"i{k}", "token" if k % 2 else "sector", f"s{k % 3}" if k % 2 else None, r.choice([-1, 0, 1]), r.randrange(100), r.choice(["tactical", None]), 1) for t in days for k in range(6) if r.random() < 0.6]
    rows += [(t, i, kind, s, -sign, c + 1, h, 2) for t, i, kind, s, sign, c, h, _ in rows if r.random() < 0.3]
    want = told(lifecycle.lifecycle(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([(t,) for t in days], "as_of date"), "n").select("as_of", "item", "stance_sign", "lifecycle_state", "delta_stance", "delta_conviction", "age"))
    beat = (days[-1] + timedelta(days=1 + 100), "", "", None, 0, 0, None, 1)  # lets the last month be told, no later one
    early = [x for x in rows if x[0] <= days[4]]
    late = [x for x in rows if x[0] > days[4]]
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    kind = spark.createDataFrame([], ITEMS).schema
    for part, extra in ((early, []), (late, [[beat], [beat], [beat]])):
        r.shuffle(part)
        for own in [part[::2], part[1::2], *extra]:
            spark.createDataFrame(own, ITEMS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(inbox)
        run(lifecycle_stream(stream, "100 days", order="n"), out, state)  # a new query goes on from the state of the last
    got = told(spark.read.parquet(out).where("item <> ''").select("as_of", "item", "stance_sign", "lifecycle_state", "delta_stance", "delta_conviction", "age"))
    assert got == want and any(x[3] == "EXITED" for x in got)


def test_quoted_texts_by_a_join_of_streams(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    posts = [(k, at(10 * k), f"t{k - 1}" if k % 2 else None) for k in range(20)]
    texts = [(f"t{k}", at(10 * k + 1), f"text {k}") for k in range(0, 20, 4)] + [("t2", at(29 + 24 * 60 * 9), "too late")]
    posts, texts = [*posts, (99, at(60 * 24 * 30), "")], [*texts, ("-", at(60 * 24 * 30), "")]
    sides = []
    for name, rows, kind in (("posts", posts, "id int, ts timestamp, quoted_id string"), ("texts", texts, "id string, ts timestamp, text string")):
        for own in (rows[1:-1:2], rows[:-1:2], rows[-1:], rows[-1:]):
            spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    run(S.quoted_stream(*sides, late="10 days", within="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["id"]: (r["context"], r["context_missing"]) for r in spark.read.parquet(str(tmp_path / "out")).where("id < 99").collect()}
    assert got == {k: (f"text {k - 1}", False) if k % 4 == 1 else (None, k % 2 == 1) for k in range(20)}


@pytest.mark.parametrize("name", ["lifecycle_streamed", "quoted_streamed"])
def test_streams_have_the_batch_forms_sql(name):
    from asofworks.plans import registry

    batch = {"lifecycle_streamed": "lifecycle_panel", "quoted_streamed": "quoted_context"}[name]
    assert registry.oracle_sql()[name] == registry.oracle_sql()[batch]
