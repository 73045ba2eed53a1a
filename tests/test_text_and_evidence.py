"""Text functions, evidence, audits, vocabularies and event-time aggregates."""

import random
from datetime import date, datetime
from difflib import SequenceMatcher
from time import process_time

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofworks.functions import text as X
from asofworks.functions import windows
from asofworks.operators import audit, evidence, prefix, reconcile
from asofworks.plans import registry
from asofworks.streaming import events as S


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_scalar_functions(spark):
    assert one(spark, X.slug, "  AI & Robots!! ") == "ai-robots"
    assert one(spark, X.stripped, "@a hello https://x.y/z?q=1 there") == "hello  there"
    assert one(spark, X.reply_substance, "@a @b hi @c") == "hi @c"
    assert one(spark, X.normalised, "“It’s”  a\n—dash… ") == '"it\'s" a --dash...'.replace("--", "-")
    assert [tuple(c) for c in one(spark, X.citations, 'x [2024-01-05] "quote one" [d]"q2"')] == [("2024-01-05", "quote one"), ("d", "q2")]
    assert one(spark, X.json_object, 'a ```{"k": {"z": 1}} ``` b') == '{"k": {"z": 1}}' and one(spark, X.json_object, "none") is None
    assert [one(spark, X.conviction, v) for v in ("50.5", "51.5", "-3", "300", "x", None)] == [50, 52, 0, 100, 50, 50]
    assert one(spark, lambda x: X.coerced(x, ("a", "b"), "c"), " A ") == "a" and one(spark, lambda x: X.coerced(x, ("a",), "c"), None) == "c"
    assert one(spark, X.partial_date, "May 2026") == date(2026, 5, 1) and one(spark, X.partial_date, "2008") == date(2008, 1, 1) and one(spark, X.partial_date, "soon") is None
    assert one(spark, X.unmasked, "***** ***") is None and one(spark, X.unmasked, "VP") == "VP"
    assert one(spark, X.unescaped, "a &amp; b&#39;s") == "a & b's"
    assert one(spark, X.host, "https://www.Example.com:80/a") == "example.com"


@pytest.mark.parametrize(("cut", "whole"), [('{"a": [1, 2', '{"a": [1, 2]}'), ('x {"a": "b', '{"a": "b"}'), ('{"a": 1,', '{"a": 1}'), ('{"a": 1, "b', '{"a": 1}'), ('{"a": 1} tail', '{"a": 1}'), ('{"a": "b\\u00', '{"a": "b"}'), ('{"a": [1.5e', '{"a": [1.5]}'), ('{"a": "x, {y', '{"a": "x, {y"}'), ('{"a": "b\\', '{"a": "b"}'), ('[1, {"a": {}', '{"a": {}}'), ('{"a": ]', None), ("none", None)])
def test_repair(cut, whole):
    assert X.repair(cut) == whole


def test_similarity():
    q = "the quick brown fox jumps over the lazy dog"
    assert X.ratio(q, q + " again") > 0.85 and X.ratio(q, "nothing like it at all in this text") < 0.6
    assert X.common_shares(["abcdef", ""], "xxabcdxx") == [pytest.approx(4 / 6), 0]


def test_jaccard(spark):
    df = spark.sql("select array(1,2,3) a, array(2,3,4) b, array() e")
    got = df.select(X.jaccard(F.col("a"), F.col("b")).alias("x"), X.jaccard(F.col("e"), F.col("e"), 1.0).alias("y")).first()
    assert (got["x"], got["y"]) == (0.5, 1.0)


def test_threads(spark):
    posts = [(1, None, "a"), (2, 1, "a"), (3, 2, "a"), (4, 3, "b"), (5, 4, "b"), (6, 99, "a")] + [(i, i - 1, "c") for i in range(101, 160)] + [(100, None, "c")]
    got = {r["id"]: r["root"] for r in evidence.thread_roots(spark.createDataFrame(posts, "id long, parent long, author string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6} | {i: 100 for i in range(100, 160)}


def test_contexts(spark):
    turns = spark.createDataFrame([(1, 0, "x", "q"), (1, 1, "y", "a"), (1, 2, "y", "b")], "t int, p int, s string, text string")
    assert [r["context"] for r in evidence.preceding(turns, "t", "p", "s", "text").orderBy("p").collect()] == [None, "q", None]
    posts = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, quoted_id long")
    got = {r["id"]: (r["context"], r["context_missing"]) for r in evidence.quoted(posts, spark.createDataFrame([(7, "seven")], "id long, text string")).collect()}
    assert got == {1: ("seven", False), 2: (None, True), 3: (None, False)}


def test_batches_and_samples(spark):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([4, 4, 4, 20, 1, 9])] + [("m", 0, 3)], "k string, o long, n long")
    assert [r["batch"] for r in evidence.batches(rows, "k", "o", "n", 10).orderBy("k", "o").collect()] == [0, 0, 1, 2, 3, 3, 0]
    assert [r["chunk"] for r in evidence.chunks(rows, "k", "o", 4).orderBy("k", "o").collect()] == [0, 0, 0, 0, 1, 1, 0]
    assert [r["o"] for r in evidence.even_sample(rows.where("k = 'k'"), "k", "o", 3).orderBy("o").collect()] == [0, 2, 5]


def test_identity(spark):
    d = date
    rows = [("a", [("first", d(2001, 1, 1), d(2003, 1, 1)), ("open", d(2002, 1, 1), None), ("later", d(2030, 1, 1), None)]), ("b", [("old", d(2000, 1, 1), d(2001, 1, 1))]), ("c", [])]
    df = spark.createDataFrame(rows, "slug string, roles array<struct<title:string,start:date,end:date>>")
    got = {r["slug"]: (r["current_role"], r["n_known"]) for r in evidence.identity_as_of(df, F.lit("2010-01-01").cast("date")).collect()}
    assert got == {"a": ("open", 2), "b": ("old", 1), "c": (None, 0)}
    a = spark.createDataFrame([("x", "short", "CEO"), ("y", "only", None)], "slug string, bio string, title string")
    b = spark.createDataFrame([("x", "much longer", "Chief"), ("z", None, "Dev")], "slug string, bio string, title string")
    assert {tuple(r) for r in evidence.merged_identities(a, b).collect()} == {("x", "much longer", "CEO"), ("y", "only", None), ("z", None, "Dev")}


def test_audit(spark):
    corpus = spark.createDataFrame([(1, "He said: “markets move slowly at first, then all at once” and left.", date(2024, 1, 1)), (2, "nothing here", date(2024, 1, 1)), (3, "a rollup is live", date(2025, 1, 1))], "doc_id long, text string, day date")
    quotes = spark.createDataFrame([("q1", "Markets move  slowly at first, then all"), ("q2", "markets never move slowly at all"), ("q3", "rollup is li"), ("q4", "ollu"), ("q5", "hing he")], "quote_id string, quote string")
    hits = audit.contained(quotes, corpus)
    assert {tuple(r) for r in hits.collect()} == {("q1", 1), ("q3", 3), ("q4", 3), ("q5", 2)}
    judged = audit.verdicts(quotes, hits, corpus, F.lit("2024-12-31").cast("date"))
    assert {tuple(r) for r in judged.collect()} == {("q1", "matched"), ("q2", "hallucinated"), ("q3", "leaked"), ("q4", "leaked"), ("q5", "matched")}
    assert tuple(audit.report(judged).first()) == (5, 2, 2, 1)
    near = spark.createDataFrame([("n", "markets move slowly at first then all at once")], "quote_id string, quote string")
    assert audit.similar(near, corpus).count() == 0 and audit.similar(near, corpus, 0.6).count() == 1  # one run of 28 of 44
    items = spark.createDataFrame([(1, "x")] * 4 + [(2, "x")] * 3 + [(3, "x")] * 3 + [(3, "y")], "as_of int, item string")
    assert [r["as_of"] for r in audit.degenerate(items).collect()] == [1]


def quote_cases():
    """Texts, and quotes of all lengths from them: whole, cut at either end, with a letter changed, and short ones."""
    r = random.Random(9)
    words = ["antidisestablishmentarianism", "xx", "zz", "two", "words", "a", "market", "moves", "slowly", "at", "first", "once", "“all”", "then", "…"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(25)] + ["", "antidisestablishmentarianism xx zz", "these two words"]
    quotes = ["antidisestablishmentarianism xx yy", "two words", "wo wor", "a", "zz", " ", "nowhere to be seen at all"]
    for _ in range(60):
        t = r.choice(texts)
        a = r.randrange(0, max(1, len(t) - 1))
        q = t[a : a + r.choice([1, 2, 3, 5, 9, 20, 60, 200])]
        k = r.randrange(0, max(1, len(q)))
        quotes += [q, q[:k] + "Q" + q[k + 1 :], q + "qq"]
    return texts, quotes


def common_share(quote, text):
    m = SequenceMatcher(None, quote, text, autojunk=False).find_longest_match(0, len(quote), 0, len(text))
    return m.size / len(quote)


def test_quotes_against_all_pairs(spark):
    texts, quotes = quote_cases()
    corpus, own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    plain = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[0], X.normalised(F.col(c))).collect()}
    t, q = plain(corpus, "text"), plain(own, "quote")
    assert {tuple(r) for r in audit.contained(own, corpus).collect()} == {(i, j) for i, a in q.items() for j, b in t.items() if a and a in b}
    for least in (0.85, 0.6):
        want = {(i, j): share for i, a in q.items() for j, b in t.items() if a and (share := common_share(a, b)) >= least}
        got = {(r["quote_id"], r["doc_id"]): r["score"] for r in audit.similar(own, corpus, least).collect()}
        assert got == pytest.approx(want) and len(want) > 40


def test_windowed_ratio_against_all_pairs(spark):
    texts, quotes = quote_cases()
    key = lambda i: i % 3
    corpus = spark.createDataFrame([(key(i), i, t) for i, t in enumerate(texts)], "who int, doc_id long, text string")
    own = spark.createDataFrame([(key(i), i, q) for i, q in enumerate(quotes)], "who int, quote_id long, quote string")
    plain = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[1], X.normalised(F.col(c))).collect()}
    want = {}
    for i, a in plain(own, "quote").items():
        for j, b in plain(corpus, "text").items():
            if a and key(i) == key(j):
                best = max(X.ratio(a, b[k : k + len(a) + 10]) for k in range(0, max(1, len(b) - len(a) + 1), max(1, len(a) // 2)))
                if best >= 0.85:
                    want[i, j] = best
    got = {(r["quote_id"], r["doc_id"]): r["score"] for r in audit.similar_windows(own, corpus, ["who"]).collect()}
    assert got == pytest.approx(want) and want


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_windowed_ratio_without_a_shared_column(spark, least, monkeypatch):
    texts, quotes = quote_cases()
    texts, quotes = texts[:12], [*quotes[::4], "\U0001f600ab", texts[0][3:90].replace("e", "") + "zz"]
    corpus, own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    plain = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[0], X.normalised(F.col(c))).collect()}
    want = {}
    for i, a in plain(own, "quote").items():
        for j, b in plain(corpus, "text").items():
            best = max((X.ratio(a, b[k : k + len(a) + 10]) for k in range(0, max(1, len(b) - len(a) + 1), max(1, len(a) // 2))), default=0) if a else 0
            if best >= least:
                want[i, j] = best
    got = {(r["quote_id"], r["doc_id"]): r["score"] for r in audit.similar_windows(own, corpus, least=least).collect()}
    assert got == pytest.approx(want) and len(want) >= 4
    monkeypatch.setattr(audit, "BROADCAST_RUNS", 0)
    assert {(r["quote_id"], r["doc_id"]) for r in audit.similar_windows(own, corpus, least=least).collect()} == want.keys()


def test_suffix_automaton():
    r = random.Random(5)
    for k in range(400):
        letters = "ab" if k % 2 else "abcd"
        quotes = ["".join(r.choice(letters) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 5))]
        text = "".join(r.choice(letters + "z") for _ in range(r.randrange(25)))
        want = [max((j - i for i in range(len(q)) for j in range(i + 1, len(q) + 1) if q[i:j] in text), default=0) for q in quotes]
        assert X.Substrings(quotes).longest_in(text) == want
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    began = process_time()
    X.common_shares([" ".join(r.choices(words, k=20)) for _ in range(200)], " ".join(r.choices(words, k=20_000)))
    assert process_time() - began < 2


def plain_batches(sizes, budget):
    used, n, out = 0, 0, []
    for s in sizes:
        if used and used + s > budget:
            used, n = 0, n + 1
        used += s
        out.append(n)
    return out


def test_batches_equal_the_fold(spark):
    r = random.Random(6)
    keys = {f"k{k}": [r.choice([0, 0, 1, 3, 7, 30, 60]) for _ in range(n)] for k, n in enumerate((1, 2, 40, 300, 5))} | {"zeros": [0] * 9, "large": [90] * 6, "end": [5, 0, 0]}
    df = spark.createDataFrame([(k, i, s) for k, own in keys.items() for i, s in enumerate(own)], "k string, i int, s int")
    got = {(x["k"], x["i"]): x["batch"] for x in evidence.batches(df, "k", "i", "s", 50).collect()}
    assert got == {(k, i): b for k, own in keys.items() for i, b in enumerate(plain_batches(own, 50))}
    assert evidence.batches(df.where("false"), "k", "i", "s", 50).collect() == []


def test_running_sums_of_one_key_take_several_tasks(spark):
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be put together
    spark.conf.set(merge, "false")
    try:
        df = spark.range(40_000).select(F.lit("one").alias("k"), "id", F.lit(2).alias("s"))
        got = prefix.running(df, ["k"], ["id"], {"total": "s"})
        assert got.where("total <> 2 * (id + 1)").count() == 0 and got.count() == 40_000
        ranges = df.repartitionByRange("k", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(ranges) > 1 and max(x["count"] for x in ranges) < 30_000
    finally:
        spark.conf.unset(merge)


def test_vocabulary(spark):
    panel = spark.createDataFrame([(1, "a", "token", "s"), (2, "a", "sector", None), (1, "b", "token", None)], "as_of int, item string, item_type string, parent_sector string")
    assert {tuple(r) for r in reconcile.distinct_ids(panel).collect()} == {("a", "sector"), ("b", "token"), ("s", "sector")}
    mapping = spark.createDataFrame([("a", "A", "token"), ("s", "S", "sector")], "id string, canonical string, canonical_type string")
    assert {tuple(r) for r in reconcile.apply_map(panel, mapping).select("as_of", "item", "item_type", "parent_sector").collect()} == {(1, "A", "token", "S"), (2, "A", "token", None), (1, "b", "token", None)}
    names = spark.createDataFrame([("Deep Fi",), ("known",), ("Known-Slug",)], "name string")
    registry_ = spark.createDataFrame([("known", "k"), ("x", "known-slug")], "name string, canonical string")
    assert {tuple(r) for r in reconcile.canonical(names, registry_).collect()} == {("Deep Fi", "deep-fi", True), ("known", "k", False), ("Known-Slug", "known-slug", False)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), f"u{h % 2}", "t", float(m)) for h in range(6) for m in range(0, 60, 20)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id string, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = S.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(90)
    assert sorted(map(str, spark.table("tumbling").collect())) == sorted(map(str, S.tumbling(df).collect()))
    assert S.sessions(df, "30 minutes").count() == 6


def test_append_new_is_resumable(spark, tmp_path):
    path = str(tmp_path / "t")
    S.append_new(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string"), path, "k")
    S.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_registry_is_whole():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


@pytest.mark.parametrize("name", ["basket_forward_return", "lifecycle_panel", "thread_roots", "slugs"])
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_all_events_are_repaired(spark):
    folder = "/root/testdata/sf0.01"
    got = {tuple(r) for r in registry.queries()["json_repair_all"](spark, folder).collect()}
    assert got == {(r[0], r[1], 2) for r in spark.read.parquet(f"{folder}/events.parquet").select("event_id", "event_type").collect()} and len(got) > 2000


@pytest.mark.parametrize("name", ["corpus_lines_whole", "citation_parse_whole"])
def test_whole_texts_reach_lines_and_citations(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in registry.queries()[name](spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall()) and max(len(r[2]) for r in got) > 1000


def against_sql(spark, folder, name, **tables):
    """A query's rows over hand-made tables, and those of its SQL."""
    con = pytest.importorskip("duckdb").connect()
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    key = lambda r: tuple((x is not None, x) for x in r)
    return [sorted(map(tuple, rows), key=key) for rows in (registry.queries()[name](spark, str(folder)).collect(), con.execute(registry.oracle_sql()[name]).fetchall())]


def test_percentages_of_all_cents(spark, tmp_path):
    own = spark.range(-20_000, 100_000).select(F.col("id").alias("s_suppkey"), (F.col("id") * 10 / 100).alias("s_acctbal"))
    got, want = against_sql(spark, tmp_path, "percent_format", supplier=own)
    assert got == want and len(want) > 100_000
    assert spark.sql("select 0.125D x").select(X.percent(F.col("x"))).first()[0] == "+12.5%"


def test_titles_that_end_within_a_reference(spark, tmp_path):
    titles = ["a &amp; b &quot;c&quot;", "cut off &amp", "&ampx &quot", "&amp;quot; &amp;amp;", "&lt;b&gt; &#39;", "", "no title", None]
    pages = spark.createDataFrame([(i, None if t is None else t if t == "no title" else f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, html string")
    got, want = against_sql(spark, tmp_path, "entity_unescape", pages=pages)
    assert got == want and dict(got)[1] == "cut off &amp"


@pytest.mark.parametrize("name", ["citation_parse", "citation_parse_whole"])
def test_citations_of_odd_rows(spark, tmp_path, name):
    texts = ["plain", "", None, '"', 'a "b" c', "[x] y ]", "null", "%s %d \\ $1", "two\nlines", "\U0001f600"]
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in texts for s in ("web", "", None, 'a "source"', '[d] "q"'))] + [(None, "x", "web"), (3, "again", "web"), (3, "again", "web")]
    got, want = against_sql(spark, tmp_path, name, documents=spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got == want and len(want) == 2 * len(rows)


def test_longest_common_subsequence_in_a_band():
    r = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    seen = 0
    for m in [1, 2, 5, 20, 60, 150, 300] * 20:
        quotes = np.array([[r.randrange(4) for _ in range(m)] for _ in range(2)], np.uint8)
        own = []
        for _ in range(6):
            w = [int(c) for c in quotes[1] if r.random() > 0.08]
            for _ in range(r.randrange(12)):
                w.insert(r.randrange(len(w) + 1), r.randrange(4))
            own.append(w[: m + 10])
        own = [w for w in own if windows.least_matched(m, np.array([len(w)]), 0.85)[0] <= min(m, len(w))]
        if not own:
            continue
        size = np.array([len(w) for w in own])
        need = windows.least_matched(m, size, 0.85)
        columns = np.full((size.max(), len(own)), 256, np.uint16)
        for i, w in enumerate(own):
            columns[: len(w), i] = w
        got = windows.subsequence(quotes, np.ones(len(own), int), columns, need, size)
        for w, n, found in zip(own, need.tolist(), got.tolist(), strict=True):
            want = plain(quotes[1].tolist(), w)
            seen += want >= n
            assert found == want if want >= n else found <= want
    assert seen > 200


@pytest.mark.parametrize("by", [["who"], []])
def test_windows_are_compared_by_blocks(spark, by, monkeypatch):
    """Groups of many blocks, and nothing that all tasks or the driver hold."""
    texts, quotes = quote_cases()
    who = lambda i: None if i % 11 == 10 else 7 if i % 5 else i % 3
    corpus = spark.createDataFrame([(who(i), i, t) for i, t in enumerate(texts)], "who int, doc_id long, text string")
    own = spark.createDataFrame([(who(i), i, q) for i, q in enumerate(quotes)], "who int, quote_id long, quote string")
    want = {tuple(r) for r in audit.similar_windows(own, corpus, by).collect()}
    monkeypatch.setattr(audit, "QUOTE_BLOCK", 500)
    monkeypatch.setattr(audit, "TEXT_BLOCK", 900)
    monkeypatch.setattr(windows, "STEP", 300)
    monkeypatch.setattr(windows, "FEW", 0)
    found = audit.similar_windows(own, corpus, by)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20
    if not by:
        assert "Broadcast" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(audit, "BROADCAST_RUNS", 0)
    assert {tuple(r) for r in audit.similar_windows(own, corpus, by).collect()} == want
