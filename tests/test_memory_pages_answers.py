"""Point-in-time memory, main content, profiles, structured answers and their scores."""

import json
import math
import random
from datetime import date
from time import process_time

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofworks.functions import answers, pages, profiles
from asofworks.operators import memory, scoring, stats

SF = "/root/testdata/sf0.001"
D = date


# Memory


@pytest.fixture(scope="module")
def vectors(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") * 37 % 1500).cast("int"))
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), day.alias("day")).cache()


def nearest(vectors, k=10, every=50):
    rows = [(r["id"], np.array(r["vector"], float), r["day"]) for r in vectors.collect()]
    out = {}
    for i, v, t in rows:
        if i % every == 0:
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w, d in rows if d <= t)
            out[i] = [j for _, j in near[:k]]
    return out


def test_memory_against_all_pairs(spark, vectors):
    want = nearest(vectors)
    rows, cells = memory.index(vectors, memory.fit(vectors, cells=16))
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.col("day").alias("t"))
    days = {r["id"]: r["day"] for r in vectors.collect()}

    def found(**how):
        out = {}
        for r in sorted(memory.search(asked, rows, cells, **how).collect(), key=lambda r: r["rank"]):
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    assert found(exact=True, probes=2) == want
    rows, cells = memory.index(vectors, memory.fit(vectors, cells=64))
    some = found(exact=False, probes=40)
    hits = sum(len(set(some[i]) & set(own)) for i, own in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))  # recall at 10: neighbours of these vectors are spread wide
    assert all(days[j] <= days[i] for i, own in some.items() for j in own)


def test_memory_of_odd_rows(spark):
    kind = "id int, vector array<double>, day date"
    rows = [(1, [1.0, 0.0], D(2024, 1, 1)), (2, [2.0, 0.1], D(2024, 1, 2)), (3, None, D(2024, 1, 1)), (4, [0.0, 0.0], D(2024, 1, 1)), (5, [float("nan"), 1.0], D(2024, 1, 1)), (6, [1.0, None], D(2024, 1, 1)), (7, [3.0, 0.0], D(2024, 1, 1)), (8, [0.0, 1.0], None)]
    m = spark.createDataFrame(rows, kind)
    rows_, cells = memory.index(m, memory.fit(m))
    asked = spark.createDataFrame([(1, [1.0, 0.0], D(2024, 1, 1)), (2, [1.0, 0.0], D(2024, 1, 9)), (3, [0.0, 0.0], D(2024, 1, 9)), (4, [1.0, 1.0], D(2023, 1, 1))], "query_id int, vector array<double>, t date")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in memory.search(asked, rows_, cells, exact=True).collect())
    assert got == [(1, 1, 1), (1, 2, 7), (2, 1, 1), (2, 2, 7), (2, 3, 2)]
    none, empty = memory.index(m.where("false"), memory.fit(m.where("false")))
    assert none.count() == 0 and len(empty.centres) == 0


def test_memory_by_blocks(spark, monkeypatch):
    """Blocks of few rows and queries; copies and multiples of a vector tie by the smaller key, bit for bit as SQL sums; null days and empty memories."""
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 7)).astype(np.float32)
    rows = [(i, (base[i % 40] * (1 if i % 3 else 4)).tolist(), D(2024, 1, 1 + i % 9) if i % 13 else None) for i in range(400)]
    m = spark.createDataFrame(rows, "id long, vector array<float>, day date")
    asked = m.where("id % 5 = 0").select(F.col("id").alias("query_id"), "vector", F.col("day").alias("t"))

    def cosine(a, b):
        x = y = z = 0.0
        for p, q in zip(a, b, strict=True):
            x, y, z = x + p * q, y + p * p, z + q * q
        return max(-1.0, min(1.0, x / math.sqrt(y * z)))

    want = {(i, n + 1, j) for i, v, t in rows if i % 5 == 0 and t for n, (_, j) in enumerate(sorted((-cosine(v, w), j) for j, w, day in rows if day and day <= t)[:10])}
    monkeypatch.setattr(memory, "QUERIES_A_PART", 30)
    monkeypatch.setattr(memory, "ROWS_A_SALT", 25)
    monkeypatch.setattr(memory, "PAIRS", 640)
    held, cells = memory.index(m, memory.fit(m, cells=6))
    assert {(x["query_id"], x["rank"], x["id"]) for x in memory.search(asked, held, cells, probes=2).collect()} == want
    none, empty = memory.index(m.where("false"), memory.fit(m.where("false")))
    assert memory.search(asked, none, empty).count() == 0


def test_hot_cells_are_dealt(spark, vectors, monkeypatch):
    want = nearest(vectors)
    rows, cells = memory.index(vectors, memory.fit(vectors, cells=2))
    monkeypatch.setattr(memory, "ROWS_A_SALT", 40)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.col("day").alias("t"))
    got = {}
    for r in sorted(memory.search(asked, rows, cells, exact=False, probes=2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


# Pages


def test_markdown():
    html = "<head><title>The  title</title><meta name=author content=Ann><meta property='article:published_time' content='2024-01-02'></head><nav>no</nav><article><h2>Head &amp; more</h2><p>One <b>two</b> <a href='/x'>three</a><br>four</p><p>p2<p>p3<ol><li>a<ul><li>b</li></ul><li>c</ol><blockquote><p>said</p></blockquote><pre>x\n  y</pre><table><tr><th>h<th>i<tr><td>1</td><td>2</td></table><img src=i.png alt='an i'><hr></article><footer>no</footer>"
    text, markdown, n, title, author, day = pages.parsed(html)
    assert markdown == "## Head & more\n\nOne **two** [three](/x)  \nfour\n\np2\n\np3\n\n1. a\n  - b\n2. c\n\n> said\n\n```\nx\n  y\n```\n\n| h | i |\n| 1 | 2 |\n\n![an i](i.png)\n\n---"
    assert text == "Head & more\nOne two three four\np2\np3\na\nb\nc\nsaid\nx\n  y\nh i\n1 2" and n == len(text)
    assert (title, author, day) == ("The title", "Ann", "2024-01-02")
    assert pages.parsed(None) == pages.parsed("") == ("", "", 0, None, None, None)
    assert pages.parsed("only <b>this</b>")[:2] == ("only this", "only **this**")
    assert pages.parsed("<div>no article</div><form>x</form><p>two")[0] == "no article\ntwo"


def test_built_pages_read_back():
    """Random articles: what their text was, and Markdown that holds each block behind its mark."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    for _ in range(200):
        text, markdown, html = [], [], []
        for _ in range(r.randrange(1, 9)):
            words = " ".join(word() for _ in range(r.randrange(1, 12)))
            kind = r.choice(["p", "h1", "h3", "blockquote", "li"])
            text.append(words)
            lead = {"p": "", "h1": "# ", "h3": "### ", "blockquote": "> ", "li": "- "}[kind]
            markdown.append(lead + words)
            inner = words.replace(" ", r.choice([" ", "\n ", " <span>"]) if "<" not in words else " ", 1)
            html.append(f"<ul><li>{inner}</ul>" if kind == "li" else f"<{kind}>{inner}</{kind}>")
        got = pages.parsed(f"<header>menu</header><main>{''.join(html)}</main><aside>x</aside>")
        assert got[0] == "\n".join(text)
        assert [x for x in got[1].split("\n") if x] == markdown


@pytest.mark.parametrize("page", ["<a " * 8000, "<b>" * 8000 + "</i>" * 8000, '<a "' * 8000, "<!" * 8000, "<p><td>" + "<b>" * 8000 + "<hr>" * 8000, "<div>" * 8000 + "<td></td>" * 8000, "<" * 50000, "&" * 50000])
def test_hostile_pages(page):
    began = process_time()
    pages.parsed(page)
    profiles.parse(page)
    assert process_time() - began < 3


def test_all_pages(spark):
    own = spark.read.parquet(f"{SF}/pages.parquet")
    got = own.select("page_id", pages.content(F.col("html")).alias("x")).select("page_id", "x.*")
    assert got.count() == own.count() and got.where("extracted_text_len <> length(extracted_text) OR extracted_text = ''").count() == 0


# Profiles


def entry(kind, i):
    if kind == "work":
        return f"<li class='x experience-item'><h3 class='experience-item__title'>T{i}</h3><h4 class='experience-item__subtitle'>C{i} &amp; Co</h4><span class=date-range>20{i:02d} - Present 26 years</span></li>"
    return f"<li class='education__list-item'><h3>S{i}</h3><h4>BSc</h4><h4> - </h4><h4>Maths</h4><span class='date-range'>19{70 + i} – 19{73 + i} · 3 yrs</span></li>"


def test_profiles_in_any_order():
    r = random.Random(2)
    for _ in range(30):
        parts = [("work", i) for i in range(r.randrange(4))] + [("study", i) for i in range(r.randrange(4))]
        r.shuffle(parts)
        name, headline, place, bio, work, study, restricted = profiles.parse("<title>Ann - Head - of | LinkedIn</title><h1>Ann</h1>" + "".join(entry(k, i) for k, i in parts))
        assert (name, headline, place, bio) == ("Ann", "Head - of", None, None)
        assert work == [{"title": f"T{i}", "company": f"C{i} & Co", "start": f"20{i:02d}", "end": None, "description": None} for k, i in parts if k == "work"]
        assert study == [{"school": f"S{i}", "degree": "BSc", "field": "Maths", "start": f"19{70 + i}", "end": f"19{73 + i}"} for k, i in parts if k == "study"]
        assert restricted == (not parts)


def test_masked_profiles_and_json():
    node = {"@graph": [{"@type": "Other"}, {"@type": "Person", "name": "Bo", "description": "about", "address": {"addressLocality": "***** **"}, "worksFor": [{"name": "W", "member": {"startDate": 2001}}, {"name": "****"}, "x"], "alumniOf": [{"name": "U", "member": {"startDate": 1990, "endDate": 1994}}]}]}
    html = f"<script type='application/ld+json'>{{no</script><script type='application/ld+json'>{json.dumps(node)}</script>"
    name, headline, place, bio, work, study, restricted = profiles.parse(html)
    assert (name, headline, place, bio, restricted) == ("Bo", None, None, "about", True)  # its page shows stars
    assert work == [{"title": None, "company": "W", "start": "2001", "end": None, "description": None}]
    assert study == [{"school": "U", "degree": None, "field": None, "start": "1990", "end": "1994"}]
    masked = "<li class=experience-item><h3 class=experience-item__title>*** **</h3></li>" + entry("study", 1).replace("Maths", "****")
    assert profiles.parse(masked)[4:] == ([], [{"school": "S1", "degree": "BSc", "field": None, "start": "1971", "end": "1974"}], True)
    assert profiles.parse(None) == (None, None, None, None, [], [], True)


# Answers and scores


def test_odd_answers(spark):
    said = json.dumps({"sectors_excited": ["bare", {"item": "A", "conviction": 250, "citations": [{"date": "d"}, {"date": "d", "quote": "q"}]}, {"name": "", "item": ""}], "tokens_concerned": [{"name": "b", "conviction": "x", "horizon": None}], "tokens_excited": None, "sectors_concerned": "none"})
    df = spark.createDataFrame([(said,), ("{}",), ("no json",), (None,)], "j string")
    got = [[(x["item"], x["item_type"], x["stance"], x["conviction"], x["horizon"], x["provenance"], len(x["citations"])) for x in r[0] or []] for r in df.select(answers.view_items(F.col("j"))).collect()]
    assert got == [[("A", "sector", "bullish", 100, "tactical", "extrapolated", 1), ("b", "token", "bearish", 50, "tactical", "extrapolated", 0)], [], [], []]
    risk = [tuple(r[0]) for r in df.select(answers.risk(F.col("j"))).collect()]
    assert set(risk) == {("no_view", 0, "", "extrapolated")}


def test_spans_of_years(spark):
    cases = {"1973 - 1975": ("1973", "1975"), "2000 - Present 26 years": ("2000", None), "Jan 2019 – Mar 2021 2 yrs 3 mos": ("Jan 2019", "Mar 2021"), "2001": ("2001", None), "2010 — current · 5 yrs": ("2010", None), "": (None, None)}
    got = {r["t"]: tuple(r["y"]) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", answers.years(F.col("t")).alias("y")).collect()}
    assert got == cases and {t: profiles.span(t) for t in cases} == cases


def test_bars_are_sorted_and_the_last_of_a_day_counts(spark):
    day = 86_400_000
    said = json.dumps({"data": [{"time": str(2 * day), "close": "3"}, {"time": str(day), "close": "1", "open": "0.5"}, {"time": day, "close": "2"}, {"close": "9"}, {"time": str(3 * day), "close": "n/a"}]})
    got = spark.createDataFrame([(said,)], "j string").select(F.inline(answers.bars(F.col("j")))).collect()
    assert [(r["date"], r["open"], r["close"]) for r in got] == [(D(1970, 1, 2), None, 2.0), (D(1970, 1, 3), None, 3.0), (D(1970, 1, 4), None, None)]


def test_transcript_routes(spark):
    uuid = "0123abcd-" + "e" * 27
    rows = [(["videos"], "youtu.be/abcdefghijk", ("videos", "youtube", "abcdefghijk", "")), (["podcasts"], f"player.simplecast.com/{uuid}", ("podcasts", "whisper", uuid, "")), (["videos"], f"player.simplecast.com/{uuid}", ("videos", "none", None, "video without youtube embed")), (["podcasts"], None, ("podcasts", "none", None, "podcast without youtube or simplecast")), (["articles"], "youtu.be/abcdefghijk", None), ([], "x", None), (None, "x", None)]
    df = spark.createDataFrame([(i, f, h) for i, (f, h, _) in enumerate(rows)], "i int, f array<string>, h string")
    got = df.select("i", answers.transcript_route(F.col("f"), F.col("h")).alias("r")).orderBy("i").collect()
    assert [None if r["r"] is None else tuple(r["r"]) for r in got] == [w for _, _, w in rows]


def test_scores(spark):
    a = spark.createDataFrame([("x", "m", "m", "80"), ("x", "m", None, "sure"), ("y", "n", "m", None)], "who string, truth string, guess string, sure string")
    assert {tuple(r) for r in scoring.tally(a, "who", "guess", "truth", "sure").collect()} == {("x", 2, 1, 0.5, 80.0), ("y", 1, 0, 0.0, None)}
    u = spark.createDataFrame([("k", ["b", "a"], "second", 2), ("k", ["c", None, "a"], "first", 1), ("l", None, "only", 1)], "k string, xs array<string>, name string, n int")
    assert sorted(map(tuple, scoring.list_union(u, "k", ("xs",), "n").collect())) == [("k", ["a", "b", "c"], "first", 1), ("l", [], "only", 1)]
    done = spark.createDataFrame([("a", 1)], "member string, as_of int")
    everyone = spark.createDataFrame([("a",), ("b",)], "member string")
    assert sorted(map(tuple, scoring.missing_tasks(done, everyone, spark.createDataFrame([(1,), (2,)], "as_of int")).collect())) == [("a", 2), ("b", 1), ("b", 2)]


def test_normal_tail(spark):
    xs = [0.0, 0.1, -1.96, 2.42, 5.0, 9.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "t double").select(stats.two_sided_p(F.col("t"))).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in xs[:-1]], rel=2e-7)
