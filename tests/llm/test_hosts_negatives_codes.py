"""Operators 11 to 13 against brute force, and on odd rows."""

import math
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import duckdb
from asofworks.llm import hard_negatives, host_reputation, vector_codes
from asofworks.llm import queries as llm

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score string, q int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Host reputation


def urls(spark, *own):
    return spark.createDataFrame([(i, u) for i, u in enumerate(own)], "page_id long, url string")


def test_hosts_and_paths(spark):
    df = urls(spark, "http://A.Example.ORG/es/1?x#y", "https://x.com?q=/a", "x.com/a", None, "", "a://b://c/d", "http://h.net#/p", "http://É.net/a\nb?c", "http://u@h.co.uk:80")
    got = df.select("page_id", host_reputation.host_of(F.col("url")).alias("h"), host_reputation.path_of(F.col("url")).alias("p"))
    assert [tuple(r)[1:] for r in got.orderBy("page_id").collect()] == [("a.example.org", "/es/1"), ("x.com", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h.net", ""), ("É.net", "/a\nb"), ("u@h.co.uk:80", "")]


def test_longest_rule_counts(spark):
    df = urls(spark, "http://a.org/x", "http://org/x", "http://borg/x", "http://a.example.org/es/2", "http://notexample.org/es/2", "http://example.org/en/19", "http://x.com/fr/1", "http://x.com/de/1", "http://a.org", "http://x.net/de/1")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in host_reputation.judge(df).collect()}
    assert [got[i] for i in range(10)] == [("org/", "allow"), ("org/", "allow"), (None, "allow"), ("example.org/es/", "block"), ("org/", "allow"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow")]
    tie = host_reputation.ruled(F.lit("b.com"), F.lit("/xy"), (("com", "/xy", "allow"), ("b.com", "/", "block")))
    assert spark.range(1).select(tie["rule"]).first()[0] in ("com/xy", "b.com/") and spark.range(1).select(tie["verdict"]).first()[0] == "block"


def test_domains(spark):
    names = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "10.0.0.1:80": ("10.0.0.1", ""), "u@a.b.org:8080": ("b.org", "org"), "": ("", "")}
    df = spark.createDataFrame([(n,) for n in names], "host string")
    d, s = host_reputation.domain_and_suffix(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", d, s).collect()} == names


def test_beta_distribution():
    """Against sums that are exact for whole parameters, and log-gamma against the standard library."""
    for a, b in ((1, 1), (3, 9), (40, 2), (200, 350), (1, 5_000)):
        n = a + b - 1
        for x in (1 / 3, 0.5):
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a, n + 1))
            assert host_reputation.beta_cdf(x, np.array([a]), np.array([b]))[0] == pytest.approx(min(1, want), rel=1e-9, abs=1e-12)
    for x in (0.01, 0.7, 3.3, 50.5, 1e7):
        assert host_reputation.log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def plain_reputation(counts):
    """Host: (good, n) to host: (share, p_bad), level by level in plain loops; p_bad by summing the density."""
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def level(groups, mean_of):
        means = {g: mean_of(g, *v) for g, v in groups.items()}
        score = lambda w: round(math.fsum(lb(w * means[g] + k, w * (1 - means[g]) + n - k) - lb(w * means[g], w * (1 - means[g])) for g, (k, n) in groups.items() if n), 9)
        weight = max(host_reputation.WEIGHTS, key=lambda w: (score(w), -w))
        return means, weight

    domain = {h: ".".join(h.split(".")[-2:]) for h in counts}
    tables = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for h, (k, n) in counts.items():
        for t, g in zip(tables, (domain[h], h.split(".")[-1]), strict=True):
            t[g][0] += k
            t[g][1] += n
    good, n_all = map(sum, zip(*counts.values(), strict=True))
    m2, w2 = level(tables[1], lambda g, k, n: (good - k + 1) / (n_all - n + 2))
    m1, w1 = level(tables[0], lambda g, k, n: (tables[1][g.split(".")[-1]][0] - k + m2[g.split(".")[-1]] * w2) / (tables[1][g.split(".")[-1]][1] - n + w2))
    m0, w0 = level(counts, lambda g, k, n: (tables[0][domain[g]][0] - k + m1[domain[g]] * w1) / (tables[0][domain[g]][1] - n + w1))
    out = {}
    for h, (k, n) in counts.items():
        a, b = m0[h] * w0 + k, (1 - m0[h]) * w0 + n - k
        steps = 200_000
        u = math.log(host_reputation.LEAST_SHARE) - (np.arange(steps) + 0.5) / steps * 40 / a  # the share's logarithm
        out[h] = a / (a + b), float(np.exp(a * u + (b - 1) * np.log1p(-np.exp(u)) - lb(a, b)).sum() * 40 / a / steps)
    return out


def test_reputation_by_plain_loops(spark):
    counts = {"a.x.com": (40, 41), "b.x.com": (1, 30), "c.x.com": (0, 0), "a.y.com": (9, 10), "d.y.com": (2, 3), "e.z.net": (1, 25), "f.z.net": (0, 18), "g.z.net": (0, 0), "q.org": (5, 5)}
    own = [(h, i < k if i < n else None) for h, (k, n) in counts.items() for i in range(max(n, 1))]
    got = {r["host"]: r for r in host_reputation.fit(spark.createDataFrame(own, "host string, good boolean")).collect()}
    want = plain_reputation(counts)
    assert got.keys() == want.keys()
    for h, (share, p_bad) in want.items():
        assert got[h]["share"] == pytest.approx(share, rel=1e-9)
        assert got[h]["p_bad"] == pytest.approx(p_bad, abs=1e-5)
        assert got[h]["verdict"] == ("block" if got[h]["p_bad"] >= host_reputation.CERTAINTY else "allow")
    assert [h for h in counts if got[h]["verdict"] == "block"] == ["b.x.com", "e.z.net", "f.z.net", "g.z.net"]  # the last one for its domain alone


def test_pages_without_outcomes_and_odd_rows(spark):
    df = urls(spark, None, "http://a.net/x", "http://a.net/x", "b", "http://" + "l" * 50_000 + ".net/" + "p" * 50_000).withColumns({"host": F.lit(1), "share": F.lit("x"), "_salt": F.lit(2)})
    got = host_reputation.judge(df)
    assert got.columns == ["page_id", "url", "_salt", "host", "path", "rule", "verdict", "share", "p_bad"]
    rows = got.collect()
    assert len(rows) == 5 and {r["verdict"] for r in rows} == {"allow"} and {r["share"] for r in rows} == {0.5}
    assert host_reputation.judge(df.where("false")).collect() == []
    bad = spark.createDataFrame([(f"http://bad.net/{i}", False) for i in range(60)] + [(f"http://good.net/{i}", True) for i in range(60)] + [("http://bad.net/new", None)], "url string, fine boolean")
    told = {r["url"]: r["verdict"] for r in host_reputation.judge(bad, rules=(), outcome=F.col("fine")).collect()}
    assert told["http://bad.net/new"] == "block" and told["http://good.net/1"] == "allow"


def test_look_up_of_many_hosts_is_salted(spark):
    from asofworks.llm.common import looked_up

    rows = spark.range(500).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"))
    details = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for most in (100_000, 10):
        got = looked_up(rows, details, "k", most).select("id", "k", "v").orderBy("id").collect()
        assert [(r["k"], r["v"]) for r in got] == [(0, 0) if i < 300 else (i, 2 * i if i < 400 else None) for i in range(500)]


def test_op11_query(spark):
    got = llm.op11_host_reputation(spark, SF)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# Hard negatives


def plain_negatives(rows):
    """rows (id, embedding, label) by the contract's words."""
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        own.append((i, label, [math.floor(256 * x) for x in v]))
    out, done = [], set()
    for a, al, av in own:
        if a % 100 or (a, al, tuple(av)) in done:
            continue
        done.add((a, al, tuple(av)))
        scored = sorted(((-sum(x * y for x, y in zip(av, bv, strict=False)), b, bl) for b, bl, bv in own if b != a))
        for s, p, _ in [x for x in scored if x[2] == al][:5]:
            fit = [x for x in scored if x[2] != al and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    return rows_of(hard_negatives.mine(hard_negatives.mining_rows(df), **options))


def vectors(n, dims, kinds, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, spread, (6, dims))
    return [(i, [float(np.float32(x)) for x in base[rng.integers(6)] + rng.normal(0, 0.2, dims)], int(rng.integers(kinds))) for i in range(n)]


def test_negatives_by_plain_loops(spark):
    rows = vectors(420, 8, 4, 3)
    assert mined(spark, rows) == plain_negatives(rows) and len(plain_negatives(rows)) > 20


def test_negatives_with_ties_repeats_and_odd_rows(spark):
    same = [(i, [0.5, 0.25], i % 3) for i in range(700)]  # everything ties
    assert mined(spark, same) == plain_negatives(same)
    odd = vectors(210, 4, 3, 5) + [(None, [1.0] * 4, 1), (301, None, 1), (302, [1.0, None, 1.0, 1.0], 1), (303, [float("nan")] * 4, 1), (304, [float("inf")] * 4, 2), (305, [1.0] * 4, None), (306, [1.0], 1), (307, [], 0), (-100, [0.5] * 4, 1), (5, [1.0] * 4, 1), (5, [1.0] * 4, 1), (400, [0.0] * 4, 2)]
    assert mined(spark, odd) == plain_negatives(odd)
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_negatives_of_great_components(spark):
    """Products beyond what floating point holds exactly."""
    rows = [(i, [float(200_000 + (i * 7919) % 1000), float(-150_000 + (i * 104729) % 977), 3.5], i % 2) for i in range(350)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_blocks_meet_in_a_shuffle_too(spark, monkeypatch):
    rows = vectors(900, 6, 3, 8)
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    assert mined(spark, rows) == plain_negatives(rows)


# Vector codes


def plain_codes(rows, positions=4, entries=256, rounds=4):
    own = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not own:
        return []
    width = -(-max(len(q) for _, _, q in own) // positions)
    own = [(i, label, q + [0] * (positions * width - len(q))) for i, label, q in own]
    head = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))[:entries]
    part = lambda q, p: q[p * width : (p + 1) * width]
    books = [[part(q, p) for _, _, q in head] for p in range(positions)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(positions):
            members = defaultdict(list)
            for _, _, q in own:
                members[near(part(q, p), books[p])[1]].append(part(q, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else c0 for e, c0 in enumerate(books[p])]
    digest = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    told = []
    for i, label, q in own:
        found = [near(part(q, p), books[p]) for p in range(positions)]
        told.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = defaultdict(int)
    for _, label, _, d in told:
        total[label] += d
    return sorted(((i, code, d, total[label], digest) for i, label, code, d in told), key=repr)


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    return rows_of(vector_codes.compress(df, **options))


def test_codes_by_plain_loops(spark):
    rows = vectors(330, 8, 3, 11)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, positions=2, entries=7, rounds=3) == plain_codes(rows, 2, 7, 3)


def test_codes_of_odd_rows(spark):
    odd = vectors(40, 6, 2, 12) + [(None, [1.0] * 6, 1), (301, None, 1), (302, [1.0, None], 1), (303, [float("nan")] * 6, 1), (304, [float("-inf")] * 6, 2), (305, [1.0] * 6, None), (306, [1.0], None), (307, [], 0), (3, [0.5] * 6, 1), (3, [0.5] * 6, 1)]
    assert coded(spark, odd, entries=9) == plain_codes(odd, entries=9)
    assert coded(spark, odd) == plain_codes(odd)  # fewer rows than entries
    same = [(i, [0.1, -0.1, 0.3, 7.0], 1) for i in range(300)]  # one entry has all
    assert coded(spark, same) == plain_codes(same)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    great = [(i, [16_000.0 + i, -15_000.5 - 20 * i, 0.0, 1.0], i % 2) for i in range(60)]
    assert coded(spark, great, entries=5) == plain_codes(great, entries=5)


def test_only_parts_that_change_migrate(spark):
    """After the first round the shuffle brings changed parts alone; the others stay in their partitions."""
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors(400, 8, 3, 13)], VECTORS)
    own = vector_codes.whole_vectors(df, "embedding", vector_codes.SCALE, vector_codes.LIMIT, "q").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), "label", "q")
    books = vector_codes.first_books(own, 4, 256, 2)[:, :16]
    home = vector_codes.housed(vector_codes.cut(own, books), 4).persist()
    books = vector_codes.means(home, books)
    changed = vector_codes.assigned(home, books).where("entry <> before").count()
    new = vector_codes.rehoused(home, books, 4)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and 0 < changed < new.count() / 2 and new.count() == 1600


def test_sql_of_12_and_13(spark):
    """The DuckDB forms over whole tables."""
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name in ("op12_hard_negatives", "op13_vector_codes"):
        got = llm.QUERIES[name](spark, SF)
        want = duckdb.sql(llm.ORACLES[name]).df()
        own = got.toPandas()[list(want.columns)]
        assert len(own) == len(want) > 0
        key = list(want.columns)
        assert (own.sort_values(key).to_numpy() == want.sort_values(key).to_numpy()).all()
