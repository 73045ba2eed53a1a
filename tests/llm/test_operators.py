"""The operators on Spark: odd rows, empty tables, clashing columns, and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofworks.llm import gif, graph, html_text, langid, lm_mixing, lm_model, packing, pieces, pii, quality_gam, quality_rules, simhash
from asofworks.llm.common import hash_sample, held

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, batch int, component_id long"


def rows():
    r = random.Random(4)
    words = "the of and thanedble eriner anea was is rely thing".split()
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(60, 120))) + ".\nEnd of it.", "en" if i % 3 else "de") for i in range(40)]
    near = out[5][1].split()
    out += [(100, None, "en"), (101, "", None), (102, " \n\t", "en"), (103, out[3][1], "en"), (104, " ".join([*near[:50], "the", *near[50:]]), "en")]
    out += [(105, "mail a.b@mail7.example.com or 4111 1111 1111 1111", "en"), (106, "x" * 3000 + " " + "漢字é" * 800, "de"), (106, "x" * 3000 + " " + "漢字é" * 800, "de"), (None, "no id here but some words", "en"), (107, "12 34 !!", "en"), (108, "the of " * 9000, "en")]
    return [(i, t, lang, "s", len(t or ""), 0.5, "fp", 1, 7) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def key(r):
    return (str(r[0]), str(r[1]))


def test_hash_sample(docs, empty):
    assert hash_sample(docs, ["doc_id", "text"], 1000).count() == docs.distinct().count()
    assert 0 < hash_sample(docs, ["doc_id", "text"], 20).count() < docs.count()
    assert hash_sample(empty, ["doc_id", "text"], 5, "lang").count() == 0
    same = docs.sparkSession.range(3000).select(F.lit(7).alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    assert hash_sample(same, ["doc_id", "text"], 20).count() <= 1 and hash_sample(same, ["doc_id", "text"], 5000, "lang").count() == 1


def test_language(docs, empty):
    out = langid.identify(docs, langid.fit(docs.where(~held("doc_id", 4, 2)), per_language=20))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "lang_pred"}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 107))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_quality_model(docs, empty, labels):
    model = quality_gam.fit(docs, labels)
    out = quality_gam.classify(docs, model, keep=["doc_id"])
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.collect())
    assert quality_gam.classify(empty, quality_gam.fit(empty, labels)).count() == 0


def test_quality_rules(docs, empty, labels):
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert len(out) == docs.select("doc_id").distinct().count()
    assert out[100]["n_words"] == 0 and out[100]["base_failed"] and not out[100]["kept"]
    assert out[108]["n_repeat_words"] == out[108]["n_words"] == 18000 and out[108]["base_failed"]
    assert quality_rules.judge(empty, labels).count() == 0


def brute_groups(pairs):
    fps = {k: simhash.fingerprint((t or "").encode()) for k, t in pairs}
    root = {k: k for k, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = [k for k, _ in pairs]
    for a in ks:
        for b in ks:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (f"{fps[k]:016x}", find(k)) for k in ks}


def test_near_duplicates(docs, empty):
    own = docs.where("doc_id IS NOT NULL")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(own).collect()}
    want = brute_groups(sorted({(r[0], r[1]) for r in rows() if r[0] is not None}))
    assert got == want and simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_slices_of_a_hot_shard_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 8)
    r = random.Random(1)
    fps = sorted({r.getrandbits(12) << 50 | r.getrandbits(3) for _ in range(150)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {x["node"]: x["root"] for x in graph.components(simhash.links(nodes)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    group = {f: roots.get(f, f) for f in signed}
    label = {f: f for f in signed}
    for _ in range(20):
        for a in signed:
            label[a] = min(label[b] for b in signed if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    assert len(set(group.values())) == len(set(label.values())) and all((group[a] == group[b]) == (label[a] == label[b]) for a in signed for b in signed[:10])


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, empty):
    from asofworks.llm.tokens import Encoder

    out = packing.pack(docs, size=64).collect()
    own, want = Encoder(), Counter()
    for r in rows():
        ids = [*own.ids(r[1] or "").tolist(), 2]
        first = (len(ids) - 1) % 64 + 1
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            b = first if k == 0 else a + 64
            raw = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            want[r[0], k, a, b - a, zlib.crc32(raw)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 64) * 1.05 + 1
    assert packing.pack(empty).count() == 0


def test_pseudonyms(docs, empty):
    out = pii.pseudonymise(docs.withColumn("n_pseudonyms", F.lit(-1)), b"key")
    got = sorted(((r["doc_id"], r["text"], r["n_pseudonyms"]) for r in out.collect()), key=key)
    assert out.columns == [*docs.columns, "n_pseudonyms"]
    want = sorted(((r[0], r[1]) for r in rows()), key=key)
    assert [(a[0], a[1]) for a in got if a[0] != 105] == [w for w in want if w[0] != 105]
    assert next(a for a in got if a[0] == 105)[2] == 2
    assert sorted(((r["doc_id"], r["text"]) for r in pii.reveal(out, b"key").collect()), key=key) == want
    assert pii.pseudonymise(empty, b"key").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"")
    spark = docs.sparkSession
    with pytest.raises(ValueError):
        pii.session_key(spark)
    assert pii.session_key(spark, b"own") == b"own"
    spark.conf.set(pii.KEY_CONF, "secret")
    assert pii.session_key(spark) == b"secret"
    spark.conf.unset(pii.KEY_CONF)


def test_media(docs, empty):
    import hashlib

    stored = gif.store(docs, keep=["doc_id", "text"]).collect()
    assert len(stored) == len(rows())
    for r in stored:
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    own = gif.frames(gif.store(docs.where("doc_id < 3"), keep=["doc_id"]).withColumn("media", F.when(F.col("doc_id") == 1, F.lit(b"xx")).otherwise(F.col("media"))))
    assert {r["doc_id"]: r["frame"] for r in own.collect()} == {0: 0, 1: None, 2: 0}
    assert gif.store(empty).count() == 0


def test_pieces(docs, empty):
    whole = pieces.encode(docs).collect()
    s = pieces.solver(None)
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in whole:
        m = pieces.MARK + texts[r["doc_id"]].replace(" ", pieces.MARK) if texts[r["doc_id"]] else ""
        assert r["score"] == (s.forward(m, 0, len(m))[0][-1] if m else 0)
    chunked = pieces.encode(docs, chunk=500)
    assert Counter((r["doc_id"], bytes(r["ids"]), r["score"]) for r in chunked.collect()) == Counter((r["doc_id"], bytes(r["ids"]), r["score"]) for r in whole)
    out = pieces.decode(chunked).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in out) == Counter((r[0], r[1] or "") for r in rows())
    assert pieces.digest(empty).count() == 0


def test_language_model(docs, empty):
    out = lm_mixing.fit_and_score(docs, folds=7, held_fold=2).collect()
    training, seen = Counter(), 0
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    for r in rows():
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2:
            training.update(words(r[1]))
    seen, distinct = sum(training.values()), len(training)
    texts = {r[0]: r[1] for r in rows()}
    assert len(out) == len(rows())
    for r in out:
        own = words(texts[r["doc_id"]])
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in training for w in own), seen)
        assert r["base_score"] == pytest.approx(sum(math.log10((training[w] + 1) / (seen + distinct + 1)) for w in own))
        assert r["score"] < 0
    assert lm_mixing.fit_and_score(empty).count() == 0


def test_language_model_counts_all_documents(spark):
    texts = [f"one two{' ' if i % 5 else chr(9)}three  four{chr(10) if i % 7 else ''}" + "z" * (i % 11) for i in range(300)]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = lm_mixing.token_counts(training).cache()
    found = {bytes(r["token"]): r["c"] for r in counts.collect()}
    assert {w: c for w, c in found.items() if w[:1] != b" "} == Counter(w for t in texts for w in t.encode().split())
    assert found[b" "] == 300
    after, between = Counter(), Counter()
    for t in texts:
        t = t.encode() + b"\xff"
        for k, b in enumerate(t):
            if b in b" \t\n\xff":
                (after if k and t[k - 1] not in b" \t\n" else between)[b] += 1
    assert {w[2]: c for w, c in found.items() if w[:2] == b" a"} == after and {w[2]: c for w, c in found.items() if w[:2] == b" b"} == between
    model = lm_mixing.fit(training, counts, sample_docs=6)
    assert (model.n_tokens, model.n_distinct) == (300 + sum(c for w, c in found.items() if w[:1] != b" "), 1 + sum(w[:1] != b" " for w in found))
    code = model.code
    raw = np.zeros((lm_model.CONTEXTS, 2 * lm_model.SLOTS), np.int32)
    lm_model.count_into(raw, code, [t.encode() for t in texts])
    for k in range(lm_model.CONTEXTS):
        values, less = lm_model.tables(raw[k])
        assert (model.values[k] == values).all() and (model.less[k] == less).all()


def test_starting_weights_come_from_all_documents(spark):
    """Every decision of every text, by plain loops: at each gate's weights their cost is least, however texts are dealt."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["one", "two", "three", f"x{r.randrange(90)}"]) for _ in range(20)) for _ in range(120)] + ["zz " * 40 + "rare qq"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_mixing.fit(docs.repartition(5), lm_mixing.token_counts(docs), sample_docs=3)
    again = lm_mixing.fit(docs.coalesce(1), lm_mixing.token_counts(docs))
    assert (model.weights == again.weights).all()
    seen = {}
    for text in texts:
        s = lm_model.Symbols(model.code, [text.encode()])
        for i, leaf in enumerate(s.leaf.tolist()):
            first = int(model.code.start[leaf])
            for packed in model.code.packed[first : first + int(model.code.size[leaf])].tolist():
                slot, gate, bit = lm_model.parts(packed)
                values = [int(model.less[k][int(s.contexts[k][i] ^ slot) << 1 | bit]) * (2 * bit - 1) for k in range(lm_model.CONTEXTS)]
                seen.setdefault(gate + int(s.place[i]), []).append([max(-15, min(15, round(v / 8))) / 2 for v in values])
    assert len(seen) > 8
    for gate, w in enumerate(model.weights):
        x = np.array(seen.get(gate, [[0.0] * lm_model.CONTEXTS]))
        assert np.abs((x / (1 + np.exp(x @ w))[:, None]).sum(axis=0) - (w - 0.3)).max() < 1e-4 * (1 + len(x))


def test_continuations_by_brute_force(spark):
    """What batches name, counted again over all of them; and copies are told by each other."""
    r = random.Random(2)
    passage = " ".join(f"p{r.randrange(500)}" for _ in range(90))
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(80)) + (" " + passage if i % 3 == 0 else "") for i in range(60)]
    twice = [i for i in range(60) if i % 3 and zlib.crc32(str(i).encode()) % 7 != 2][:2]  # both are learned from
    texts[twice[0]] = texts[twice[1]] = " ".join(f"v{r.randrange(900)}" for _ in range(150))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 7 == 2).withColumn("batch", (F.col("doc_id") % 3).cast("int"))
    code = lm_model.Code.of([], 1, [1] * 7, [1] * 7, [[1] * 256] * 3)
    shared = spark.sparkContext.broadcast(lm_model.Model(code, None, None, None, None, None, n_tokens=1))
    got = {}
    for x in lm_mixing.continuations(docs.repartitionById(3, "batch"), shared).collect():
        got.setdefault((x["batch"], x["key"]), set()).add((x["name"], x["n"], bytes(x["code"])))
    votes, asking, places = {}, {}, Counter()
    for batch in range(3):
        own = {}
        for i in range(batch, 60, 3):
            w = lm_model.Words([texts[i].encode()])
            units, border = w.units(code)
            for a, k, b in zip(*(x.tolist() for x in w.keyed()), strict=True):
                asking.setdefault((batch, k), set()).add(i % 7 == 2)
                if i % 7 != 2:
                    own.setdefault(k, Counter())[units[border[a] : border[b]]] += 1
                    places[k] += 1
        for k, found in own.items():
            part, n = max(found.items(), key=lambda x: (x[1], lm_model.name_of(x[0])))
            votes.setdefault(k, Counter())[part] += n
    want = {}
    for (batch, k), who in asking.items():
        if k in votes and (True in who or places[k] > 1):
            top = sorted(((-n, lm_model.name_of(p), p) for p, n in votes[k].items()))[:2]
            want[batch, k] = {(name, -n, p) for n, name, p in top}
    assert got == want and len(want) > 10
    out = {x["doc_id"]: x["bits_per_byte"] for x in lm_mixing.fit_and_score(docs.select("doc_id", "text")).collect()}
    others = [v for k, v in out.items() if k not in twice and k % 3]
    assert max(out[k] for k in twice) < 0.5 * min(others)


def test_continuations_are_counted_over_the_whole_corpus(spark):
    """What is no batch's most frequent continuation may be that of the corpus, and none of its occurrences is left out."""
    parts = {0: "aa " * 5 + "zz " * 3, 1: "bb " * 5 + "zz " * 3, 2: "cc " * 4 + "zz " * 3 + "aa"}
    rows = [(f"one two three four {word}", False, batch) for batch, words in parts.items() for word in words.split()]
    docs = spark.createDataFrame([*rows, ("one two three four what", True, 2), ("one two three four what", True, 3)], "text string, held_out boolean, batch int")
    code = lm_model.Code.of([], 1, [1] * 7, [1] * 7, [[1] * 256] * 3)
    shared = spark.sparkContext.broadcast(lm_model.Model(code, None, None, None, None, None, n_tokens=1))
    got = sorted((r["batch"], r["n"], bytes(r["code"])[4:6]) for r in lm_mixing.continuations(docs.repartitionById(4, "batch"), shared).collect())
    assert got == [(b, n, word) for b in range(4) for n, word in ((6, b"aa"), (9, b"zz"))]


def test_pages(spark):
    page = "<html><nav><a href=1>Home</a></nav><article><h1>Title {0}</h1><p>One &amp; two.<p>Four</article><footer>c</footer>"
    data = [(i, "u", page.format(i), "x") for i in range(30)] + [(50, None, None, "x"), (51, "u", "", "x"), (None, "u", "<p>a", "x"), (3, "u", page.format(3), "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    out = html_text.extract(pages, html_text.fit(pages))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(data) and got[4] == "Title 4\nOne & two.\nFour" and got[50] == got[51] == "" and got[None] == "a"
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_spelled_words_are_counted_once_a_distinct_word(spark):
    """Tables and weights equal those of all symbols of all texts; of rare words only the ends are read again with each text."""
    r = random.Random(9)
    rare = [f"q{k}é" for k in range(60)] + ["y" * 70, "Z" * 90 + "x"]  # twice each, or too long for a symbol of its own
    texts = [" ".join(r.choice(["one", "two", "three"]) for _ in range(9)) + " ".join(["", *r.sample(rare, 3)]) + r.choice(["", "\n", " ", "\t\n"]) for _ in range(40)] + ["", " ", *["y" * 70] * 4]
    training = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(3)
    counts = lm_mixing.token_counts(training).cache()
    model = lm_mixing.fit(training, counts)
    code, raw = model.code, [t.encode() for t in texts]
    spelled = Counter({bytes(x["token"]): x["c"] for x in counts.collect() if x["token"][:1] != b" " and bytes(x["token"]) not in code.atoms})
    assert spelled[b"y" * 70] > 3 and len(spelled) > 2 and max(spelled.values()) > 1
    whole, ends = lm_model.Symbols(code, raw), lm_model.Symbols(code, raw, inner=False)
    words = lm_model.Spellings(code, list(spelled), np.array(list(spelled.values())))
    total = Counter()
    for s, n in ((ends, [1] * len(ends.leaf)), (words, words.times.tolist())):
        for *x, k in zip(s.leaf.tolist(), s.place.tolist(), *(c.tolist() for c in s.contexts), n, strict=True):
            total[tuple(x)] += k
    assert total == Counter(zip(whole.leaf.tolist(), whole.place.tolist(), *(c.tolist() for c in whole.contexts), strict=True))
    assert len(ends.leaf) + len(words.leaf) < 0.8 * len(whole.leaf)
    all_counts = np.zeros((lm_model.CONTEXTS, 2 * lm_model.SLOTS), np.int32)
    lm_model.count_into(all_counts, code, raw)
    for k in range(lm_model.CONTEXTS):
        values, less = lm_model.tables(all_counts[k])
        assert (model.values[k] == values).all() and (model.less[k] == less).all()
    cells = np.zeros(lm_model.GATES * lm_model.CELLS, np.int64)
    lm_model.cells_into(cells, code, lm_model.levels(model.less), whole)
    for gate in range(lm_model.GATES):
        own = cells[gate * lm_model.CELLS : (gate + 1) * lm_model.CELLS]
        at = np.flatnonzero(own)
        assert (model.weights[gate] == (np.round(lm_model.gate_weights(at, own[at]), 9) if len(at) else 0.3)).all()
