"""The pipeline's stages on the smallest tables, each against a plain version of itself."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asofworks.llm import langid, packing, pii, quality_gam, simhash
from asofworks.llm.common import ARROW_ROWS, READER_ROWS, held, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    spark.conf.set(pii.KEY_CONF, "key of the test")
    out, docs = [], table(spark, SF, "documents")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_names(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, *_ in stages] == ["language ID", "quality classifier", "SimHash near-dedup", "PII pseudonyms", "best-fit packing"]
    assert all(new.columns == columns for _, _, new in stages[:-1])


def test_language_and_quality_decide(spark, stages):
    _, docs, kept = stages[0]
    net = langid.fit(docs.where(~held("doc_id", 4, 2)))
    want = {r["doc_id"] for r in langid.identify(docs, net).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert set(rows(kept)) == want and len(want) > 0.9 * docs.count()
    _, docs, kept = stages[1]
    model = quality_gam.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(~held("doc_id", 5, 0)))
    assert set(rows(kept)) == {r["doc_id"] for r in quality_gam.classify(docs, model).collect() if r["predicted"]}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_each_group_of_near_copies_stays(spark, stages):
    _, docs, kept = stages[2]
    own = {k: shingles(t) for k, t in rows(docs).items()}
    alike = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b])
    left = set(rows(kept))
    gone = set(own) - left
    assert all(any(alike(a, b) >= 0.7 for b in own if b < a) for a in gone)  # nothing goes without a copy before it
    pairs = [(a, b) for a in own for b in own if a < b and alike(a, b) >= 0.9]
    assert sum(a in left and b in left for a, b in pairs) <= 0.02 * len(pairs)


def test_near_copies_of_made_texts(spark):
    import random

    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(150)] for _ in range(12)]
    data = []
    for k, words in enumerate(base):
        data += [(100 * k, " ".join(words)), (100 * k + 1, " ".join([*words[:70], "extra", *words[70:]])), (100 * k + 2, " ".join(words).upper())]
    data += [(9000, None), (9001, ""), (9002, "one"), (9003, "one")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: i // 100 * 100 for i, _ in data if i < 9000} | {9000: 9000, 9001: 9000, 9002: 9002, 9003: 9002}


def test_near_copies_are_decided_by_their_shingles(spark):
    import random

    r = random.Random(7)
    data, alike = [], {}
    for k in range(240):  # pairs that differ in words far apart, at similarities on both sides of 0.8
        n = r.randrange(105, 400)
        words = [f"v{r.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for place in r.sample(range(5, n - 5, 6), max(1, round(n * r.uniform(0.1, 0.15) / 5))):
            other[place] = f"x{r.randrange(10**6)}"
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(data[-2][1]), shingles(data[-1][1])
        alike[k] = len(a & b) / len(a | b)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    above, below = [k for k, v in alike.items() if 0.8 <= v <= 0.85], [k for k, v in alike.items() if 0.75 <= v < 0.8]
    assert len(above) > 30 and len(below) > 30
    assert sum(got[2 * k + 1] != 2 * k for k in above) <= 1  # one pair in 500 shares no band
    assert all(got[2 * k + 1] == 2 * k + 1 for k, v in alike.items() if v < 0.8)


def test_an_id_with_two_texts_keeps_both(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(80))
    data = [(5, text("a")), (5, text("b")), (3, text("a") + " more"), (9, text("b") + " more"), (5, text("b").upper()), (7, text("c")), (7, text("c")), (None, text("c"))]
    docs = spark.createDataFrame(data, table(spark, SF, "documents").select("doc_id", "text").schema)
    got = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(3, text("a") + " more"), (5, text("b")), (7, text("c")), (None, text("c"))], key=str)


def test_private_and_packed(stages):
    _, docs, done = stages[3]
    f = pii.Feistel(b"key of the test")
    assert rows(done) == {k: pii.pseudonyms(t, f)[0] for k, t in rows(docs).items()}
    _, docs, done = stages[4]
    from asofworks.llm.tokens import Encoder

    own = Encoder()
    want = {k: len(own.ids(t)) + 1 for k, t in rows(docs).items()}
    total = Counter()
    for r in done.collect():
        total[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert total == want
    assert packing.END == 2


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count()


def test_stages_take_nulls_and_empty_tables(spark):
    """Each stage on rows with nulls, repeats and columns of clashing names, and on no rows."""
    own = table(spark, SF, "documents")
    names = ["_language", "_quality", "_good", "_pseudonyms", "node", "n_pseudonyms", "score"]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \n", None, "s", 3), (3, "12 34", "en", None, 5), (3, "12 34", "en", None, 5)], own.schema)
    docs = own.limit(30).unionByName(odd)
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).distinct().collect()} == {("mine",) * len(names)}
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_each_stage_readies_its_session(spark):
    """A stage that runs alone, on documents that the one before it left, reads long texts in small batches."""
    docs = table(spark, SF, "documents").limit(5).collect()
    for name, stage in corpus_pipeline.STAGES:
        own = spark.newSession()
        stage(own, own.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF)
        assert (own.conf.get(ARROW_ROWS), own.conf.get(READER_ROWS)) == ("1000", "256"), name


def test_whole_keys_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_BYTES", 10_000)
    keys = sorted([k // 4 for k in range(400)] + [50] * 300)
    batches = [pa.RecordBatch.from_pydict({"key": keys[a : a + 7], "text": ["x" * 500] * len(keys[a : a + 7])}) for a in range(0, len(keys), 7)]
    found = [b.column("key").to_pylist() for b in simhash.whole_keys(iter(batches))]
    assert sum(found, []) == keys and sum(len(set(x)) for x in found) == 100  # every row once, no key in two batches
    assert max(len(x) for x in found if 50 not in x) * 500 < 20_000
