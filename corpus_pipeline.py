"""A training corpus from raw documents: language, quality, near-duplicates, privacy, packing.

Every stage takes documents with any further columns, of any names, and returns
the same columns (the last one the packed pieces). Nulls in any column are
allowed; an empty table gives an empty table. Models are trained on the table
`documents` itself (and `labels`), on the folds that their operators leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofworks.llm import langid, packing, pii, quality_gam, simhash
from asofworks.llm.common import checkpoint, held, ready, table

#: Texts whose best language is less likely than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    there = {c.lower() for c in docs.columns}
    while name in there:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows.

    A null text, an empty one and one without a letter go. Repeated rows go or
    stay together; a score of exactly the least one stays.
    """
    net = langid.fit(table(spark, sf_dir, "documents").where(~held("doc_id", 4, 2)))
    own, score = free(docs, "_language"), free(docs, "_language_score")
    found = langid.identify(docs, net, lang_out=own, score_out=score)
    return found.where((F.col(own) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(own, score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model takes for good.

    Null and empty texts are scored like any other (as texts without words).
    Repeated rows go or stay together; a score of exactly the threshold stays.
    """
    model = quality_gam.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held("doc_id", 5, 0)))
    score, good = free(docs, "_quality"), free(docs, "_good")
    return quality_gam.classify(docs, model, score_out=score, verdict_out=good).where(F.col(good) == 1).drop(score, good)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id, once; documents without an id stay.

    Null and empty texts, and those of white space alone, are one group. Of equal
    ids the smallest hash of the text stays; an id with texts of several groups
    stands in each. Rows that are equal but for other columns are one document.
    """
    ready(spark)
    return simhash.without_copies(docs.where("doc_id IS NOT NULL")).unionByName(docs.where("doc_id IS NULL"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows a text that has changed.

    A null text stays null; repeated rows get equal pseudonyms.
    """
    ready(spark)
    n = free(docs, "_pseudonyms")
    done = pii.pseudonymise(docs, pii.session_key(spark, pii.OPEN_KEY), count_out=n)
    return done.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(n)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the corpus: a row for each piece of a document. A null or empty text is one piece, the end token; repeated rows are packed each."""
    ready(spark)
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("PII pseudonyms", private), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
