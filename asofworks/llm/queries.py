"""One query for each operator of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import gif, hard_negatives, host_reputation, html_text, langid, lm_mixing, packing, pieces, pii, quality_gam, quality_rules, simhash, vector_codes
from .common import held, table


def op1_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.fit_and_score(table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.session_key(spark, pii.OPEN_KEY), keep=["doc_id", "text"])


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages), keep=["page_id", "url"])


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("media")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.fit(docs, labels.where(~held("doc_id", 5, 0)))
    return quality_gam.classify(docs, model, keep=["doc_id"]).select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held("doc_id", 4, 2)))
    return langid.identify(docs, net, keep=["doc_id"]).select("doc_id", held("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.mining_rows(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_mixing": op1_lm_mixing,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_simhash_bktree": op3_simhash_bktree,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_text": op5_html_text,
    "op6_gif_media": op6_gif_media,
    "op7_packing": op7_packing,
    "op8_quality_gam": op8_quality_gam,
    "op9_pieces": op9_pieces,
    "op10_langid": op10_langid,
    "op11_host_reputation": op11_host_reputation,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {"op12_hard_negatives": hard_negatives.SQL, "op13_vector_codes": vector_codes.oracle()}
