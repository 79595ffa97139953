"""One thin query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, licenses, oracles, packing, quality_cnn, rules, secrets, sharding, simhash, urlfilter, warc

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def vocabulary_path() -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, _table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: each is filed as source/lang/(a thousand ids)/doc_id, and one whose
    first or last sentence is its notice is a licence file of that folder."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.scan(docs, licenses.template_table(spark), (F.col("kind") == 0) & ((F.col("line") == 0) | F.col("last")))


def _stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.materialise(rules.ledger(_table(spark, sf_dir, "documents")), "ledger")[0]


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; policies are masks on its bits."""
    book = _stored_ledger(spark, sf_dir)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes("base")).alias("base_failed"), rules.passes("v2").alias("kept"), F.col("failed").alias("failed_rules"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs, from the stored ledger alone."""
    return rules.ablation(_stored_ledger(spark, sf_dir), "v2")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (op1_warc, op2_quality, op3_packing, op4_secrets, op5_sharding, op6_urls, op7_licenses, op8_rules, op9_decontamination, op10_simhash, rules_ablation)
    return {f.__name__: common.tidy(f) for f in known}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ALL)
