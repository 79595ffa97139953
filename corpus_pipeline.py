"""The corpus pipeline: five stages over `documents`, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. Nulls, empty texts, repeated rows and empty tables are
what the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuswright.llm import common, decontam, packing, queries, rules, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep(docs)


@common.tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id. Fingerprints of
    at most three differing bits link, and five-word similarities of 0.8 or more."""
    return simhash.deduplicate(docs, similar=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by marks; every document stays."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    return packing.pack_documents(docs, queries.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints by XXH64 and the tokenizer have no form in SQL; tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage stored for itself goes when its result is
    stored, and its input with it; the packed pieces are all that the last result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as kept:
            docs, path = common.materialise(stage(spark, docs, sf_dir), name)
            kept.add(path)
        common.remove(spark, *before)
        before = [path]
    packed = common.tidy(STAGES[-1][1])(spark, docs, sf_dir)
    common.remove(spark, *before)
    return packed
