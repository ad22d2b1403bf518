"""From documents to token shards: language ID, near-dedup, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's documents.

Defined cases: texts that are null or have no letter are rejected as no language; empty and repeated rows are therefore gone or
merged before decontamination; very long texts are worked on whole; null ids, sources and languages and extra columns are carried;
an empty table passes through all stages and gives no rows. Which of several equal rows stays makes no difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import decontaminate, langid, mixing, near_dup, token_blocks
from duoscope.llm.registry import unpacked
from duoscope.session import scratch_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on these documents, does not reject."""
    found = langid.predict(docs, langid.fit(docs))
    return unpacked(found.where(~F.col("rejected")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: that with the smallest id. Rows go by id and text, so other texts of an id stay."""
    return near_dup.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times."""
    taken = mixing.with_copies(docs).where("copies > 0")
    return unpacked(taken.select("row", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix and what reading them back gives per document."""
    return token_blocks.token_table(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Language model and tokenizer have no SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
