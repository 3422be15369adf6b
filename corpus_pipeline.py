"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. doc_id is the key of a document; the operators state how they treat nulls, empty texts and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapart.llm.common import written
from terrapart.llm.decontaminate import decontaminated
from terrapart.llm.line_dedup import dedup_lines
from terrapart.llm.quality_rules import passed, quality_rules
from terrapart.llm.simhash import similar_documents
from terrapart.llm.word_bpe import digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are too frequent on their host."""
    return measured(passed(quality_rules(docs)).drop("text").withColumnRenamed("clean_text", "text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one line of each group of equal or similar lines left in the corpus."""
    return measured(dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents whose five-word shingles have a Jaccard index of 0.8 or more: that with the smallest doc_id."""
    found = similar_documents(docs)
    others = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return digests(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near), ("decontamination", benchmark), ("bpe", encode)]

#: SQL cannot express fuzzy lines, fingerprints or the tokenizer; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
