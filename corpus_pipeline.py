"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage works on all that the one before it kept; its result is written as Parquet and read
again. All stages but the last return the columns of ``documents``, whatever else these are called.

Defined results: null and empty texts fail the quality rules and go. Rows of one id with different texts are
documents of their own, in the order of a digest of their texts; fully repeated rows are one document to line
dedup, and one row of them stays after the Jaccard join. A null id counts as the largest, so of a group such a row stays only if no other
is in it. Of copies the smallest id stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandworks.llm import decontam, jaccard, linededup, packing, quality
from strandworks.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; the count of characters follows."""
    from pyspark.sql import functions as F

    out = linededup.clean_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", curve_packing),
]

#: Near-duplicate groups, Hilbert keys and token ids have no SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
