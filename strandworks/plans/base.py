"""The tables that the registered queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions import sequence as S


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    """Documents as raw sources: species is the source, the key is the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("species"), F.col("doc_id").cast("string").alias("sequence_key"), F.concat_ws(":", "source", "doc_id").alias("source_name"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )


def sources(spark, sf_dir, alphabet="ACGTN"):
    """Cleaned sources."""
    return documents(spark, sf_dir).withColumn("seq", S.clean(F.col("text"), alphabet)).drop("text")


def acgt(spark, sf_dir):
    """Sources of A, C, G and T only."""
    return documents(spark, sf_dir).withColumn("seq", S.strict_clean(F.col("text"))["sequence"]).drop("text")


#: The cleaned text of the given tables: ê is the one character there whose two bytes are both letters.
CLEAN = (
    "upper(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({x}, ''), 'ê', 'NN'), '[^\\x00-\\x7F]', 'N', 'g'), "
    "'[^A-Za-z]', '', 'g'), '[^ACGTNacgtn]', 'N', 'g'))"
)
SRC = f"""src AS (
  SELECT source AS species, CAST(doc_id AS VARCHAR) AS sequence_key, source || ':' || doc_id AS source_name, doc_id, {CLEAN.format(x="text")} AS seq
  FROM documents
)"""
ACGT = """acgt AS (
  SELECT source AS species, source || ':' || doc_id AS source_name, doc_id, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS seq
  FROM documents
)"""
SPLIT = """spl AS (
  SELECT species, source_name, doc_id, split, s AS start, e - s AS size, seq[s + 1 : e] AS seq FROM (
    SELECT *, unnest(['train', 'val', 'test']) AS split, unnest([CAST(0 AS BIGINT), a, b]) AS s, unnest([a, b, n]) AS e FROM (
      SELECT *, a + CAST(trunc(CAST(n AS DOUBLE) * 0.2) AS BIGINT) AS b FROM (
        SELECT *, CAST(length(seq) AS BIGINT) AS n, CAST(trunc(CAST(length(seq) AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a FROM src)))
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
