"""Flattening run results and configurations into report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_SOURCE = "array<struct<species:string,source_name:string,sample_bytes:bigint,sample_bases:bigint,arithmetic_bits_per_base:double,coded_bytes:bigint,gzip_bytes:bigint,bases_per_second:double,compression_bytes_per_second:double>>"
RESULT = f"map<string,map<string,struct<aggregate:struct<sample_bases:bigint,coded_bytes:bigint,gzip_bytes:bigint,arithmetic_bits_per_base:double>,per_source:{PER_SOURCE}>>>"


def branches(results: DataFrame, json_col: str = "results") -> DataFrame:
    """One row per (run, split, mode); malformed branches are null and drop out."""
    parsed = results.withColumn("r", F.from_json(json_col, RESULT))
    split = parsed.select(*[c for c in results.columns if c != json_col], F.explode("r").alias("split", "modes"))
    return split.select(*[c for c in split.columns if c != "modes"], F.explode("modes").alias("mode", "branch")).filter("branch is not null")


def aggregate_rows(b: DataFrame) -> DataFrame:
    return b.filter("branch.aggregate is not null").select(*[c for c in b.columns if c != "branch"], "branch.aggregate.*")


def source_rows(b: DataFrame) -> DataFrame:
    return b.select(*[c for c in b.columns if c != "branch"], F.explode("branch.per_source").alias("s")).select(*[c for c in b.columns if c != "branch"], "s.*")


def ratios(rows: DataFrame) -> DataFrame:
    """Against two bits a base, raw bytes and gzip; null where the denominator is zero or missing."""
    return rows.withColumns({
        "vs_two_bit": F.try_divide("arithmetic_bits_per_base", F.lit(2.0)),
        "vs_raw": F.try_divide("coded_bytes", "sample_bases"),
        "vs_gzip": F.try_divide("coded_bytes", "gzip_bytes"),
    })


def with_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """The published percentage by source name, else by species, else null."""
    by_name = baseline.select(F.col("name").alias("source_name"), F.col("percent").alias("p1"))
    by_species = baseline.select(F.col("name").alias("species"), F.col("percent").alias("p2"))
    return rows.join(by_name, "source_name", "left").join(by_species, "species", "left").withColumn("baseline_percent", F.coalesce("p1", "p2")).drop("p1", "p2")


def curve_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "percent_of_two_bit": F.col("arithmetic_bits_per_base") / 2 * 100,
        "baseline_bits_per_base": F.col("baseline_percent") / 100 * 2,
        "mbases_per_second": F.col("bases_per_second") / 1e6,
        "compression_mbytes_per_second": F.col("compression_bytes_per_second") / 1e6,
    })


def dataset_order(rows: DataFrame, dataset: DataFrame) -> DataFrame:
    """``sort_key``: the first place of the source name in the dataset list (place, name), else of the species, else 10**9."""
    first = dataset.groupBy("name").agg(F.min("place").alias("place"))
    by_name = first.select(F.col("name").alias("source_name"), F.col("place").alias("o1"))
    by_species = first.select(F.col("name").alias("species"), F.col("place").alias("o2"))
    return rows.join(by_name, "source_name", "left").join(by_species, "species", "left").withColumn("sort_key", F.coalesce("o1", "o2", F.lit(10**9)).cast("long")).drop("o1", "o2")


def with_legacy(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    return rows.unionByName(legacy.withColumns({"split": F.lit("test"), "mode": F.lit("legacy")}), allowMissingColumns=True)


def flatten_struct(rows: DataFrame, column: str, key: str) -> DataFrame:
    """``key, name, value``: dotted names of a struct's leaves; arrays drop out, nulls stay."""
    from pyspark.sql import types as T

    def leaves(kind, path):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            elif not isinstance(f.dataType, T.ArrayType):
                yield [*path, f.name]

    pairs = [F.struct(F.lit(".".join(p)).alias("name"), F.col(".".join([column, *p])).cast("string").alias("value")) for p in leaves(rows.schema[column].dataType, [])]
    return rows.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.*")


def merged_metrics(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, metric, value) rows; of one metric the last part that has it wins."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    w = Window.partitionBy(key, "metric").orderBy(F.desc("priority"))
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select(key, "metric", "value")


def artifact_name(name: Column, fallback: str = "run") -> Column:
    """Everything but letters and digits as one underscore, trimmed; ``train_windows_x`` becomes ``windows_x``."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    short = F.when(clean.startswith("train_windows_"), F.substr(clean, F.lit(7))).otherwise(clean)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(fallback))


def run_name(*choices: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def run_metadata(runs: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    return runs.select(key, *(c.isNotNull().alias(f"has_{n}") for n, c in parts.items()))
