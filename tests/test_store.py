"""A store is decoded to what was coded, and says which block is not what was stored."""

import random

from pyspark.sql import functions as F

from strandworks.operators import coding as K
from strandworks.sources import store as ST
from strandworks.sources.fasta import blocks_of


def stored(spark, path):
    rng = random.Random(8)
    rows = [(f"s{i}", "".join(rng.choice("ACGT"[: 1 + i % 4]) for _ in range(n))) for i, n in enumerate((1, 2, 999, 1000, 1001, 5000, 3000))]
    src = spark.createDataFrame(rows, "source_name string, seq string")
    blocks, tables = blocks_of(src, 1000), K.letter_tables(src)
    ST.write_store(K.encode_sequences(blocks, tables), tables, path)
    return blocks, dict(rows)


def test_stored_and_read_again(spark, tmp_path):
    blocks, rows = stored(spark, str(tmp_path / "s"))
    out = {r.source_name: r for r in ST.check_store(ST.read_store(spark, str(tmp_path / "s")), blocks).collect()}
    assert {n: (r.blocks, r.exact, r.bad_blocks) for n, r in out.items()} == {n: (-(-len(s) // 1000), True, []) for n, s in rows.items()}
    index = spark.read.parquet(str(tmp_path / "s" / "blocks"))
    assert index.agg(F.sum("symbols")).first()[0] == sum(map(len, rows.values()))
    assert index.filter("coded_bytes <> length(coded)").count() == 0


def test_faults_are_found_and_named(spark, tmp_path):
    path = str(tmp_path / "s")
    blocks, _ = stored(spark, path)
    found, tables = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/tables")
    at = lambda s, b: (F.col("source_name") == s) & (F.col("block_id") == b)
    flip = F.udf(lambda x: bytes([*x[:20], x[20] ^ 4, *x[21:]]) if len(x) > 20 else x, "binary")
    bad = found.withColumn("coded", F.when(at("s6", 1), flip("coded")).when(at("s5", 4), F.expr("substring(coded, 1, length(coded) - 1)")).otherwise(F.col("coded")))
    bad = bad.filter(~at("s5", 0)).withColumn("table_id", F.when(at("s3", 0), "gone").otherwise(F.col("table_id")))
    bad = bad.unionByName(found.filter(at("s4", 0)).withColumn("block_id", F.lit(7).cast("long"))).filter(~at("s2", 0))
    bad = bad.unionByName(found.filter(at("s6", 0)).withColumn("source_name", F.lit("s2")))
    out = {r.source_name: [(b.block_id, b.why) for b in r.bad_blocks] for r in ST.check_store(ST.decoded(bad, tables), blocks).filter("not exact").collect()}
    assert out == {"s6": [(1, "checksum")], "s5": [(0, "lost"), (4, "length")], "s3": [(0, "no table")], "s4": [(7, "added")], "s2": [(0, "different")]}
