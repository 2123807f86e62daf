"""A store of coded blocks: an index of (source, block, symbols, bytes, checksum, table) beside the bytes, and the tables that they were coded by.

The store is two Parquet folders, so blocks are decoded where they lie, in parallel, and joined to the originals block by block.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators.coding import CODED_INTERVALS, _filled, decode_many


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; one of our own in local mode only, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="strandworks-store-")


def write_store(coded: DataFrame, tables: DataFrame, path: str) -> None:
    """Store ``source_name, block_id, symbols, coded`` and the ``source_name, letters, counts`` that these were coded by; equal tables are stored once."""
    t = tables.withColumn("table_id", F.md5(F.concat_ws(":", "letters", F.array_join(F.transform("counts", lambda x: x.cast("string")), ","))))
    t.select("table_id", "letters", "counts").distinct().write.parquet(f"{path}/tables")
    blocks = coded.join(t.select("source_name", "table_id"), "source_name")
    index = ("source_name", "block_id", "symbols", F.length("coded").cast("long").alias("coded_bytes"), F.crc32("coded").alias("checksum"), "table_id", "coded")
    blocks.select(*index).write.parquet(f"{path}/blocks")


def decoded(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``source_name, block_id, seq, fault``: stored blocks decoded; a block whose bytes or table are not what was stored has no ``seq``, and ``fault`` says why."""

    def seqs_of(rows: list[dict]) -> list[str]:
        width = max(len(r["counts"]) for r in rows) + 1
        cum = np.array([(c := [0, *accumulate(r["counts"])]) + c[-1:] * (width - len(c)) for r in rows])
        sizes = np.array([r["symbols"] for r in rows])
        found, cut = decode_many([r["coded"] for r in rows], sizes, cum), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return ["".join(map(r["letters"].__getitem__, found[a:b].tolist())) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, faults = batch.select(["symbols", "coded_bytes", "checksum", "coded", "letters", "counts"]).to_pylist(), []
            for r in rows:
                data = r["coded"] = r["coded"] or b""
                faults.append("no table" if r["letters"] is None else "length" if len(data) != r["coded_bytes"] else "checksum" if zlib.crc32(data) != r["checksum"] else None)
            good = [i for i, f in enumerate(faults) if not f]
            seqs: list[str | None] = [None] * len(rows)
            for lo, up in _filled([rows[i]["symbols"] for i in good], CODED_INTERVALS):
                for i, seq in zip(good[lo:up], seqs_of([rows[i] for i in good[lo:up]]), strict=True):
                    seqs[i] = seq
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.string()), pa.array(faults, pa.string())], ["source_name", "block_id", "seq", "fault"])

    return blocks.join(tables, "table_id", "left").select("source_name", "block_id", "symbols", "coded_bytes", "checksum", "coded", "letters", "counts").mapInArrow(run, "source_name string, block_id long, seq string, fault string")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/tables"))


def check_store(found: DataFrame, originals: DataFrame) -> DataFrame:
    """``source_name, blocks, exact, bad_blocks``: decoded blocks against the originals' (``source_name, block_id, seq``); lost, added, damaged and different ones are named."""
    o = originals.select("source_name", "block_id", F.col("seq").alias("original"))
    j = o.join(found.select("source_name", "block_id", "seq", "fault"), ["source_name", "block_id"], "full")
    why = F.when(F.col("original").isNull(), "added").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("seq").isNull(), "lost").when(F.col("seq") != F.col("original"), "different")
    bad = F.array_sort(F.collect_list(F.when(why.isNotNull(), F.struct("block_id", why.alias("why")))))
    return j.groupBy("source_name").agg(F.count("*").alias("blocks"), (F.count(why) == 0).alias("exact"), bad.alias("bad_blocks"))
