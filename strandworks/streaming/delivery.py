"""Resumed delivery of a stream of events: each row once, whatever is replayed.

What a batch adds is written to a folder of the next version, overwriting what a failed try left there; then the ledger of that
version, with the last number delivered of each run, is written, and only its success mark makes the version count. A batch
that comes again, after either write or with a lost checkpoint, finds its rows in the ledger.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Delivery:
    """For ``writeStream.foreachBatch``: events (``run, seq, ...``; ``seq`` counts up within a run) go to Parquet under ``root``."""

    def __init__(self, root: str):
        self.root = root

    def version(self, spark: SparkSession) -> int:
        """The last version whose ledger is whole; 0 before the first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger/version=*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(re.search(r"version=(\d+)/", f.getPath().toString()).group(1)) for f in found), default=0)

    def ledger(self, spark: SparkSession) -> DataFrame:
        """``run, delivered``."""
        v = self.version(spark)
        return spark.read.parquet(f"{self.root}/ledger/version={v}") if v else spark.createDataFrame([], "run bigint, delivered bigint")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known, version = self.ledger(spark), self.version(spark) + 1
        new = batch.dropDuplicates(["run", "seq"]).join(known, "run", "left").filter(F.col("delivered").isNull() | (F.col("seq") > F.col("delivered"))).drop("delivered")
        self.write(new, f"{self.root}/rows/version={version}")
        # the ledger is made of what was written, so it never names a row that was not
        added = spark.read.schema(new.schema).parquet(f"{self.root}/rows/version={version}").select("run", F.col("seq").cast("long").alias("delivered"))
        known.unionByName(added).groupBy("run").agg(F.max("delivered").alias("delivered")).write.mode("overwrite").parquet(f"{self.root}/ledger/version={version}")

    def write(self, rows: DataFrame, path: str) -> None:
        """Where rows go; a sink of one's own has to overwrite what an earlier try of this version left."""
        rows.write.mode("overwrite").parquet(path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of versions that count, with the ``version`` that brought them."""
        return spark.read.parquet(f"{self.root}/rows").filter(F.col("version") <= self.version(spark))
