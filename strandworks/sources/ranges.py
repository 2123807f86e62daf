"""FASTA records of files of any size, read by byte ranges.

Spark's text reader cuts plain files to ranges and settles the lines at the cuts; which record a range begins in, and how far into it,
follows from one row for each range (headers in it, letters behind the last), summed up over the ranges of the file. Gzipped
files have one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.operators.blocks import cut_anew
from strandworks.sources.fasta import Cutter

PIECES = "path string, range long, nth long, header string, lo long, seq string"
ENDS = "path string, range long, heads long, tail long, header string"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The lines of each range, in order; rows of a task are those of whole ranges, one after another."""
    rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), line) for batch in batches for i, line in enumerate(batch.column(2).to_pylist()))
    held = next(rows, None)
    while held is not None:
        key = held[:2]

        def lines() -> Iterator[bytes]:
            nonlocal held
            while held is not None and held[:2] == key:  # noqa: B023
                yield held[2].strip()
                held = next(rows, None)

        yield key, lines()


def _header(line: bytes) -> str:
    return line[1:].strip().decode("utf-8", "replace")


def read_record_ranges(spark: SparkSession, root: str, block: int = 1 << 20) -> DataFrame:
    """``path, record, header, block_id, start, seq`` as ``fasta.read_records`` gives them, of the ``*.fa`` and ``*.fa.gz`` files under a folder.

    A file's ranges are read by as many tasks as ``spark.sql.files.maxPartitionBytes`` makes of them.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fa,fa.gz}").option("lineSep", "\n").text(root)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, at), found in _ranges(batches):
            heads, tail, header = 0, 0, None
            for line in found:
                if line.startswith(b">"):
                    heads, tail, header = heads + 1, 0, line
                else:
                    tail += len(line.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pylist([{"path": path, "range": at, "heads": heads, "tail": tail, "header": None if header is None else _header(header)}], ends_schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, at), found in _ranges(batches):
            nth, header, cutter = 0, None, Cutter(block)

            def out(parts) -> Iterator[pa.RecordBatch]:
                for lo, seq in parts:
                    yield pa.RecordBatch.from_pylist([{"path": path, "range": at, "nth": nth, "header": header, "lo": lo, "seq": seq.decode()}], pieces_schema)  # noqa: B023

            for line in found:
                if line.startswith(b">"):
                    yield from out(cutter.rest())
                    nth, header, cutter = nth + 1, _header(line), Cutter(block)
                    yield from out([(0, b"")])
                elif line:
                    # one character a byte, so that places are characters
                    yield from out(cutter.add(line.decode("utf-8", "replace").upper().encode("ascii", "replace") if not line.isascii() else line.upper()))
            yield from out(cutter.rest())

    ends_schema = pa.schema([("path", pa.string()), ("range", pa.int64()), ("heads", pa.int64()), ("tail", pa.int64()), ("header", pa.string())])
    pieces_schema = pa.schema([("path", pa.string()), ("range", pa.int64()), ("nth", pa.int64()), ("header", pa.string()), ("lo", pa.int64()), ("seq", pa.string())])
    # one row for each range: what lies before it in its file
    w = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    e = lines.mapInArrow(ends, ENDS).withColumn("letters", before("tail"))
    since = F.last(F.when(F.col("heads") > 0, F.col("letters")), ignorenulls=True).over(w)
    opened = F.last(F.when(F.col("heads") > 0, F.col("header")), ignorenulls=True).over(w)
    e = e.select("path", "range", before("heads").alias("records"), opened.alias("opened"), (F.col("letters") - F.coalesce(since, F.lit(0))).alias("into"))
    j = lines.mapInArrow(pieces, PIECES).join(e, ["path", "range"])
    first = F.col("nth") == 0
    placed = j.select(
        "path", (F.col("records") + F.col("nth") - 1).alias("record"), F.when(first, F.col("opened")).otherwise(F.col("header")).alias("header"),
        (F.col("lo") + F.when(first, F.col("into")).otherwise(0)).alias("lo"), F.length("seq").cast("long").alias("n"), "seq",
    )
    return cut_anew(placed.filter("record >= 0"), ["path", "record", "header"], block)
