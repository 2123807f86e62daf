"""Line dedup over overlapping three-line windows.

Lines are split at ``\\n``; a line counts if it holds anything but white space, and is compared
without the white space around it. Each three consecutive counting lines of a document are a
window. Of all occurrences of a window, in all documents, the first (by id, then place) stays; the
lines of later occurrences are covered, covered places are merged, and covered lines are removed.
Lines that don't count are never part of a window and always stay. Windows are judged on the input, not on what is left.

A digest of 128 bits stands for a window. Windows are counted with partial sums before the shuffle,
so a window that a third of all documents share is one row per task there. The repeated ones are
written, then joined back: both sides of that join are plain exchanges, so Spark can split the
occurrences of a very common window over tasks (or broadcasts the written table if it is small).

Defined results: null and empty texts have no lines that count and stay as they are; texts of fewer than three counting lines are never changed; where ids are repeated or null,
see ``common.keyed``: fully repeated rows are one document, and none of them is a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import keyed, materialise

WINDOW = 3
_SPACE = "\\x20\\x09-\\x0D"


def line_table(text: Column) -> Column:
    """``array<struct<i, line>>`` of the counting lines, with their places among all lines."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, f"^[{_SPACE}]+|[{_SPACE}]+$", "").alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid, p, h``: the hash of each window, p being its first line's place among counting lines."""
    lines = docs.select("rid", F.transform(line_table(F.col("text")), lambda x: x["line"]).alias("lines"))
    n = F.size("lines") - window + 1
    hashed = F.transform(
        F.slice("lines", 1, F.greatest(n, F.lit(0))),
        lambda _, i: F.struct(i.alias("p"), F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i + 1, window)).cast("binary"))).alias("h")),
    )
    return lines.select("rid", F.explode(hashed).alias("w")).select("rid", "w.p", "w.h")


def later_windows(found: DataFrame) -> DataFrame:
    """``rid, p`` of every occurrence but the first of each repeated window."""
    counted = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("rid", "p")).alias("first"))
    again = materialise(counted.filter("n > 1").select("h", "first"), "repeated-windows")
    return found.join(again, "h").filter((F.col("rid") != F.col("first.rid")) | (F.col("p") != F.col("first.p"))).select("rid", "p")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_row: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` per row; with ``keep_row`` also the row that came in, as ``_row``."""
    rows, texts, _ = keyed(docs, id_col, text_col, keep_row)
    found = materialise(windows(texts, window), "windows")
    covered = (
        later_windows(found)
        .select("rid", F.explode(F.sequence(F.col("p"), F.col("p") + window - 1)).alias("p"))
        .groupBy(F.col("rid").alias("c_rid"))
        .agg(F.collect_set("p").alias("gone"))
    )
    # a repeated row meets the one entry of its rid, so each row gets the same result
    joined = rows.join(covered, F.col("rid") == F.col("c_rid"), "left").withColumns({"_t": line_table(F.col("text")), "_lines": F.split("text", "\n")})
    placed = joined.withColumn("_gone", F.transform("gone", lambda p: F.get(F.col("_t"), p)["i"]))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return placed.select(
        "doc_id",
        F.size("_t").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        *(["_row"] if keep_row else []),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the lines gone, in the columns that came in. Nothing else changes."""
    out = dedup(docs, id_col, text_col, window, keep_row=True)
    new = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_row")[text_col])
    return out.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
