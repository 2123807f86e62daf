"""What the operators of this subpackage share: scratch tables, row keys, Arrow helpers, text hashing.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir`` (a folder of
our own only where that is unset, as in tests), so that they outlive executors.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shuffle files of a finished write are of no use to later jobs.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables. A temporary one only in local mode, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandworks-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: cuts the lineage there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/strandworks-{name}-{uuid.uuid4().hex}"
    with session_conf(spark, {_CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Set session options for one job and put the old values back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    """How many partitions the session deals shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Only the id (long) and the text (null: empty), whatever else the table carries; the row itself as ``_row`` if asked."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_row else []),
    )


class Keyed(NamedTuple):
    rows: DataFrame  # doc_id, text, rid
    texts: DataFrame  # rid, text, once for each rid
    plain: bool  # whether rids are the ids


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> Keyed:
    """``doc_id, text, rid``, and ``rid, text`` once for each rid. A rid is unique per distinct (doc_id, text) and ordered as doc_id is.

    Normally ids are unique and rid is the id itself. If an id is null or repeated, distinct
    (doc_id, text) pairs are numbered in order (null ids last, then by a 128-bit text digest):
    range partitions are sorted, counted, and numbered on from the counts before them. Fully repeated
    rows are one document and share a rid.
    """
    slim = narrow(docs, id_col, text_col, keep_row)
    seen = slim.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    repeated = seen["ids"] < seen["n"] or bool(
        slim.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    )
    if not repeated:
        rows = slim.withColumn("rid", F.col("doc_id"))
        return Keyed(rows, rows.select("rid", "text"), True)
    marked = slim.withColumn("digest", F.md5(F.col("text").cast("binary")))
    pairs = marked.select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")).distinct()
    order = [F.col("k_id").asc_nulls_last(), F.col("k_digest")]
    placed = materialise(pairs.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "rid-ranges")
    # the counts are one row per partition, which bounds what is broadcast
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = placed.join(F.broadcast(base), "part")
    numbered = materialise(placed.select("k_id", "k_digest", (within + F.col("base")).cast("long").alias("rid")), "rids")
    rows = marked.join(
        numbered, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    ).drop("k_id", "k_digest", "digest")
    return Keyed(rows, rows.select("rid", "text").dropDuplicates(["rid"]), False)


#: Rows of a few numbers each that may be broadcast: 64 MB at the most.
BROADCAST_ROWS = 2_000_000


def small_enough(written: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table of narrow rows has at most ``most`` of them: the check before a broadcast."""
    return written.limit(most + 1).count() <= most


# --- Arrow and numpy -------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the offsets of its rows, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def groups_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes. Rows must be parted by a non-word byte."""
    inside = is_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = [edge]
    if len(inside) and inside[0]:
        edges.insert(0, np.zeros(1, np.int64))
    if len(inside) and inside[-1]:
        edges.append(np.full(1, len(inside), np.int64))
    edge = np.concatenate(edges)
    return edge[::2], edge[1::2]


#: The low 0, 1, ... 8 bytes of a 64-bit integer.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a word that is its own key.
SHORT = 15
_LONG = U64(0xFF << 56)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each word, in two halves: equal keys mean equal words.

    A word of up to ``SHORT`` bytes is its own key, with its length in the top byte. A longer one
    has a BLAKE2b digest of 120 bits: two of n long words share a key with probability n * n / 2**121.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    lo = eight[starts] & _LOW[np.minimum(size, 8)]
    hi = (eight[starts + np.minimum(size, 8)] & _LOW[np.clip(size - 8, 0, 7)]) | (size.astype(U64) << U64(56))
    for i in np.flatnonzero(size > SHORT).tolist():
        d = hashlib.blake2b(padded[starts[i] : ends[i]].data, digest_size=16).digest()
        lo[i], hi[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:15], "little") | int(_LONG)
    return lo, hi


def folded(lo: np.ndarray, hi: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of 128-bit keys. It selects and groups; whoever calls things equal compares keys or bytes."""
    with np.errstate(over="ignore"):
        return mix(lo ^ mix(hi + U64(seed) * _MULT))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, for what is compared exactly later on."""
    return folded(*word_keys(data, starts, ends))


def parted(data: np.ndarray, offsets: np.ndarray, sep: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with one separator byte after each row, and the new offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, sep, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = data
    return out, offsets + np.arange(n + 1)


#: Words of ``[^\x20\x09-\x0D]+`` by their UTF-8 bytes.
SPACED_WORD = np.ones(256, bool)
SPACED_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, letters, all else beyond ASCII.
PLAIN_WORD = np.zeros(256, bool)
PLAIN_WORD[0x30:0x3A] = PLAIN_WORD[0x61:0x7B] = PLAIN_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
