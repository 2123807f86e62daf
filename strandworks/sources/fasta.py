"""Reading FASTA and flat sequence files, and keeping cleaned copies up to date.

Files are read with ``binaryFile`` (one task per file); blocks of fixed length come out, so no row
downstream holds a chromosome.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import sequence as S

CACHE_VERSION = 1


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of the files under a folder. Empty files don't show in a Spark listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def with_species(files: DataFrame, root: str) -> DataFrame:
    """Add ``species`` (the folder or file under the root) and whether the file lies in its ``dna`` folder."""
    rest = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    return files.withColumns({"species": F.substring_index(rest, "/", 1), "rest": rest, "is_dna": rest.rlike("^[^/]+/dna/[^/]+$")})


def discover_fasta(spark: SparkSession, root: str) -> DataFrame:
    """FASTA files of each species: those in ``dna/`` if there are any, else those beside it; with their keys."""
    files = with_species(list_files(spark, root, "*.fa*"), root).filter(F.col("path").rlike("\\.fa(\\.gz)?$"))
    files = files.filter(F.col("is_dna") | F.col("rest").rlike("^[^/]+/[^/]+$"))
    best = files.groupBy("species").agg(F.max("is_dna").alias("use_dna"))
    return files.join(best, "species").filter(F.col("is_dna") == F.col("use_dna")).select(
        "species", "path", "length", "modificationTime", S.sequence_key(F.regexp_extract("path", "([^/]+)$", 1)).alias("sequence_key")
    )


def source_modes(spark: SparkSession, root: str, species: list[str]) -> DataFrame:
    """``species, source_mode``: flat_file, fasta_dir, or an error naming the species that are neither."""
    files = with_species(list_files(spark, root), root).filter(F.col("species").isin(species))
    modes = files.groupBy("species").agg(
        F.max(F.col("rest") == F.col("species")).alias("flat"), F.max(F.col("path").rlike("\\.fa(\\.gz)?$") & (F.col("rest") != F.col("species"))).alias("fasta")
    ).select("species", F.when(F.col("flat"), "flat_file").when(F.col("fasta"), "fasta_dir").alias("source_mode"))
    lost = set(species) - {r.species for r in modes.filter("source_mode is not null").collect()}
    if lost:
        raise ValueError(f"neither flat file nor FASTA folder: {sorted(lost)}")
    return modes


def _letter_tables(alphabet: str) -> tuple[bytes, bytes]:
    keep = S.normalize_alphabet(alphabet).encode()
    letters = [b for b in range(256) if chr(b).isalpha()]
    other = b"N"[0] if b"N" in keep else None
    table, gone = bytearray(range(256)), []
    for b in range(256):
        up = chr(b).upper().encode("latin-1", "replace")[0] if b < 128 else b
        if up in keep:
            table[b] = up
        elif b in letters and other is not None:
            table[b] = other
        else:
            gone.append(b)
    return bytes(table), bytes(gone)


def lines_of(path: str, content: pa.Scalar) -> Iterator[bytes]:
    """The lines of a file's bytes, unpacked as they are read if it is gzipped: the text is never held whole."""
    raw = io.BytesIO(memoryview(content.as_buffer()))
    with gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw as f:
        yield from f


class Cutter:
    """Cuts a stream of text into blocks of fixed length: (start, block)."""

    def __init__(self, block: int):
        self.block, self.held, self.n, self.start = block, [], 0, 0

    def add(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        self.held.append(text)
        self.n += len(text)
        if self.n >= self.block:
            whole, at = b"".join(self.held), 0
            while self.n - at >= self.block:
                yield self.start + at, whole[at : at + self.block]
                at += self.block
            self.start, self.held, self.n = self.start + at, [whole[at:]], self.n - at

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.n:
            yield self.start, b"".join(self.held)


def _contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The given files (path and other columns) with their content; a file of over 2 GB, as stored, doesn't fit a Spark value."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fa*").load(root).select("path", "content")
    return content.join(files, "path")


def fasta_blocks(spark: SparkSession, root: str, alphabet: str = "ACGTN", block: int = 1 << 20, files: DataFrame | None = None) -> DataFrame:
    """``species, sequence_key, path, block_id, start, seq``: every file (or those given) cleaned and cut into blocks."""
    table, gone = _letter_tables(alphabet)
    names = ["species", "sequence_key", "path", "block_id", "start", "seq"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for species, key, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                cutter = Cutter(block)

                def out(pieces, who=(species, key, path)) -> Iterator[pa.RecordBatch]:
                    for at, seq in pieces:
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in who), pa.array([at // block], pa.int64()), pa.array([at], pa.int64()), pa.array([seq.decode()])], names)

                for line in lines_of(path, content):
                    line = line.strip()
                    if line and not line.startswith(b">"):
                        yield from out(cutter.add(line.translate(table, gone)))
                yield from out(cutter.rest())

    files = files if files is not None else discover_fasta(spark, root)
    rows = _contents(spark, root, files.select("path", "species", "sequence_key")).select("species", "sequence_key", "path", "content")
    return rows.mapInArrow(cut, "species string, sequence_key string, path string, block_id long, start long, seq string")


def read_records(spark: SparkSession, root: str, block: int = 1 << 20) -> DataFrame:
    """``path, record, header, block_id, start, seq``: the FASTA records of every file under a root, gzipped or not, in blocks.

    Lines are stripped and upper-cased; what stands before the first header drops out; a record without a sequence is one empty block.
    """
    names = ["path", "record", "header", "block_id", "start", "seq"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                record, header, cutter, some = -1, None, Cutter(block), False

                def out(pieces) -> Iterator[pa.RecordBatch]:
                    for at, seq in pieces:
                        row = (path, record, header, at // block, at, seq.decode("utf-8", "replace"))  # noqa: B023
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

                def ended() -> Iterator[pa.RecordBatch]:
                    if header is not None:  # noqa: B023
                        yield from out(cutter.rest() if cutter.n or some else [(0, b"")])  # noqa: B023

                for line in lines_of(path, content):
                    line = line.strip()
                    if line.startswith(b">"):
                        yield from ended()
                        record, header, cutter, some = record + 1, line[1:].strip().decode("utf-8", "replace"), Cutter(block), False
                    elif line and header is not None:
                        for got in out(cutter.add(line.upper())):
                            some = True
                            yield got
                yield from ended()

    files = list_files(spark, root, "*.fa*").filter(F.col("path").rlike("\\.fa(\\.gz)?$")).select("path")
    return _contents(spark, root, files).select("path", "content").mapInArrow(cut, "path string, record long, header string, block_id long, start long, seq string")


def flat_blocks(spark: SparkSession, root: str, block: int = 1 << 20) -> DataFrame:
    """``species, sequence_key, block_id, start, seq``: flat files as they are, one source per file, named after the species, uncleaned; a byte is a character."""
    names = ["species", "sequence_key", "block_id", "start", "seq"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for species, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                for at in range(0, len(data), block):
                    seq = bytes(data[at : at + block]).decode("latin-1")
                    yield pa.RecordBatch.from_arrays([pa.array([species]), pa.array([species]), pa.array([at // block], pa.int64()), pa.array([at], pa.int64()), pa.array([seq])], names)

    files = spark.read.format("binaryFile").load(root).select(F.regexp_extract("path", "([^/]+)$", 1).alias("species"), "content")
    return files.mapInArrow(cut, "species string, sequence_key string, block_id long, start long, seq string")


#: Blocks of a piece that they are cut from.
PIECE_BLOCKS = 32


def blocks_of(rows: DataFrame, block: int, keep_empty: bool = False) -> DataFrame:
    """Cut a ``seq`` column into blocks of fixed length; an empty one has none, or one empty block if these are kept.

    Blocks are cut from pieces: a place in a string is found by walking up to it, so that cutting each from the whole is quadratic.
    """

    def cut(rows: DataFrame, size: int, at: str) -> DataFrame:
        n = F.ceil(F.length("seq") / size).cast("int")
        n = F.greatest(n, F.lit(1)) if keep_empty else n
        ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return rows.withColumn(at, F.explode(ids)).withColumn("seq", F.substr("seq", F.col(at) * size + 1, F.lit(size)))

    out = cut(cut(rows, block * PIECE_BLOCKS, "_piece"), block, "block_id")
    out = out.withColumn("block_id", F.col("_piece").cast("long") * PIECE_BLOCKS + F.col("block_id")).drop("_piece")
    return out.select(*(c for c in rows.columns if c not in ("block_id", "start")), "block_id", (F.col("block_id") * block).alias("start"))


def cache_status(files: DataFrame, manifest: DataFrame, alphabet: str, enabled: bool = True) -> DataFrame:
    """``status`` of each file against the manifest of cleaned files: hit, created, rebuilt or disabled."""
    now = files.withColumn("identity", F.sha2(F.to_json(F.struct(F.lit(CACHE_VERSION).alias("version"), "path", "length", "modificationTime", F.lit(alphabet).alias("alphabet"))), 256))
    if not enabled:
        return now.withColumn("status", F.lit("disabled"))
    known = manifest.select(F.col("path").alias("m_path"), F.col("identity").alias("m_identity"))
    j = now.join(known, F.col("path") == F.col("m_path"), "left")
    status = F.when(F.col("m_identity").isNull(), "created").when(F.col("m_identity") == F.col("identity"), "hit").otherwise("rebuilt")
    return j.withColumn("status", status).drop("m_path", "m_identity")


def status_totals(statuses: DataFrame) -> DataFrame:
    """How many files were hits, created, rebuilt or left out."""
    of = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s)
    return statuses.agg(F.count("*").alias("applicable"), *map(of, ("hit", "created", "rebuilt", "disabled")))


def token_cache_key(identity: list[Column]) -> Column:
    """SHA-256 of a token table entry's identity; split scope is part of it, so splits never share an entry."""
    return F.sha2(F.to_json(F.struct(*identity)), 256)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or none if there is nothing at that path yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


MANIFEST = "path string, identity string, version long"


def refresh_clean(spark: SparkSession, root: str, table: str, alphabet: str = "ACGTN", block: int = 1 << 20, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks, statuses) of the FASTA files under a root, cleaned through the table at ``table``.

    Only files that are new or have changed are read; their blocks take the place of older ones, file by
    file, and only then does the manifest name them, so that a run that breaks off is made good by the
    next. Without the table (``enabled`` false) everything is cleaned and nothing is kept.
    """
    files = discover_fasta(spark, root)
    if not enabled:
        return fasta_blocks(spark, root, alphabet, block), cache_status(files, spark.createDataFrame([], MANIFEST), alphabet, enabled=False)
    known = read_or_none(spark, f"{table}/manifest")
    known = spark.createDataFrame([], MANIFEST) if known is None else known
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    current = known.groupBy("path").agg(F.max_by("identity", "version").alias("identity"))
    statuses = cache_status(files, current, alphabet)  # of the manifest as it was listed above, whatever is added below
    changed = statuses.filter("status <> 'hit'")
    blocks = fasta_blocks(spark, root, alphabet, block, changed).withColumn("file_id", F.sha2("path", 256))
    empty = changed.select(F.sha2("path", 256).alias("file_id"), "species", "sequence_key", "path")  # so that a file without sequence replaces its older blocks too
    blocks = blocks.unionByName(empty.withColumns({"block_id": F.lit(-1).cast("long"), "start": F.lit(0).cast("long"), "seq": F.lit("")}))
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(f"{table}/blocks")
    changed.select("path", "identity", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{table}/manifest")
    out = spark.read.parquet(f"{table}/blocks").filter("block_id >= 0")
    return out.join(statuses.select("path"), "path", "left_semi").select("species", "sequence_key", "path", "block_id", "start", "seq"), statuses


def refresh_tokens(wanted: DataFrame, identity: list[Column], tokenise: Callable[[DataFrame], DataFrame], table: str) -> tuple[DataFrame, DataFrame]:
    """(token rows, statuses) of ``wanted`` sources through the table at ``table``: only entries that it lacks are tokenised, and appended.

    ``identity`` is what an entry depends on (source, its bytes or their digest, split and its place, tokeniser);
    ``tokenise`` maps rows of ``wanted`` with ``cache_key`` to token rows that keep it.
    """
    spark = wanted.sparkSession
    keyed = wanted.withColumn("cache_key", token_cache_key(identity))
    known = read_or_none(spark, f"{table}/entries")
    have = keyed.select("cache_key").limit(0) if known is None else known.select("cache_key").distinct()
    statuses = keyed.join(have.withColumn("have", F.lit(True)), "cache_key", "left").withColumn("status", F.when(F.col("have"), "hit").otherwise("created")).drop("have")
    missing = keyed.join(have, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    if not missing.isEmpty():  # both writes are of the entries as they were listed above
        tokenise(missing).write.mode("append").parquet(f"{table}/tokens")
        missing.select("cache_key").write.mode("append").parquet(f"{table}/entries")
    return spark.read.parquet(f"{table}/tokens").join(keyed.select("cache_key").distinct(), "cache_key", "left_semi"), statuses


def write_csv(frames: list[DataFrame], path: str) -> None:
    """A CSV table whose header is the union of columns in order of first appearance; without frames, one without a line."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if not names:
        SparkSession.active().createDataFrame([], "value string").write.mode("overwrite").text(path)
        return
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    rows.select(*names).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, root: str, schema: str, name: str = "compression_compare.json") -> DataFrame:
    """Every result document under a root, with the run (its folder), one row per file."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    return rows.withColumn("run_dir", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only event log; blank lines and non-objects drop out, a malformed line ends the read with its file, its number and its text."""
    placed = lambda p: spark.read.text(p).withColumns({"file": F.col("_metadata.file_path"), "range": F.col("_metadata.file_block_start"), "id": F.monotonically_increasing_id()})
    lines = placed(path)
    valid = F.try_parse_json("value").isNotNull() | (F.trim("value") == "")
    bad = lines.filter(~valid).orderBy("file").select("file").first()
    if bad:
        # only now are lines counted, those of one file: ranges in order, and the lines within each
        one = placed(bad["file"])
        first = one.filter(~valid).orderBy("range", "id").first()
        before = one.filter((F.col("range") < first["range"]) | ((F.col("range") == first["range"]) & (F.col("id") < first["id"]))).count()
        raise ValueError(f"malformed line {before + 1} in {bad['file']}: {first['value'][:80]}")
    checked = lines.filter(F.trim("value") != "")
    return checked.filter(F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("e"), "file").select("e.*", "file")


def manifest_of(files: DataFrame, alphabet: str) -> DataFrame:
    return cache_status(files, files.limit(0).select("path", F.lit("").alias("identity")), alphabet).select("path", "identity")
