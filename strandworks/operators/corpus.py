"""Selecting, joining up, splitting and sampling sources (``species, source_name, sequence_key, seq``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.sequence import split_points

SPLITS = ("train", "val", "test")


def select_keys(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources of species that ``wanted`` (species, sequence_key) names only with those keys; other species whole."""
    listed = wanted.select(F.col("species").alias("w_species")).distinct()
    exact = wanted.select(F.col("species").alias("x_species"), F.trim("sequence_key").alias("x_key")).distinct()
    j = sources.join(listed, F.col("species") == F.col("w_species"), "left").join(exact, (F.col("species") == F.col("x_species")) & (F.col("sequence_key") == F.col("x_key")), "left")
    return j.filter(F.col("w_species").isNull() | F.col("x_key").isNotNull()).select(sources.columns)


def unmatched_keys(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested keys for which there is no source with a sequence."""
    return wanted.join(sources.filter(F.length("seq") > 0), ["species", "sequence_key"], "left_anti")


def require_keys(sources: DataFrame, wanted: DataFrame) -> None:
    lost = unmatched_keys(sources, wanted).limit(20).collect()
    if lost:
        raise ValueError(f"no sequence for {[(r.species, r.sequence_key) for r in lost]}")


def non_empty(sources: DataFrame) -> DataFrame:
    return sources.filter(F.length("seq") > 0)


def require_sources(sources: DataFrame) -> None:
    """An error that names species (20 at most) of which no source has a sequence."""
    lost = sources.groupBy("species").agg(F.max(F.length("seq")).alias("n")).filter("n is null or n = 0").limit(20).collect()
    if lost:
        raise ValueError(f"no sequence left for {sorted(r.species for r in lost)}")


def prefix_sample(sources: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` characters of each source; all of it for none or a limit below one."""
    return sources if not limit or limit <= 0 else sources.withColumn("seq", F.substring("seq", 1, limit))


def pick_sample(sources: DataFrame, n: int, order: str) -> DataFrame:
    """One sample: the first source of n characters or more, cut to n, else the longest, the first on ties."""
    row = F.struct("source_name", F.substring("seq", 1, n).alias("sample"))
    enough = F.length("seq") >= n
    best = sources.agg(F.min_by(row, F.when(enough, F.col(order))).alias("cut"), F.max_by(row, F.struct(F.length("seq"), -F.col(order))).alias("longest"))
    return best.select(F.coalesce("cut", "longest").alias("s")).select("s.*")


def slice_record(sources: DataFrame, start: int, max_bases: int) -> DataFrame:
    """From a 1-based start, so many bases (to the end for 0 or less)."""
    seq = F.substr("seq", F.lit(start), F.lit(max_bases)) if max_bases > 0 else F.substr("seq", F.lit(start))
    return sources.withColumn("seq", seq)


def separate(sources: DataFrame) -> DataFrame:
    return sources.withColumn("source_name", F.concat_ws(":", "species", "sequence_key"))


def boundary(alphabet: str, merge_size: int, seq_length: int) -> str:
    return "N" * (max(1, merge_size) * max(1, seq_length)) if "N" in alphabet else ""


def concat_offsets(lengths: DataFrame, gap: int, order: str, edges: int = 128) -> DataFrame:
    """Where each sequence of a species starts once they are joined with ``gap`` characters between: lengths only.

    Sums run within ranges of (species, order) and are lifted by the sums of the species' ranges before, so that no task holds a
    species. The ranges are cut at ``edges`` rows, those with the smallest hashes; which rows these are changes no result. Of equal
    places within a species any may come first. Nulls are a species of their own, and come first within one.
    """
    key = F.struct(F.col("species"), F.col(order))
    cuts = lengths.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(edges).agg(F.collect_list("k").alias("_edges"))
    ranged = lengths.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < key))).drop("_edges")  # one row of edges
    sums = ranged.groupBy("species", "_range").agg(F.sum(F.col("length") + gap).alias("m"))
    before = Window.partitionBy("species").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("species").alias("_species"), F.col("_range").alias("_before_range"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("species", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(base, F.col("species").eqNullSafe(F.col("_species")) & (F.col("_range") == F.col("_before_range")))
    start = F.col("_before") + F.coalesce(F.sum(F.col("length") + gap).over(own), F.lit(0))
    return out.withColumn("start", start.cast("long")).select(*lengths.columns, "start")


def observed_alphabet(sources: DataFrame, *keys: str, boundary: str = "") -> DataFrame:
    """Sorted distinct characters per key (or over all), with those of the boundary that sequences are joined with."""
    letters = sources.select(*keys, F.explode(F.array_distinct(F.split(F.concat("seq", F.lit(boundary)), ""))).alias("c")).filter("c <> ''").distinct()
    return letters.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("alphabet"), F.count("*").alias("alphabet_size"))


def split_table(sources: DataFrame, train: float = 0.6, val: float = 0.2, caps: dict[str, int | None] | None = None) -> DataFrame:
    """One row per source and split: start and size. A cap of none or zero caps nothing; starts don't move."""
    n = F.length("seq").cast("long")
    a, b = split_points(n, train, val)
    starts, ends = (F.lit(0).cast("long"), a, b), (a, b, n)
    rows = []
    for name, start, end in zip(SPLITS, starts, ends, strict=True):
        size = end - start
        cap = (caps or {}).get(name)
        rows.append(F.struct(F.lit(name).alias("split"), start.alias("start"), (F.least(size, F.lit(cap).cast("long")) if cap else size).alias("size")))
    return sources.withColumn("s", F.explode(F.array(*rows))).select("*", "s.*").drop("s")


def split_sequences(sources: DataFrame, **options) -> DataFrame:
    out = split_table(sources, **options)
    return out.withColumn("seq", F.substr("seq", (F.col("start") + 1).cast("int"), F.col("size").cast("int")))


def too_small(splits: DataFrame, least: int = 2) -> DataFrame:
    """Sources with fewer than two characters in some split."""
    return splits.groupBy("source_name").agg(F.min("size").alias("least")).filter(F.col("least") < least)


def require_splits(splits: DataFrame, least: int = 2) -> None:
    """An error that names sources (20 at most) of which a split is too small."""
    lost = too_small(splits, least).limit(20).collect()
    if lost:
        raise ValueError(f"fewer than {least} characters in a split of {sorted(r.source_name for r in lost)}")


#: What a summary row says about its source; columns that a table lacks are null.
SOURCE_FIELDS = {
    "source_mode": "string", "source_path": "string", "sequence_keys": "array<string>", "sequence_files": "array<string>", "clean_cache_status": "string", "clean_cache_path": "string",
}


def split_summary(splits: DataFrame) -> DataFrame:
    """One row per source: what it was made of, how long it is, start and size of each split, state of its clean table."""
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    have = [F.first(c).alias(c) if c in splits.columns else F.lit(None).cast(t).alias(c) for c, t in SOURCE_FIELDS.items()]
    out = splits.groupBy("species", "source_name").agg(*have, *(of(s, c) for s in SPLITS for c in ("start", "size")))
    total = F.col(f"{SPLITS[-1]}_start") + F.col(f"{SPLITS[-1]}_size")
    return out.withColumns({"selected_sequence_count": F.size(F.coalesce("sequence_keys", F.array().cast("array<string>"))).cast("long"), "total_size": total})


def dataset_totals(splits: DataFrame) -> DataFrame:
    """Species, bytes in all and by split, and how many letters the sequences use."""
    of = lambda s: F.sum(F.when(F.col("split") == s, F.col("size")).otherwise(0)).cast("long").alias(f"{s}_bytes")
    totals = splits.agg(F.countDistinct("species").alias("species_count"), F.sum("size").cast("long").alias("total_bytes"), *map(of, SPLITS))
    letters = splits.select(F.explode(F.array_distinct(F.split("seq", ""))).alias("c")).filter("c <> ''").agg(F.countDistinct("c").alias("alphabet_size"))
    return totals.join(F.broadcast(letters))  # one row each


def window_starts_available(sources: DataFrame, seq_length: int, keep_short: bool) -> DataFrame:
    """How many places a random window may start at; short sources drop out, or count once for k-mers."""
    n = F.length("seq") - seq_length + 1
    out = sources.withColumn("available", (F.greatest(n, F.lit(1)) if keep_short else n).cast("long"))
    return out if keep_short else out.filter("available > 0")


def sampling_weights(available: DataFrame, strategy: str) -> DataFrame:
    a = F.col("available").cast("double")
    weight = {"proportional": a, "uniform": F.lit(1.0), "sqrt": F.sqrt(a)}[strategy]
    return available.withColumn("weight", weight)


def drawn(seed: int, tag: str, index: Column | str) -> Column:
    """52 bits of a counter-based generator: the head of the MD5 digest of ``seed:tag:index``, which SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(index).cast("string") if isinstance(index, str) else index.cast("string"))), 1, 13), 16, 10).cast("long")


def sample_windows(weighted: DataFrame, samples: int, seed: int, order: str) -> DataFrame:
    """``sample_index, source_name, start``: one weighted draw per index, the same for the same seed.

    Cumulative weights are prefix sums within hashed buckets of sources, lifted by the sums of the buckets
    before; draws are ``drawn`` of (seed, index), and meet their source in a range join on the scaled cumulative
    weight, dealt to cells so that it is an equi-join. There are as many cells as draws, so that few sources and few draws
    meet in one, however many there are of both. Weights are kept while they are summed up and met: what they are made of is read once.
    """
    cells = 1 << max(12, min(30, samples.bit_length()))
    weighted = weighted.select(*dict.fromkeys((order, "source_name", "available", "weight"))).persist()
    bucket = F.substring(F.md5(F.col(order).cast("string")), 1, 2)
    own = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = weighted.withColumn("bucket", bucket)
    sums = b.groupBy("bucket").agg(F.sum("weight").alias("w"))  # one row per bucket, so windows over all of them are small
    before = F.coalesce(F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    base = sums.select("bucket", before.alias("before"), F.sum("w").over(Window.partitionBy()).alias("total"))
    c = b.join(F.broadcast(base), "bucket").withColumn("upto", F.col("before") + F.sum("weight").over(own))
    c = c.withColumns({"hi": F.col("upto") / F.col("total"), "lo": (F.col("upto") - F.col("weight")) / F.col("total")})
    c = c.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * cells))))
    unit = lambda tag: drawn(seed, tag, "id") / F.lit(float(1 << 52))
    draws = weighted.sparkSession.range(samples).withColumns({"u": unit("source"), "v": unit("start")}).withColumn("cell", F.floor(F.col("u") * cells))
    hit = draws.join(c, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.select(F.col("id").alias("sample_index"), "source_name", F.floor(F.col("v") * F.col("available")).cast("long").alias("start"))


def shuffled_split(chunks: DataFrame, seed: int, ratio: float, key: str, bits: int = 12) -> DataFrame:
    """Chunks in seeded order (``rank``); the last ``int(n * ratio)`` are validation (train keeps one at least).

    The order is that of a hash; its top bits part it into 2**bits ranges of about equal size, which are ranked each by itself and lifted
    by the counts of the ranges before.
    """
    ranged = chunks.withColumn("_h", drawn(seed, "order", key)).withColumn("_range", F.shiftright("_h", 52 - bits))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_range", before.alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    val = F.least(F.floor(F.col("n") * ratio), F.col("n") - 1)
    out = ranged.join(F.broadcast(base), "_range").withColumn("rank", rank)
    return out.withColumn("split", F.when(F.col("rank") >= F.col("n") - val, "val").otherwise("train")).select(*chunks.columns, "rank", "split")


def samples_per_pass(train_sizes: DataFrame, seq_length: int) -> DataFrame:
    """Windows of one pass over each species' train split, and their total."""
    per = train_sizes.groupBy("species").agg(F.sum("size").alias("size")).withColumn("n", F.ceil(F.col("size") / seq_length))
    return per.rollup("species").agg(F.sum("size").cast("long").alias("train_bytes"), F.sum("n").cast("long").alias("samples")).withColumn("species", F.coalesce("species", F.lit("TOTAL")))


def intersect_ranges(blocks: DataFrame, ranges: DataFrame, block: int) -> DataFrame:
    """Which part of which block feeds which range: ranges are dealt to the blocks that they touch, so it is an equi-join."""
    dealt = ranges.filter("size > 0").withColumn("block_id", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    j = blocks.join(dealt.withColumnRenamed("start", "r_start"), ["source_name", "block_id"])
    lo, hi = F.greatest("start", "r_start"), F.least(F.col("start") + F.length("seq"), F.col("r_start") + F.col("size"))
    return j.filter(hi > lo).select("source_name", "split", "block_id", (lo - F.col("r_start")).cast("long").alias("start"), F.substr("seq", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("seq"))


def cache_rank(status: Column) -> Column:
    """The status of joined sources: rebuilt before created before disabled before hit."""
    order = ["hit", "disabled", "created", "rebuilt"]
    return F.element_at(F.array(*map(F.lit, order)), F.max(F.array_position(F.array(*map(F.lit, order)), status)).cast("int"))
