"""Metrics per source, summaries over sources, position profiles and sequence profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions import sequence as S

TINY = 1e-12


def per(a: str, b: str, least: float = 1) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(least))


def source_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and rates per source from ``bases, bits, coded_bytes, seconds`` rows."""
    s = parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("bases", "bits", "coded_bytes", "seconds")))
    return s.withColumns({
        "theoretical_bits_per_base": per("bits", "bases"),
        "arithmetic_bits_per_base": per("coded_bytes", "bases") * 8,
        "bases_per_second": per("bases", "seconds", TINY),
    })


def summary(per_source: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Ratios of sums over sources; columns that a family lacks count as zero."""
    have = set(per_source.columns)
    s = per_source.groupBy(*keys).agg(F.count("*").alias("sources"), *((F.sum(F.coalesce(c, F.lit(0))) if c in have else F.lit(0)).alias(c) for c in sums))
    return s.withColumns({"bits_per_base": per("bits", "bases"), "coded_bits_per_base": per("coded_bytes", "bases") * 8})


def constant_or_absent(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A value that all rows of a group share, nulls included; null otherwise."""
    n = F.count("*")
    same = (F.countDistinct(column) == 1) & (F.count(column) == n)
    return rows.groupBy(*keys).agg(F.when(same, F.min(column)).alias(column))


def latent_summary(per_source: DataFrame, keys: list[str]) -> DataFrame:
    """Decoder stream and latent side information, apart and together."""
    s = per_source.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("bases", "coded_bytes", "side_bits")))
    total = F.col("coded_bytes") * 8 + F.col("side_bits")
    return s.withColumns({"side_bytes": F.ceil(F.col("side_bits") / 8), "decoder_bits_per_base": per("coded_bytes", "bases") * 8, "total_bits_per_base": total / F.greatest("bases", F.lit(1))})


def chunk_summary(per_source: DataFrame, model_bytes: int) -> DataFrame:
    s = per_source.agg(F.sum("bases").alias("bases"), F.sum("coded_bytes").alias("coded_bytes"), F.bool_and("exact").alias("all_exact"))
    return s.withColumns({"ratio": F.col("bases") / F.greatest("coded_bytes", F.lit(1)), "bits_per_base": per("coded_bytes", "bases") * 8, "bytes_with_model": F.col("coded_bytes") + model_bytes})


def loss_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Token-weighted loss from ``nats, label, bases``; labels below zero are left out."""
    m = F.col("label") >= 0
    s = rows.groupBy(*keys).agg(F.sum(F.when(m, F.col("nats"))).alias("nats"), F.count(F.when(m, 1)).alias("tokens"), F.sum(F.when(m, F.col("bases"))).alias("bases"))
    bits = F.col("nats") / F.log(F.lit(2.0))
    return s.withColumns({"bits_per_token": bits / F.greatest("tokens", F.lit(1)), "bits_per_base": bits / F.greatest("bases", F.lit(1))})


def position_profile(windows: DataFrame, k: int, eos: int) -> DataFrame:
    """``base, position, count, bits`` from rows (position of the token in its window, token, piece, bits).

    Tokens are summed up by place and piece first; only these sums are taken apart into bases.
    """
    sums = windows.filter(F.col("token") != eos).groupBy("position", "piece").agg(F.count("*").alias("n"), F.sum("bits").alias("b"))
    each = sums.select("position", "n", "b", F.posexplode(F.filter(F.split("piece", ""), lambda c: c != "")).alias("j", "base"))
    return each.groupBy("base", (F.col("position") * k + F.col("j")).alias("position")).agg(F.sum("n").alias("count"), F.sum(F.col("b") / k).alias("bits"))


def profile_rows(profile: DataFrame, length: int) -> DataFrame:
    """One row per position, empty ones too: both indexes, count, bits, and their mean (null if empty)."""
    s = profile.groupBy("position").agg(F.sum("count").alias("count"), F.sum("bits").alias("bits"))
    dense = profile.sparkSession.range(length).select(F.col("id").alias("position"))
    j = dense.join(s, "position", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "bits": F.coalesce("bits", F.lit(0.0))})
    return j.select("position", (F.col("position") + 1).alias("position_one_based"), "count", "bits", F.when(F.col("count") > 0, F.col("bits") / F.col("count")).alias("mean_bits"))


def manifest_check(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Actual files and bytes of each expected species (0 if absent) and in total."""
    found = files.groupBy("species").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    j = expected.join(found, "species", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "bytes")})
    sums = [F.sum(c).cast("long").alias(c) for c in ("expected_files", "expected_bytes", "files", "bytes")]
    out = j.rollup("species").agg(*sums).withColumn("species", F.coalesce("species", F.lit("TOTAL")))
    return out.withColumn("ok", (F.col("files") == F.col("expected_files")) & (F.col("bytes") == F.col("expected_bytes")))


# --- profiles of sequences -----------------------------------------------------------------------


def kmer_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key, kmer, count`` of the overlapping k-mers of A, C, G, T and U: counted within each row first."""
    each = rows.select(key, F.explode(S.kmer_tally(F.col("seq"), k)).alias("t"))
    return each.groupBy(key, "t.kmer").agg(F.sum("t.count").alias("count"))


def top_kmers(counts: DataFrame, key: str, least: int, limit: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("count"), "kmer")
    return counts.filter(F.col("count") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def repeat_mask(rows: DataFrame, top: DataFrame, key: str, k: int, strong: int = 8) -> DataFrame:
    """``key, pos, level`` of the bases that a top k-mer covers: 2 if it is frequent, else 1.

    The few top k-mers of a sequence meet it in a join; its places are looked through once, and only covered ones become rows.
    """
    found = rows.join(kmer_sets(top, key, strong), key).select(key, F.explode(covered(F.col("seq"), F.col("weak"), F.col("strong"), k)).alias("c"))
    return found.select(key, "c.pos", F.col("c.level").cast("int").alias("level"))


def kmer_sets(top: DataFrame, key: str, strong: int = 8) -> DataFrame:
    """``key, weak, strong``: the top k-mers of each sequence, the frequent ones apart."""
    kmers = lambda c: F.collect_list(F.when(c, F.col("kmer")))
    return top.groupBy(key).agg(kmers(F.col("count") < strong).alias("weak"), kmers(F.col("count") >= strong).alias("strong"))


def covered(seq: Column, weak: Column, strong: Column, k: int) -> Column:
    """``array<struct<pos, level>>``: the places that a k-mer of ``weak`` (1) or ``strong`` (2) covers, others left out; looked up in Arrow batches."""
    codes, places = S.letter_codes("ACGTU").astype(np.int64), S.kmer_places(k, "ACGTU")

    def wanted(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row's k-mers, and the offsets of rows."""
        off = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, cut = S.letters_of(sets.flatten())
        if (np.diff(cut) != k).any():
            raise ValueError(f"the k-mers of a mask have {k} letters")
        return codes[data].reshape(-1, k) @ (5 ** np.arange(k - 1, -1, -1, dtype=np.int64)), off

    @F.arrow_udf("array<struct<pos:int,level:byte>>")
    def of(seqs: pa.Array, weak: pa.Array, strong: pa.Array) -> pa.Array:
        data, off = S.letters_of(seqs)
        sets, found, levels, sizes = (wanted(weak), wanted(strong)), [], [], np.zeros(len(seqs), np.int64)
        for first, here, row, at, ids in places(data, off):
            level, n = np.zeros(here[-1], np.int8), len(here) - 1
            for i, (kmers, cut) in enumerate(sets, 1):
                own = np.repeat(np.arange(n), np.diff(cut[first : first + n + 1]))
                hit = at[np.isin(row * 5**k + ids, own * 5**k + kmers[cut[first] : cut[first + n]])]
                for j in range(k):
                    level[hit + j] = i
            place = np.flatnonzero(level)
            lies = np.searchsorted(here, place, "right") - 1
            found.append(place - here[lies])
            levels.append(level[place])
            sizes[first : first + n] = np.bincount(lies, minlength=n)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int8), *levels]))], ["pos", "level"])
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)

    return of(seq, weak, strong)


def repeat_lines(rows: DataFrame, mask: DataFrame, key: str, width: int) -> DataFrame:
    """Share of covered bases in each display line, and the width of its meter."""
    n = F.ceil(F.length("seq") / width)
    lines = rows.select(key, F.length("seq").alias("n"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("line"))
    covered = mask.groupBy(key, F.floor(F.col("pos") / width).cast("int").alias("line")).agg(F.count("*").alias("covered"))
    share = F.coalesce("covered", F.lit(0)) / F.least(F.lit(width), F.col("n") - F.col("line") * width)
    return lines.join(covered, [key, "line"], "left").select(key, "line", share.alias("repeat_fraction"), F.greatest(F.lit(4), F.floor(share * 100)).cast("long").alias("meter"))


def sequence_profile(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.length("seq").cast("long").alias("bases"), S.gc_fraction(F.col("seq")).alias("gc_fraction"), S.non_acgt_fraction(F.col("seq")).alias("non_acgt_fraction"))
