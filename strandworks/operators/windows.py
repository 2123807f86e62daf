"""Tokens and windows over base position (``source_name, tokens ARRAY<..>``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions.config import IGNORED_LABEL, max_target_tokens


def _range(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def append_eos(tokens: Column, eos: int) -> Column:
    return F.concat(tokens, F.array(F.lit(eos).cast("long")))


#: Pieces of a vocabulary at most: 6**9 are 10 million.
VOCABULARY = 1 << 24


def dictionary_tokens(rows: DataFrame, vocabulary: DataFrame, k: int, unk: int, drop_tail: bool = False, seq: str = "seq") -> DataFrame:
    """``source_name, token_ids, base_lengths, tail_sequence, total_bases``: pieces of k looked up in (piece, id).

    The vocabulary, whose size is checked, goes to the tasks; pieces are looked up where they are, so nothing is shuffled.
    """
    entries = vocabulary.select("piece", "id").limit(VOCABULARY + 1).toPandas()
    if len(entries) > VOCABULARY:
        raise ValueError(f"a vocabulary has at most {VOCABULARY} pieces")
    known, ids = pa.array(entries["piece"], pa.string()), np.append(entries["id"].to_numpy(np.int64), unk)

    @F.arrow_udf("array<long>")
    def look_up(pieces: pa.Array) -> pa.Array:
        at = pc.index_in(pieces.flatten(), value_set=known).fill_null(len(known)).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).fill_null(0).to_numpy())]), pa.int32()), pa.array(ids[at]))

    s = F.upper(F.regexp_replace(seq, "^\\s+|\\s+$", ""))
    pieces = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))
    cut_off = (F.length(s) % k != 0) & F.lit(drop_tail)
    cut = F.when(cut_off, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)
    base = rows.select("source_name", s.alias("s"), cut.alias("pieces"), F.when(cut_off, F.element_at(pieces, -1)).otherwise("").alias("tail_sequence"))
    lengths = F.transform("pieces", lambda x: F.length(x).cast("long"))
    return base.select("source_name", look_up("pieces").alias("token_ids"), lengths.alias("base_lengths"), "tail_sequence", F.length("s").cast("long").alias("total_bases"))


def prefix_ids(species: Column, prefixes: dict[str, str], vocabulary: DataFrame) -> Column:
    """The ids of the species' prefix: none or one. A prefix token that the vocabulary lacks is an error, before any job runs."""
    tokens = {k: v if v.startswith("<") and v.endswith(">") else f"<{v}>" for k, v in ((k, (v or "").strip()) for k, v in prefixes.items()) if v}
    known = {r.piece: r.id for r in vocabulary.filter(F.col("piece").isin([*tokens.values(), ""])).select("piece", "id").collect()}
    lost = sorted({v for v in tokens.values() if v not in known})
    if lost:
        raise ValueError(f"the vocabulary has no {', '.join(lost)}")
    none = F.array().cast("array<long>")
    if not tokens:
        return none
    table = F.create_map(*[F.lit(x) for k, v in tokens.items() for x in (k, known[v])])
    got = F.try_element_at(table, species)
    return F.when(got.isNull(), none).otherwise(F.array(got.cast("long")))


def prefix_token(species: Column, prefixes: dict[str, str]) -> Column:
    """The species' prefix token in angle brackets, or none."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    name = F.nullif(F.trim(F.try_element_at(table, species)), F.lit(""))
    return F.when(name.rlike("^<.*>$"), name).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def tumbling(rows: DataFrame, length: int, pad: int, prefix: int = 0) -> DataFrame:
    """Windows of ``length`` tokens (less the prefix), the last filled up with pads; empty sources give none."""
    room = max_target_tokens(length, prefix)
    n = F.size("tokens")
    w = rows.withColumn("window_id", F.explode(_range(F.ceil(n / room))))
    part = F.slice("tokens", F.col("window_id") * room + 1, room)
    return w.select(*[c for c in rows.columns if c != "tokens"], F.col("window_id").cast("long"), F.concat(part, F.array_repeat(F.lit(pad).cast("long"), room - F.size(part))).alias("input_ids"), F.size(part).cast("long").alias("valid"))


def targets(rows: DataFrame, length: int, prefix: int) -> DataFrame:
    """Unpadded windows of the tokens that fit beside a prefix."""
    room = max_target_tokens(length, prefix)
    w = rows.withColumn("window_id", F.explode(_range(F.ceil(F.size("tokens") / room))))
    return w.withColumn("target", F.slice("tokens", F.col("window_id") * room + 1, room)).withColumn("window_id", F.col("window_id").cast("long"))


def decoder_window(target: Column, prefix: list[int], length: int, pad: int) -> tuple[Column, Column]:
    """(input ids, labels): inputs are shifted right by one pad, prefix and filling carry no label."""
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    fill = F.lit(length - len(prefix)) - F.size(target)
    whole = F.concat(longs(prefix), target)
    inputs = F.slice(F.concat(longs([pad]), whole, F.array_repeat(F.lit(pad).cast("long"), fill)), 1, length)
    shifted = F.when(fill > 0, F.concat(longs([pad]), F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), F.array_repeat(F.lit(pad).cast("long"), fill))).otherwise(inputs)
    labels = F.concat(longs([IGNORED_LABEL] * len(prefix)), target, F.array_repeat(F.lit(IGNORED_LABEL).cast("long"), fill))
    return shifted, labels


def label_lengths(base_lengths: Column, prefix: list[int], length: int) -> Column:
    """How many bases each label of a window stands for; 0 at the prefix and where it is filled up."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    return F.concat(zeros(F.lit(len(prefix))), base_lengths, zeros(F.lit(length - len(prefix)) - F.size(base_lengths)))


def encoder_window(target: Column, prefix: list[int], length: int, pad: int) -> tuple[Column, Column, Column]:
    """(input ids, attention mask, labels): inputs are not shifted."""
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    used = F.size(target) + len(prefix)
    fill = F.lit(length) - used
    inputs = F.concat(longs(prefix), target, F.array_repeat(F.lit(pad).cast("long"), fill))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), fill))
    labels = F.concat(longs([IGNORED_LABEL] * len(prefix)), target, F.array_repeat(F.lit(IGNORED_LABEL).cast("long"), fill))
    return inputs, mask, labels


def sliding(rows: DataFrame, length: int, pad: int, block: int = 4096) -> DataFrame:
    """One window per token that ends at it, filled up on the left: ``pos, input_ids``.

    Tokens go out in blocks with a halo of ``length - 1`` before them, so no row grows with the source.
    """
    n = F.size("tokens")
    b = rows.withColumn("b", F.explode(_range(F.ceil(n / block))))
    lo = F.col("b") * block
    halo = F.concat(
        F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(length - 1) - lo, F.lit(0)).cast("int")),
        F.slice("tokens", F.greatest(lo - (length - 1), F.lit(0)) + 1, (block + F.least(lo, F.lit(length - 1))).cast("int")),
    )
    out = b.select(*[c for c in rows.columns if c != "tokens"], lo.alias("lo"), halo.alias("h"), F.least(F.lit(block), n - lo).alias("m"))
    out = out.withColumn("i", F.explode(_range(F.col("m"))))
    return out.select(*[c for c in rows.columns if c != "tokens"], (F.col("lo") + F.col("i")).cast("long").alias("pos"), F.slice("h", F.col("i") + 1, length).alias("input_ids"))


def left_contexts(rows: DataFrame, length: int, pad: int, prefix: list[int], block: int = 4096) -> DataFrame:
    """For each token the last ``length`` of pad, prefix and the tokens before it (nothing is filled up)."""
    lead = F.array(*[F.lit(x).cast("long") for x in [pad, *prefix]])
    n = F.size("tokens")
    shifted = rows.withColumn("tokens", F.when(n > 0, F.concat(lead, F.slice("tokens", 1, F.greatest(n - 1, F.lit(0))))).otherwise(F.array().cast("array<long>")))
    filled = sliding(shifted, length, -1, block).filter(F.col("pos") >= len(prefix))
    context = F.slice("input_ids", F.greatest(F.lit(length) - F.col("pos"), F.lit(1)).cast("int"), length)
    return filled.select(*[c for c in rows.columns if c != "tokens"], (F.col("pos") - len(prefix)).alias("pos"), context.alias("context"))


def overlap_ranges(lengths: DataFrame, length: int, stride: int) -> DataFrame:
    """``window_id, start, scored_from, scored_to`` over n tokens: each token is scored once.

    The first window scores all its tokens, each later one its last ``stride``.
    """
    more = F.greatest(F.ceil((F.col("n") - length) / stride), F.lit(0)).cast("int")
    w = lengths.filter("n > 0").withColumn("window_id", F.explode(F.sequence(F.lit(0), more)))
    first = F.col("window_id") == 0
    start = F.col("window_id") * stride
    return w.select(
        *[c for c in lengths.columns if c != "n"], F.col("window_id").cast("long"), start.cast("long").alias("start"),
        F.when(first, F.lit(0)).otherwise(length + (F.col("window_id") - 1) * stride).cast("long").alias("scored_from"),
        F.least(F.col("n"), F.when(first, F.lit(length)).otherwise(length + F.col("window_id") * stride)).cast("long").alias("scored_to"),
    )


def chunks(rows: DataFrame, length: int, pad: int = 1) -> DataFrame:
    """Base codes in chunks of fixed length, filled up with ``pad``; ``padding`` of the last one."""
    return tumbling(rows, length, pad).select(*[c for c in rows.columns if c != "tokens"], F.col("window_id").alias("chunk_id"), F.col("input_ids").alias("codes"), (F.lit(length) - F.col("valid")).cast("long").alias("padding"))
