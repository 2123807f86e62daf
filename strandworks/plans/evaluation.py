"""Queries: the compression evaluation from documents to sums, with a stand-in scorer of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions.config import frequency_total
from strandworks.operators import corpus as C
from strandworks.operators import evaluation as E
from strandworks.operators import metrics as M
from strandworks.operators.coding import streamed_sizes
from strandworks.plans.base import SPLIT, SRC, sources, with_
from strandworks.sources.fasta import blocks_of

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


K, VOCAB, PAD, EOS, LENGTH, STRIDE = 3, 127, 125, 126, 64, 16
TOTAL = frequency_total(VOCAB)
MODES = [E.Mode("non_overlap", LENGTH), E.Mode("overlap", LENGTH, STRIDE), E.Mode("sliding", LENGTH)]
CODINGS = {"whole": None, "steps": E.Steps(K, 2, 5)}
KEYS = ["species", "source_name", "split"]


def _sequences(spark, sf):
    return C.split_sequences(sources(spark, sf))


def _evaluated(spark, sf):
    blocks = E.symbol_blocks(_sequences(spark, sf), KEYS, K, "ACGTN", EOS)
    results = E.evaluate(blocks, KEYS, MODES, E.repeat_scorer(VOCAB), VOCAB, PAD, TOTAL, CODINGS)
    return E.per_source(results, KEYS, K, True)


#: Symbols with the one before each in its window, and the stand-in's probabilities and quantised intervals behind each symbol.
_SCORED = (
    f"tk AS (SELECT species, source_name, split, list_append(list_transform(regexp_extract_all(seq, '.{{3}}'), lambda m: (strpos('ACGTN', m[1]) - 1) * 25 + (strpos('ACGTN', m[2]) - 1) * 5 + strpos('ACGTN', m[3]) - 1), {EOS}) AS t FROM spl)",
    "sy AS (SELECT species, source_name, split, i, t[i] AS t, t[i - 1] AS b FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk))",
    f"md AS (SELECT species, source_name, split, mode, t, CASE WHEN i = 1 OR (mode = 'non_overlap' AND (i - 1) % {LENGTH} = 0) THEN {PAD} ELSE b END AS b FROM sy, (VALUES ('non_overlap'), ('overlap'), ('sliding')) m(mode))",
    f"z AS (SELECT i, exp(2 - 4 * i / {VOCAB - 1}.0) AS w FROM range(0, {VOCAB}) r(i))",
    f"pr AS (SELECT b.i AS b, t.i AS t, t.w * CASE WHEN t.i = b.i THEN exp(1.5) ELSE 1.0 END / ((SELECT sum(w) FROM z) + b.w * (exp(1.5) - 1)) AS p FROM z b, z t)",
    f"fl AS (SELECT *, floor(p * ({TOTAL} - {VOCAB})) AS f, {TOTAL} - {VOCAB} - sum(floor(p * ({TOTAL} - {VOCAB}))) OVER (PARTITION BY b) AS lft, row_number() OVER (PARTITION BY b ORDER BY floor(p * ({TOTAL} - {VOCAB})) - p * ({TOTAL} - {VOCAB}), t) AS k FROM pr)",
    "iv AS (SELECT b, t, p, CAST(coalesce(sum(f + 1 + CASE WHEN k <= lft THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM fl)",
    "ev AS (SELECT species, source_name, split, mode, count(*) AS symbols, sum(-log2(p)) AS bits, CAST(sum(lo) AS BIGINT) AS cum_low FROM md JOIN iv USING (b, t) GROUP BY species, source_name, split, mode)",
)


@query(
    "w2_evaluation",
    with_(SRC, SPLIT, *_SCORED)
    + f"""SELECT split, mode, coding, count(*) AS sources, CAST(sum(symbols - 1) * {K} AS BIGINT) AS bases, CAST(sum(symbols) AS BIGINT) AS symbols, CAST(sum(symbols) * CASE coding WHEN 'whole' THEN 1 ELSE 2 END AS BIGINT) AS emitted, round(sum(bits), 3) AS bits,
round(sum(bits) / greatest(sum(symbols - 1) * {K}, 1), 6) AS theoretical_bits_per_base, CASE coding WHEN 'whole' THEN CAST(sum(cum_low) AS BIGINT) END AS cum_low, true AS coded_within
FROM ev, (VALUES ('whole'), ('steps')) c(coding) GROUP BY split, mode, coding""",
)
def w2(spark, sf):
    """Documents to bits and coded bytes of each (split, mode, coding). ``coded_within``: every source's bytes are within 1 % and 16 bytes a block of its bits."""
    s = _evaluated(spark, sf)
    within = F.abs(8 * F.col("coded_bytes") - F.col("bits")) <= F.col("bits") / 100 + 128 * F.col("blocks")
    out = s.groupBy("split", "mode", "coding").agg(
        F.count("*").alias("sources"), *(F.sum(c).alias(c) for c in ("bases", "symbols", "emitted", "bits", "cum_low")), F.bool_and(within).alias("coded_within")
    )
    per_base = F.round(M.per("bits", "bases"), 6)
    return out.withColumns({"theoretical_bits_per_base": per_base, "cum_low": F.when(F.col("coding") == "whole", F.col("cum_low"))}).withColumn("bits", F.round("bits", 3))


@query("w2_coded_bytes")
def w2_coded(spark, sf):
    """The coded bytes of each (split, mode, coding) beside the codecs' sizes of the same samples, summed over sources; tests decode the bytes."""
    s = M.summary(_evaluated(spark, sf), ["split", "mode", "coding"], ["bases", "bits", "coded_bytes"])
    plain = streamed_sizes(blocks_of(_sequences(spark, sf).select(*KEYS, "seq"), 1 << 16), KEYS)
    sizes = plain.groupBy("split").agg(*(F.sum(c).alias(f"{c}_bytes") for c in ("ascii", "two_bit", "gzip", "bz2", "lzma")))
    return s.join(sizes, "split")


@query(
    "w2_source_metrics",
    with_(SRC, SPLIT, *_SCORED)
    + f"SELECT species, split, mode, CAST(sum(symbols - 1) * {K} AS BIGINT) AS bases, round(sum(bits), 3) AS bits, round(sum(bits) / greatest(sum(symbols - 1) * {K}, 1), 6) AS theoretical_bits_per_base, true AS coded_at_all FROM ev GROUP BY species, split, mode",
)
def w2_sources(spark, sf):
    """Metrics of each (species, split, mode) from the evaluation itself."""
    m = M.source_metrics(_evaluated(spark, sf).filter("coding = 'whole'"), ["species", "split", "mode"])
    return m.select("species", "split", "mode", "bases", F.round("bits", 3).alias("bits"), F.round("theoretical_bits_per_base", 6).alias("theoretical_bits_per_base"), (F.col("coded_bytes") > 0).alias("coded_at_all"))
