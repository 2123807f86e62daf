"""Queries: tokens and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.functions.config import overlap_stride
from strandworks.operators import blocks as B
from strandworks.operators import corpus as C
from strandworks.operators import windows as W
from strandworks.plans.base import ACGT, SPLIT, SRC, acgt, documents, sources, table, with_
from strandworks.sources.fasta import blocks_of

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_IDS = "list_transform(regexp_extract_all(seq, '.{3}'), lambda m: CAST((strpos('ACGTN', m[1]) - 1) * 25 + (strpos('ACGTN', m[2]) - 1) * 5 + strpos('ACGTN', m[3]) - 1 AS BIGINT))"
TOK = f"tok AS (SELECT species, source_name, doc_id, seq, {_IDS} AS tokens FROM src)"


def tokens(spark, sf, k=3):
    return sources(spark, sf).withColumn("tokens", S.kmer_ids(F.col("seq"), k))


def _ids(col):
    return F.sha2(F.array_join(col, ","), 256)


@query(
    "w1_prepare",
    with_(SRC, SPLIT) + """SELECT species, split, count(*) AS n_sources, CAST(sum(size) AS BIGINT) AS bases, CAST(sum(size // 3) AS BIGINT) AS n_tokens, CAST(sum(ceil((size // 3) / 128.0)) AS BIGINT) AS n_windows,
CAST(sum(length(seq) - length(translate(seq, 'GC', ''))) AS BIGINT) AS gc_bases, CAST(sum((2 * size + 7) // 8) AS BIGINT) AS two_bit_bytes FROM spl GROUP BY species, split""",
)
def w1(spark, sf):
    """The flagship slice: clean, split, tokenise, count windows and size up each (species, split)."""
    rows = C.split_sequences(sources(spark, sf)).withColumn("n", F.size(S.kmer_ids(F.col("seq"), 3)))
    return rows.groupBy("species", "split").agg(
        F.count("*").alias("n_sources"), F.sum("size").cast("long").alias("bases"), F.sum("n").cast("long").alias("n_tokens"), F.sum(F.ceil(F.col("n") / 128)).cast("long").alias("n_windows"),
        F.sum(S.count_of(F.col("seq"), "GC")).cast("long").alias("gc_bases"), F.sum(S.two_bit_bytes(F.col("size"))).cast("long").alias("two_bit_bytes"),
    )


@query("d1_byte_tokens", with_(SRC) + "SELECT doc_id, CAST(length(seq) AS BIGINT) AS n_tokens, sha256(array_to_string(list_transform(list_filter(string_split(seq, ''), lambda c: c <> ''), lambda c: ascii(c)), ',')) AS ids_sha256 FROM src")
def d1(spark, sf):
    t = sources(spark, sf).withColumn("t", S.byte_tokens(F.col("seq")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), _ids("t").alias("ids_sha256"))


@query("d2_tokens", with_(SRC, TOK) + "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, sha256(array_to_string(tokens, ',')) AS ids_sha256 FROM tok")
def d2(spark, sf):
    return tokens(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _ids("tokens").alias("ids_sha256"))


@query("d4_fixed_kmer_tail", with_(SRC) + "SELECT doc_id, CAST(length(seq) // 3 AS BIGINT) AS n_tokens, seq[length(seq) - length(seq) % 3 + 1 :] AS tail_sequence, CAST(length(seq) AS BIGINT) AS total_bases FROM src")
def d4(spark, sf):
    return tokens(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), S.tail(F.col("seq"), 3).alias("tail_sequence"), F.length("seq").cast("long").alias("total_bases"))


def vocabulary(spark, k=3, letters="NAGCT"):
    """Every piece of 1 to k letters; ids by (length, letter order). Ours: the published order is not known."""
    pieces = spark.range(1).select(F.lit("").alias("piece"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("id"))
    out, last, offset = None, pieces, 0
    table_ = spark.createDataFrame([(c, i) for i, c in enumerate(letters)], "letter string, rank int")
    for n in range(1, k + 1):
        last = last.join(F.broadcast(table_)).select(F.concat("piece", "letter").alias("piece"), F.lit(n).alias("n"), (F.col("id") * len(letters) + F.col("rank")).alias("id"))
        level = last.select("piece", (F.col("id") + offset).alias("id"))
        out = level if out is None else out.union(level)
        offset += len(letters) ** n
    return out


_PIECE_ID = "CASE length(p) WHEN 3 THEN 30 + (strpos('NAGCT', p[1]) - 1) * 25 + (strpos('NAGCT', p[2]) - 1) * 5 + strpos('NAGCT', p[3]) - 1 WHEN 2 THEN 5 + (strpos('NAGCT', p[1]) - 1) * 5 + strpos('NAGCT', p[2]) - 1 ELSE strpos('NAGCT', p) - 1 END"


@query("d5_dictionary_tokens", with_(SRC) + f"SELECT source_name, CAST(length(seq) // 3 AS BIGINT) AS n_tokens, sha256(array_to_string(list_transform(regexp_extract_all(seq, '.{{3}}'), lambda p: {_PIECE_ID}), ',')) AS ids_sha256, seq[length(seq) - length(seq) % 3 + 1 :] AS tail_sequence, CAST(length(seq) AS BIGINT) AS total_bases FROM src")
def d5(spark, sf):
    t = W.dictionary_tokens(sources(spark, sf), vocabulary(spark), 3, -1, drop_tail=True)
    return t.select("source_name", F.size("token_ids").cast("long").alias("n_tokens"), _ids("token_ids").alias("ids_sha256"), "tail_sequence", "total_bases")


@query("d6_prefix_token", "SELECT doc_id, CASE source WHEN 'src1' THEN '<HUMAN>' WHEN 'src2' THEN '<R>' END AS prefix FROM documents")
def d6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.prefix_token(F.col("source"), {"src1": "HUMAN", "src2": "<R>", "src3": " "}).alias("prefix"))


@query("d7_token_totals", with_(SRC) + "SELECT coalesce(species, 'TOTAL') AS species, CAST(sum(length(seq) // 3) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS prefixes, CAST(sum(length(seq)) AS BIGINT) AS bases FROM src GROUP BY ROLLUP (species)")
def d7(spark, sf):
    t = tokens(spark, sf).groupBy("species").agg(F.sum(F.size("tokens")).alias("t"), F.count("*").alias("p"), F.sum(F.length("seq")).alias("b"))
    return t.rollup("species").agg(F.sum("t").cast("long").alias("tokens"), F.sum("p").cast("long").alias("prefixes"), F.sum("b").cast("long").alias("bases")).withColumn("species", F.coalesce("species", F.lit("TOTAL")))


@query("d8_eos", with_(SRC, TOK) + "SELECT doc_id, sha256(array_to_string(list_append(tokens, CAST(126 AS BIGINT)), ',')) AS ids_sha256 FROM tok")
def d8(spark, sf):
    return tokens(spark, sf).select("doc_id", _ids(W.append_eos(F.col("tokens"), 126)).alias("ids_sha256"))


@query("d9_base_codes", with_(ACGT) + "SELECT doc_id, translate(seq, 'ACGT', '1234') AS codes, seq AS decoded FROM acgt")
def d9(spark, sf):
    c = acgt(spark, sf).withColumn("c", S.base_codes(F.col("seq")))
    return c.select("doc_id", F.array_join("c", "").alias("codes"), S.from_base_codes(F.col("c"), F.length("seq")).alias("decoded"))


def _windows_sql(room, pad):
    return f"""win AS (SELECT doc_id, w, tokens[w * {room} + 1 : w * {room} + {room}] AS part FROM (SELECT *, unnest(range(0, CAST(ceil(len(tokens) / {room}.0) AS BIGINT))) AS w FROM tok)),
padded AS (SELECT doc_id, w AS window_id, part, list_concat(part, list_transform(range(0, {room} - len(part)), lambda x: CAST({pad} AS BIGINT))) AS ids FROM win)"""


@query("e1_windows", with_(SRC, TOK, _windows_sql(128, 125)) + "SELECT doc_id, window_id, sha256(array_to_string(ids, ',')) AS ids_sha256, CAST(len(part) AS BIGINT) AS valid FROM padded")
def e1(spark, sf):
    return W.tumbling(tokens(spark, sf).select("doc_id", "tokens"), 128, 125).select("doc_id", "window_id", _ids("input_ids").alias("ids_sha256"), "valid")


@query("e2_prefix_windows", with_(SRC, TOK, _windows_sql(126, 125)) + "SELECT doc_id, window_id, sha256(array_to_string(ids, ',')) AS ids_sha256, CAST(len(part) AS BIGINT) AS valid FROM padded")
def e2(spark, sf):
    return W.tumbling(tokens(spark, sf).select("doc_id", "tokens"), 128, 125, prefix=2).select("doc_id", "window_id", _ids("input_ids").alias("ids_sha256"), "valid")


_FILL = "list_transform(range(0, 63 - len(part)), lambda x: CAST({x} AS BIGINT))"


@query(
    "e3_decoder_windows",
    with_(SRC, TOK, _windows_sql(63, 125)) + f"""SELECT doc_id, window_id, sha256(array_to_string(list_concat([CAST(125 AS BIGINT)], (list_concat([CAST(9 AS BIGINT)], part))[1 : len(part)], {_FILL.format(x=125)}), ',')) AS inputs_sha256,
sha256(array_to_string(list_concat([CAST(-100 AS BIGINT)], part, {_FILL.format(x=-100)}), ',')) AS labels_sha256,
sha256(array_to_string(list_concat([CAST(0 AS BIGINT)], list_transform(part, lambda x: CAST(3 AS BIGINT)), {_FILL.format(x=0)}), ',')) AS lengths_sha256 FROM padded""",
)
def e3(spark, sf):
    t = W.targets(tokens(spark, sf).select("doc_id", "tokens"), 64, 1)
    inputs, labels = W.decoder_window(F.col("target"), [9], 64, 125)
    lengths = W.label_lengths(F.transform("target", lambda x: F.lit(3).cast("long")), [9], 64)
    return t.select("doc_id", "window_id", _ids(inputs).alias("inputs_sha256"), _ids(labels).alias("labels_sha256"), _ids(lengths).alias("lengths_sha256"))


@query(
    "e4_encoder_windows",
    with_(SRC, TOK, _windows_sql(63, 125)) + f"""SELECT doc_id, window_id, sha256(array_to_string(list_concat([CAST(9 AS BIGINT)], part, {_FILL.format(x=125)}), ',')) AS inputs_sha256, CAST(len(part) + 1 AS BIGINT) AS attended, sha256(array_to_string(list_concat([CAST(1 AS BIGINT)], list_transform(part, lambda x: CAST(1 AS BIGINT)), {_FILL.format(x=0)}), ',')) AS mask_sha256,
sha256(array_to_string(list_concat([CAST(-100 AS BIGINT)], part, {_FILL.format(x=-100)}), ',')) AS labels_sha256 FROM padded""",
)
def e4(spark, sf):
    t = W.targets(tokens(spark, sf).select("doc_id", "tokens"), 64, 1)
    inputs, mask, labels = W.encoder_window(F.col("target"), [9], 64, 125)
    return t.select("doc_id", "window_id", _ids(inputs).alias("inputs_sha256"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), _ids(mask).alias("mask_sha256"), _ids(labels).alias("labels_sha256"))


@query(
    "e5_sliding_windows",
    with_(SRC, TOK) + """, p AS (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos FROM tok)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, repeat('125,', CAST(greatest(7 - pos, 0) AS INTEGER)) || string_agg(CAST(t AS VARCHAR), ',') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ids FROM p""",
)
def e5(spark, sf):
    return W.sliding(tokens(spark, sf).select("doc_id", "tokens"), 8, 125, block=500).select("doc_id", "pos", F.array_join("input_ids", ",").alias("ids"))


@query(
    "e6_left_contexts",
    with_(SRC, TOK) + """, p AS (SELECT doc_id, unnest(list_concat([CAST(125 AS BIGINT), 9], tokens)) AS t, generate_subscripts(list_concat([CAST(125 AS BIGINT), 9], tokens), 1) - 3 AS pos FROM tok)
SELECT * FROM (SELECT doc_id, CAST(pos AS BIGINT) AS pos, string_agg(CAST(t AS VARCHAR), ',') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ids FROM p) WHERE pos >= 0""",
)
def e6(spark, sf):
    return W.left_contexts(tokens(spark, sf).select("doc_id", "tokens"), 6, 125, [9], block=500).select("doc_id", "pos", F.array_join("context", ",").alias("ids"))


@query(
    "e7_overlap",
    with_(SRC) + """, n AS (SELECT doc_id, length(seq) // 3 AS n FROM src), w AS (SELECT *, unnest(range(0, 1 + CAST(greatest(ceil((n - 128) / 32.0), 0) AS BIGINT))) AS i FROM n WHERE n > 0)
SELECT doc_id, i AS window_id, i * 32 AS start, CASE i WHEN 0 THEN 0 ELSE 96 + i * 32 END AS scored_from, CAST(least(n, 128 + i * 32) AS BIGINT) AS scored_to FROM w""",
)
def e7(spark, sf):
    n = tokens(spark, sf).select("doc_id", F.size("tokens").alias("n"))
    return W.overlap_ranges(n, 128, overlap_stride(8, None, 4))


@query("e9_chunks", with_(ACGT) + """, c AS (SELECT doc_id, seq, unnest(range(0, CAST(ceil(length(seq) / 64.0) AS BIGINT))) AS i FROM acgt)
SELECT doc_id, i AS chunk_id, rpad(translate(seq[i * 64 + 1 : i * 64 + 64], 'ACGT', '1234'), 64, '1') AS codes, CAST(64 - length(seq[i * 64 + 1 : i * 64 + 64]) AS BIGINT) AS padding FROM c""")
def e9(spark, sf):
    codes = acgt(spark, sf).select("doc_id", F.transform(S.base_codes(F.col("seq")), lambda c: c.cast("long")).alias("tokens"))
    return W.chunks(codes, 64).select("doc_id", "chunk_id", F.array_join("codes", "").alias("codes"), "padding")


#: Characters of a block in these queries; no multiple of the k-mers' length, so that blocks begin at every phase.
BLOCK = 1000


def seq_blocks(spark, sf):
    return blocks_of(sources(spark, sf).select("source_name", "seq"), BLOCK)


@query("d2_block_tokens", with_(SRC, TOK) + f"""SELECT source_name, b AS block_id, CAST(ceil(b * {BLOCK} / 3.0) AS BIGINT) AS first_token, sha256(array_to_string(tokens[CAST(ceil(b * {BLOCK} / 3.0) AS BIGINT) + 1 : CAST(ceil((b + 1) * {BLOCK} / 3.0) AS BIGINT)], ',')) AS ids_sha256
FROM (SELECT source_name, tokens, unnest(range(0, CAST(ceil(length(seq) / {BLOCK}.0) AS BIGINT))) AS b FROM tok)""")
def d2_blocks(spark, sf):
    """Token ids over blocks, each block's first k-mer wherever its phase puts it."""
    return B.block_tokens(seq_blocks(spark, sf), 3).select("source_name", "block_id", "first_token", _ids("tokens").alias("ids_sha256"))


def _by_source(name, columns):
    """The SQL of a query by doc_id, by source instead."""
    return f"WITH base AS ({SQL[name]}) SELECT source || ':' || doc_id AS source_name, {columns} FROM base JOIN documents USING (doc_id)"


@query("e1_block_windows", _by_source("e1_windows", "window_id, ids_sha256, valid"))
def e1_blocks(spark, sf):
    w = B.block_windows(seq_blocks(spark, sf), 3, 128, 125)
    return w.select("source_name", "window_id", _ids("input_ids").alias("ids_sha256"), "valid")


@query("e5_block_windows", _by_source("e5_sliding_windows", "pos, ids"))
def e5_blocks(spark, sf):
    w = B.sliding(B.block_tokens(seq_blocks(spark, sf), 3), 8, 125)
    return w.select("source_name", "pos", F.array_join("input_ids", ",").alias("ids"))


@query("d2_raw_blocks", with_(SRC, TOK, "b AS (SELECT source_name, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS i FROM tok)") + "SELECT source_name, CAST(i * 3 // 700 AS BIGINT) AS block_id, min(i) AS first_token, count(*) AS n_tokens, sha256(string_agg(t, ',' ORDER BY i)) AS ids_sha256 FROM b GROUP BY source_name, i * 3 // 700")
def d2_raw(spark, sf):
    """Tokens from raw blocks of 1,000 characters, line feeds and all: kept letters are counted up to each block, and blocks of 700 kept letters cut anew."""
    raw = blocks_of(documents(spark, sf).select("source_name", F.col("text").alias("seq")), 1000)
    t = B.block_tokens(B.regular(raw, lambda c: S.clean(c, "ACGTN"), 700), 3).filter(F.size("tokens") > 0)
    return t.select("source_name", "block_id", "first_token", F.size("tokens").cast("long").alias("n_tokens"), _ids("tokens").alias("ids_sha256"))
