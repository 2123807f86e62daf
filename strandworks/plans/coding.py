"""Queries: scoring, quantising and coding. Logits are the given embeddings, targets their labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.functions.config import frequency_total
from strandworks.operators import coding as K
from strandworks.operators import corpus as C
from strandworks.operators import trie as T
from strandworks.operators import windows as W
from strandworks.plans.base import ACGT, SPLIT, SRC, acgt, sources, table, with_
from strandworks.plans.tokens import tokens, vocabulary
from strandworks.sources import store as ST
from strandworks.sources.fasta import blocks_of

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _probs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return e.withColumn("log_p", K.log_softmax(F.col("x")))


_P = """e AS (SELECT vec_id AS key, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
p AS (SELECT key, label, list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x))))) AS p FROM e)"""


@query("f2_bits", with_(_P) + "SELECT label, count(*) AS symbols, round(sum(-log2(p[label + 1])), 6) AS bits FROM p GROUP BY label")
def f2(spark, sf):
    b = _probs(spark, sf).withColumn("b", K.bits_of(F.get("log_p", F.col("label"))))
    return b.groupBy("label").agg(F.count("*").alias("symbols"), F.round(F.sum("b"), 6).alias("bits"))


@query("f3_frequency_total", "SELECT DISTINCT n AS vocab, CAST(pow(2, greatest(15, ceil(log2(greatest(32768, n + 1, ceil(n / 0.01)))))) AS BIGINT) AS total FROM (SELECT n_chars + 2 AS n FROM documents)")
def f3(spark, sf):
    n = table(spark, sf, "documents").select((F.col("n_chars") + 2).alias("vocab")).distinct()
    return n.withColumn("total", K.frequency_totals(F.col("vocab")))


_TOTAL = frequency_total(64)
_Q = f"""s AS (SELECT key, unnest(list_transform(p, lambda x: x * ({_TOTAL} - 64))) AS s, generate_subscripts(p, 1) - 1 AS idx FROM p),
r AS (SELECT key, idx, CAST(floor(s) AS BIGINT) AS b, row_number() OVER (PARTITION BY key ORDER BY floor(s) - s, idx) AS rank, {_TOTAL} - 64 - sum(CAST(floor(s) AS BIGINT)) OVER (PARTITION BY key) AS lft FROM s),
q AS (SELECT key, idx, b + 1 + CASE WHEN rank <= lft THEN 1 ELSE 0 END AS freq FROM r)"""


def _quantised(spark, sf):
    p = _probs(spark, sf).withColumn("p", F.transform("log_p", lambda x: F.exp(x)))
    return K.quantised(p, "key", "p", _TOTAL)


@query("f4_quantise", with_(_P, _Q) + "SELECT key, CAST(idx AS INTEGER) AS idx, freq FROM q")
def f4(spark, sf):
    return _quantised(spark, sf).select("key", "idx", "freq")


@query("f5_target_interval", with_(_P, _Q, "c AS (SELECT key, idx, freq, CAST(sum(freq) OVER (PARTITION BY key ORDER BY idx) AS BIGINT) AS cum_high FROM q)") + f"SELECT key, cum_high - freq AS cum_low, cum_high, CAST({_TOTAL} AS BIGINT) AS total FROM c JOIN embeddings ON key = vec_id AND idx = label")
def f5(spark, sf):
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("idx"))
    return _quantised(spark, sf).join(t, ["key", "idx"]).select("key", "cum_low", "cum_high", F.lit(_TOTAL).cast("long").alias("total"))


@query("f1_score_windows")
def f1(spark, sf):
    """Bits and intervals per source under the fixed stand-in scorer (ours; no trained model is meant)."""
    t = W.targets(tokens(spark, sf).select("source_name", "tokens"), 64, 0).withColumn("start", F.col("window_id") * 64)
    inputs, labels = W.decoder_window(F.col("target"), [], 64, 125)
    scored = K.score_windows(t.select("source_name", "start", inputs.alias("input_ids"), labels.alias("labels")), K.fixed_scores(127), frequency_total(127))
    return scored.groupBy("source_name").agg(F.count("*").alias("symbols"), F.round(F.sum(-F.col("log2p")), 4).alias("bits"), F.sum("cum_low").alias("cum_low"))


SQL["f1_score_windows"] = with_(SRC, "x AS (SELECT source_name, unnest(list_transform(regexp_extract_all(seq, '.{3}'), lambda m: (strpos('ACGTN', m[1]) - 1) * 25 + (strpos('ACGTN', m[2]) - 1) * 5 + strpos('ACGTN', m[3]) - 1)) AS t FROM src)",
    "z AS (SELECT i, exp(2 - 4 * i / 126.0) AS w FROM range(0, 127) r(i))", "zz AS (SELECT i, w / sum(w) OVER () AS p FROM z)",
    f"qs AS (SELECT i, CAST(floor(p * ({frequency_total(127)} - 127)) AS BIGINT) AS b, row_number() OVER (ORDER BY floor(p * ({frequency_total(127)} - 127)) - p * ({frequency_total(127)} - 127), i) AS k, {frequency_total(127)} - 127 - sum(CAST(floor(p * ({frequency_total(127)} - 127)) AS BIGINT)) OVER () AS lft, p FROM zz)",
    "qq AS (SELECT i, p, coalesce(sum(b + 1 + CASE WHEN k <= lft THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM qs)") + "SELECT source_name, count(*) AS symbols, round(sum(-log2(p)), 4) AS bits, CAST(sum(lo) AS BIGINT) AS cum_low FROM x JOIN qq ON t = i GROUP BY source_name"


@query("f1_count_model", with_(SRC, SPLIT, "t AS (SELECT source_name, species, split, list_transform(regexp_extract_all(seq, '.{3}'), lambda m: (strpos('ACGTN', m[1]) - 1) * 25 + (strpos('ACGTN', m[2]) - 1) * 5 + strpos('ACGTN', m[3]) - 1) AS k FROM spl)",
    "g AS (SELECT species, split, k[i] AS c, k[i + 1] AS n FROM (SELECT *, unnest(range(1, len(k))) AS i FROM t WHERE len(k) > 1))", "m AS (SELECT c, n, count(*) AS cn FROM g WHERE split = 'train' GROUP BY c, n)", "tot AS (SELECT c, sum(cn) AS ct FROM m GROUP BY c)")
    + "SELECT species AS source_name, count(*) AS symbols, round(sum(-log2((coalesce(cn, 0) + 1.0) / (coalesce(ct, 0) + 125.0))), 4) AS bits FROM g LEFT JOIN m USING (c, n) LEFT JOIN tot USING (c) WHERE split = 'test' GROUP BY species")
def f1b(spark, sf):
    """An order-1 count model of tokens: counts on train splits, bits on test splits."""
    t = C.split_sequences(sources(spark, sf)).select(F.col("species").alias("source_name"), "split", S.kmer_ids(F.col("seq"), 3).alias("tokens"))
    out = K.count_model_bits(t.filter("split = 'train'"), t.filter("split = 'test'"), 1, 125)
    return out.withColumn("bits", F.round("bits", 4))


@query("f6_arithmetic_code")
def f6(spark, sf):
    """Coded bytes of every source under its own base frequencies; tests decode them again."""
    src = sources(spark, sf).select("source_name", "seq")
    coded = K.encode_sequences(blocks_of(src, 1 << 16), K.letter_tables(src))
    return coded.select("source_name", F.col("block_id").alias("code_block"), "symbols", F.length("coded").cast("long").alias("coded_bytes"))


_F7 = """t AS (SELECT key, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS token FROM p),
m AS (SELECT *, token >= 27 AS reserved, sum(p) OVER (PARTITION BY key, token >= 27) AS other, sum(p) OVER (PARTITION BY key, token >= 27, token // 3) AS pair FROM t),
s AS (SELECT key, token, 0 AS step, CASE WHEN reserved THEN 0 ELSE token // 3 + 1 END AS symbol, 10 AS width, CASE WHEN reserved THEN other ELSE pair END AS p FROM m
UNION ALL SELECT key, token, 1, CASE WHEN reserved THEN token - 27 ELSE token % 3 END, CASE WHEN reserved THEN 37 ELSE 3 END, p / CASE WHEN reserved THEN other ELSE pair END FROM m)"""


@query("f7_step_probabilities", with_(_P, _F7) + "SELECT key, CAST(token AS INTEGER) AS token, step, CAST(symbol AS BIGINT) AS symbol, CAST(width AS BIGINT) AS width, round(p, 9) AS p FROM s")
def f7(spark, sf):
    """64 probabilities: 3 letters of 3 in groups of two, and 37 reserved tokens."""
    p = _probs(spark, sf).select("key", F.posexplode(F.transform("log_p", lambda x: F.exp(x))).alias("token", "p"))
    return K.step_probabilities(p, 3, 2, 3).withColumn("p", F.round("p", 9))


@query("f8_chunk_symbols", with_(SRC) + "SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(seq, '.{3}'), lambda m: ((strpos('ACGTN', m[1]) - 1) * 5 + strpos('ACGTN', m[2]) - 1) || '/' || (strpos('ACGTN', m[3]) - 1)), ',')) AS steps_sha256 FROM src")
def f8(spark, sf):
    steps = F.transform("tokens", lambda t: F.array_join(K.chunk_symbols(t, 3, 2, 5), "/"))
    return tokens(spark, sf).select("doc_id", F.sha2(F.array_join(steps, ","), 256).alias("steps_sha256"))


_PIECES = "pieces AS (SELECT DISTINCT p[1 : n] AS piece FROM (SELECT unnest(regexp_extract_all(seq, '.{3}')) AS p FROM src), (VALUES (1), (2), (3)) t(n))"


@query("f9_prefix_tree", with_(SRC, _PIECES, "n AS (SELECT piece[1 : i] AS prefix FROM (SELECT piece, unnest(range(0, length(piece) + 1)) AS i FROM pieces))") + "SELECT prefix, CASE WHEN prefix <> '' THEN prefix[1 : length(prefix) - 1] END AS parent, length(prefix) AS depth, count(*) AS n_pieces FROM n GROUP BY prefix")
def f9(spark, sf):
    """The tree of the pieces of up to 3 letters that the corpus uses."""
    used = sources(spark, sf).select(F.explode(S.kmers(F.col("seq"), 3)).alias("p")).distinct()
    pieces = used.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring("p", F.lit(1), n))).alias("piece")).distinct()
    return K.prefix_tree(pieces.union(pieces.sparkSession.createDataFrame([("<P>",)], "piece string")))


def _pieces(spark):
    """The first 60 pieces of the vocabulary, and four reserved ones behind them."""
    return vocabulary(spark).withColumn("piece", F.when(F.col("id") >= 60, F.concat(F.lit("<r"), "id", F.lit(">"))).otherwise(F.col("piece")))


def _tree(spark):
    return T.tree_of(_pieces(spark).filter("id < 64"))


def _piece_probs(spark, sf):
    return _probs(spark, sf).select("key", F.transform("log_p", lambda x: F.exp(x)).alias("p"), (F.col("key") % 60).alias("target"))


_PIECE = "CASE WHEN i < 5 THEN 'NAGCT'[i + 1] WHEN i < 30 THEN 'NAGCT'[(i - 5) // 5 + 1] || 'NAGCT'[(i - 5) % 5 + 1] ELSE 'NAGCT'[(i - 30) // 25 + 1] || 'NAGCT'[(i - 30) // 5 % 5 + 1] || 'NAGCT'[(i - 30) % 5 + 1] END"
_PP = f"pp AS (SELECT key, i >= 60 AS reserved, {_PIECE} AS piece, p FROM (SELECT key, unnest(p) AS p, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS i FROM p))"
_MASS = """mass AS (SELECT key, prefix, sum(p) AS mass, coalesce(sum(p) FILTER (piece = prefix), 0) AS exact FROM (SELECT key, piece, p, unnest(list_transform(range(0, length(piece) + 1), lambda n: piece[1 : n])) AS prefix FROM pp WHERE NOT reserved) GROUP BY key, prefix),
oth AS (SELECT key, sum(p) AS other FROM pp WHERE reserved GROUP BY key)"""
_TARGET = f"t AS (SELECT key, {_PIECE} AS piece FROM (SELECT vec_id AS key, CAST(vec_id % 60 AS INTEGER) AS i FROM embeddings))"
_BASE = "(strpos('NAGCT', {}) - 1)"


@query("f10_subtree_mass", with_(_P, _PP, _MASS) + "SELECT key, prefix, round(mass, 9) AS mass, round(exact, 9) AS exact FROM mass UNION ALL SELECT key, '<other>', round(other, 9), 0.0 FROM oth")
def f10(spark, sf):
    m = T.subtree_masses(_piece_probs(spark, sf), _tree(spark))
    return m.select("key", "prefix", F.round("mass", 9).alias("mass"), F.round("exact", 9).alias("exact"))


@query("f11_base_stream", with_(_P, _PP, _MASS, _TARGET, "st AS (SELECT key, piece, unnest(range(0, CAST(least(length(piece) + 1, 3) AS BIGINT))) AS step FROM t)") + f"""SELECT key, CAST(step AS INTEGER) AS step, CAST(CASE WHEN step = length(piece) THEN 0 ELSE {_BASE.format("piece[step + 1]")} + 1 END AS BIGINT) AS symbol,
round(CASE WHEN step = length(piece) THEN a.exact ELSE n.mass END / (a.mass + CASE WHEN step = 0 THEN other ELSE 0 END), 9) AS p
FROM st JOIN mass a USING (key) JOIN mass n USING (key) JOIN oth USING (key) WHERE a.prefix = piece[1 : step] AND n.prefix = piece[1 : step + 1]""")
def f11(spark, sf):
    return T.target_steps(_piece_probs(spark, sf), _tree(spark)).select("key", "step", "symbol", F.round("p", 9).alias("p"))


@query("f12_grouped_stream", with_(_P, _PP, _MASS, _TARGET) + f"""SELECT key, 0 AS step, CAST(CASE length(piece) WHEN 1 THEN 1 + {_BASE.format("piece")} WHEN 2 THEN 6 + {_BASE.format("piece[1]")} * 5 + {_BASE.format("piece[2]")} ELSE 31 + {_BASE.format("piece[1]")} * 5 + {_BASE.format("piece[2]")} END AS BIGINT) AS symbol,
CAST(56 AS BIGINT) AS width, round(CASE WHEN length(piece) <= 2 THEN m.exact ELSE m.mass - m.exact END / (r.mass + other), 9) AS p
FROM t JOIN mass m USING (key) JOIN mass r USING (key) JOIN oth USING (key) WHERE m.prefix = piece[1 : 2] AND r.prefix = ''
UNION ALL SELECT key, 1, CAST({_BASE.format("piece[3]")} AS BIGINT), CAST(5 AS BIGINT), round(m.exact / (r.mass - r.exact), 9)
FROM t JOIN mass m USING (key) JOIN mass r USING (key) WHERE length(piece) = 3 AND m.prefix = piece AND r.prefix = piece[1 : 2]""")
def f12(spark, sf):
    """Groups of two bases over pieces of three at most: 1 + 5 + 25 + 25 symbols at the root, then 5."""
    return T.target_steps(_piece_probs(spark, sf), _tree(spark), 2).withColumn("p", F.round("p", 9))


_BITS = "lpad(bin(length(t)), 3, '0') || array_to_string(list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: lpad(bin(strpos('NAGCT', c) - 1), 3, '0')), '')"


@query("f13_tail_side_info", with_(SRC) + f"SELECT doc_id, t AS tail, CAST(3 + 3 * length(t) AS BIGINT) AS bits, upper(array_to_string(list_transform(range(0, CAST(ceil(length(b) / 8.0) AS BIGINT)), lambda i: format('{{:02x}}', CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN b[i * 8 + j + 1] = '1' THEN CAST(pow(2, 7 - j) AS INTEGER) ELSE 0 END)) AS INTEGER))), '')) AS info FROM (SELECT doc_id, t, {_BITS} AS b FROM (SELECT doc_id, seq[length(seq) - length(seq) % 6 + 1 :] AS t FROM src))")
def f13(spark, sf):
    t = sources(spark, sf).select("doc_id", S.tail(F.col("seq"), 6).alias("tail"))
    return t.select("doc_id", "tail", K.tail_bits(F.col("tail")).alias("bits"), K.tail_side_info(F.col("tail")).alias("info"))


@query("f14_raw_tail", with_(SRC) + "SELECT doc_id, CAST(length(seq) % 6 AS BIGINT) AS bytes, CAST(8 * (length(seq) % 6) AS BIGINT) AS bits FROM src")
def f14(spark, sf):
    n = K.raw_tail_bytes(S.tail(F.col("seq"), 6), F.lit(True))
    return sources(spark, sf).select("doc_id", n.alias("bytes"), (8 * n).alias("bits"))


@query("f15_baseline_sizes")
def f15(spark, sf):
    """Sizes by codecs that are fed the blocks of a source in their order; tests hold them against whole samples."""
    src = sources(spark, sf).select("source_name", "seq")
    return K.streamed_sizes(blocks_of(src, 1 << 16, keep_empty=True).select("source_name", "start", "seq"), ["source_name"])


@query("f15_plain_sizes", with_(SRC) + "SELECT source_name, CAST(length(seq) AS BIGINT) AS ascii, CAST((2 * length(seq) + 7) // 8 AS BIGINT) AS two_bit FROM src")
def f15b(spark, sf):
    """The two baselines that need no codec."""
    n = F.octet_length("seq").cast("long")
    return sources(spark, sf).select("source_name", n.alias("ascii"), S.two_bit_bytes(n).alias("two_bit"))


@query("f16_latent_bits", with_(SRC, "v AS (SELECT source_name, least(128, n - w * 128) AS valid FROM (SELECT source_name, length(seq) // 3 AS n, unnest(range(0, CAST(ceil((length(seq) // 3) / 128.0) AS BIGINT))) AS w FROM src))", "k AS (SELECT *, CAST(least(greatest(ceil(valid * 0.25), 1), valid) AS BIGINT) AS n FROM v)") + "SELECT source_name, CAST(sum(n) AS BIGINT) AS latents, CAST(sum((n * 64 * 2 + 4 + n * 2) * 8) AS BIGINT) AS dense_bits, CAST(sum((n * 8 * 2 + 4) * 8) AS BIGINT) AS continuous_bits, CAST(sum((8 * 2 + 4) * 8) AS BIGINT) AS flat_bits FROM k GROUP BY source_name")
def f16(spark, sf):
    w = W.tumbling(tokens(spark, sf).select("source_name", "tokens"), 128, 125)
    v = F.col("valid")
    return w.groupBy("source_name").agg(
        F.sum(K.latent_count(v, 0.25)).alias("latents"),
        F.sum(K.latent_bits("dense", v, 0.25, 64, 8, 2, True)).alias("dense_bits"),
        F.sum(K.latent_bits("continuous_bottleneck", v, 0.25, 64, 8, 2, False)).alias("continuous_bits"),
        F.sum(K.latent_bits("flatten_bottleneck", v, 0.25, 64, 8, 2, False)).alias("flat_bits"),
    )


@query("f16_whole_latent_bits", with_(SRC, "v AS (SELECT source_name, length(seq) // 3 AS n, CAST(ceil((length(seq) // 3) / 128.0) AS BIGINT) AS w FROM src)") + "SELECT source_name, CAST((n * 64 * 2 + w * 4) * 8 AS BIGINT) AS dense_bits, CAST((n * 8 * 2 + w * 4) * 8 AS BIGINT) AS continuous_bits, CAST((w * 16 * 2 + w * 4) * 8 AS BIGINT) AS flat_bits FROM v WHERE w > 0")
def f16b(spark, sf):
    w = W.tumbling(tokens(spark, sf).select("source_name", "tokens"), 128, 125).groupBy("source_name").agg(F.sum("valid").alias("v"), F.count("*").alias("w"))
    of = lambda mode: K.whole_latent_bits(mode, F.col("v"), F.col("w"), 64, 8, 16, 2)
    return w.select("source_name", of("dense").alias("dense_bits"), of("continuous_bottleneck").alias("continuous_bits"), of("flatten_bottleneck").alias("flat_bits"))


@query("f17_residuals", with_(ACGT) + "SELECT doc_id, CAST(length(seq) - length(replace(seq, 'C', '')) AS BIGINT) AS same, CAST(length(replace(seq, 'C', '')) AS BIGINT) AS nonzeros, round(length(replace(seq, 'C', '')) / greatest(length(seq), 1), 9) AS density, sha256(seq) AS restored_sha256 FROM acgt")
def f17(spark, sf):
    """Deltas against a constant prediction of C."""
    r = acgt(spark, sf).withColumn("codes", S.base_codes(F.col("seq"))).withColumn("prediction", F.array_repeat(F.lit(2), F.size("codes")))
    out = K.residuals(r, "doc_id", "prediction")
    # restored from what is stored: prediction, places and values
    back = S.from_base_codes(K.restored(F.col("prediction"), F.col("indices"), F.col("data")))
    return out.select("doc_id", (F.size("prediction") - F.col("nonzeros")).alias("same"), "nonzeros", F.round("density", 9).alias("density"), F.sha2(back, 256).alias("restored_sha256"))


@query("f18_recheck", with_(ACGT) + "SELECT source_name, doc_id % 7 <> 0 AS exact FROM acgt")
def f18(spark, sf):
    """Sequences decoded from their codes; every seventh is missing and so not exact."""
    a = acgt(spark, sf)
    decoded = a.filter("doc_id % 7 <> 0").select("source_name", S.from_base_codes(S.base_codes(F.col("seq"))).alias("seq"))
    return K.recheck(decoded, a)


@query("f18_stored", with_(ACGT) + "SELECT source_name, CAST(ceil(length(seq) / 1024.0) AS BIGINT) AS blocks, true AS exact, 0 AS bad FROM acgt WHERE length(seq) > 0")
def f18b(spark, sf):
    """Every source coded by its own table, stored, read again, decoded and compared block by block."""
    src = acgt(spark, sf).select("source_name", "seq")
    blocks, tables = blocks_of(src, 1024), K.letter_tables(src)
    path = f"{ST.shared_dir(spark)}/coded-{uuid.uuid4().hex}"
    ST.write_store(K.encode_sequences(blocks, tables), tables, path)
    return ST.check_store(ST.read_store(spark, path), blocks).select("source_name", "blocks", "exact", F.size("bad_blocks").alias("bad"))
