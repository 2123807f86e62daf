"""Queries: metrics, profiles, reports and training events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandworks.operators import blocks as B
from strandworks.operators import corpus as C
from strandworks.operators import metrics as M
from strandworks.operators import report as R
from strandworks.plans.base import SPLIT, SRC, sources, table, with_
from strandworks.plans.tokens import TOK, tokens
from strandworks.sources.fasta import blocks_of
from strandworks.streaming import events as E

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _parts(spark, sf):
    """Sizes per source and split: GC bases at 2 bits, others at 1.75, coded to whole bytes; a second per 1000 bases."""
    s = C.split_sequences(sources(spark, sf))
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return s.select("species", "source_name", "doc_id", "split", F.col("size").alias("bases"), (gc * 2 + (F.col("size") - gc) * 1.75).alias("bits"), F.ceil((gc * 2 + (F.col("size") - gc) * 1.75) / 8).alias("coded_bytes"), (F.col("size") / 1000).alias("seconds"))


_PARTS = """parts AS (SELECT species, source_name, doc_id, split, size AS bases, gc * 2 + (size - gc) * CAST(1.75 AS DOUBLE) AS bits, CAST(ceil((gc * 2 + (size - gc) * 1.75) / 8) AS BIGINT) AS coded_bytes, CAST(size AS DOUBLE) / 1000 AS seconds
FROM (SELECT *, length(seq) - length(translate(seq, 'GC', '')) AS gc FROM spl))"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("g1_source_metrics", with_(SRC, SPLIT, _PARTS) + "SELECT species, split, CAST(sum(bases) AS BIGINT) AS bases, round(sum(bits), 6) AS bits, CAST(sum(coded_bytes) AS BIGINT) AS coded_bytes, round(sum(seconds), 6) AS seconds, round(sum(bits) / greatest(sum(bases), 1), 6) AS theoretical_bits_per_base, round(8.0 * sum(coded_bytes) / greatest(sum(bases), 1), 6) AS arithmetic_bits_per_base, round(sum(bases) / greatest(sum(seconds), 1e-12), 3) AS bases_per_second FROM parts GROUP BY species, split")
def g1(spark, sf):
    m = M.source_metrics(_parts(spark, sf), ["species", "split"])
    return _rounded(m, "bits", "seconds", "theoretical_bits_per_base", "arithmetic_bits_per_base").withColumn("bases_per_second", F.round("bases_per_second", 3))


@query("g2_summary", with_(SRC, SPLIT, _PARTS) + "SELECT split, count(*) AS sources, CAST(sum(bases) AS BIGINT) AS bases, round(sum(bits), 6) AS bits, CAST(sum(coded_bytes) AS BIGINT) AS coded_bytes, CAST(0 AS INTEGER) AS side_bits, round(sum(bits) / greatest(sum(bases), 1), 6) AS bits_per_base, round(8.0 * sum(coded_bytes) / greatest(sum(bases), 1), 6) AS coded_bits_per_base FROM parts GROUP BY split")
def g2(spark, sf):
    return _rounded(M.summary(_parts(spark, sf), ["split"], ["bases", "bits", "coded_bytes", "side_bits"]), "bits", "bits_per_base", "coded_bits_per_base")


@query("g3_constant_or_absent", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 AND count(lang) = count(*) THEN min(lang) END AS lang FROM documents GROUP BY source")
def g3(spark, sf):
    return M.constant_or_absent(table(spark, sf, "documents"), ["source"], "lang")


@query("g4_latent_summary", with_(SRC, SPLIT, _PARTS) + "SELECT split, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(coded_bytes) AS BIGINT) AS coded_bytes, CAST(sum(bases * 3) AS BIGINT) AS side_bits, CAST(ceil(sum(bases * 3) / 8.0) AS BIGINT) AS side_bytes, round(8.0 * sum(coded_bytes) / greatest(sum(bases), 1), 6) AS decoder_bits_per_base, round((8.0 * sum(coded_bytes) + sum(bases * 3)) / greatest(sum(bases), 1), 6) AS total_bits_per_base FROM parts GROUP BY split")
def g4(spark, sf):
    p = _parts(spark, sf).withColumn("side_bits", F.col("bases") * 3)
    return _rounded(M.latent_summary(p, ["split"]), "decoder_bits_per_base", "total_bits_per_base")


@query("g5_chunk_summary", with_(SRC, SPLIT, _PARTS) + "SELECT CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(coded_bytes) AS BIGINT) AS coded_bytes, bool_and(coded_bytes >= 0) AS all_exact, round(sum(bases) / greatest(sum(coded_bytes), 1), 6) AS ratio, round(8.0 * sum(coded_bytes) / greatest(sum(bases), 1), 6) AS bits_per_base, CAST(sum(coded_bytes) + 1000 AS BIGINT) AS bytes_with_model FROM parts")
def g5(spark, sf):
    return _rounded(M.chunk_summary(_parts(spark, sf).withColumn("exact", F.col("coded_bytes") >= 0), 1000), "ratio", "bits_per_base")


@query("g6_loss_summary", "SELECT n.lang, round(sum(nats) FILTER (label >= 0), 6) AS nats, count(*) FILTER (label >= 0) AS tokens, CAST(sum(bases) FILTER (label >= 0) AS BIGINT) AS bases, round(sum(nats) FILTER (label >= 0) / ln(2) / greatest(count(*) FILTER (label >= 0), 1), 6) AS bits_per_token, round(sum(nats) FILTER (label >= 0) / ln(2) / greatest(sum(bases) FILTER (label >= 0), 1), 6) AS bits_per_base FROM (SELECT lang, n_chars / 1000.0 AS nats, CASE WHEN doc_id % 3 = 0 THEN -100 ELSE 1 END AS label, 3 AS bases FROM documents) n GROUP BY n.lang")
def g6(spark, sf):
    rows = table(spark, sf, "documents").select("lang", (F.col("n_chars") / 1000).alias("nats"), F.when(F.col("doc_id") % 3 == 0, -100).otherwise(1).alias("label"), F.lit(3).alias("bases"))
    return _rounded(M.loss_summary(rows, ["lang"]), "nats", "bits_per_token", "bits_per_base")


def _scored(spark, sf):
    t = tokens(spark, sf).select(F.posexplode("tokens").alias("i", "token"))
    letters = F.array(*map(F.lit, "ACGTN"))
    piece = F.concat(F.get(letters, (F.col("token") / 25).cast("int")), F.get(letters, (F.col("token") / 5 % 5).cast("int")), F.get(letters, (F.col("token") % 5).cast("int")))
    return t.select((F.col("i") % 16).alias("position"), "token", piece.alias("piece"), (F.col("token") / 10).alias("bits"))


_PROFILE = "prof AS (SELECT 'ACGTN'[d + 1] AS base, CAST(i % 16 * 3 + j AS BIGINT) AS position, t / 10.0 / 3 AS bits FROM (SELECT t, i, unnest([0, 1, 2]) AS j, unnest([CAST(t // 25 AS INTEGER), CAST(t // 5 % 5 AS INTEGER), CAST(t % 5 AS INTEGER)]) AS d FROM (SELECT unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS i FROM tok)))"


@query("g7_position_profile", with_(SRC, TOK, _PROFILE) + "SELECT base, position, count(*) AS count, round(sum(bits), 4) AS bits FROM prof GROUP BY base, position")
def g7(spark, sf):
    p = M.position_profile(_scored(spark, sf), 3, 126)
    return p.select("base", F.col("position").cast("long").alias("position"), "count", F.round("bits", 4).alias("bits"))


@query("g8_profile_rows", with_(SRC, TOK, _PROFILE, "s AS (SELECT position, count(*) AS count, sum(bits) AS bits FROM prof GROUP BY position)") + "SELECT p AS position, p + 1 AS position_one_based, coalesce(count, 0) AS count, round(coalesce(bits, 0), 4) AS bits, round(bits / count, 6) AS mean_bits FROM range(0, 50) r(p) LEFT JOIN s ON position = p")
def g8(spark, sf):
    return M.profile_rows(M.position_profile(_scored(spark, sf), 3, 126), 50).withColumns({"bits": F.round("bits", 4), "mean_bits": F.round("mean_bits", 6)})


_EXPECTED = "exp AS (SELECT source AS species, count(*) AS expected_files, CAST(sum(n_chars) AS BIGINT) AS expected_bytes FROM documents GROUP BY source UNION ALL SELECT 'none', 0, 0)"


@query("g9_manifest_check", with_(_EXPECTED, "f AS (SELECT source AS species, count(*) AS files, sum(n_chars) AS bytes FROM documents WHERE doc_id % 50 <> 0 GROUP BY source)", "g AS (SELECT coalesce(species, 'TOTAL') AS species, CAST(sum(expected_files) AS BIGINT) AS expected_files, CAST(sum(expected_bytes) AS BIGINT) AS expected_bytes, CAST(sum(coalesce(files, 0)) AS BIGINT) AS files, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM exp LEFT JOIN f USING (species) GROUP BY ROLLUP (species))") + "SELECT *, files = expected_files AND bytes = expected_bytes AS ok FROM g")
def g9(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("species"), F.col("n_chars").alias("length"), "doc_id")
    expected = docs.groupBy("species").agg(F.count("*").alias("expected_files"), F.sum("length").alias("expected_bytes"))
    expected = expected.union(spark.createDataFrame([("none", 0, 0)], "species string, expected_files long, expected_bytes long"))
    return M.manifest_check(expected, docs.filter("doc_id % 50 <> 0"))


_ACGTU = "length(seq) - length(translate(seq, 'ACGTU', ''))"


@query("g10_gc", with_(SRC) + f"SELECT doc_id, CAST(length(seq) AS BIGINT) AS bases, round(CASE WHEN {_ACGTU} > 0 THEN (length(seq) - length(translate(seq, 'GC', ''))) / ({_ACGTU}) ELSE 0 END, 9) AS gc_fraction, round(CASE WHEN seq <> '' THEN (length(seq) - ({_ACGTU})) / length(seq) ELSE 0 END, 9) AS non_acgt_fraction FROM src")
def g10(spark, sf):
    return M.sequence_profile(sources(spark, sf), "doc_id").withColumns({c: F.round(c, 9) for c in ("gc_fraction", "non_acgt_fraction")})


_OCC = "occ AS (SELECT doc_id, p AS pos, seq[p + 1 : p + 4] AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 3)) AS p FROM src WHERE length(seq) >= 4) WHERE regexp_matches(seq[p + 1 : p + 4], '^[ACGTU]{4}$'))"
_CNT = "cnt AS (SELECT doc_id, kmer, count(*) AS count FROM occ GROUP BY doc_id, kmer)"
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, kmer) AS rank FROM cnt WHERE count >= 2) WHERE rank <= 5)"


@query("g11_kmers", with_(SRC, _OCC, _CNT) + "SELECT * FROM cnt")
def g11(spark, sf):
    return M.kmer_counts(sources(spark, sf), "doc_id", 4)


@query("g11_block_kmers", with_(SRC, _OCC, _CNT) + "SELECT source_name, kmer, count FROM cnt JOIN src USING (doc_id)")
def g11_blocks(spark, sf):
    return B.kmer_counts(blocks_of(sources(spark, sf).select("source_name", "seq"), 1000), 4)


@query("g12_fasta_totals", with_(SRC) + "SELECT count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS bases FROM src")
def g12(spark, sf):
    return sources(spark, sf).agg(F.count("*").alias("records"), F.sum(F.length("seq")).cast("long").alias("bases"))


@query("h3_top_kmers", with_(SRC, _OCC, _CNT, _TOP) + "SELECT doc_id, kmer, count, rank FROM top")
def h3(spark, sf):
    return M.top_kmers(M.kmer_counts(sources(spark, sf), "doc_id", 4), "doc_id", 2, 5).withColumn("rank", F.col("rank").cast("long"))


_MASK = "mask AS (SELECT doc_id, pos, max(CASE WHEN count >= 8 THEN 2 ELSE 1 END) AS level FROM (SELECT doc_id, kmer, count, unnest([pos, pos + 1, pos + 2, pos + 3]) AS pos FROM occ JOIN top USING (doc_id, kmer)) GROUP BY doc_id, pos)"


def _mask(spark, sf):
    src = sources(spark, sf)
    return M.repeat_mask(src, M.top_kmers(M.kmer_counts(src, "doc_id", 4), "doc_id", 2, 5), "doc_id", 4)


@query("h4_repeat_mask", with_(SRC, _OCC, _CNT, _TOP, _MASK) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, level FROM mask")
def h4(spark, sf):
    return _mask(spark, sf)


@query("h5_repeat_lines", with_(SRC, _OCC, _CNT, _TOP, _MASK, "l AS (SELECT doc_id, length(seq) AS n, unnest(range(0, CAST(ceil(length(seq) / 60.0) AS BIGINT))) AS line FROM src)", "c AS (SELECT doc_id, pos // 60 AS line, count(*) AS k FROM mask GROUP BY doc_id, pos // 60)") + "SELECT doc_id, CAST(line AS INTEGER) AS line, round(coalesce(k, 0) / least(60, n - line * 60), 9) AS repeat_fraction, CAST(greatest(4, floor(coalesce(k, 0) / least(60, n - line * 60) * 100)) AS BIGINT) AS meter FROM l LEFT JOIN c USING (doc_id, line)")
def h5(spark, sf):
    return M.repeat_lines(sources(spark, sf), _mask(spark, sf), "doc_id", 60).withColumn("repeat_fraction", F.round("repeat_fraction", 9))


_BY_SOURCE = "FROM {} JOIN (SELECT doc_id, source_name FROM src) USING (doc_id)"


def _block_mask(spark, sf):
    b = blocks_of(sources(spark, sf).select("source_name", "seq"), 600)
    return b, B.repeat_mask(b, M.top_kmers(B.kmer_counts(b, 4), "source_name", 2, 5), 4, 600)


@query("h4_block_mask", with_(SRC, _OCC, _CNT, _TOP, _MASK) + "SELECT source_name, CAST(pos AS BIGINT) AS pos, level " + _BY_SOURCE.format("mask"))
def h4b(spark, sf):
    """The mask from blocks of 600 characters, each with what reaches into it on both sides."""
    return _block_mask(spark, sf)[1]


@query("h5_block_lines", with_(SRC, _OCC, _CNT, _TOP, _MASK, "l AS (SELECT doc_id, length(seq) AS n, unnest(range(0, CAST(ceil(length(seq) / 60.0) AS BIGINT))) AS line FROM src)", "c AS (SELECT doc_id, pos // 60 AS line, count(*) AS k FROM mask GROUP BY doc_id, pos // 60)") + "SELECT source_name, line, round(coalesce(k, 0) / least(60, n - line * 60), 9) AS repeat_fraction, CAST(greatest(4, floor(coalesce(k, 0) / least(60, n - line * 60) * 100)) AS BIGINT) AS meter FROM l LEFT JOIN c USING (doc_id, line) JOIN (SELECT doc_id, source_name FROM src) USING (doc_id)")
def h5b(spark, sf):
    return B.repeat_lines(*_block_mask(spark, sf), 60, 600).withColumn("repeat_fraction", F.round("repeat_fraction", 9))


# --- reports -------------------------------------------------------------------------------------


#: Sources of one run at most, which bounds the size of a result document.
RUN_SOURCES = 200


def _results(spark, sf):
    """One result document per run, a bounded batch of a species' sources, as JSON, with a malformed branch in it."""
    p = _parts(spark, sf).withColumn("run", F.concat_ws("/", "species", F.floor(F.col("doc_id") / RUN_SOURCES)))
    p = p.withColumn("one", F.struct("species", "source_name", F.col("bases").alias("sample_bytes"), F.col("bases").alias("sample_bases"), (F.col("coded_bytes") * 8 / F.greatest("bases", F.lit(1))).alias("arithmetic_bits_per_base"), "coded_bytes", (F.col("bases") % 7 * 10).alias("gzip_bytes"), F.lit(1000.0).alias("bases_per_second"), F.when(F.col("doc_id") % 3 > 0, F.col("bases") * 250.0).alias("compression_bytes_per_second")))
    per = p.groupBy("run", "split").agg(F.collect_list("one").alias("per_source"), F.struct(F.sum("bases").alias("sample_bases"), F.sum("coded_bytes").alias("coded_bytes"), F.sum(F.col("bases") % 7 * 10).alias("gzip_bytes"), (F.sum("coded_bytes") * 8 / F.greatest(F.sum("bases"), F.lit(1))).alias("arithmetic_bits_per_base")).alias("aggregate"))
    doc = per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("split", F.create_map(F.lit("windows"), F.struct("aggregate", "per_source"), F.lit("broken"), F.lit(None))))).alias("m"))
    return doc.select("run", F.to_json("m").alias("results"))


_RUN = f"species || '/' || doc_id // {RUN_SOURCES}"
_AGG = f"agg AS (SELECT {_RUN} AS run, split, 'windows' AS mode, CAST(sum(bases) AS BIGINT) AS sample_bases, CAST(sum(coded_bytes) AS BIGINT) AS coded_bytes, CAST(sum(bases % 7 * 10) AS BIGINT) AS gzip_bytes, 8.0 * sum(coded_bytes) / greatest(sum(bases), 1) AS bpb FROM parts GROUP BY {_RUN}, split)"


@query("i1_aggregate_rows", with_(SRC, SPLIT, _PARTS, _AGG) + "SELECT run, split, mode, sample_bases, coded_bytes, gzip_bytes, round(bpb, 6) AS arithmetic_bits_per_base FROM agg")
def i1(spark, sf):
    return _rounded(R.aggregate_rows(R.branches(_results(spark, sf))), "arithmetic_bits_per_base")


@query("i1_source_rows", with_(SRC, SPLIT, _PARTS) + f"SELECT {_RUN} AS run, split, 'windows' AS mode, species, source_name, bases AS sample_bytes, bases AS sample_bases, round(8.0 * coded_bytes / greatest(bases, 1), 6) AS arithmetic_bits_per_base, coded_bytes, bases % 7 * 10 AS gzip_bytes, CAST(1000 AS DOUBLE) AS bases_per_second, CASE WHEN doc_id % 3 > 0 THEN bases * CAST(250 AS DOUBLE) END AS compression_bytes_per_second FROM parts")
def i1b(spark, sf):
    return _rounded(R.source_rows(R.branches(_results(spark, sf))), "arithmetic_bits_per_base")


@query("i2_ratios", with_(SRC, SPLIT, _PARTS) + "SELECT source_name, split, round(8.0 * coded_bytes / greatest(bases, 1) / 2, 6) AS vs_two_bit, round(coded_bytes / nullif(bases, 0), 6) AS vs_raw, round(coded_bytes / nullif(bases % 7 * 10, 0), 6) AS vs_gzip FROM parts")
def i2(spark, sf):
    r = R.ratios(R.source_rows(R.branches(_results(spark, sf))))
    return _rounded(r, "vs_two_bit", "vs_raw", "vs_gzip").select("source_name", "split", "vs_two_bit", "vs_raw", "vs_gzip")


def _baseline(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.filter("doc_id % 10 = 0").select(F.concat_ws(":", "source", "doc_id").alias("name"), F.lit(90.0).alias("percent"))
    return names.union(docs.filter("source in ('src1', 'src2')").select("source", F.lit(99.0)).distinct())


_BASE = "CASE WHEN doc_id % 10 = 0 THEN CAST(90 AS DOUBLE) WHEN species IN ('src1', 'src2') THEN CAST(99 AS DOUBLE) END"


@query("h1_baseline", with_(SRC, SPLIT, _PARTS) + f"SELECT source_name, split, {_BASE} AS baseline_percent FROM parts")
def h1(spark, sf):
    return R.with_baseline(_parts(spark, sf), _baseline(spark, sf)).select("source_name", "split", "baseline_percent")


@query("i3_curve_rows", with_(SRC, SPLIT, _PARTS) + f"SELECT source_name, split, round(8.0 * coded_bytes / greatest(bases, 1) / 2 * 100, 6) AS percent_of_two_bit, round({_BASE} / 100 * 2, 6) AS baseline_bits_per_base, CAST(0.001 AS DOUBLE) AS mbases_per_second, round(CASE WHEN doc_id % 3 > 0 THEN bases * CAST(250 AS DOUBLE) END / 1000000, 6) AS compression_mbytes_per_second FROM parts")
def i3(spark, sf):
    r = R.curve_rows(R.with_baseline(R.source_rows(R.branches(_results(spark, sf))), _baseline(spark, sf)))
    return _rounded(r, "percent_of_two_bit", "baseline_bits_per_base", "compression_mbytes_per_second").select("source_name", "split", "percent_of_two_bit", "baseline_bits_per_base", "mbases_per_second", "compression_mbytes_per_second")


@query("h2_dataset_order", with_(SRC) + "SELECT source_name, CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id WHEN species = 'src1' THEN 5 ELSE 1000000000 END AS BIGINT) AS sort_key FROM src")
def h2(spark, sf):
    s = sources(spark, sf).select("species", "source_name", "doc_id")
    listed = s.filter("doc_id % 4 = 0").select(F.col("source_name").alias("name"), F.col("doc_id").alias("place"))
    listed = listed.union(listed.withColumn("place", F.col("place") + 7)).union(s.filter("species = 'src1'").select("species", F.lit(5).cast("long")).distinct())
    return R.dataset_order(s, listed).select("source_name", "sort_key")


@query("h7_legacy", with_(SRC, SPLIT, _PARTS) + "SELECT source_name, split, 'windows' AS mode, bases, bits FROM parts UNION ALL SELECT source || ':' || doc_id, 'test', 'legacy', n_chars, NULL FROM documents")
def h7(spark, sf):
    new = _parts(spark, sf).select("source_name", "split", F.lit("windows").alias("mode"), "bases", "bits")
    return R.with_legacy(new, table(spark, sf, "documents").select(F.concat_ws(":", "source", "doc_id").alias("source_name"), F.col("n_chars").alias("bases")))


@query("h8_key_sets", "SELECT (SELECT count(*) FROM (SELECT source, lang FROM documents EXCEPT SELECT source, lang FROM documents WHERE doc_id % 2 = 0)) AS only_odd, (SELECT count(*) FROM (SELECT source FROM documents UNION SELECT lang FROM documents)) AS all_names")
def h8(spark, sf):
    d = table(spark, sf, "documents")
    lost = d.select("source", "lang").distinct().exceptAll(d.filter("doc_id % 2 = 0").select("source", "lang").distinct())
    names = d.select("source").union(d.select("lang")).distinct()
    return lost.agg(F.count("*").alias("only_odd")).join(names.agg(F.count("*").alias("all_names")))


@query("i4_dataset_table", "SELECT source, doc_id // 1000 AS part, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS sequence_keys, count(*) AS sequence_count FROM documents GROUP BY source, doc_id // 1000")
def i4(spark, sf):
    """A row of the table names a thousand keys at most; a larger species has several."""
    d = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / 1000))
    g = d.groupBy("source", "part").agg(F.array_sort(F.collect_list("doc_id")).alias("k"), F.count("*").alias("sequence_count"))
    return g.select("source", "part", F.array_join("k", "|").alias("sequence_keys"), "sequence_count")


@query("i5_flatten", "SELECT doc_id, unnest(['lang', 'size.chars', 'size.none']) AS name, unnest([lang, CAST(n_chars AS VARCHAR), NULL]) AS value FROM documents")
def i5(spark, sf):
    c = F.struct("lang", F.struct(F.col("n_chars").alias("chars"), F.lit(None).cast("int").alias("none")).alias("size"), F.array("source").alias("list"))
    return R.flatten_struct(table(spark, sf, "documents").select("doc_id", c.alias("config")), "config", "doc_id")


@query("i6_merged_metrics", "SELECT source AS run, 'chars' AS metric, CAST(sum(n_chars) AS DOUBLE) AS value FROM documents GROUP BY source UNION ALL SELECT source, 'docs', CAST(CASE WHEN source = 'src1' THEN -1 ELSE count(*) END AS DOUBLE) FROM documents GROUP BY source")
def i6(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("run")).agg(F.sum("n_chars").cast("double").alias("chars"), F.count("*").cast("double").alias("docs"))
    first = d.unpivot(["run"], ["chars", "docs"], "metric", "value")
    return R.merged_metrics([first, d.filter("run = 'src1'").select("run", F.lit("docs").alias("metric"), F.lit(-1.0).alias("value"))], "run")


@query("i7_artifact_name", "SELECT page_id, coalesce(nullif(CASE WHEN c LIKE 'train\\_windows\\_%' ESCAPE '\\' THEN c[7:] ELSE c END, ''), 'run') AS name FROM (SELECT page_id, regexp_replace(regexp_replace(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'train_windows_' || url ELSE '--' END, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM pages)")
def i7(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("train_windows_"), "url")).otherwise("--")
    return table(spark, sf, "pages").select("page_id", R.artifact_name(raw).alias("name"))


@query("i8_run_name", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN source ELSE 'dir' || doc_id END AS name FROM documents")
def i8(spark, sf):
    pick = lambda n, c: F.when(F.col("doc_id") % 4 == n, F.col(c)).otherwise(" ")
    return table(spark, sf, "documents").select("doc_id", R.run_name(pick(0, "lang"), pick(1, "source"), F.lit(None).cast("string"), F.concat(F.lit("dir"), "doc_id")).alias("name"))


@query("i9_run_metadata", "SELECT doc_id, quality IS NOT NULL AS has_quality, toxic IS NOT NULL AS has_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def i9(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.run_metadata(j, "doc_id", {"quality": F.col("quality"), "toxic": F.col("toxic")})


# --- training events -----------------------------------------------------------------------------


def events(spark, sf):
    """The event table as a training log: views train, purchases and signups validate and test, the rest is noise."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "view", "train").when(F.col("event_type").isin("purchase", "signup"), "eval").otherwise(F.col("event_type"))
    split = F.when(F.col("event_type") == "purchase", "val").when(F.col("event_type") == "signup", "test")
    e = table(spark, sf, "events").withColumn("seq", F.row_number().over(w).cast("long"))
    step = F.when(F.col("event_id") % 9 == 0, "1.5").otherwise((F.col("seq") * 10).cast("string"))
    return e.select(
        F.col("user_id").cast("bigint").alias("run"), "seq", kind.alias("event"), split.alias("split"), step.alias("step"), F.lit("1").alias("epoch"), F.col("value").alias("loss_nats_per_token"),
        (F.col("value") / 2).alias("bits_per_base"), F.lit(0.001).alias("learning_rate"), (F.col("value") * 100).alias("tokens_per_second"),
    )


_EV = """ev AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'view' THEN 'train' WHEN event_type IN ('purchase', 'signup') THEN 'eval' ELSE event_type END AS event,
CASE event_type WHEN 'purchase' THEN 'val' WHEN 'signup' THEN 'test' END AS split, CASE WHEN event_id % 9 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 END AS step, value FROM events)"""
_METRICS = """met AS (SELECT run, seq, step, CAST(1 AS BIGINT) AS epoch, unnest(CASE WHEN event = 'train' THEN ['train/loss', 'train/bpb', 'train/lr', 'train/tokens_per_second'] WHEN split = 'val' THEN ['val/loss', 'val/bpb', 'eval/loss', 'eval/bpb'] ELSE ['test/loss', 'test/bpb'] END) AS metric,
unnest(CASE WHEN event = 'train' THEN [value, value / 2, 0.001, value * 100] WHEN split = 'val' THEN [value, value / 2, value, value / 2] ELSE [value, value / 2] END) AS value FROM ev WHERE event IN ('train', 'eval') AND value IS NOT NULL)"""


@query("j1_metric_rows", with_(_EV, _METRICS) + "SELECT run, seq, step, epoch, metric, round(value, 6) AS value FROM met")
def j1(spark, sf):
    return E.metric_rows(events(spark, sf)).withColumn("value", F.round("value", 6))


@query("j2_resume", with_(_EV, _METRICS) + "SELECT run, seq, metric, round(value, 6) AS value FROM met WHERE seq > 3")
def j2(spark, sf):
    return E.metric_rows(E.undelivered(events(spark, sf), 3)).select("run", "seq", "metric", F.round("value", 6).alias("value"))


@query("j3_best_validation", with_(_EV) + "SELECT run, round(coalesce(min(value / 2) FILTER (split = 'val' AND seq > 3), min(value / 2) FILTER (split = 'val' AND seq <= 3)), 6) AS reported_best, round(min(value / 2) FILTER (split = 'val'), 6) AS true_best FROM ev GROUP BY run")
def j3(spark, sf):
    return _rounded(E.best_validation(events(spark, sf), 3), "reported_best", "true_best")


@query("j4_running_best", with_(_EV, "v AS (SELECT run, seq * 10 AS step, value / 2 AS b, min(value / 2) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev WHERE split = 'val')") + "SELECT run, step, round(b, 6) AS bits_per_base, round(least(b, coalesce(p, b)), 6) AS best, p IS NULL OR b < p AS improved FROM v")
def j4(spark, sf):
    e = events(spark, sf).withColumn("step", (F.col("seq") * 10).cast("string"))
    return _rounded(E.running_best(e), "bits_per_base", "best")


@query("j5_throughput", with_(_EV) + "SELECT run, seq, round(16 * 1024 * 10 / greatest(value, 1e-12), 3) AS tokens_per_second, round(16 * 1024 * 10 / greatest(value, 1e-12) * 3, 3) AS bases_per_second FROM ev")
def j5(spark, sf):
    t = E.throughput(events(spark, sf).select("run", "seq", F.lit(10).alias("steps"), F.col("loss_nats_per_token").alias("seconds")), 16, 1024, 3)
    return t.select("run", "seq", F.round("tokens_per_second", 3).alias("tokens_per_second"), F.round("bases_per_second", 3).alias("bases_per_second"))
