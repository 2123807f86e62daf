"""Queries: names, cleaning, selection, joining up, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.operators import blocks as B
from strandworks.operators import corpus as C
from strandworks.plans.base import SPLIT, SRC, documents, sources, table, with_
from strandworks.sources import fasta

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NAME_SQL = """CASE doc_id % 4 WHEN 0 THEN source || '.dna.chromosome.' || doc_id || '.fa.gz' WHEN 1 THEN source || '.DNA.primary_assembly.' || lang || '.fa'
  WHEN 2 THEN source || '.dna.nonchromosomal.fa.gz' ELSE source || '_' || lang || '.fa' END"""


@query(
    "a2_sequence_key",
    f"""WITH n AS (SELECT doc_id, {_NAME_SQL} AS f FROM documents)
SELECT doc_id, f AS file_name, CASE WHEN regexp_extract(f, '(?i)\\.dna\\.chromosome\\.(.+?)\\.fa(\\.gz)?$', 1) <> '' THEN regexp_extract(f, '(?i)\\.dna\\.chromosome\\.(.+?)\\.fa(\\.gz)?$', 1)
  WHEN regexp_extract(f, '(?i)\\.dna\\.primary_assembly\\.(.+?)\\.fa(\\.gz)?$', 1) <> '' THEN regexp_extract(f, '(?i)\\.dna\\.primary_assembly\\.(.+?)\\.fa(\\.gz)?$', 1)
  WHEN regexp_matches(f, '(?i)\\.dna\\.nonchromosomal\\.') THEN 'nonchromosomal' ELSE regexp_replace(regexp_replace(f, '\\.gz$', ''), '\\.fa$', '') END AS sequence_key FROM n""",
)
def a2(spark, sf):
    names = table(spark, sf, "documents").select("doc_id", F.expr(_NAME_SQL).alias("file_name"))
    return names.withColumn("sequence_key", S.sequence_key(F.col("file_name")))


@query(
    "a3_fasta_records",
    """WITH d AS (SELECT doc_id, lang, string_split(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, 'doc' || doc_id AS header, upper(array_to_string(list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '')) AS sequence FROM d
UNION ALL SELECT doc_id, 'lang', upper(lang) FROM documents""",
)
def a3(spark, sf):
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    text = F.concat(F.lit("dropped\n>doc"), "doc_id", F.lit("\n"), ascii_text, F.lit("\n>lang\n"), "lang", F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", F.explode(S.fasta_records(text)).alias("r")).select("doc_id", "r.header", "r.sequence")


@query("a4_flat_blocks", """WITH d AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS b FROM documents)
SELECT doc_id, CAST(b AS BIGINT) AS block_id, CAST(b * 1000 AS BIGINT) AS start, text[b * 1000 + 1 : b * 1000 + 1000] AS seq FROM d""")
def a4(spark, sf):
    return fasta.blocks_of(table(spark, sf, "documents").select("doc_id", F.col("text").alias("seq")), 1000).select("doc_id", "block_id", "start", "seq")


_STATUS_SQL = """status AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'rebuilt' ELSE 'hit' END AS status FROM documents)"""


def _files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.concat_ws("/", "source", "doc_id").alias("path"), F.col("n_chars").alias("length"), F.lit("2020-01-01").alias("modificationTime"))


def _statuses(spark, sf):
    files = _files(spark, sf)
    before = files.filter("doc_id % 3 <> 0").withColumn("length", F.when(F.col("doc_id") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return fasta.cache_status(files, fasta.manifest_of(before, "ACGTN"), "ACGTN")


@query("a6_cache_status", f"WITH {_STATUS_SQL} SELECT doc_id, status FROM status")
def a6(spark, sf):
    return _statuses(spark, sf).select("doc_id", "status")


@query("a7_cache_totals", f"WITH {_STATUS_SQL} SELECT count(*) AS applicable, count(*) FILTER (status = 'hit') AS hit, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'rebuilt') AS rebuilt, CAST(0 AS BIGINT) AS disabled FROM status")
def a7(spark, sf):
    return fasta.status_totals(_statuses(spark, sf))


@query(
    "a8_token_cache",
    """SELECT doc_id, split, sha256('{"version":1,"species":"' || source || '","doc_id":' || doc_id || ',"split":"' || split || '"}') AS cache_key
FROM documents, (VALUES ('train'), ('val')) s(split) WHERE doc_id % 4 <> 0""",
)
def a8(spark, sf):
    wanted = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    key = fasta.token_cache_key([F.lit(1).alias("version"), F.col("source").alias("species"), F.col("doc_id"), F.col("split")])
    keyed = wanted.withColumn("cache_key", key)
    return keyed.join(keyed.filter("doc_id % 4 = 0").select("cache_key"), "cache_key", "left_anti").select("doc_id", "split", "cache_key")


@query("b2_clean", with_(SRC) + "SELECT doc_id, seq FROM src")
def b2(spark, sf):
    text = F.concat(F.lit(">doc"), "doc_id", F.lit("\n"), "text")
    return documents(spark, sf).select("doc_id", S.clean(text).alias("seq"))


@query(
    "b3_strict_clean",
    """WITH t AS (SELECT doc_id, strlen(text) + strlen('>doc' || doc_id) + 1 AS raw_bytes, strlen(replace(text, chr(10), '')) AS body, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS sequence FROM documents)
SELECT doc_id, sequence, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(body - length(sequence) AS BIGINT) AS removed_non_acgt, CAST(1 AS BIGINT) AS skipped_header_lines FROM t""",
)
def b3(spark, sf):
    text = F.concat(F.lit(">doc"), "doc_id", F.lit("\n"), "text")
    return documents(spark, sf).select("doc_id", S.strict_clean(text).alias("r")).select("doc_id", "r.*")


def _wanted(spark, sf):
    docs = documents(spark, sf)
    return docs.filter("species in ('src1', 'src2') and doc_id % 3 = 0").select("species", "sequence_key").union(docs.filter("species = 'src3'").select("species", F.concat(F.lit("x"), "sequence_key"))).distinct()


_WANTED = "wanted AS (SELECT DISTINCT species, CASE WHEN species = 'src3' THEN 'x' || sequence_key ELSE sequence_key END AS sequence_key FROM src WHERE species = 'src3' OR (species IN ('src1', 'src2') AND doc_id % 3 = 0))"


@query("b4_select_keys", with_(SRC, _WANTED) + "SELECT doc_id, species FROM src s WHERE species NOT IN (SELECT species FROM wanted) OR EXISTS (SELECT 1 FROM wanted w WHERE w.species = s.species AND w.sequence_key = s.sequence_key)")
def b4(spark, sf):
    return C.select_keys(sources(spark, sf), _wanted(spark, sf)).select("doc_id", "species")


@query("b5_unmatched_keys", with_(SRC, _WANTED) + "SELECT species, sequence_key FROM wanted ANTI JOIN (SELECT * FROM src WHERE length(seq) > 0) USING (species, sequence_key)")
def b5(spark, sf):
    return C.unmatched_keys(sources(spark, sf), _wanted(spark, sf))


@query("b6_non_empty", with_(SRC) + "SELECT species, count(*) AS n FROM src WHERE length(seq) > 0 GROUP BY species")
def b6(spark, sf):
    return C.non_empty(sources(spark, sf)).groupBy("species").agg(F.count("*").alias("n"))


@query("b7_prefix_sample", with_(SRC) + "SELECT doc_id, seq[1:500] AS seq FROM src")
def b7(spark, sf):
    return C.prefix_sample(sources(spark, sf), 500).select("doc_id", "seq")


@query("b8_pick_sample", with_(SRC) + "SELECT source_name, seq[1:3000] AS sample FROM src ORDER BY length(seq) >= 3000 DESC, CASE WHEN length(seq) >= 3000 THEN doc_id END, length(seq) DESC, doc_id LIMIT 1")
def b8(spark, sf):
    return C.pick_sample(sources(spark, sf), 3000, "doc_id")


@query("b9_slice_record", with_(SRC) + "SELECT doc_id, seq[101:350] AS seq FROM src")
def b9(spark, sf):
    return C.slice_record(sources(spark, sf), 101, 250).select("doc_id", "seq")


@query("c1_separate", with_(SRC) + "SELECT source_name, CAST(length(seq) AS BIGINT) AS size FROM src")
def c1(spark, sf):
    return C.separate(sources(spark, sf)).select("source_name", F.length("seq").cast("long").alias("size"))


@query("c2_concat", with_(SRC, "j AS (SELECT species, string_agg(seq, repeat('N', 6) ORDER BY doc_id) AS s FROM src GROUP BY species)") + "SELECT species, b AS block_id, b * 100000 AS start, sha256(s[b * 100000 + 1 : b * 100000 + 100000]) AS seq_sha256 FROM (SELECT species, s, unnest(range(0, CAST(ceil(length(s) / 100000.0) AS BIGINT))) AS b FROM j)")
def c2(spark, sf):
    """Species joined up, in blocks of the joined text."""
    src, gap = sources(spark, sf), C.boundary("ACGTN", 2, 3)
    starts = C.concat_offsets(src.select("source_name", "doc_id", "species", F.length("seq").alias("length")), len(gap), "doc_id")
    out = B.concatenated(src.select("species", "source_name", "seq"), starts.select("source_name", "start"), gap, 100_000)
    return out.select("species", "block_id", "start", F.sha2("seq", 256).alias("seq_sha256"))


@query("c2_concat_offsets", with_(SRC) + "SELECT doc_id, species, CAST(coalesce(sum(length(seq) + 6) OVER (PARTITION BY species ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM src")
def c2b(spark, sf):
    lengths = sources(spark, sf).select("doc_id", "species", F.length("seq").alias("length"))
    return C.concat_offsets(lengths, 6, "doc_id").select("doc_id", "species", "start")


@query("c3_cache_status", f"WITH {_STATUS_SQL} SELECT source, CASE max(CASE status WHEN 'hit' THEN 1 WHEN 'created' THEN 3 ELSE 4 END) WHEN 1 THEN 'hit' WHEN 3 THEN 'created' ELSE 'rebuilt' END AS status FROM status GROUP BY source")
def c3(spark, sf):
    return _statuses(spark, sf).groupBy("source").agg(C.cache_rank(F.col("status")).alias("status"))


@query("c4_alphabet", with_(SRC) + "SELECT species, string_agg(DISTINCT c, '' ORDER BY c) AS alphabet, count(DISTINCT c) AS alphabet_size FROM (SELECT species, unnest(string_split(seq, '')) AS c FROM src WHERE seq <> '') GROUP BY species")
def c4(spark, sf):
    return C.observed_alphabet(sources(spark, sf), "species")


@query("c4_joined_alphabet", with_(SRC) + "SELECT species, string_agg(DISTINCT c, '' ORDER BY c) AS alphabet, count(DISTINCT c) AS alphabet_size FROM (SELECT species, unnest(string_split(seq || '-R', '')) AS c FROM src) WHERE c <> '' GROUP BY species")
def c4b(spark, sf):
    """The letters of species whose sequences are joined with ``-R``."""
    return C.observed_alphabet(sources(spark, sf), "species", boundary="-R")


@query("c5_split", with_(SRC, SPLIT) + "SELECT doc_id, split, start, size FROM spl")
def c5(spark, sf):
    return C.split_table(sources(spark, sf)).select("doc_id", "split", "start", "size")


@query("c6_capped_split", with_(SRC, SPLIT) + "SELECT doc_id, split, start, CASE split WHEN 'train' THEN size ELSE least(size, 100) END AS size FROM spl")
def c6(spark, sf):
    return C.split_table(sources(spark, sf), caps={"train": 0, "val": 100, "test": 100}).select("doc_id", "split", "start", "size")


@query("c7_too_small", with_(SRC, SPLIT) + "SELECT source_name, min(size) AS least FROM spl GROUP BY source_name HAVING min(size) < 2")
def c7(spark, sf):
    return C.too_small(C.split_table(sources(spark, sf)))


@query("c8_split_summary", with_(SRC, SPLIT) + """SELECT species, source_name, 'flat_file' AS source_mode, CAST(max(doc_id) AS VARCHAR) AS keys, CAST(1 AS BIGINT) AS selected_sequence_count, CAST(sum(size) AS BIGINT) AS total_size, max(start) FILTER (split = 'train') AS train_start, max(size) FILTER (split = 'train') AS train_size, max(start) FILTER (split = 'val') AS val_start, max(size) FILTER (split = 'val') AS val_size,
max(start) FILTER (split = 'test') AS test_start, max(size) FILTER (split = 'test') AS test_size FROM spl GROUP BY species, source_name""")
def c8(spark, sf):
    src = sources(spark, sf).withColumns({"source_mode": F.lit("flat_file"), "sequence_keys": F.array("sequence_key")})
    return C.split_summary(C.split_table(src)).select("species", "source_name", "source_mode", F.array_join("sequence_keys", ",").alias("keys"), "selected_sequence_count", "total_size", *(f"{s}_{c}" for s in C.SPLITS for c in ("start", "size")))


@query("c9_dataset_totals", with_(SRC, SPLIT) + "SELECT count(DISTINCT species) AS species_count, (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(seq, '')) AS c FROM src) WHERE c <> '') AS alphabet_size, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(size) FILTER (split = 'train') AS BIGINT) AS train_bytes, CAST(sum(size) FILTER (split = 'val') AS BIGINT) AS val_bytes, CAST(sum(size) FILTER (split = 'test') AS BIGINT) AS test_bytes FROM spl")
def c9(spark, sf):
    return C.dataset_totals(C.split_table(sources(spark, sf)))


@query("c10_weights", with_(SRC) + "SELECT source_name, CAST(length(seq) - 127 AS BIGINT) AS available, round(sqrt(length(seq) - 127), 6) AS weight FROM src WHERE length(seq) >= 128")
def c10(spark, sf):
    out = C.sampling_weights(C.window_starts_available(sources(spark, sf), 128, keep_short=False), "sqrt")
    return out.select("source_name", "available", F.round("weight", 6).alias("weight"))


#: ``operators.corpus.drawn``.
def _drawn(seed, tag, index):
    return f"CAST('0x' || substr(md5('{seed}:{tag}:' || {index}), 1, 13) AS BIGINT)"


def _draws(av):
    """SQL of weighted draws over (source_name, available), as many as there are documents."""
    return (
        f"wt AS (SELECT *, sum(available) OVER (ORDER BY substr(md5(source_name), 1, 2), source_name) AS upto, sum(available) OVER () AS total FROM {av})",
        f"dr AS (SELECT id, {_drawn(7, 'source', 'id')} / 4503599627370496.0 AS u, {_drawn(7, 'start', 'id')} / 4503599627370496.0 AS v FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS id))",
        "pk AS (SELECT id AS sample_index, source_name, CAST(floor(v * available) AS BIGINT) AS start FROM dr JOIN wt ON u >= CAST(upto - available AS DOUBLE) / CAST(total AS DOUBLE) AND u < CAST(upto AS DOUBLE) / CAST(total AS DOUBLE))",
    )


@query("c10_sample_windows", with_(SRC, "av AS (SELECT species AS source_name, sum(length(seq) - 127) AS available FROM src WHERE length(seq) >= 128 GROUP BY species)", *_draws("av")) + "SELECT * FROM pk")
def c10b(spark, sf):
    """As many seeded draws as there are documents, over per-species weights."""
    per = C.window_starts_available(sources(spark, sf), 128, keep_short=False).groupBy(F.col("species").alias("source_name")).agg(F.sum("available").alias("available"))
    n = table(spark, sf, "documents").count()
    return C.sample_windows(C.sampling_weights(per, "proportional"), n, 7, "source_name")


@query("c11_available_starts", with_(SRC) + "SELECT source_name, CAST(greatest(length(seq) - 127, 1) AS BIGINT) AS available FROM src")
def c11(spark, sf):
    return C.window_starts_available(sources(spark, sf), 128, keep_short=True).select("source_name", "available")


@query("c10_window_sequences", with_(SRC, "av AS (SELECT source_name, length(seq) - 127 AS available FROM src WHERE length(seq) >= 128)", *_draws("av")) + "SELECT sample_index, source_name, start, seq[start + 1 : start + 128] AS seq FROM pk JOIN src USING (source_name)")
def c10c(spark, sf):
    """Draws over single sources, and the windows that they stand for, fetched from blocks of 100 characters."""
    src = sources(spark, sf)
    picks = C.sample_windows(C.sampling_weights(C.window_starts_available(src, 128, keep_short=False).select("source_name", "available"), "proportional"), table(spark, sf, "documents").count(), 7, "source_name")
    return B.fetched(fasta.blocks_of(src.select("source_name", "seq"), 100), picks, 128, 100)


@query("c12_shuffled_split", f"SELECT doc_id, source AS species, rank, CASE WHEN rank >= n - least(CAST(floor(n * 0.1) AS BIGINT), n - 1) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {_drawn(11, 'order', 'doc_id')}, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)")
def c12(spark, sf):
    return C.shuffled_split(documents(spark, sf).select("doc_id", "species"), 11, 0.1, "doc_id")


@query("c13_samples_per_pass", with_(SRC, SPLIT) + """, per AS (SELECT species, sum(size) AS size, ceil(sum(size) / 1024.0) AS n FROM spl WHERE split = 'train' GROUP BY species)
SELECT coalesce(species, 'TOTAL') AS species, CAST(sum(size) AS BIGINT) AS train_bytes, CAST(sum(n) AS BIGINT) AS samples FROM per GROUP BY ROLLUP (species)""")
def c13(spark, sf):
    return C.samples_per_pass(C.split_table(sources(spark, sf)).filter("split = 'train'"), 1024)


@query("h6_intersect", with_(SRC, SPLIT) + """, pieces AS (SELECT source_name, split, size, seq, start, unnest(range(start // 1000, (start + size - 1) // 1000 + 1)) AS block_id FROM spl WHERE size > 0)
SELECT source_name, split, CAST(block_id AS BIGINT) AS block_id, CAST(greatest(block_id * 1000, start) - start AS BIGINT) AS start, seq[greatest(block_id * 1000, start) - start + 1 : least(block_id * 1000 + 1000, start + size) - start] AS seq FROM pieces""")
def h6(spark, sf):
    src = sources(spark, sf).select("source_name", "seq")
    ranges = C.split_table(src).select("source_name", "split", "start", "size")
    return C.intersect_ranges(fasta.blocks_of(src, 1000), ranges, 1000)
