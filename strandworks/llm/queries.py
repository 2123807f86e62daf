"""The queries that apply this subpackage's operators to the given tables, and their SQL."""

from __future__ import annotations

from strandworks.llm import decontam, jaccard, licenses, linecrf, linededup, packing, periodic, phrases, quality, secrets, substrings, suffixdedup, warc
from strandworks.llm.common import narrow, table


def op4_line_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), c AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE t <> ''),
w AS (
  SELECT doc_id, p, a || chr(10) || b || chr(10) || d AS g
  FROM (SELECT doc_id, p, t AS a, lead(t, 1) OVER x AS b, lead(t, 2) OVER x AS d FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY p))
  WHERE d IS NOT NULL
), r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r)),
gl AS (SELECT doc_id, i FROM gone JOIN c USING (doc_id, p)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gl USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gl GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_suffix_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    out = suffixdedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as hexadecimal digits, two for each.
OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + 200]) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
s AS (SELECT doc_id, i, sum(CASE WHEN i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i) AS last FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(CASE WHEN a > before THEN h[2 * before + 1 : 2 * a] ELSE '' END, '' ORDER BY a) || h[2 * max(b) + 1 :] AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id, h)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op6_quality_rules(spark, sf_dir):
    return quality.score(narrow(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}))
_LIMITS = {r.name: r for r in quality.RULES}

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {_LIMITS["word_length"].least} AND {_LIMITS["word_length"].most}
       AND n_symbols / n_words <= {_LIMITS["symbols"].most} AND n_stop_words / n_words >= {_LIMITS["stop_words"].least}
       AND n_dup_lines / n_lines <= {_LIMITS["line_repeats"].most} AND n_bullets / n_lines <= {_LIMITS["bullet_lines"].most}
       AND n_ellipsis / n_lines <= {_LIMITS["ellipsis_lines"].most} AS kept
FROM b
"""

def op7_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc_convert(spark, sf_dir):
    return warc.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

def op1_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_curve_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_OP3_WORDS = "string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, list_filter({_OP3_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_OP3_WORDS}, lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), hits AS (
  SELECT doc_id, i, n, item
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)) JOIN bw USING (n, g)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

def op10_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op11_line_crf(spark, sf_dir):
    return linecrf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), g AS (
  SELECT lang, k, w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] END AS w2, CASE WHEN k > 2 THEN w[i + 2] END AS w3
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, concat_ws(' ', w1, w2, w3) AS phrase, w1, w2, w3, count(*) AS n FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (
  SELECT lang, k, phrase, n AS a, 1 AS cut, w1 AS p, CASE k WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS s FROM f WHERE k > 1 AND n >= 10
  UNION ALL SELECT lang, k, phrase, n, 2, w1 || ' ' || w2, w3 FROM f WHERE k = 3 AND n >= 10
), h AS (SELECT lang, phrase, n FROM f WHERE n >= 10),
c AS (
  SELECT q.*, u.n AS l, v.n AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(u.n AS HUGEINT) * v.n) AS score
  FROM q JOIN h u ON u.lang = q.lang AND u.phrase = q.p JOIN h v ON v.lang = q.lang AND v.phrase = q.s
), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM c) WHERE o = 1),
x AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, n FROM f WHERE k = 3 AND n >= 10 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM f WHERE k = 3 AND n >= 10
), e AS (SELECT lang, phrase, max(n) AS longer FROM x GROUP BY lang, phrase),
d AS (
  SELECT m.* FROM m LEFT JOIN e ON e.lang = m.lang AND e.phrase = m.phrase AND m.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a
), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b JOIN tot USING (lang) WHERE rank <= 2000
"""


def op13_periodic_runs(spark, sf_dir):
    out = periodic.periodic_runs(table(spark, sf_dir, "documents"), planted=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


#: The checksum of a decimal id, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: c <> ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AS planted, h // 10 AS g
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32} AS h FROM documents)
), p AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d WHERE n > 0),
x AS (
  SELECT doc_id, n, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), e AS (SELECT u.doc_id, v.i - u.i AS q, u.i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (
  SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (SELECT *, e - s AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.s <= s.s AND t.e >= s.e)),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
b AS (
  SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r t WHERE t.doc_id = r.doc_id AND (t.n * r.q > r.n * t.q OR (t.n * r.q = r.n * t.q AND (t.s < r.s OR (t.s = r.s AND t.q < r.q)))))
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.e) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_curve_packing": op2_curve_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc_convert": op8_warc_convert,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_line_crf": op11_line_crf,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {
    "op3_decontaminate": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_warc_convert": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_collocations": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
