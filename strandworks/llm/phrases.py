"""Phrase collocations of each language by weighted automata.

A text is lower-cased (A-Z), cut to pieces at ``[.,;:!?\\n\\x0B\\f\\r]`` and these to words at spaces and tabs. Every word with the
two behind it in its piece is an n-gram, so ``f`` of a phrase of up to three words is the sum over all n-grams that begin with it.

1. Shards: a task counts the n-grams of ``SHARD_WORDS`` words at a time, sorts them and builds count transducers
   from the sorted order, one for each range of n-grams that it touches (``automata``).
2. Union: all transducers of a range meet, are united one after another and summed; sums over prefix ranges give each phrase's ``f``.
   A prefix may go over a range's edge: the two first and two last of each range go out as rows and are summed by
   Spark. What is left is a transducer of the range's phrases of ``least`` occurrences or more.
3. Parts: each range sends an acceptor of the parts that its candidates are cut to, each part once, to the ranges they lie in; there
   it is composed with the range's transducer, and goes back with weights.
4. Scores by exact integers; two-word candidates that a longer one covers go by an anti-join; the best of each language by two windows.

Ranges are cut at n-grams, not at words, by splitters from a bounded sample of documents; they decide on balance alone. A word
that a third of all text consists of is one entry for each shard, and its n-grams spread over many ranges. To the driver go the
sample (at most ``SAMPLE_EACH`` n-grams of some 4 documents for each range) and four edge prefixes for each range and language at most.

Defined results: null and empty texts have no words; a null language is ``und``, as is the language of that name; repeated rows count
each time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.llm.automata import Automaton, _packed, ranked, summed, united
from strandworks.llm.common import LOWER, groups_of, materialise, partitions, parted, session_conf, utf8, words_of

#: Words that a task counts at a time, and bytes of text that it cuts to words at a time.
SHARD_WORDS, GROUP_BYTES = 1_500_000, 1 << 20
#: N-grams of each sampled document.
SAMPLE_EACH = 32
#: Automata that are handed to Python at a time.
BATCH_ROWS = "64"
LEAST, COVER, TOP, SCALE = 10, 50, 2_000, 1_000_000

_WORD = np.ones(256, bool)
_WORD[list(b" \t.,;:!?\n\x0b\x0c\r")] = False
_CUT = np.zeros(256, np.int64)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = 1

Splitters = list[tuple[str, bytes, bytes, bytes]]


# --- n-grams of texts ----------------------------------------------------------------------------


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, whether a piece ends behind each, and each one's text."""
    data, offsets = parted(LOWER[data], offsets, 0x0A)
    a, b = words_of(data, _WORD)
    words = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)), pa.py_buffer(data[_WORD[data]])])
    cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
    ends = np.ones(len(a), bool)
    ends[:-1] = cuts[a[1:]] > cuts[b[:-1]]
    return words, ends, np.searchsorted(offsets, a, "right") - 1


def _ngrams(words: pa.Array, ends: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """Vocabulary, and a row of three labels for each of the first n words."""
    label, vocabulary = ranked(words)
    label, ends = np.append(label, [0, 0]), np.append(ends, [True, True])
    go1 = ~ends[:n]
    go2 = go1 & ~ends[1 : n + 1]
    return vocabulary, np.stack([label[:n], np.where(go1, label[1 : n + 1], 0), np.where(go2, label[2 : n + 2], 0)], axis=1)


def _cuts(vocabulary: pa.Array, w: np.ndarray, marks: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """Where sorted rows of labels are cut by sorted marks: the first row that is no less than each."""
    words, rows = vocabulary.to_pylist(), []
    for mark in marks:
        row = [0, 0, 0]
        for k, word in enumerate(mark):
            if not word:
                break
            at = bisect_left(words, word)
            row[k] = at + 1
            if at == len(words) or words[at] != word:
                break
        rows.append(row)
    if not rows:
        return np.zeros(0, np.int64)
    key = _packed(np.concatenate([w, np.array(rows, np.int64)]))
    return np.searchsorted(key[: len(w)], key[len(w) :])


def _dealt(lang: str, vocabulary: pa.Array, w: np.ndarray, weights: np.ndarray, splitters: Splitters) -> Iterator[tuple[int, Automaton]]:
    """The automaton of each range that sorted entries touch."""
    base = bisect_left(splitters, (lang, b"", b"", b""))
    marks = [s[1:] for s in splitters[base : bisect_left(splitters, (lang + "\0", b"", b"", b""))]]
    at = [0, *_cuts(vocabulary, w, marks).tolist(), len(w)]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        if b > a:
            yield base + k, Automaton.of(vocabulary, w[a:b], weights[a:b])


def sampled_splitters(texts: DataFrame, n: int) -> Splitters:
    """At most n - 1 n-grams that cut those of all texts to ranges of about one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            langs = batch.column(0).to_pylist()
            for lo, hi in groups_of(offsets, GROUP_BYTES):
                words, ends, text = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                vocabulary, w = _ngrams(words, ends, len(words))
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                at = np.concatenate([np.unique(np.linspace(a, b - 1, min(SAMPLE_EACH, b - a)).astype(np.int64)) for a, b in zip(edge, edge[1:])] or [edge[:0]])
                w, known = w[at], [b"", *vocabulary.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo + t] for t in text[at].tolist()], pa.string()), *(pa.array([known[i] for i in w[:, k].tolist()], pa.binary()) for k in range(3))], ["lang", "a", "b", "c"])

    rows = texts.count()
    if n < 2 or not rows:
        return []
    few = texts.sample(min(1.0, max(2_000, 4 * n) / rows), seed=1)
    found = sorted({(r[0], *map(bytes, r[1:])) for r in few.mapInArrow(run, "lang string, a binary, b binary, c binary").distinct().collect()})
    return sorted({found[len(found) * k // n] for k in range(1, n)}) if found else []


def shard_automata(texts: DataFrame, splitters: Splitters) -> DataFrame:
    """``lang, part, counts``: the transducers of each shard of each task."""

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            words, ends = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for i in range(0, len(words), SHARD_WORDS):
                n = min(SHARD_WORDS, len(words) - i)
                vocabulary, w = _ngrams(words[i : i + n + 2], ends[i : i + n + 2], n)
                w, c = summed(w, np.ones(n, np.int64))
                rows = [(k, a.dumps()) for k, a in _dealt(lang, vocabulary, w, c, splitters)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["lang", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for lo, hi in groups_of(offsets, GROUP_BYTES):
                words, ends, text = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                of = code[lo:hi][text]
                for k in np.unique(of).tolist():
                    own = of == k
                    held.setdefault(names[k], []).append((words.filter(pa.array(own)), ends[own]))
                size += len(words)
                if size >= SHARD_WORDS:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return texts.mapInArrow(run, "lang string, part int, counts binary")


# --- ranges --------------------------------------------------------------------------------------


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[dict]]]:
    """Rows that came sorted by language and range, group by group."""
    rows = (r for batch in batches for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist())
    return groupby(rows, key=lambda r: (r["lang"], r["part"]))


def _meet(df: DataFrame, n: int, *order: str) -> DataFrame:
    """One range to a task: ranges are of about one size, so their numbers, not hashes of them, deal them out."""
    return df.repartitionById(n, F.col("part")).sortWithinPartitions("lang", "part", *order)


def _group_sums(w: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the first k labels, and the sums over rows that share them, of rows that have k labels."""
    has = w[:, k - 1] > 0
    w, weights = w[has], weights[has]
    head = np.flatnonzero(np.append(True, (w[1:, :k] != w[:-1, :k]).any(1))) if len(w) else np.zeros(0, np.int64)
    out = np.zeros((len(head), 3), np.int64)
    out[:, :k] = w[head, :k]
    return out, np.add.reduceat(weights, head) if len(w) else weights


def range_counts(shards: DataFrame, n: int, least: int) -> DataFrame:
    """``lang, part, n_words, counts, edges`` of each range: its phrases' transducer, and the sums of prefixes at its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part), rows in _groups(batches):
            vocabulary, w, c = united(Automaton.loads(r["counts"]) for r in rows)
            known, found, edges = [b"", *vocabulary.to_pylist()], [], []
            for k in (1, 2):
                p, f = _group_sums(w, c, k)
                at = sorted({0, len(p) - 1}) if len(p) else []
                edges += [{"a": known[p[i, 0]], "b": known[p[i, 1]], "n": int(f[i])} for i in at]
                inner = np.ones(len(p), bool)
                inner[at] = False
                found.append((p[inner & (f >= least)], f[inner & (f >= least)]))
            keep = (w[:, 2] > 0) & (c >= least)
            found.append((w[keep], c[keep]))
            phrases = Automaton.of(vocabulary, *summed(np.concatenate([p for p, _ in found]), np.concatenate([f for _, f in found])))
            yield pa.RecordBatch.from_pylist([{"lang": lang, "part": part, "n_words": int(c.sum()), "counts": phrases.dumps(), "edges": edges}], schema)

    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n_words", pa.int64()), ("counts", pa.binary()), ("edges", pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])))])
    return _meet(shards, n).mapInArrow(run, "lang string, part int, n_words long, counts binary, edges array<struct<a:binary,b:binary,n:long>>")


def _automaton(rows: list[tuple[bytes, bytes, int]]) -> Automaton:
    """Of a few phrases of up to two words."""
    label, vocabulary = ranked(pa.array([x for r in rows for x in r[:2] if x], pa.large_binary()))
    w = np.zeros((len(rows), 3), np.int64)
    w[:, :2][np.array([[bool(r[0]), bool(r[1])] for r in rows], bool).reshape(-1, 2)] = label
    return Automaton.of(vocabulary, *summed(w, np.array([r[2] for r in rows], np.int64)))


class Edges:
    """Prefixes that lie over ranges' edges, with their whole sums: by language, and by the range that scores them."""

    def __init__(self, ranges: DataFrame, least: int):
        e = ranges.select("lang", "part", F.explode("edges").alias("e")).groupBy("lang", "e.a", "e.b").agg(F.sum("e.n").alias("n"), F.min("part").alias("home"))
        self.of: dict[str, list] = {}
        self.at: dict[tuple[str, int], list] = {}
        # four for each range and language at most, which bounds what comes here
        for r in e.filter(F.col("n") >= least).collect():
            row = (bytes(r["a"]), bytes(r["b"]), r["n"])
            self.of.setdefault(r["lang"], []).append(row)
            if row[1]:
                self.at.setdefault((r["lang"], r["home"]), []).append(row)

    def candidates(self, lang: str, part: int, counts: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Vocabulary, rows and counts of a range's phrases of two and three words."""
        vocabulary, w, f = united([Automaton.loads(counts), _automaton(self.at.get((lang, part), []))])
        long = w[:, 1] > 0
        return vocabulary, w[long], f[long]


def _parts(w: np.ndarray) -> np.ndarray:
    """For each candidate its parts: first word, rest, all but the last, last word. Of two words the last two are the first two again."""
    three = w[:, 2] > 0
    out = np.zeros((4, len(w), 3), np.int64)
    out[0, :, 0] = w[:, 0]
    out[1, :, 0], out[1, :, 1] = w[:, 1], w[:, 2]
    out[2, :, 0], out[2, :, 1] = w[:, 0], np.where(three, w[:, 1], 0)
    out[3, :, 0] = np.where(three, w[:, 2], w[:, 1])
    return out


def _weights(a: Automaton, vocabulary: pa.Array, w: np.ndarray) -> np.ndarray:
    """Rows of another vocabulary's labels, composed with an automaton."""
    to = np.concatenate([[0], a.labels_of(vocabulary.cast(pa.large_binary()))])
    return a.composed(to[w])


def part_requests(ranges: DataFrame, edges: Edges, splitters: Splitters) -> DataFrame:
    """``lang, part, origin, counts``: acceptors of the parts that range ``origin`` asks range ``part`` for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part), rows in _groups(batches):
            vocabulary, w, _ = edges.candidates(lang, part, next(rows)["counts"])
            asked, times = summed(_parts(w).reshape(-1, 3), np.ones(4 * len(w), np.int64))
            new = _weights(_automaton(edges.of.get(lang, [])), vocabulary, asked) == 0
            out = [(k, a.dumps()) for k, a in _dealt(lang, vocabulary, asked[new], times[new], splitters)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([k for k, _ in out], pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], ["lang", "part", "origin", "counts"])

    return ranges.select("lang", "part", "counts").mapInArrow(run, "lang string, part int, origin int, counts binary")


def answered(ranges: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """``lang, part, origin, counts``: each acceptor with the weights of range ``origin``, back at the range that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part), rows in _groups(batches):
            own = None
            for r in rows:
                a = Automaton.loads(r["counts"])
                if own is None:
                    own = a
                    continue
                w, _ = a.entries()
                f = _weights(own, a.vocabulary, w)
                if not f.all():
                    raise ValueError(f"{int((f == 0).sum())} parts of candidates are in no range")
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([r["origin"]], pa.int32()), pa.array([part], pa.int32()), pa.array([Automaton.of(a.vocabulary, w, f).dumps()], pa.binary())], ["lang", "part", "origin", "counts"])

    both = ranges.select("lang", "part", F.lit(-1).alias("origin"), "counts").unionByName(requests)
    return _meet(both, n, "origin").mapInArrow(run, "lang string, part int, origin int, counts binary")


def _ratio(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """floor(SCALE * a * a / (l * r)), whatever the size of the products."""
    if len(a) and (int(a.max()) ** 2 * SCALE >= 1 << 63 or int(l.max()) * int(r.max()) >= 1 << 63):
        a, l, r = (x.astype(object) for x in (a, l, r))
    return (SCALE * a * a // (l * r)).astype(np.int64)


def scored(ranges: DataFrame, answers: DataFrame, edges: Edges, n: int) -> DataFrame:
    """``lang, phrase, a, l, r, score, covered`` of all candidates; ``covered`` are the shorter ones that one covers."""
    names = ["lang", "phrase", "a", "l", "r", "score", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part), rows in _groups(batches):
            vocabulary, w, a = edges.candidates(lang, part, next(rows)["counts"])
            parts = united([_automaton(edges.of.get(lang, [])), *(Automaton.loads(r["counts"]) for r in rows)])
            f = _weights(Automaton.of(*parts), vocabulary, _parts(w).reshape(-1, 3)).reshape(4, -1)
            three = w[:, 2] > 0
            one, two = _ratio(a, f[0], f[1]), _ratio(a, f[2], f[3])
            first = one <= two
            l, r, score = np.where(first, f[0], f[2]), np.where(first, f[1], f[3]), np.minimum(one, two)
            known = [b"", *vocabulary.to_pylist()]
            spell = lambda rows: [b" ".join(known[i] for i in row if i).decode() for row in rows.tolist()]
            head, tail = three & (100 * a >= COVER * f[2]), three & (100 * a >= COVER * f[1])
            for i in range(0, len(w), 1 << 15):
                s = slice(i, i + (1 << 15))
                heads, tails = spell(w[s, :2]), spell(w[s, 1:])
                covered = [[x for x, y in ((p, u), (q, v)) if y] for p, u, q, v in zip(heads, head[s].tolist(), tails, tail[s].tolist())]
                cols = [pa.array([lang] * len(heads)), pa.array(spell(w[s])), *(pa.array(x[s]) for x in (a, l, r, score)), pa.array(covered, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    both = ranges.select("lang", "part", F.lit(-1).alias("origin"), "counts").unionByName(answers)
    return _meet(both, n, "origin").mapInArrow(run, "lang string, phrase string, a long, l long, r long, score long, covered array<string>")


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All candidates (``scored``), written, and ``lang, n``."""
    spark = docs.sparkSession
    texts, n = _texts(docs, text_col, lang_col), partitions(spark)
    splitters = sampled_splitters(texts, n)
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}):
        ranges = materialise(range_counts(shard_automata(texts, splitters), n, least), "phrase-ranges")
        edges = Edges(ranges, least)
        answers = answered(ranges, part_requests(ranges, edges, splitters), n)
        out = materialise(scored(ranges, answers, edges, n), "phrases")
    return out, ranges.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases that no longer one covers."""
    found, totals = candidates(docs, text_col, lang_col, least)
    covered = found.select("lang", F.explode("covered").alias("phrase")).distinct()
    left = found.drop("covered").join(covered, ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of 32 shares of each language first, so that no task ranks a whole language
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    few = left.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
