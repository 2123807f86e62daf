"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is
``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. A document
word inside any occurrence of a window is hit.

Both sides are fingerprinted alike: of every ``WINDOW - K + 1`` consecutive k-gram hashes the
least is kept, so any shared span of ``WINDOW`` words or more shares a fingerprint. Documents are
joined to the fingerprints of the test items, and each match is extended: the windows that lie
around it are looked up by a hash and then compared word by word with the items' (by word keys, see
``common.word_keys``). Items shorter than a window have no such guarantee; their whole word sequence is
looked up at every place of its length.

The test side is cut into blocks of at most ``BLOCK_BYTES`` of text (that is the size bound of what is
broadcast), whose index is a few flat arrays. An item longer than a block is cut into overlapping
pieces. With several blocks the driver builds, broadcasts, applies and drops one at a time, so its memory
doesn't grow with the benchmark; documents are read once per block, each block's finds are written, and
results are merged by one aggregation. Nothing is shuffled for one block.

Defined results: null texts have no words and are never contaminated; an item without words
matches nothing; items of equal text count one by one; a null item id is named "null", and rows of one item id
are one item; repeated document rows are each judged by themselves; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import LOWER, PLAIN_WORD, U64, folded, groups_of, keyed, materialise, mix, narrow, parted, utf8, word_keys, words_of

WINDOW = 13
K = 5
#: Bytes of benchmark text in one broadcast block; a block takes about ten times as much in a worker.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
_M = [int(x) | 1 for x in mix(np.arange(1, 200, dtype=U64))]


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(seed))
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * U64(_M[j])
        return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def fingerprint_places(g: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the least of some w consecutive ones (all of them on ties)."""
    if len(g) < w:
        return np.flatnonzero(g == g.min()) if len(g) else np.zeros(0, np.int64)
    least = window_min(g, w)
    # place j is kept if g[j] equals the least of one of the windows that hold it: the largest such least
    most = ~window_min(~np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)]), w)
    return np.flatnonzero(g == most)


class Words:
    """The words of a chunk of texts: keys, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text, off = parted(data, offsets)
        text = LOWER[text]
        starts, ends = words_of(text, PLAIN_WORD)
        self.lo, self.hi = word_keys(text, starts, ends)
        self.h = folded(self.lo, self.hi)
        self.first = np.searchsorted(starts, off)


class Windows:
    """The distinct windows of one length, by hash: a place where each occurs, and the set of items that have it."""

    def __init__(self, words: Words, at: np.ndarray, item: np.ndarray, n: int):
        self.n = n
        seed = 0
        while True:  # another hash in the case, never seen, that two windows share one
            h = gram_at(words.h, at, n, seed)
            o = np.lexsort((item, h))
            new = np.concatenate([[True], h[o][1:] != h[o][:-1]]) if len(o) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            self.seed, self.h, self.place = seed, h[o][new], at[o][new]
            if not len(o) or equal_words(words, at[o], words, self.place[group], n).all():
                break
            seed += 1
        # items of each window once; windows of the same items share one set
        keep = new | np.concatenate([[False], item[o][1:] != item[o][:-1]]) if len(o) else new
        owners, cut = item[o][keep], np.append(np.flatnonzero(new[keep]), keep.sum())
        sets: dict[bytes, int] = {}
        self.owner_set = np.array([sets.setdefault(owners[a:b].tobytes(), len(sets)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.int64)
        self.owners = [np.frombuffer(x, item.dtype) for x in sets]


def gram_at(h: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of the n words from each place."""
    out = np.full(len(at), U64(seed))
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[at + j] * U64(_M[j])
        return mix(out)


def equal_words(a: Words, at: np.ndarray, b: Words, bt: np.ndarray, n: int) -> np.ndarray:
    same = np.ones(len(at), bool)
    for j in range(n):
        same &= (a.lo[at + j] == b.lo[bt + j]) & (a.hi[at + j] == b.hi[bt + j])
    return same


class Block:
    """Items, indexed for lookup in a task: flat arrays of fingerprints and windows."""

    def __init__(self, names: list[str], texts: list[bytes], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        number: dict[str, int] = {}
        item = np.array([number.setdefault(x, len(number)) for x in names], np.int32)
        self.names = list(number)
        sizes = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        self.words = w = Words(np.frombuffer(b"".join(texts), np.uint8), sizes)
        count = np.diff(w.first)
        self.prints = np.zeros(0, U64)
        self.by_length: dict[int, Windows] = {}
        for n in sorted({min(window, c) for c in count.tolist() if c}):
            mine = np.flatnonzero(np.minimum(count, window) == n)
            each = count[mine] - n + 1
            at = np.repeat(w.first[:-1][mine], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            self.by_length[n] = Windows(w, at, np.repeat(item[mine], each), n)
            if n == window:
                g = grams(w.h, k)
                kept = [a + fingerprint_places(g[a : b - k + 1], window - k + 1) for a, b in zip(w.first[:-1][mine].tolist(), w.first[1:][mine].tolist(), strict=True)]
                self.prints = np.unique(g[np.concatenate(kept)])


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of ``values`` that are in the sorted ``table``; a 64 Ki bitmap spares most searches."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[(table >> U64(44)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(values >> U64(44)).astype(np.int64)])
    found = np.searchsorted(table, values[at])
    found[found == len(table)] = 0
    return at[table[found] == values[at]]


def hits_of_chunk(data: np.ndarray, offsets: np.ndarray, block: Block):
    """Per text: number of words, and (starts, ends, item names) of the occurrences of windows."""
    words = Words(data, offsets)
    first, w, k = words.first, block.window, block.k
    found: dict[int, list] = {}
    items: dict[int, list] = {}
    for n, windows in block.by_length.items():
        if not len(windows.h):
            continue
        if n == w:
            # fingerprints of the document side: those of the chunk as a whole hold those of every text in it,
            # as each window that counts lies inside one text
            g = grams(words.h, k)
            if len(g) < w - k + 1:
                continue
            kept = fingerprint_places(g, w - k + 1)
            at = kept[within(g[kept], block.prints)]
            at = np.unique((at[:, None] - np.arange(w - k + 1)[None, :]).ravel())
            at = at[(at >= 0) & (at + n <= len(words.h))]
            at = at[within(gram_at(words.h, at, n, windows.seed), windows.h)]
        else:
            at = within(grams(words.h, n, windows.seed), windows.h)
        owner = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[owner + 1]
        at, owner = at[inside], owner[inside]
        which = np.searchsorted(windows.h, gram_at(words.h, at, n, windows.seed))
        same = equal_words(words, at, block.words, windows.place[which], n)
        at, owner, which = at[same], owner[same], which[same]
        for d in np.unique(owner).tolist():
            m = owner == d
            a, b = found.setdefault(d, [[], []])
            a += (at[m] - first[d]).tolist()
            b += (at[m] - first[d] + n).tolist()
            items.setdefault(d, []).extend(windows.owners[x] for x in np.unique(windows.owner_set[which[m]]).tolist())
    named = {d: (*x, [block.names[i] for i in np.unique(np.concatenate(items[d])).tolist()]) for d, x in found.items()}
    return np.diff(first), named


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int, window: int = WINDOW) -> Iterator[tuple[list[str], list[bytes]]]:
    """Names and texts in blocks of bounded size; a longer text in pieces that have all its windows."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    names, texts, size = [], [], 0
    for name, text in rows.toLocalIterator():
        data = text.encode()
        pieces = [data]
        if len(data) > most_bytes:
            starts, ends = words_of(LOWER[np.frombuffer(data, np.uint8)], PLAIN_WORD)
            pieces, i = [], 0
            while i < len(starts):
                j = max(int(np.searchsorted(ends, starts[i] + most_bytes, "right")), min(i + window, len(starts)))
                pieces.append(data[starts[i] : ends[j - 1]])
                i = len(starts) if j == len(starts) else max(i + 1, j - window + 1)
        for piece in pieces:
            names.append(name)
            texts.append(piece)
            size += len(piece)
            if size >= most_bytes:
                yield names, texts
                names, texts, size = [], [], 0
    if names or size == 0:
        yield names, texts


FOUND = {"n_words": T.LongType(), "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.StringType())}


def scan(docs: DataFrame, shared) -> DataFrame:
    """Each row of ``docs`` (text first, other columns pass through) against one broadcast block."""
    schema = T.StructType([*(T.StructField(n, t) for n, t in FOUND.items()), *docs.schema.fields[1:]])
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            counts, spans = [np.zeros(0, np.int64)], {}
            for a, b in groups_of(off, CHUNK):
                n, found = hits_of_chunk(data[off[a] : off[b]], off[a : b + 1] - off[a], shared.value)
                counts.append(n)
                spans |= {a + d: x for d, x in found.items()}
            empty = ([], [], [])
            lists = [[spans.get(i, empty)[c] for i in range(len(batch))] for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(counts), kinds[0]), *(pa.array(x, t) for x, t in zip(lists, kinds[1:], strict=True)), *batch.columns[1:]], names)

    return docs.mapInArrow(run, schema)


def scanned(docs: DataFrame, keys: list[str], benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` (text and others) with what each block found.

    For one block the other columns pass through; for several, finds are merged by ``keys``, which must be unique.
    """
    sc = docs.sparkSession.sparkContext
    parts = blocks(benchmark, item_col, item_text_col, block_bytes, window)
    held, following = next(parts), next(parts, None)
    if following is None:
        return scan(docs, sc.broadcast(Block(*held, window, k)))
    written = []
    while held is not None:
        shared = sc.broadcast(Block(*held, window, k))
        written.append(materialise(scan(docs.select("text", *keys), shared), "block-finds"))
        shared.destroy()
        held, following = following, next(parts, None)
    found = written[0]
    for other in written[1:]:
        found = found.unionByName(other.filter(F.size("starts") > 0))
    return found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))


def judged(found: DataFrame) -> DataFrame:
    """The figures of each document, from the spans and items found in it; other columns stay."""
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    items = F.array_sort(F.array_distinct("items"))
    reach = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("total"), F.lit(-1).alias("reach")),
        lambda s, x: F.struct(
            (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reach"]))).alias("total"),
            F.greatest(s["reach"], x["end"]).alias("reach"),
        ),
        lambda s: s["total"].cast("long"),
    )
    out = found.withColumns({"n_hit": reach, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256), "spans": spans})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW, k: int = K,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the ``spans`` of hit words."""
    of = (benchmark, item_col, item_text_col, block_bytes, window, k)
    if one_block(benchmark, item_text_col, block_bytes):
        found = scanned(narrow(docs, id_col, text_col).select("text", "doc_id"), [], *of)
    else:
        rows, texts, _ = keyed(docs, id_col, text_col)
        found = rows.select("doc_id", "rid").join(scanned(texts.select("text", "rid"), ["rid"], *of), "rid")
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated")


def one_block(benchmark: DataFrame, text_col: str, block_bytes: int) -> bool:
    """Whether all texts of the benchmark fit into one block."""
    return (benchmark.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0) < block_bytes


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, in the columns that came in.

    With one block of benchmark text the rows pass through the scan and nothing is shuffled; with
    several, contaminated texts are found first and taken out by an anti-join.
    """
    if one_block(benchmark, item_text_col, block_bytes):
        found = scanned(narrow(docs, id_col, text_col, keep_row=True).select("text", "_row"), [], benchmark, item_col, item_text_col, block_bytes)
        return judged(found).filter(~F.col("contaminated")).select("_row.*")
    rows, texts, _ = keyed(docs, id_col, text_col, keep_row=True)
    bad = contamination(texts, benchmark, "rid", "text", item_col, item_text_col, block_bytes).filter("contaminated")
    return rows.join(bad.select(F.col("doc_id").alias("rid")), "rid", "left_anti").select("_row.*")
