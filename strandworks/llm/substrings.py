"""Substring dedup by prefix-partitioned suffix trees.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``LENGTH`` consecutive words of one
text. Every word that lies in a window whose word sequence starts anywhere else too is removed,
first occurrences included. Windows are judged on the input.

Only suffixes at content-defined anchors are rows (see ``anchors``), one for a run of windows, and
anchors that occur once in the corpus are left out. Suffixes are dealt out by prefixes of variable
length: the shortest of ``PREFIXES`` leading words that brings a group to ``GROUP`` suffixes at most.
The suffixes of a group are sorted by multikey quicksort, and common prefixes of neighbours give
its suffix tree: how deep a suffix's node is bounds the windows that can repeat at all, and the
leaves below the internal nodes of depth ``LENGTH`` are the repeats. Words are compared by keys that are the words
themselves, or 120-bit digests of those over 15 bytes.

A group that is too large under the longest of these prefixes, the anchor, is dealt out by whole windows instead: a task sorts
the windows of its suffixes in the same way, of equal ones one goes on, and these meet by a hash of all their words and are
sorted again. Wherever they meet, sorted words decide; sizes and hashes only deal rows out. So neither a group nor one
window is ever held or read by one task as a whole.

Defined results: null and empty texts have no words; repeated or null ids as in ``common.keyed``
(fully repeated rows are one text, which alone is no repeat); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm import anchors
from strandworks.llm.common import SPACED_WORD, folded, groups_of, keyed, materialise, parted, partitions, small_enough, utf8, word_hashes, word_keys, words_of
from strandworks.llm.decontam import grams

LENGTH = 35
GRAM = 8
#: Leading words that a group's suffixes share; the last is the whole anchor.
PREFIXES = (1, 2, 4, 8)
#: Suffixes in one group (about 48 words each); those that are held, and windows that are sorted, at a time.
GROUP, HELD_ROWS, HELD_WINDOWS = 2_000, 20_000, 1_000_000
#: Bytes of text whose words are told apart at a time.
CHUNK = 1 << 21


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, off = parted(data, offsets)
    starts, ends = words_of(text, SPACED_WORD)
    lo, hi = word_keys(text, starts, ends)
    return np.stack([lo, hi], 1).ravel(), folded(lo, hi), np.searchsorted(starts, off)


CONTEXT = "rid long, first long, dist long, n long, context binary, p1 long, p2 long, p4 long, p8 long"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def contexts(texts: DataFrame, marked: DataFrame, rule: anchors.Rule) -> DataFrame:
    """Each edge with the words of all its windows, and hashes of the leading words from its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(batch.column(1))
            for x, y in groups_of(off, CHUNK):
                row, first, last, dist = anchors.edge_arrays(batch.column(2).slice(x, y - x))
                text, at = parted(data[off[x] : off[y]], off[x : y + 1] - off[x])
                starts, ends = words_of(text, SPACED_WORD)
                h = word_hashes(text, starts, ends)
                begin = np.searchsorted(starts, at)[row] + first
                a, b = starts[begin], ends[begin + last - first + rule.length - 1]
                body = [text[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                keys = [grams(h, p)[begin + dist].view(np.int64) for p in PREFIXES]
                cols = [rids[x:y][row], first, dist, last - first + 1]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(body, pa.binary()), *(pa.array(k, pa.int64()) for k in keys)], CONTEXT_NAMES)

    j = texts.join(anchors.edges_by_text(marked), F.col("rid") == F.col("e_rid"))
    return j.select("rid", "text", "edges").mapInArrow(run, CONTEXT)


def prefix_groups(around: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes with ``grp``, a prefix of variable length; and those whose longest prefix is still too common.

    Prefixes are counted with partial sums. The too common ones, at most one in ``group`` rows, are
    broadcast if they are few; else each level is joined, in a way that Spark can split where it is skewed.
    """
    levels = [f"p{p}" for p in PREFIXES]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(p).alias("key")) for i, p in enumerate(levels)])).alias("e")
    counted = around.select(each).groupBy("e.level", "e.key").count().filter(F.col("count") > group).select("level", "key")
    common = materialise(counted, "common-prefixes")
    few = small_enough(common)
    out, choice = around, None
    for i, level in enumerate(levels):
        hot = common.filter(F.col("level") == i).select(F.col("key").alias(f"{level}_hot"))
        out = out.join(F.broadcast(hot) if few else hot, F.col(level) == F.col(f"{level}_hot"), "left")
        small = F.col(f"{level}_hot").isNull()
        pick = F.struct(F.lit(level).alias("level"), F.col(level).alias("key"))
        choice = F.when(small, pick) if choice is None else choice.when(small, pick)
    out = out.withColumn("grp", F.when(choice.isNotNull(), F.xxhash64(choice)))
    columns = ["grp", "rid", "first", "dist", "n", "context"]
    return out.filter("grp is not null").select(columns), out.filter("grp is null").select(F.col(levels[-1]).alias("grp"), *columns[1:])


FOUND = "rid long, first long, last long"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def found_rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], FOUND_NAMES)


def deep_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, end) of the topmost internal nodes of a suffix tree that are ``depth`` deep or more.

    ``shared[i]`` is how much sorted suffix i shares with the one before it (0 for the first).
    """
    deep = np.concatenate([[False], shared >= depth, [False]])
    return np.flatnonzero(deep[1:] & ~deep[:-1]) - 1, np.flatnonzero(deep[:-1] & ~deep[1:])


class Tree:
    """The suffix trees of some whole groups, sorted together, and what repeats in them."""

    def __init__(self, table: pa.Table, length: int):
        data, off = utf8(table.column("context"))
        text, at = parted(data, off)
        starts, ends = words_of(text, SPACED_WORD)
        self.content, self.length = anchors.Content(np.stack(word_keys(text, starts, ends), 1).ravel(), words=True), length
        self.start = np.searchsorted(starts, at[:-1])
        self.text, self.at, self.until = text, starts, ends
        grp = table.column("grp").to_numpy()
        self.grp = np.cumsum(np.concatenate([[False], grp[1:] != grp[:-1]]))
        self.rid, self.first, self.dist, self.n = (table.column(k).to_numpy() for k in ("rid", "first", "dist", "n"))

    def _sorted(self, parts: tuple, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of suffixes of so many words within ``parts`` (integers), and the words each shares with the one before."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        o = np.lexsort(parts[::-1])
        cut = np.concatenate([[True], np.any([p[o][1:] != p[o][:-1] for p in parts], axis=0)])
        start, end = start[o], start[o] + size[o]
        key = lambda r, j: self.content.column(start[r], end[r], j)
        order, shared = anchors.multikey_quicksort(key, self.content.depth(int(size.max())), np.diff(np.append(np.flatnonzero(cut), len(o))))
        return o[order], shared // 2

    def _leaves(self, shared: np.ndarray, depth: int) -> np.ndarray:
        below = np.zeros(len(shared) + 1, np.int64)
        a, b = deep_nodes(shared, depth)
        np.add.at(below, a, 1)
        np.add.at(below, b, -1)
        return np.cumsum(below[:-1]) > 0

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix and place of every window in the order of the words, and how many words each shares with the one before."""
        row = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        order, shared = self._sorted((self.grp[row],), self.start[row] + place, np.full(len(row), self.length))
        return row[order], place[order], shared

    def repeats(self) -> Iterator[tuple]:
        """(rids, first, end) of words below deep nodes."""
        length, size = self.length, self.n + self.length - 1
        # runs that agree as a whole: all their windows repeat, and one of each goes on
        order, shared = self._sorted((self.grp, self.n, self.dist), self.start, size)
        equal = shared >= size[order]
        whole = equal | np.concatenate([equal[1:], [False]])
        m = order[whole]
        yield self.rid[m], self.first[m], self.first[m] + size[m]
        reps = np.sort(order[~equal])
        # the tree over suffixes at anchors: how deep a leaf's parent is bounds the windows that repeat
        order, shared = self._sorted((self.grp[reps],), self.start[reps] + self.dist[reps], size[reps] - self.dist[reps])
        reps = reps[order]
        reach = np.maximum(shared, np.append(shared[1:], 0)) if len(reps) else shared
        least = np.maximum(length - reach, self.dist[reps] - self.n[reps] + 1)
        count = np.maximum(self.dist[reps] - least + 1, 0)
        for part in np.array_split(np.arange(int(self.dist.max()) + 1), max(1, min(int(self.dist.max()) + 1, -(-int(count.sum()) // HELD_WINDOWS)))):
            # equal windows lie at equal distances, so distances can be taken a few at a time
            a, b = np.maximum(least, part[0]), np.minimum(self.dist[reps], part[-1])
            k = np.where(count > 0, np.maximum(b - a + 1, 0), 0)
            run = np.repeat(np.arange(len(reps)), k)
            row = reps[run]
            place = self.dist[row] - (a[run] + np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k))
            order, shared = self._sorted((self.grp[row],), self.start[row] + place, np.full(len(row), length))
            q = order[self._leaves(shared, length)]
            pos = self.first[row[q]] + place[q]
            yield self.rid[row[q]], pos, pos + length


APART = "grp long, rid long, first long, last long, dist long, n long, context binary"


def windows_apart(large: DataFrame, rule: anchors.Rule) -> DataFrame:
    """Suffixes whose longest prefix is too common, dealt out by whole windows, the longest prefix that decides anything.

    A task sorts the windows of its suffixes to the tree's leaves of depth ``length``: of equal ones one goes on, with its words and a hash of all of
    them as ``grp``, and all of several are intervals (``grp`` is null). So a window has at most one row from each task, whatever its number.
    """
    names = [x.split()[0] for x in APART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.argsort(table.column("grp").to_numpy(), kind="stable")))
            tree = Tree(table, rule.length)
            row, place, shared = tree.windows()
            head = shared < rule.length
            alone = head & np.append(head[1:], True)
            again = ~alone
            rid, first, last = anchors.merge_intervals(tree.rid[row[again]], tree.first[row[again]] + place[again], tree.first[row[again]] + place[again] + rule.length)
            none, zero = pa.nulls(len(rid), pa.int64()), pa.array(np.zeros(len(rid), np.int64))
            yield pa.RecordBatch.from_arrays([none, *(pa.array(c, pa.int64()) for c in (rid, first, last)), zero, zero, pa.nulls(len(rid), pa.binary())], names)
            row, place = row[head], place[head]
            begin = tree.start[row] + place
            key = grams(word_hashes(tree.text, tree.at, tree.until), rule.length)[begin].view(np.int64)
            for i in range(0, len(row), 20_000):
                p, q = row[i : i + 20_000], begin[i : i + 20_000]
                body = [tree.text[x:y].tobytes() for x, y in zip(tree.at[q].tolist(), tree.until[q + rule.length - 1].tolist(), strict=True)]
                place_in = tree.first[p] + place[i : i + 20_000]
                zero = np.zeros(len(p), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key[i : i + 20_000], tree.rid[p], place_in, place_in + rule.length, zero, zero + 1)), pa.array(body, pa.binary())], names)

        for batch in batches:
            held.append(batch)
            n += int(batch.column(4).to_numpy().sum())
            if n >= anchors.HELD // 2:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return large.mapInArrow(run, APART)


def solve_groups(dealt: DataFrame, length: int) -> DataFrame:
    """Intervals of repeated words, from rows sorted by grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in Tree(t, length).repeats():
                if len(part[0]):
                    yield found_rows(*anchors.merge_intervals(*part))

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < HELD_ROWS:
                continue
            table = pa.Table.from_batches(held)
            grp = table.column("grp").to_numpy()
            cut = int(np.argmax(grp == grp[-1]))
            if cut:
                yield from solve(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, FOUND)


def repeated_words(texts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``rid, first, last``: intervals [first, last) of words to remove (they may overlap); ``texts`` has rid and text."""
    rule = anchors.Rule(length, GRAM, "any")
    marked = anchors.marks(texts, rule, encode, lambda codes: grams(codes, GRAM), True, "word-runs")
    around = materialise(contexts(texts, marked, rule), "word-contexts")
    n = partitions(texts.sparkSession)
    small, large = prefix_groups(around, group)
    found = solve_groups(small.repartition(n, "grp").sortWithinPartitions("grp"), length)
    apart = materialise(windows_apart(large, rule), "windows-apart")
    met = apart.filter("grp is not null").select("grp", "rid", "first", "dist", "n", "context").repartition(n, "grp").sortWithinPartitions("grp")
    settled = marked.filter(F.col("kind") == anchors.INTERVAL).select(*FOUND_NAMES).unionByName(apart.filter("grp is null").select(*FOUND_NAMES))
    return settled.unionByName(found).unionByName(solve_groups(met, length))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document, kept being the words that stay, one space apart."""
    rows, texts, _ = keyed(docs, id_col, text_col)
    spans = anchors.intervals_by_text(repeated_words(texts, length, group))
    joined = rows.join(spans, F.col("rid") == F.col("i_rid"), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _BYTES_WORD.findall(text)
                left, at = [], 0
                for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
                    if a > at:
                        left += words[at:a]
                    at = max(at, b)
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


_BYTES_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
