"""Suffix-array dedup: remove every byte of a ``LENGTH``-byte string that also starts earlier.

All texts are UTF-8 bytes; strings never cross texts; "earlier" is a smaller id, or an earlier
start in the same text. Strings are judged on the input, and overlapping occurrences count.

A full suffix array of the corpus would be a hundred times its size, so the array is sparse: its
suffixes are those at content-defined anchors (see ``anchors``), one for a run of string starts,
and anchors that occur once in the corpus are left out. Sampled splitters range-partition the
suffixes by their leading bytes, ties by text, so that a suffix of very many copies is split too.
Each bucket is sorted; multikey quicksort over the bytes then finds the runs that agree as a whole,
and, among what is left of an anchor, the single strings that agree. Only the outermost anchors of a
bucket may go on beyond it: for these the first of each string is compared across the boundaries. How far a
suffix agrees with its neighbours in the order bounds the strings that can repeat at all, so a
common phrase that is shorter than ``LENGTH`` adds few of them.

Defined results: null and empty texts have no bytes and nothing is removed; repeated or null ids
as in ``common.keyed`` (fully repeated rows are one text, not earlier than each other); other
columns are ignored. Removal may leave partial UTF-8, so kept bytes are binary. Bytes are compared
with bytes: no hash ever stands for a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm import anchors
from strandworks.llm.common import discard, keyed, materialise, partitions, utf8

LENGTH = 100
GRAM = 32
#: Suffixes that are looked at together, and strings that are sorted at a time.
HELD_ROWS, HELD_STRINGS = 20_000, 1_000_000


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return data, data, offsets


CONTEXT = "rid long, first long, dist long, n long, context binary"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def contexts(docs: DataFrame, marked: DataFrame, rule: anchors.Rule) -> DataFrame:
    """Each edge with the bytes of all its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(batch.column(1))
            row, first, last, dist = anchors.edge_arrays(batch.column(2))
            start, end = off[row] + first, off[row] + last + rule.length
            for i in range(0, len(row), 20_000):
                part = slice(i, i + 20_000)
                body = [data[a:b].tobytes() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                cols = [rids[row[part]], first[part], dist[part], last[part] - first[part] + 1]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(body, pa.binary())], CONTEXT_NAMES)

    j = docs.join(anchors.edges_by_text(marked), F.col("rid") == F.col("e_rid"))
    return j.select("rid", "text", "edges").mapInArrow(run, CONTEXT)


SORTED = "kind int, rid long, first long, last long, suffix binary"
CLOSED, OPEN = 0, 1


class Bucket:
    """Suffixes of whole anchors, in order, and what repeats among them."""

    def __init__(self, table: pa.Table, rule: anchors.Rule):
        data, off = utf8(table.column("context"))
        self.data, self.content, self.rule = data, anchors.Content(data, words=False), rule
        self.start, self.end = off[:-1], off[1:]
        self.rid, self.first, self.dist, self.n = (table.column(k).to_numpy() for k in ("rid", "first", "dist", "n"))
        self.anchor = self.start + self.dist
        new = np.zeros(len(table), bool)
        for j in range(self.content.depth(rule.gram)):
            c = self.content.column(self.anchor, self.anchor + rule.gram, j)
            new[1:] |= c[1:] != c[:-1]
        self.lead = np.cumsum(new)

    def _equal(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, parts: tuple, first: np.ndarray, longest: int) -> tuple:
        """Sort rows by their bytes within ``parts`` (integers): rows by class, earliest first; firsts; classes."""
        o = np.lexsort(parts[::-1])
        cut = np.concatenate([[True], np.any([p[o][1:] != p[o][:-1] for p in parts], axis=0)])
        start, end = start[o], end[o]
        depth = self.content.depth(longest)
        order, shared = anchors.multikey_quicksort(lambda r, j: self.content.column(start[r], end[r], j), depth, np.diff(np.append(np.flatnonzero(cut), len(o))))
        got, earliest, _ = anchors.classes(order, shared == depth, self.rid[rows[o]], first[o])
        return o[got], earliest

    def solve(self, open_first: bool, open_last: bool) -> Iterator[tuple]:
        """(kind, rids, first and last string starts, bytes or None) of what repeats or may repeat elsewhere."""
        length, every = self.rule.length, np.arange(len(self.rid))
        rows, earliest = self._equal(every, self.start, self.end, (self.lead, self.n, self.dist), self.first, int(self.n.max()) + length - 1)
        again = rows[~earliest]
        yield CLOSED, *anchors.merge_intervals(self.rid[again], self.first[again], self.first[again] + self.n[again]), None
        reps = np.sort(rows[earliest])
        opened = (open_first & (self.lead[reps] == 0)) | (open_last & (self.lead[reps] == self.lead[-1]))
        # how far each suffix agrees with a neighbour, from its anchor on; unknown at a bucket's ends
        right, end = self.anchor[reps], self.end[reps]
        common = self.content.shared(right[1:], end[1:], right[:-1], end[:-1], length) if len(reps) > 1 else np.zeros(0, np.int64)
        reach = np.maximum(np.concatenate([[length * open_first], common]), np.concatenate([common, [length * open_last]]))
        least = np.maximum(length - reach, self.dist[reps] - self.n[reps] + 1)  # a string's least distance from the anchor
        live = (np.bincount(self.lead[reps])[self.lead[reps]] > 1) | opened
        count = np.where(live, np.maximum(self.dist[reps] - least + 1, 0), 0)
        # equal strings lie at equal distances, so distances can be taken a few at a time
        cuts, total = [0], 0
        per = np.zeros(int(self.dist.max()) + 2, np.int64)
        np.add.at(per, np.maximum(least[count > 0], 0), 1)
        np.add.at(per, self.dist[reps][count > 0] + 1, -1)
        for d, k in enumerate(np.cumsum(per).tolist()):
            if total and total + k > HELD_STRINGS:
                cuts.append(d)
                total = 0
            total += k
        for low, high in zip(cuts, [*cuts[1:], len(per)], strict=True):
            a, b = np.maximum(least, low), np.minimum(self.dist[reps], high - 1)
            m = np.where(count > 0, np.maximum(b - a + 1, 0), 0)
            run = np.repeat(np.arange(len(reps)), m)
            if not len(run):
                continue
            d = a[run] + np.arange(len(run)) - np.repeat(np.cumsum(m) - m, m)
            row = reps[run]
            place = self.dist[row] - d
            start, first = self.start[row] + place, self.first[row] + place
            o, earliest = self._equal(row, start, start + length, (self.lead[row], d), first, length)
            again = o[~earliest]
            yield CLOSED, *anchors.merge_intervals(self.rid[row[again]], first[again], first[again] + 1), None
            q = o[earliest & opened[run[o]]]
            if len(q):
                yield OPEN, self.rid[row[q]], first[q], first[q] + 1, [self.data[x : x + length].tobytes() for x in start[q].tolist()]


def sort_buckets(ordered: DataFrame, rule: anchors.Rule) -> DataFrame:
    """Repeats within each bucket as ranges of string starts, and open rows for its outermost anchors.

    Rows come in the order of their bytes from the anchor on, then rid and first.
    """
    names = [x.split()[0] for x in SORTED.split(", ")]

    def rows(kind: int, rid, first, last, body) -> pa.RecordBatch:
        n = len(rid)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind), pa.int32()), pa.array(rid, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(body, pa.binary()) if body else pa.nulls(n, pa.binary())], names
        )

    def lead_of(table: pa.Table, i: int) -> bytes:
        d = table.column("dist")[i].as_py()
        return table.column("context")[i].as_py()[d : d + rule.gram]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, outermost = 0, True  # whether the held rows begin with the bucket's first anchor

        def solved(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            for got in Bucket(table, rule).solve(outermost, last):
                if len(got[1]):
                    yield rows(*got)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < HELD_ROWS or not len(batch):
                continue
            table = pa.Table.from_batches(held)
            last, low, high = lead_of(table, n - 1), 0, n
            if lead_of(table, 0) == last:
                continue
            while low < high:  # where the last anchor begins
                mid = (low + high) // 2
                low, high = (mid + 1, high) if lead_of(table, mid) < last else (low, mid)
            yield from solved(table.slice(0, low), False)
            outermost = False
            held, n = table.slice(low).to_batches(), n - low
        if n:
            yield from solved(pa.Table.from_batches(held), True)

    return ordered.select(*CONTEXT_NAMES).mapInArrow(run, SORTED)


def across_boundaries(found: DataFrame) -> DataFrame:
    """Ranges of suffix starts that repeat: closed ones, and open ones that an earlier bucket's group holds too."""
    opened = found.filter(F.col("kind") == OPEN)
    # one row per bucket and suffix at most, so no group outgrows the number of buckets
    firsts = opened.groupBy("suffix").agg(F.min(F.struct("rid", "first")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    late = opened.join(firsts, "suffix").filter(F.struct("rid", "first") > F.col("least")).select("rid", "first", "last")
    return found.filter(F.col("kind") == CLOSED).select("rid", "first", "last").unionByName(late)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rid, first, last``: intervals [first, last) of bytes to remove (they may overlap); ``docs`` has rid and text."""
    rule = anchors.Rule(length, gram, "later")
    marked = anchors.marks(docs, rule, encode, lambda codes: anchors.byte_grams(codes, gram), False, "byte-runs")
    around = materialise(contexts(docs, marked, rule), "contexts")
    suffix = F.expr("substring(context, cast(dist as int) + 1)")
    ordered = around.repartitionByRange(partitions(docs.sparkSession), suffix, "rid").sortWithinPartitions(suffix, "rid", "first")
    sorted_ = materialise(sort_buckets(ordered, rule), "suffixes")
    discard(around)
    found = across_boundaries(sorted_)
    settled = marked.filter(F.col("kind") == anchors.INTERVAL).select("rid", "first", "last")
    return settled.unionByName(found.select("rid", "first", (F.col("last") + length - 1).alias("last")))


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` of every document."""
    rows, texts, _ = keyed(docs, id_col, text_col)
    spans = anchors.intervals_by_text(repeated_spans(texts, length, gram))
    joined = rows.join(spans, F.col("rid") == F.col("i_rid"), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, parts, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = union_of(spans)
                at, left = 0, []
                for a, b in cut:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                n.append(len(text))
                gone.append(sum(b - a for a, b in cut))
                parts.append(len(cut))
                kept.append(b"".join(left))
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, parts)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
