"""Repeated windows of a fixed length, looked for around content-defined anchors.

A window is ``length`` consecutive symbols (bytes or words) of one text. Of the ``gram``-long
stretches in a window, the one with the least hash (the first on ties) is its anchor, so equal
windows have equal anchors at equal distances. Consecutive windows with one anchor form a run, and a
run is one row: about two rows per ``length - gram`` symbols instead of one per symbol.

Hashes only choose anchors and bring together what may be equal. What is equal is decided by
sorting: ``multikey_quicksort`` over the symbols themselves, first among the runs of one task
(a third of all rows may be copies, which then never leave it), then by the callers among the runs
of all tasks whose anchor is found twice or more.

``mode`` "later" marks every window that starts earlier too (by text, then place); "any" marks every
window that starts anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import U64, groups_of, materialise, mix, partitions, utf8
from strandworks.llm.decontam import window_min

#: Windows of one piece, whose arrays stay in a core's cache.
PIECE = 1 << 18
_PLACE = U64((1 << 20) - 1)
#: Runs that a task holds before it sorts them, and symbols that these may refer to.
HELD, HELD_BYTES, HELD_WORDS = 500_000, 32_000_000, 4_000_000
#: Bytes of text that are cut into runs at a time.
CHUNK = 1 << 19
_FACTORS = mix(np.arange(301, 365, dtype=U64)) | U64(1)


@dataclass(frozen=True)
class Rule:
    length: int  # symbols of a window
    gram: int  # symbols of an anchor
    mode: str  # "later" or "any"


class Content:
    """Symbols as columns of 64-bit integers that compare as the symbols do.

    Bytes come eight to a column, big end first; a word takes two columns, the halves of its key.
    """

    def __init__(self, values: np.ndarray, words: bool):
        self.words, self.values = words, values
        self.scale, self.step = (2, 1) if words else (1, 8)
        padded = np.concatenate([values, np.zeros(8, values.dtype)])
        self.eight = padded if words else np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))
        self.top = len(self.eight) - 1

    def depth(self, symbols: int) -> int:
        """Columns that hold so many symbols."""
        return 2 * symbols if self.words else -(-symbols // 8)

    def column(self, start: np.ndarray, end: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """Column ``j`` of each stretch of symbols [start, end), 0 beyond its end."""
        at = start * self.scale + j * self.step
        v = self.eight[np.minimum(at, self.top)].astype(U64)
        left = end * self.scale - at
        if self.words:
            return np.where(left > 0, v, U64(0))
        return v & _HIGH[np.clip(left, 0, 8)]

    def shared(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: int) -> np.ndarray:
        """How many leading bytes, ``most`` at the most, the stretches at ``a`` and ``b`` have in common."""
        out = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for j in range(self.depth(most)):
            x = self.column(a[going], a_end[going], j) ^ self.column(b[going], b_end[going], j)
            out[going] += (8 - (x[:, None] >= _BYTE[None, :]).sum(1)).astype(np.int64)
            going = going[x == 0]
            if not len(going):
                break
        return np.minimum(out, np.minimum(most, np.minimum(a_end - a, b_end - b)))


#: The high 0, 1, ... 8 bytes of a 64-bit integer; and the least integer that takes 1, 2, ... 8 bytes.
_HIGH = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - k)) - 1) for k in range(9)], U64)
_BYTE = np.array([1 << 8 * k for k in range(8)], U64)


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes (eight or more)."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    n = len(data) - gram + 1
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k, at in enumerate([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
            out += mix(eight[at : at + n] * _FACTORS[k]) if k % 2 else eight[at : at + n] * _FACTORS[k]
        return mix(out)


def multikey_quicksort(key: Callable, depth: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows by columns of integers; all segments advance together.

    ``key(rows, columns)`` gives the integer of each row in each column. Rows come in segments of
    the given lengths, each sorted by itself. A segment is parted into smaller, equal and larger by
    a pivot in its current column; the equal part goes on to the next column. Returns the order,
    and how many leading columns each row shares with the row before it (0 at a segment's start).
    """
    n = int(lengths.sum())
    order, shared = np.arange(n), np.zeros(n, np.int64)
    start, size, level = np.cumsum(lengths) - lengths, lengths.astype(np.int64), np.zeros(len(lengths), np.int64)
    some = size > 1
    start, size, level = start[some], size[some], level[some]
    while len(start) and depth:
        off = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(seg)) + (start - off)[seg]
        rows = order[pos]
        k = key(rows, level[seg])
        a, b, c = k[off], k[off + size // 2], k[off + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        part = (k > pivot).astype(np.int64) + (k >= pivot)
        cell = seg * 3 + part
        count = np.bincount(cell, minlength=3 * len(size))
        target = (np.cumsum(count) - count)[cell]
        for p in range(3):  # stable places within each part
            m = part == p
            before = np.cumsum(m)
            target += np.where(m, before - 1 - (before[off] - m[off])[seg], 0)
        moved = np.empty_like(rows)
        moved[target] = rows
        order[pos] = moved
        count = count.reshape(-1, 3)
        begin = start[:, None] + np.cumsum(count, axis=1) - count
        deep = level[:, None] + np.array([0, 1, 0])
        cut = (count > 0) & (begin > start[:, None])
        shared[begin[cut]] = np.broadcast_to(level[:, None], cut.shape)[cut]
        whole = np.flatnonzero((count[:, 1] > 1) & (deep[:, 1] == depth))
        if len(whole):  # equal in every column
            m = count[whole, 1] - 1
            shared[np.repeat(begin[whole, 1] + 1 - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] = depth
        go = (count > 1) & (deep < depth)
        start, size, level = begin[go], count[go], deep[go]
    return order, shared


def runs(grams: Callable, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor's distance from the first, anchor hash) of each run.

    ``bounds`` part the symbols into texts; ``grams(a, b)`` hashes the grams of symbols [a, b).
    """
    width, n_windows = rule.length - rule.gram + 1, int(bounds[-1]) - rule.length + 1
    none = np.zeros(0, np.int64)
    if n_windows <= 0:
        return none, none, none, none, none.astype(U64)
    size = np.diff(bounds) - rule.length + 1
    valid = np.zeros(n_windows + rule.length, np.int32)
    some = size > 0
    np.add.at(valid, bounds[:-1][some], 1)
    np.add.at(valid, bounds[:-1][some] + size[some], -1)
    valid = np.cumsum(valid)[:n_windows] > 0
    out = []
    for p in range(0, n_windows, PIECE):
        ok = valid[p : p + PIECE]
        if not ok.any():
            continue
        g = grams(p, p + len(ok) + rule.length - 1)
        at = np.arange(len(g)).astype(U64)
        anchor = (window_min((g & ~_PLACE) | at, width) & _PLACE).astype(np.int64)
        change = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(ok & np.concatenate([[True], change | ~ok[:-1]]))
        last = np.flatnonzero(ok & np.concatenate([change | ~ok[1:], [True]]))
        a = anchor[first]
        out.append((first + p, last - first + 1, a - first, g[a]))
    first, count, dist, h = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(U64))
    text = np.searchsorted(bounds, first, "right") - 1
    # windows of neighbouring texts may share an anchor only by place, so runs never cross texts
    return text, first - bounds[text], count, dist, h


def merge_intervals(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of the intervals of each text."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    new_text = np.concatenate([[True], rid[1:] != rid[:-1]])
    # running maximum of ends within a text, by lifting each text above the one before
    lift = np.cumsum(new_text).astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    head = new_text.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return rid[at], start[at], np.maximum.reduceat(reach, at)


COLUMNS = ["h", "until", "rid", "place", "flag"]
SCHEMA = "h long, until long, rid long, place long, flag long"
#: A run; a run whose anchor other runs of its task have, and a mark that they do; an interval that is settled.
CANDIDATE, EDGE_RUN, MARK, DONE = 0, 1, 2, 3


def pack_place(first, count, dist):
    return (first << 24) | (count << 12) | dist


def classes(order: np.ndarray, whole: np.ndarray, rid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by class, the earliest of each class first; whether a row is its class's first; each row's class.

    ``whole`` says whether a sorted row equals the one before it in every column.
    """
    klass = np.cumsum(~whole) - 1
    o = np.lexsort((first[order], rid[order], klass))
    rows, klass = order[o], klass[o]
    return rows, np.concatenate([[True], klass[1:] != klass[:-1]]) if len(rows) else np.zeros(0, bool), klass


def settle(rid, first, count, dist, h, start, content: Content, rule: Rule) -> list[pa.RecordBatch]:
    """The rows that a task sends on: one of each content, and the intervals of the copies among its own runs.

    Runs of one anchor and shape are sorted by their symbols. ``start``: a run's first symbol in ``content``.
    """
    by = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    single, multi, group = by[alone], by[~alone], group[~alone]
    shape = (count[multi] << 12) | dist[multi]
    o = np.lexsort((shape, group))
    multi, group, shape = multi[o], group[o], shape[o]
    head = np.concatenate([[True], (group[1:] != group[:-1]) | (shape[1:] != shape[:-1])]) if len(multi) else np.zeros(0, bool)
    lengths = np.diff(np.append(np.flatnonzero(head), len(multi)))
    begin, end = start[multi], start[multi] + count[multi] + rule.length - 1
    depth = content.depth(int(count[multi].max()) + rule.length - 1) if len(multi) else 0
    order, shared = multikey_quicksort(lambda rows, j: content.column(begin[rows], end[rows], j), depth, lengths)
    rows, earliest, klass = classes(order, (shared == depth) & (depth > 0), rid[multi], first[multi])
    again = ~earliest if rule.mode == "later" else (np.bincount(klass)[klass] > 1 if len(klass) else earliest)
    m = multi[rows[again]]
    d_rid, d_start, d_end = merge_intervals(rid[m], first[m], first[m] + count[m] + rule.length - 1)
    kept = rows[earliest]
    several = np.bincount(group[kept], minlength=int(group.max()) + 1 if len(group) else 0) > 1
    edge, lone = multi[kept[several[group[kept]]]], multi[kept[~several[group[kept]]]]
    marks = multi[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]) & several[group])] if len(group) else edge
    cand = np.concatenate([single, lone])
    spread = lambda r, s: mix(r.astype(U64) * U64(31) + s.astype(U64)).view(np.int64)
    zero = lambda x: np.zeros(len(x), np.int64)
    cols = [
        np.concatenate([h[cand].view(np.int64), spread(rid[edge], first[edge]), h[marks].view(np.int64), spread(d_rid, d_start)]),
        np.concatenate([zero(cand), zero(edge), zero(marks), d_end]),
        np.concatenate([rid[cand], rid[edge], zero(marks), d_rid]),
        np.concatenate([pack_place(first[cand], count[cand], dist[cand]), pack_place(first[edge], count[edge], dist[edge]), zero(marks), d_start]),
        np.repeat([CANDIDATE, EDGE_RUN, MARK, DONE], [len(cand), len(edge), len(marks), len(d_rid)]),
    ]
    return [pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], pa.int64()) for c in cols], COLUMNS) for i in range(0, len(cols[0]), 50_000)]


def pieces(batches: Iterator[pa.RecordBatch], rule: Rule, encode: Callable, words: bool) -> Iterator[tuple]:
    """(rids, first symbol of each text, hash of grams, values, bounds): many short texts, or a stretch of a long one.

    ``encode(bytes, offsets)`` gives values (``Content``'s), what the grams are hashed from, and bounds.
    A long text comes in stretches of ``CHUNK`` bytes, cut at a space where symbols are words; each
    repeats the last ``length - 1`` symbols of the one before, so every window is in just one of them.
    """
    for batch in batches:
        data, off = utf8(batch.column(1))
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in groups_of(off, CHUNK):
            part = data[off[a] : off[b]]
            if len(part) <= 2 * CHUNK:
                yield rids[a:b], np.zeros(b - a, np.int64), *encode(part, off[a : b + 1] - off[a])
                continue
            at, n, tail = 0, 0, None
            while at < len(part):
                end = at + CHUNK
                if words and end < len(part):
                    gaps = np.flatnonzero(part[at + CHUNK // 2 : end] == 0x20)
                    while not len(gaps) and end < len(part):
                        gaps, end = np.flatnonzero(part[end : end + CHUNK] == 0x20) + end - at - CHUNK // 2, end + CHUNK
                    end = at + CHUNK // 2 + int(gaps[-1]) + 1 if len(gaps) else len(part)
                values, codes, bounds = encode(part[at:end], np.array([0, min(end, len(part)) - at]))
                scale = len(values) // max(1, len(codes))
                fresh = len(codes)
                if tail is not None:
                    values, codes = np.concatenate([tail[0], values]), np.concatenate([tail[1], codes])
                yield rids[a:b], np.array([n - (len(codes) - fresh)]), values, codes, np.array([0, len(codes)])
                n += fresh
                keep = min(len(codes), rule.length - 1)
                tail = (values[len(values) - keep * scale :].copy(), codes[len(codes) - keep :].copy()) if keep else None
                at = end


def candidates(docs: DataFrame, rule: Rule, encode: Callable, grams: Callable, words: bool) -> DataFrame:
    """Runs and settled intervals of ``docs`` (rid, text); ``grams(codes)`` hashes what ``encode`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, n, symbols = [], [], 0, 0

        def flush() -> list[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            return settle(*cols, Content(np.concatenate(values), words), rule)

        for rids, at, value, codes, bounds in pieces(batches, rule, encode, words):
            text, first, count, dist, h = runs(lambda a, b, c=codes: grams(c[a:b]), bounds, rule)
            if not len(text):
                continue
            held.append((rids[text], first + at[text], count, dist, h, bounds[text] + first + symbols))
            values.append(value)
            n, symbols = n + len(text), symbols + len(codes)
            if n >= HELD or symbols >= (HELD_WORDS if words else HELD_BYTES):
                yield from flush()
                held, values, n, symbols = [], [], 0, 0
        if n:
            yield from flush()

    return docs.select("rid", "text").mapInArrow(run, SCHEMA)


MARK_SCHEMA = "rid long, kind int, first long, last long, dist int"
INTERVAL, EDGE = 0, 1


def compared(sorted_rows: DataFrame, rule: Rule) -> DataFrame:
    """Marks from rows sorted by h: intervals, and as edges [first, last] the runs whose anchor is not theirs alone.

    A run's anchor is another's too if a neighbour in the order has it, so one row is held back at a time.
    """

    def of(cols: list[np.ndarray], before: int | None, after: int | None) -> pa.RecordBatch:
        h, until, rid, place, flag = cols
        same = h[1:] == h[:-1]
        twin = np.concatenate([[before is not None and h[0] == before], same]) | np.concatenate([same, [after is not None and h[-1] == after]])
        edge = (flag == EDGE_RUN) | ((flag == CANDIDATE) & twin)
        keep = np.flatnonzero(edge | (flag == DONE))
        done = flag[keep] == DONE
        place = place[keep]
        first, count, dist = place >> 24, (place >> 12) & 4095, place & 4095
        arrays = [
            pa.array(rid[keep], pa.int64()),
            pa.array(np.where(done, INTERVAL, EDGE), pa.int32()),
            pa.array(np.where(done, place, first), pa.int64()),
            pa.array(np.where(done, until[keep], first + count - 1), pa.int64()),
            pa.array(np.where(done, 0, dist), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["rid", "kind", "first", "last", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None
        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                yield of(held, before, int(cols[0][0]))
                before = int(held[0][-1])
            held = cols
        if held is not None:
            yield of(held, before, None)

    return sorted_rows.select(*COLUMNS).mapInArrow(run, MARK_SCHEMA)


def marks(docs: DataFrame, rule: Rule, encode: Callable, grams: Callable, words: bool, name: str) -> DataFrame:
    """Settled intervals and edges of ``docs`` (rid, text), written once: ``rid, kind, first, last, dist``.

    Each task sends one row at most for an anchor, or as many marks, so a common anchor is no larger than the number of tasks.
    """
    found = candidates(docs, rule, encode, grams, words)
    spread = found.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h")
    return materialise(compared(spread, rule), name)


def edges_by_text(marked: DataFrame) -> DataFrame:
    """``e_rid, edges``: the edges of each text."""
    return (
        marked.filter(F.col("kind") == EDGE)
        .groupBy(F.col("rid").alias("e_rid"))
        .agg(F.collect_list(F.struct("first", "last", "dist")).alias("edges"))
    )


def edge_arrays(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row, first, last, dist) of all edges of a column of ``edges_by_text``."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), *(flat.field(k).to_numpy().astype(np.int64) for k in ("first", "last", "dist"))


def intervals_by_text(marked: DataFrame) -> DataFrame:
    """``i_rid, spans``: all intervals (rid, first, last) of each text."""
    return marked.groupBy(F.col("rid").alias("i_rid")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
