"""Periodic runs of words: block convolution at dyadic scales, by an exact number-theoretic transform.

A run is a stretch of words with smallest period q (words q apart are identical) of at least
``max(6, 4 * q)`` words that no neighbour extends. For each scale B = 1, 2, 4, ... the words are cut to
blocks of B. A run whose period is in B .. 2B - 1 has, as it holds four periods, two blocks or more in a row that
occur again q words on. The sum of squared differences between a block and what lies q on is
``sum x^2 + sum y^2 - 2 * sum x * y``; the last term for all q of a scale is one convolution of the block with the
two blocks behind it, done modulo ``PRIME`` in integers. Where two stretches are equal the sum is zero, so none is
missed; a sum that is zero by the modulus alone is found out, as blocks in a row are compared word by word.
Distances that enough blocks in a row share are seeds; a seed is extended to both sides by less than a block.
Seeds inside a run of a smaller period that divides theirs are that run again and go, which also bounds the work on a text of one word
repeated: the whole takes n * log(n)**2 steps for n words, at scales up to n / 4 only.

All documents of a batch lie behind one another, the longest first, with a symbol of its own after each, so a scale looks at a
prefix. Nothing is shuffled: a row's result follows from the row.

Defined results: null and empty texts have no words and no runs; repeated rows each have their result; other columns are ignored.
``planted`` (the query's setting) rewrites a tenth of the texts by their id; a null id rewrites nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandworks.llm.common import SPACED_WORD, groups_of, narrow, parted, utf8, words_of

U64 = np.uint64
#: 3 * 2**30 + 1, of which 5 is a primitive root: transforms of up to 2**30 places, and products fit 64 bits.
PRIME, ROOT = 3221225473, 5
P = U64(PRIME)
#: Numbers that are transformed at a time: they stay in a core's cache.
SLAB = 1 << 16
#: Bytes of text that are looked at together.
GROUP_BYTES = 4 << 20
LEAST, PERIODS = 6, 4

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, runs_sha256 string, collapsed_sha256 string"


# --- the transform -------------------------------------------------------------------------------


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // P) * P


def _less(x: np.ndarray) -> np.ndarray:
    """x modulo ``PRIME`` where x is under twice that."""
    return np.minimum(x, x - P)


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(1, U64)
    while len(out) < half:
        out = np.concatenate([out, _mod(out * U64(pow(w, len(out), PRIME)))])
    return out


def forward(a: np.ndarray) -> np.ndarray:
    """Transform along the first axis, in bit-reversed order."""
    m, rows = a.shape
    half = m // 2
    while half:
        v = a.reshape(-1, 2, half, rows)
        out = np.empty_like(v)
        out[:, 0] = _less(v[:, 0] + v[:, 1])
        out[:, 1] = _mod(_less(v[:, 0] + (P - v[:, 1])) * _powers(half, False)[:, None])
        a, half = out.reshape(m, rows), half // 2
    return a


def backward(a: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``, m times too large."""
    m, rows = a.shape
    half = 1
    while half < m:
        v = a.reshape(-1, 2, half, rows)
        t = _mod(v[:, 1] * _powers(half, True)[:, None])
        out = np.empty_like(v)
        out[:, 0] = _less(v[:, 0] + t)
        out[:, 1] = _less(v[:, 0] + (P - t))
        a, half = out.reshape(m, rows), half * 2
    return a


@lru_cache(maxsize=64)
def _reversal(m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a transform: the place of the opposite frequency, and the factor that turns a block's frequencies into its reverse's."""
    freq = np.zeros(1, np.int64)
    while len(freq) < m:
        freq = np.concatenate([2 * freq, 2 * freq + 1])
    place = np.empty(m, np.int64)
    place[freq] = np.arange(m)
    whole = np.concatenate([_powers(m // 2, False), P - _powers(m // 2, False)])
    return place[(m - freq) % m], whole[(m // 2 - 1) * freq % m][:, None]


def zero_mismatches(x: np.ndarray, n: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``j, q``: blocks of the first n symbols, and distances from block to 2 * block - 1 at which the squared differences sum to zero."""
    m, blocks = 2 * block, -(-n // block)
    need = (blocks + 2) * block
    x = x[:need] if len(x) >= need else np.concatenate([x, np.zeros(need - len(x), U64)])
    x = _mod(x)
    squares = np.concatenate([np.zeros(1, U64), np.cumsum(_mod(x * x))])
    opposite, factor = _reversal(m)
    rows = max(1, SLAB // m)
    found_j, found_q = [], []
    for j0 in range(0, blocks, rows):
        r = min(rows, blocks - j0)
        a = np.zeros((m, r + 2), U64)
        a[:block] = x[j0 * block : (j0 + r + 2) * block].reshape(r + 2, block).T
        f = forward(a)
        w = np.empty((m, r), U64)
        w[:block] = _less(f[:block, 1 : r + 1] + f[:block, 2:])  # even frequencies: a block's shift changes nothing
        w[block:] = _less(f[block:, 1 : r + 1] + (P - f[block:, 2:]))
        c = backward(_mod(_mod(f[opposite, :r] * factor) * w))[block - 1 : m - 1]
        at = (np.arange(j0, j0 + r) * block)[None, :]
        behind = at + block + np.arange(block)[:, None]
        total = (squares[at + block] - squares[at]) + (squares[behind + block] - squares[behind])
        q, j = np.nonzero(_less(c + c) == _mod(_mod(total) * U64(m % PRIME)))
        found_j.append(j + j0)
        found_q.append(q + block)
    return np.concatenate(found_j), np.concatenate(found_q)


# --- runs ----------------------------------------------------------------------------------------


def _in_a_row(j: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, last, q`` of blocks in a row at the same distance."""
    order = np.lexsort((j, q))
    j, q = j[order], q[order]
    head = np.ones(len(j), bool)
    head[1:] = (q[1:] != q[:-1]) | (j[1:] != j[:-1] + 1)
    tail = np.append(head[1:], True) if len(j) else head
    return j[head], j[tail], q[head]


def _settled(x: np.ndarray, block: int, first: np.ndarray, last: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``start, end, q`` of blocks in a row that are equal word by word; those that are not are split at the false ones."""
    for f, g, d in zip(first.tolist(), last.tolist(), q.tolist(), strict=True):
        a, b = f * block, (g + 1) * block
        same = x[a:b] == x[a + d : b + d]
        if same.all():
            yield a, b, d
            continue
        good = np.flatnonzero(same.reshape(-1, block).all(1))
        for k, l, _ in zip(*_in_a_row(good, np.zeros(len(good), np.int64)), strict=True):
            if l - k + 1 >= _rows_needed(d, block):
                yield a + int(k) * block, a + int(l + 1) * block, d


def _rows_needed(q, block: int):
    """Blocks in a row that lie in any stretch of 3 * q places."""
    return (3 * q + 1) // block - 1


def runs_of(x: np.ndarray, within: list[int]) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least four periods in ``x``, sorted by start and period.

    ``within``: for each scale the length of the prefix that its texts take. Texts have to be parted by
    symbols that occur nowhere else.
    """
    found: list[np.ndarray] = []
    for scale, n in enumerate(within):
        block = 1 << scale
        first, last, q = _in_a_row(*zero_mismatches(x, n, block))
        keep = last - first + 1 >= _rows_needed(q, block)
        for runs in found:  # by start, and so by end: those of a scale overlap by less than two of their periods
            if len(runs):
                k = np.searchsorted(runs[:, 0], first * block, "right") - 1
                r = runs[np.maximum(k, 0)]
                keep &= ~((k >= 0) & (r[:, 1] >= (last + 1) * block + q) & (q % r[:, 2] == 0))
        rows = []
        for a, b, d in _settled(x, block, first[keep], last[keep], q[keep]):
            lo = max(0, a - block)
            differ = np.flatnonzero(x[lo:a] != x[lo + d : a + d])
            start = lo + int(differ[-1]) + 1 if len(differ) else lo
            hi = min(len(x) - d, b + block)
            differ = np.flatnonzero(x[b:hi] != x[b + d : hi + d])
            end = (b + int(differ[0]) if len(differ) else hi) + d
            if end - start >= PERIODS * d:
                rows.append((start, end, d))
        rows = np.array(sorted(set(rows)), np.int64).reshape(-1, 3)
        found.append(rows)
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[out[:, 1] - out[:, 0] >= LEAST]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


# --- documents -----------------------------------------------------------------------------------


def plant(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that takes each place of a text that the query's rule rewrites; None where it does not."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


def _longest(runs: list[list[int]]) -> list[int]:
    """The run of the greatest exact length by period; the first of those."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _group(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, planted: bool) -> list[tuple]:
    data, offsets = parted(data, offsets)
    starts, ends = words_of(data, SPACED_WORD)
    first = np.searchsorted(starts, offsets)  # of each text's words
    size = np.diff(first)
    texts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)), pa.py_buffer(data[SPACED_WORD[data]])])
    coded = texts.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    # longest first, and a symbol of its own behind each text
    order = np.argsort(-size, kind="stable")
    at = np.zeros(len(ids) + 1, np.int64)
    at[1:] = np.cumsum(size[order] + 1)
    x = np.empty(int(at[-1]), np.int64)
    for k, d in enumerate(order.tolist()):
        w = word[first[d] : first[d + 1]]
        to = plant(ids[d], len(w)) if planted else None
        x[at[k] : at[k + 1] - 1] = w if to is None else w[to]
        x[at[k + 1] - 1] = len(coded.dictionary) + k
    within = []
    while (n := int((size >= PERIODS << len(within)).sum())):
        within.append(int(at[n]))
    runs = runs_of(x.astype(U64), within)
    change = np.zeros(len(x) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    keep[at[1:] - 1] = False  # the symbols between texts
    spaced = pa.array([w + b" " for w in coded.dictionary.to_pylist()], pa.binary())
    left, left_at = utf8(spaced.take(pa.array(x[keep])))
    left, kept_at = left.tobytes(), left_at[np.concatenate([[0], np.cumsum(keep)])[at]]
    run_at = np.searchsorted(runs[:, 0], at)
    out: list = [None] * len(ids)
    for k, d in enumerate(order.tolist()):
        own = [[a - int(at[k]), b - a, q] for a, b, q in runs[run_at[k] : run_at[k + 1]].tolist()]
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in own)
        best = [*(b := _longest(own)), 1000 * b[1] // b[2]] if own else [None] * 4
        kept = left[kept_at[k] : kept_at[k + 1] - 1] if kept_at[k + 1] > kept_at[k] else b""
        out[d] = (ids[d], int(size[d]), len(own), *best, listed, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """``SCHEMA`` for each row: the runs (``start,length,period`` lines), the most repeated one, and digests of the runs and of the text without later periods."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in groups_of(offsets, GROUP_BYTES):
                rows = _group(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], planted)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)
