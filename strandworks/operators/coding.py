"""Scoring, quantising and coding of symbols.

Probability rows stay inside a task; what leaves it are a few numbers per symbol.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.config import grouped_widths

# --- probabilities as columns (small vocabularies) -----------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def log_softmax(logits: Column) -> Column:
    """Natural-log probabilities of an array of logits."""
    norm = lambda x, top: top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return let(logits, lambda x: let(F.array_max(x), lambda top: let(norm(x, top), lambda n: F.transform(x, lambda v: v - n))))


def bits_of(log_p: Column) -> Column:
    return -log_p / F.lit(float(np.log(2)))


def frequency_totals(vocab: Column, target_mass: float = 0.01, least: int = 1 << 15) -> Column:
    """``functions.config.frequency_total`` of a column of vocabulary sizes."""
    need = F.greatest(F.lit(least), vocab + 1, F.ceil(vocab / target_mass))
    return F.pow(F.lit(2), F.ceil(F.log2(need))).cast("long")


def quantised(rows: DataFrame, key: str, probs: str, total: int) -> DataFrame:
    """``key, idx, freq, cum_low, cum_high``: integers of at least 1 that sum to ``total``.

    ``floor(p * (total - V)) + 1``, what is left over goes to the largest fractions, the lowest index
    first on ties. One array per row: everything happens inside the row, without a shuffle.
    """
    p, v = F.col(probs), F.size(probs)

    def rest(b: Column) -> Column:
        return F.lit(total).cast("long") - v - F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)

    def extra(s: Column, b: Column) -> Column:
        order = F.array_sort(F.transform(s, lambda x, i: F.struct((F.floor(x) - x).alias("f"), i.alias("i"))))
        return F.transform(F.slice(order, 1, F.greatest(rest(b), F.lit(0)).cast("int")), lambda x: x["i"])

    def lowered(b: Column) -> Column:
        """Where doubles rounded up to too much: one less, as often as needed, for the largest, the first on ties."""
        first = lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1
        times = F.when(rest(b) < 0, F.sequence(F.lit(1).cast("long"), -rest(b))).otherwise(F.array().cast("array<long>"))
        return F.aggregate(times, b, lambda x, _: let(first(x), lambda j: F.transform(x, lambda y, i: y - (i == j).cast("long"))))

    scaled = let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda norm: F.transform(p, lambda x: x / norm * (F.lit(total) - v)))
    freqs = let(
        scaled,
        lambda s: let(
            F.transform(s, lambda x: F.floor(x)),
            lambda b: let(extra(s, b), lambda e: F.transform(lowered(b), lambda x, i: x + 1 + F.array_contains(e, i).cast("long"))),
        ),
    )
    step = rows.select(key, freqs.alias("freqs"))
    one = step.select(key, "freqs", F.posexplode("freqs").alias("idx", "freq"))
    low = F.aggregate(F.slice("freqs", 1, F.col("idx")), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select(key, "idx", "freq", low.alias("cum_low"), (low + F.col("freq")).alias("cum_high"))


# --- the same in numpy, for large vocabularies inside a scorer -----------------------------------


#: Rows that are quantised at a time: their tables stay in a core's cache.
QUANTISED_ROWS = 512


def quantise(probs: np.ndarray, total: int) -> np.ndarray:
    """Cumulative integer tables (rows x V + 1) of probability rows."""
    n, v = probs.shape
    out = np.zeros((n, v + 1), np.int64)
    for i in range(0, n, QUANTISED_ROWS):
        _quantise(probs[i : i + QUANTISED_ROWS], total, out[i : i + QUANTISED_ROWS, 1:])
    return out


def _quantise(probs: np.ndarray, total: int, out: np.ndarray) -> None:
    n, v = probs.shape
    key = probs / probs.sum(1, keepdims=True)
    key *= total - v
    freq = np.floor(key)
    left = (total - v - freq.sum(1)).astype(np.int64)
    np.subtract(freq, key, out=key)  # minus the fraction
    # the largest fractions get one more, the lowest index first where fractions are equal
    edge = np.sort(key, axis=1)[np.arange(n), np.clip(left - 1, 0, v - 1)][:, None]
    extra = key <= edge
    uneven = np.flatnonzero(extra.sum(1) != left)
    if len(uneven):  # more that tie than are left, or nothing left at all
        under, ties = key[uneven] < edge[uneven], key[uneven] == edge[uneven]
        room = left[uneven] - under.sum(1)
        extra[uneven] = (under | (ties & (np.cumsum(ties, axis=1) <= room[:, None]))) & (left[uneven] > 0)[:, None]
    freq += 1
    freq += extra
    for r in np.flatnonzero(left < 0):  # rounding up by floats: take back from the largest
        for _ in range(int(-left[r])):
            freq[r, int(np.argmax(freq[r]))] -= 1
    out[:] = np.cumsum(freq, axis=1)


class TableScorer:
    """A scorer of few distributions: ``table`` has one in each row, and ``states`` maps windows (n, L) and a place to the rows (n, L - place) that hold from there on."""

    def __init__(self, table: np.ndarray, states: Callable[[np.ndarray, int], np.ndarray]):
        self.table, self.states = table, states

    def __call__(self, windows: np.ndarray, first: int = 0) -> np.ndarray:
        return self.table[self.states(windows, first)]


#: Windows that are scored at a time.
SCORED_WINDOWS = 64
SCORED = "source_name string, pos long, target int, log2p double, cum_low long, cum_high long, total long"


def score_windows(windows: DataFrame, score_fn: Callable[[np.ndarray], np.ndarray], total: int) -> DataFrame:
    """Score every position of ``windows`` (source_name, start, input_ids, labels) with a caller's function.

    ``score_fn`` maps (n, L) input ids to (n, L, V) natural-log probabilities; labels below 0 are
    not scored. Probability rows are gathered, quantised and dropped ``SCORED_WINDOWS`` windows at a time; the few of a ``TableScorer``
    are quantised once, and more windows are looked up at a time.
    """
    few = isinstance(score_fn, TableScorer)
    names = [x.split()[0] for x in SCORED.split(", ")]

    def rows_of(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, many = quantise(np.exp(score_fn.table), total) if few else None, SCORED_WINDOWS * (64 if few else 1)
        for batch in batches:
            for lo in range(0, len(batch), many):
                part = batch.slice(lo, many)
                labels, ids = rows_of(part.column(3)), rows_of(part.column(2))
                row, col = np.nonzero(labels >= 0)
                if not len(row):
                    continue
                target = labels[row, col]
                if few:
                    cum, p, at = table, score_fn.table, score_fn.states(ids, 0)[row, col]
                else:
                    p, at = score_fn(ids)[row, col], np.arange(len(row))
                    cum = quantise(np.exp(p), total)
                cols = [
                    part.column(0).take(pa.array(row)), pa.array(part.column(1).to_numpy()[row] + col, pa.int64()), pa.array(target.astype(np.int32)),
                    pa.array(p[at, target] / np.log(2)), pa.array(cum[at, target]), pa.array(cum[at, target + 1]), pa.array(np.full(len(row), total, np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    return windows.select("source_name", "start", "input_ids", "labels").mapInArrow(run, SCORED)


def fixed_scores(vocab: int) -> TableScorer:
    """A stand-in scorer: one fixed distribution at every place, falling from the first symbol to the last."""
    x = np.linspace(2, -2, vocab)
    return TableScorer((x - np.log(np.exp(x).sum()))[None], lambda ids, first: np.zeros((len(ids), ids.shape[1] - first), np.int64))


#: Rows whose contexts are counted together before they leave a task.
TALLIED_ROWS = 256


def _tallied(ids: np.ndarray, off: np.ndarray, group: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of tokens (``off``: where they begin) in groups: the first place of each different (group, ``order`` tokens, next token), and how often it is there."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    m = max(0, len(ids) - order)
    at = np.flatnonzero(row[:m] == row[order:])
    names, place = np.unique(ids, return_inverse=True)
    key, kinds = group[row[at]].astype(np.int64), int(group.max(initial=0)) + 1
    for j in range(order + 1):
        if kinds * len(names) > 2**62:  # keys in use are numbered anew before they can pass 64 bits
            used, key = np.unique(key, return_inverse=True)
            kinds = len(used)
        key = key * len(names) + place[at + j]
        kinds *= len(names)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def context_tallies(tokens: DataFrame, order: int, key: str | None = None) -> DataFrame:
    """``[key], context, next, n`` of a few rows of ``tokens`` at a time, to be summed up; no token makes a row of its own."""
    names = [*([key] if key else []), "context", "next", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TALLIED_ROWS):
                part = batch.slice(i, TALLIED_ROWS)
                ids, off = _lists(part.column("tokens"))
                keys = part.column(key).dictionary_encode("encode") if key else None
                group = keys.indices.to_numpy(zero_copy_only=False) if key else np.zeros(len(part), np.int64)
                at, n = _tallied(ids, off, group, order)
                context = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * order, pa.int32()), pa.array(ids[(at[:, None] + np.arange(order)).ravel()], pa.int64()))
                own = [part.column(key).take(pa.array(np.searchsorted(off, at, "right") - 1))] if key else []
                yield pa.RecordBatch.from_arrays([*own, context, pa.array(ids[at + order], pa.int64()), pa.array(n, pa.int64())], names)

    rows = tokens.select(*names[:-3], F.col("tokens").cast("array<long>").alias("tokens"))
    kind = [f"`{key}` {rows.schema[key].dataType.simpleString()}"] if key else []
    return rows.mapInArrow(run, ", ".join([*kind, "context array<long>", "next long", "n long"]))


def context_counts(tokens: DataFrame, order: int) -> DataFrame:
    """``context, next, n`` over all token arrays: what an order-m count model is made of."""
    return context_tallies(tokens, order).groupBy("context", "next").agg(F.sum("n").alias("n"))


def count_model_bits(train: DataFrame, test: DataFrame, order: int, vocab: int, smoothing: float = 1.0) -> DataFrame:
    """``source_name, symbols, bits`` of test tokens under the smoothed counts of the training tokens."""
    counts = context_counts(train, order)
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"))
    asked = context_tallies(test, order, "source_name").groupBy("source_name", "context", "next").agg(F.sum("n").alias("times"))
    j = asked.join(counts, ["context", "next"], "left").join(totals, "context", "left")
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * vocab)
    return j.groupBy("source_name").agg(F.sum("times").cast("long").alias("symbols"), F.sum(-F.log2(p) * F.col("times")).alias("bits"))


# --- arithmetic coding ---------------------------------------------------------------------------


class Encoder:
    """A 32-bit arithmetic coder over (cum_low, cum_high, total) triples."""

    TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30

    def __init__(self):
        self.low, self.high, self.pending, self.bits = 0, self.TOP, 0, []

    def _emit(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits.extend([1 - bit] * self.pending)
        self.pending = 0

    def encode(self, lo: int, hi: int, total: int) -> None:
        span = self.high - self.low + 1
        self.high = self.low + span * hi // total - 1
        self.low += span * lo // total
        while True:
            if self.high < self.HALF:
                self._emit(0)
            elif self.low >= self.HALF:
                self._emit(1)
                self.low -= self.HALF
                self.high -= self.HALF
            elif self.low >= self.QUARTER and self.high < 3 * self.QUARTER:
                self.pending += 1
                self.low -= self.QUARTER
                self.high -= self.QUARTER
            else:
                return
            self.low, self.high = self.low * 2, self.high * 2 + 1

    def encode_all(self, lo: np.ndarray, hi: np.ndarray, total: int) -> None:
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            self.encode(a, b, total)

    def finish(self) -> bytes:
        self.pending += 1
        self._emit(0 if self.low < self.QUARTER else 1)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes() if self.bits else b""


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits whole numbers below 2**53 have."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _in_order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes from the longest to the shortest, where each begins, and how many of them reach over each step."""
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    steps = np.arange(size[0] if len(size) else 0)
    return order, (np.cumsum(sizes) - sizes)[order], np.searchsorted(-size, -steps, side="left")


def _settled(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``low, high`` shifted until they are a quarter apart, and by how many bits: first those that agree, then those that straddle the middle."""
    agreed = 32 - _bits(low ^ high)
    low, high = (low << agreed) & Encoder.TOP, ((high << agreed) | ((1 << agreed) - 1)) & Encoder.TOP
    straddle = 31 - _bits(~(low & ~high) & (Encoder.HALF - 1))
    return (low << straddle) & (Encoder.HALF - 1), (((high << straddle) | ((1 << straddle) - 1)) & Encoder.TOP) | Encoder.HALF, agreed, straddle


#: Intervals that ``encode_many`` is given at a time.
CODED_INTERVALS = 1 << 22
#: Lower bounds that are summed up at a time.
SUMMED = 1 << 19
#: Totals up to which an interval's bounds times the coder's range fit 63 bits.
MOST_TOTAL = 1 << 30


def encode_many(lo: np.ndarray, hi: np.ndarray, total: int | np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of an ``Encoder`` for each of several lanes, whose intervals follow each other lane by lane; ``total`` is one for all or one for each.

    All lanes take a step at a time. What is written is the sum of the intervals' lower bounds at their places, so bits that hang on
    a carry need no list of their own: sums are made in limbs of 16 bits, and carries go up at the end.
    """
    order, start, active = _in_order(sizes)
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), Encoder.TOP, np.int64)
    total = np.broadcast_to(np.asarray(total, np.int64), sizes.shape)[order]
    if len(total) and total.max() > MOST_TOTAL:
        raise ValueError(f"a total is at most {MOST_TOTAL}")
    one = total[0] if len(total) and (total == total[0]).all() else None
    power = one is not None and one & (one - 1) == 0
    added, shifted = np.empty(len(lo), np.uint32), np.empty(len(lo), np.uint8)
    for t, m in enumerate(active.tolist()):
        at, l, span = start[:m] + t, low[:m], high[:m] - low[:m] + 1
        a, b = span * lo[at], span * hi[at]
        if power:
            n = int(one).bit_length() - 1
            a, b = a >> n, b >> n
        else:
            a, b = a // total[:m], b // total[:m]
        low[:m], high[:m], agreed, straddle = _settled(l + a, l + b - 1)
        added[at], shifted[at] = a, agreed + straddle
    last = np.empty(len(sizes), np.int64)
    last[order] = np.where(low < Encoder.QUARTER, Encoder.QUARTER, Encoder.HALF) - low
    after = np.concatenate([[0], np.cumsum(shifted, dtype=np.int64)])
    ends = np.cumsum(sizes)
    first, bits = after[ends - sizes], after[ends] - after[ends - sizes]
    limbs = bits // 16 + 4
    base = np.cumsum(limbs) - limbs
    moved, out = np.repeat(base * 16 - first, sizes), np.zeros(int(limbs.sum()) + 2, np.int64)

    def put(value: np.ndarray, place: np.ndarray) -> None:
        limb = place // 16
        value, from_ = value.astype(np.int64) << (16 - place % 16), int(limb.min())
        for j, shift in enumerate((32, 16, 0)):
            part = np.bincount(limb - from_, weights=((value >> shift) & 0xFFFF).astype(np.float64))
            out[from_ + j : from_ + j + len(part)] += part.astype(np.int64)

    for i in range(0, len(lo), SUMMED):
        put(added[i : i + SUMMED], after[i : min(i + SUMMED, len(lo))] + moved[i : i + SUMMED])
    if len(sizes):
        put(last, base * 16 + bits)
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:-1] += carry[1:]
    data = out.astype(">u2").tobytes()
    return [data[2 * b : 2 * b + (n + 9) // 8] for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def decode_many(coded: list[bytes], sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The symbols that ``Decoder`` reads from each lane, lane by lane; ``tables`` has a lane's cumulative table in each row, filled up with its total."""
    order, start, active = _in_order(sizes)
    data = np.frombuffer(b"".join(c + bytes(16) for c in coded), np.uint8)
    words = np.zeros(max(len(data) - 8, 0), np.uint64)
    for j in range(8):
        words |= data[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    length = np.array([len(c) + 16 for c in coded], np.int64)
    begin, end = ((np.cumsum(length) - length) * 8)[order], ((np.cumsum(length) - 16) * 8)[order]
    cum, total = tables[order], tables[order, -1]

    def read(at: np.ndarray, n: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = np.minimum(at, end)  # zeros behind the end
        return ((words[at >> 3] << (at & 7).astype(np.uint64) >> np.uint64(32)).astype(np.int64)) >> (32 - n)

    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), Encoder.TOP, np.int64)
    code, at = read(begin, np.full(len(sizes), 32), end), begin + 32
    out = np.zeros(int(sizes.sum()), np.int64)
    for t, m in enumerate(active.tolist()):
        l, c, span = low[:m], code[:m], high[:m] - low[:m] + 1
        value = ((c - l + 1) * total[:m] - 1) // span
        symbol = (cum[:m, 1:-1] <= value[:, None]).sum(1)
        out[start[:m] + t] = symbol
        row = np.arange(m)
        a, b = l + span * cum[row, symbol] // total[:m], l + span * cum[row, symbol + 1] // total[:m] - 1
        low[:m], high[:m], agreed, straddle = _settled(a, b)
        c = ((c << agreed) | read(at[:m], agreed, end[:m])) & Encoder.TOP
        at[:m] += agreed
        code[:m] = (c & Encoder.HALF) | (((c << straddle) | read(at[:m], straddle, end[:m])) & (Encoder.HALF - 1))
        at[:m] += straddle
    return out


class Decoder:
    """Reads what ``Encoder`` wrote: the caller gives each symbol's cumulative table."""

    def __init__(self, coded: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(coded, np.uint8)).tolist(), 32
        self.low, self.high, self.code = 0, Encoder.TOP, int("".join(map(str, (self.bits + [0] * 32)[:32])), 2)

    def decode(self, cum: np.ndarray | list[int]) -> int:
        """The next symbol, given the cumulative table (from 0 to the total) that it was coded with."""
        total, span = int(cum[-1]), self.high - self.low + 1
        value = ((self.code - self.low + 1) * total - 1) // span
        symbol = bisect_right(cum, value) - 1
        self.high = self.low + span * int(cum[symbol + 1]) // total - 1
        self.low += span * int(cum[symbol]) // total
        while True:
            if self.high < Encoder.HALF:
                cut = 0
            elif self.low >= Encoder.HALF:
                cut = Encoder.HALF
            elif self.low >= Encoder.QUARTER and self.high < 3 * Encoder.QUARTER:
                cut = Encoder.QUARTER
            else:
                return symbol
            bit = self.bits[self.at] if self.at < len(self.bits) else 0
            self.low, self.high, self.code, self.at = (self.low - cut) * 2, (self.high - cut) * 2 + 1, (self.code - cut) * 2 + bit, self.at + 1


def _places(text: str) -> np.ndarray:
    """The code point of each character."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _filled(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have up to ``most`` together, one row at least."""
    lo, n = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and n + size > most:
            yield lo, i
            lo, n = i, 0
        n += size
    if sizes:
        yield lo, len(sizes)


def encode_blocks(symbols: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """Code each block of ``block`` positions of each source: ``keys, code_block, symbols, coded``."""
    schema = ", ".join([*(f"{k} string" for k in keys), "code_block long, symbols long, coded binary"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        e = Encoder()
        for lo, hi, total in zip(frame["cum_low"].tolist(), frame["cum_high"].tolist(), frame["total"].tolist(), strict=True):
            e.encode(lo, hi, total)
        return pd.DataFrame([[*key, len(frame), e.finish()]], columns=[*keys, "code_block", "symbols", "coded"])

    blocks = symbols.withColumn("code_block", F.floor(F.col("pos") / block))
    return blocks.select(*keys, "code_block", "pos", "cum_low", "cum_high", "total").groupBy(*keys, "code_block").applyInPandas(run, schema)


def encode_sequences(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``source_name, block_id, symbols, coded`` of blocks (source_name, block_id, seq), each coded by its source's table.

    ``tables``: ``source_name, letters, counts``, a letter's interval being as wide as its count. A block is coded from its text, without a row for each base.
    """
    names = ["source_name", "block_id", "symbols", "coded"]

    def coded(rows: list[tuple[np.ndarray, str, list[int]]]) -> list[bytes]:
        lo, hi, total = [], [], []
        for seq, letters, counts in rows:
            high, known = np.cumsum(counts), _places(letters)
            at = np.minimum(np.searchsorted(known, seq), len(known) - 1)
            if (known[at] != seq).any():
                raise ValueError("a block has letters that its table lacks")
            lo.append((high - counts)[at])
            hi.append(high[at])
            total.append(int(high[-1]))
        return encode_many(np.concatenate(lo), np.concatenate(hi), np.array(total), np.array([len(s) for s, *_ in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_places(s), letters, n) for s, letters, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            for lo, up in _filled([len(s) for s, *_ in rows], CODED_INTERVALS):
                part = batch.slice(lo, up - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s, *_ in rows[lo:up]], pa.int64()), pa.array(coded(rows[lo:up]), pa.binary())], names)

    j = blocks.join(tables, "source_name").select("source_name", "block_id", "seq", "letters", "counts")
    return j.mapInArrow(run, "source_name string, block_id long, symbols long, coded binary")


def letter_tables(sources: DataFrame) -> DataFrame:
    """``source_name, letters, counts`` of each source's (or its blocks') letters in order."""

    @F.arrow_udf("array<struct<c:string,n:long>>")
    def tally(seqs: pa.Array) -> pa.Array:
        letters, counts, cut = [], [], [0]
        for seq in seqs.to_pylist():
            at = _places(seq or "")
            c, n = np.unique(at, return_counts=True) if at.max(initial=0) > 255 else (np.flatnonzero(n := np.bincount(at)), n[n > 0])
            letters += map(chr, c.tolist())
            counts += n.tolist()
            cut.append(len(letters))
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(letters, pa.string()), pa.array(counts, pa.int64())], ["c", "n"]))

    each = sources.select("source_name", F.explode(tally("seq")).alias("x"))
    n = each.groupBy("source_name", "x.c").agg(F.sum("x.n").cast("long").alias("n"))
    t = n.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("t"))
    return t.select("source_name", F.array_join(F.transform("t", lambda x: x["c"]), "").alias("letters"), F.transform("t", lambda x: x["n"]).alias("counts"))


# --- factorisations ------------------------------------------------------------------------------


def chunk_symbols(token: Column, k: int, m: int, letters: int) -> Column:
    """The steps of m bases of a merged token, the first most significant."""
    out, rest = [], k
    for w in grouped_widths(k, m):
        rest -= w
        out.append(F.floor(token / letters**rest) % letters**w)
    return F.array(*[c.cast("long") for c in out])


def step_probabilities(probs: DataFrame, k: int, m: int, letters: int) -> DataFrame:
    """``key, token, step, symbol, width, p``: conditional probabilities whose product over the steps is the token's own.

    Input: ``key, token, p`` of all letters**k tokens of each key, and of reserved tokens, whose ids follow
    those. The root has the mass of all reserved tokens as symbol 0, then the mass of each first group; a reserved token
    takes one more step, among the reserved. Masses are sums within a key: its rows are one group of V.
    """
    regular = letters**k
    p = probs.withColumn("reserved", F.col("token") >= regular)
    out, rest, cur = None, k, p.filter("not reserved")
    parts = []
    for step, w in enumerate(grouped_widths(k, m)):
        rest -= w
        prefix = F.floor(F.col("token") / letters**rest).cast("long")
        cur = cur.withColumn(f"m{step}", F.sum("p").over(Window.partitionBy("key", prefix)))
        symbol = prefix % letters**w
        first = step == 0
        parts.append(F.struct(F.lit(step).alias("step"), (symbol + 1 if first else symbol).cast("long").alias("symbol"), F.lit(letters**w + first).cast("long").alias("width"), (F.col(f"m{step}") if first else F.try_divide(f"m{step}", f"m{step - 1}")).alias("p")))
    out = cur.select("key", "token", F.explode(F.array(*parts)).alias("s"))
    other = Window.partitionBy("key")
    root = letters ** grouped_widths(k, m)[0] + 1
    mass = p.filter("reserved").withColumns({"m": F.sum("p").over(other), "n": F.count("*").over(other)})
    two = F.array(
        F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("symbol"), F.lit(root).cast("long").alias("width"), F.col("m").alias("p")),
        F.struct(F.lit(1).alias("step"), (F.col("token") - regular).cast("long").alias("symbol"), F.col("n").alias("width"), F.try_divide("p", "m").alias("p")),
    )
    return out.unionByName(mass.select("key", "token", F.explode(two).alias("s"))).select("key", "token", "s.*")


def prefix_tree(vocabulary: DataFrame) -> DataFrame:
    """``prefix, parent, depth, n_pieces``: the nodes of the tree of all pieces; reserved ``<...>`` pieces are left out."""
    plain = vocabulary.filter(~F.col("piece").rlike("^<.*>$"))
    nodes = plain.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("piece")), lambda i: F.substring("piece", F.lit(1), i))).alias("prefix"))
    return nodes.groupBy("prefix").agg(F.count("*").alias("n_pieces")).select("prefix", F.when(F.length("prefix") > 0, F.expr("substring(prefix, 1, length(prefix) - 1)")).alias("parent"), F.length("prefix").cast("long").alias("depth"), "n_pieces")


#: The prefix under which the mass of reserved pieces stands.
OTHER = "<other>"


# --- side information, baselines, residuals ------------------------------------------------------


def tail_bits(tail: Column) -> Column:
    """Three bits of length and three for each base."""
    return (3 + 3 * F.length(tail)).cast("long")


def tail_side_info(tail: Column, order: str = "NAGCT") -> Column:
    """The tail as bytes (hex): length, then bases in the given order, filled up with zero bits."""
    bits = F.concat(F.lpad(F.bin(F.length(tail)), 3, "0"), F.array_join(F.transform(F.filter(F.split(tail, ""), lambda c: c != ""), lambda c: F.lpad(F.bin(F.instr(F.lit(order), c) - 1), 3, "0")), ""))
    size = F.ceil(F.length(bits) / 8) * 8
    padded = F.rpad(bits, size, F.lit("0"))
    return F.lpad(F.conv(padded, 2, 16), (size / 4).cast("int"), F.lit("0"))


def raw_tail_bytes(tail: Column, fixed_kmer: Column) -> Column:
    """The other family's rule: nothing for an empty tail, else plain ASCII for fixed k-mers."""
    return F.when(fixed_kmer, F.octet_length(tail)).otherwise(0).cast("long")


CODECS = {"gzip": lambda b: gzip.compress(b, 9, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}


def baseline_sizes(samples: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``source_name, ascii, two_bit, gzip, bz2, lzma`` bytes of whole samples; larger samples are an error."""

    @F.pandas_udf("gzip long, bz2 long, lzma long")
    def sizes(seq: pd.Series) -> pd.DataFrame:
        data = [s.encode() for s in seq]
        if max(map(len, data), default=0) > most_bytes:
            raise ValueError(f"a sample exceeds {most_bytes} bytes; codecs need it whole")
        return pd.DataFrame({k: [len(f(b)) for b in data] for k, f in CODECS.items()})

    n = F.octet_length("seq").cast("long")
    return samples.select("source_name", n.alias("ascii"), F.floor((2 * n + 7) / 8).cast("long").alias("two_bit"), sizes("seq").alias("z")).select("source_name", "ascii", "two_bit", "z.*")


#: Letters over which LZMA's hashes of two to four letters meet in the same places whatever the dictionary's size (from 2**16 places up).
LZMA_LETTERS = b"ACGTN"
#: Bytes of a sample that are held before its LZMA codec is chosen.
LZMA_HELD = 1 << 20


class Lzma:
    """The size of ``lzma.compress`` of what is fed in parts.

    A codec of the default dictionary of 8 MB clears and frees tables of many MB for a text of a few letters. A sample of A, C, G, T and N
    that is over before ``LZMA_HELD`` bytes gets a dictionary of its own length: it looks matches up as the default one does, so that it
    takes the same bytes. Other samples go on with the default.
    """

    def __init__(self):
        self.held, self.codec, self.size = [], None, 0
        self.room = LZMA_HELD

    def compress(self, data: bytes) -> None:
        if self.codec is None:
            self.held.append(data)
            self.room -= len(data)
            if self.room >= 0 and not data.translate(None, LZMA_LETTERS):
                return
            data, self.codec = b"".join(self.held), lzma.LZMACompressor()
            self.held = []
        self.size += len(self.codec.compress(data))

    def flush(self) -> int:
        if self.codec is None:
            data = b"".join(self.held)
            return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": max(4096, len(data))}]))
        return self.size + len(self.codec.flush())


class Sized:
    """The size of what a codec makes of parts."""

    def __init__(self, codec):
        self.codec, self.size = codec, 0

    def compress(self, data: bytes) -> None:
        self.size += len(self.codec.compress(data))

    def flush(self) -> int:
        return self.size + len(self.codec.flush())


def _codecs() -> list:
    return [Sized(zlib.compressobj(9, zlib.DEFLATED, 31)), Sized(bz2.BZ2Compressor()), Lzma()]


#: Samples whose sizes leave a task in one batch.
SIZED_ROWS = 1024


def streamed_sizes(blocks: DataFrame, keys: list[str], at: str = "start") -> DataFrame:
    """``keys, ascii, two_bit, gzip, bz2, lzma`` bytes of samples in blocks (``keys, at, seq``), however long: the sizes that whole samples give.

    Blocks of a sample meet in their order and are fed to compressors of which only the state and the sizes are kept.
    """
    sizes = ["ascii", "two_bit", *CODECS]
    names = [*keys, *sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, codecs, rows = None, 0, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*(f.type for f in fields), *[pa.int64()] * len(sizes)], strict=True)], names)

        for batch in batches:
            fields = [batch.schema.field(i) for i in range(len(keys))]
            for *now, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or now != key:
                    if key is not None:
                        rows.append((*key, n, (2 * n + 7) // 8, *(c.flush() for c in codecs)))
                    key, n, codecs = now, 0, _codecs()
                if len(rows) >= SIZED_ROWS:
                    yield made()
                    rows = []
                data = text.encode()
                n += len(data)
                for c in codecs:
                    c.compress(data)
        if key is not None:
            rows.append((*key, n, (2 * n + 7) // 8, *(c.flush() for c in codecs)))
            yield made()

    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    met = blocks.repartition(*keys).sortWithinPartitions(*keys, at).select(*keys, "seq")
    return met.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} long" for c in sizes)]))


def latent_count(valid: Column, ratio: float) -> Column:
    return F.least(F.greatest(F.ceil(valid * ratio), F.lit(1)), valid).cast("long")


def latent_bits(mode: str, valid: Column, ratio: float, hidden: int, bottleneck: int, dtype_bytes: int, scores: bool) -> Column:
    """Side information of one window's latent vectors, in bits."""
    n = latent_count(valid, ratio)
    width = {"dense": n * hidden, "continuous_bottleneck": n * bottleneck, "flatten_bottleneck": F.lit(bottleneck)}[mode]
    return ((width * dtype_bytes + 4 + (n * dtype_bytes if scores else 0)) * 8).cast("long")


def whole_latent_bits(mode: str, valid: Column, windows: Column, hidden: int, code: int, flat: int, dtype_bytes: int) -> Column:
    """The other family's rule: a latent vector for each valid place (or one for each window), no count of them and no scores."""
    width = {"dense": valid * hidden, "continuous_bottleneck": valid * code, "flatten_bottleneck": windows * flat}[mode]
    return ((width * dtype_bytes + windows * 4) * 8).cast("long")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the offsets of its rows."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sparse(codes: pa.Array, prediction: pa.Array) -> pa.Array:
    (a, off), (b, other) = _lists(codes), _lists(prediction)
    if not np.array_equal(off, other):
        raise ValueError("codes and prediction differ in length")
    delta = a - b
    at = np.flatnonzero(delta)
    cut = pa.array(np.searchsorted(at, off), pa.int32())
    row = np.searchsorted(off, at, side="right") - 1
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cut, pa.array(x)) for x in ((at - off[row]).astype(np.int32), delta[at].astype(np.int64))], ["indices", "data"])


def _restored(prediction: pa.Array, indices: pa.Array, data: pa.Array) -> pa.Array:
    (out, off), (at, cut), (delta, _) = _lists(prediction), _lists(indices), _lists(data)
    out = out.astype(np.int64)
    out[at + np.repeat(off[:-1], np.diff(cut))] += delta
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out))


def residuals(rows: DataFrame, key: str, *keep: str) -> DataFrame:
    """``key, nonzeros, density, indices, data`` from arrays ``codes`` and ``prediction`` of equal length, and columns to ``keep``; see ``restored``."""
    sparse = F.arrow_udf(_sparse, "struct<indices:array<int>,data:array<long>>")
    d = rows.withColumn("sparse", sparse("codes", "prediction"))
    n = F.size("sparse.indices").cast("long")
    return d.select(key, n.alias("nonzeros"), (n / F.greatest(F.size("codes"), F.lit(1))).alias("density"), "sparse.indices", "sparse.data", *keep)


def restored(prediction: Column, indices: Column, data: Column) -> Column:
    """The codes that a prediction and its sparse residuals stand for: each residual is added at its place."""
    return F.arrow_udf(_restored, "array<long>")(prediction, indices, data)


def csr(cells: DataFrame) -> DataFrame:
    """``matrix, row, start, indices, data`` from ``matrix, row, col, value``: one compressed row each, and where it starts in its matrix's arrays.

    No row holds a whole matrix; ``start`` is what ``indptr`` has for the row.
    """
    lines = cells.groupBy("matrix", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("l"))
    before = Window.partitionBy("matrix").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("l")).over(before), F.lit(0)).cast("long")
    return lines.select("matrix", "row", start.alias("start"), F.transform("l", lambda x: x["col"]).alias("indices"), F.transform("l", lambda x: x["value"]).alias("data"))


def recheck(decoded: DataFrame, originals: DataFrame) -> DataFrame:
    """``source_name, exact``: stored results against the sequences that they came from."""
    j = originals.select("source_name", F.col("seq").alias("original")).join(decoded.select("source_name", F.col("seq").alias("decoded")), "source_name", "left")
    return j.select("source_name", F.coalesce(F.col("original") == F.col("decoded"), F.lit(False)).alias("exact"))
