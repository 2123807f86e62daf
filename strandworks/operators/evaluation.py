"""Compression evaluation as one job: symbols to windows, scores, quantised intervals, coded bytes and sums.

Symbols come in blocks of any length (``keys, first_token, tokens``). ``recut`` deals them to code blocks with what windows
reach over on both sides, in one shuffle. A task scores the windows of a code block as strided views, a few at a time, feeds the
targets' intervals to one coder and drops them: what leaves it is a row for each code block and mode. No window is ever stored
and every symbol is scored once, so memory depends on the window and the vocabulary only.

A scorer maps windows (n, L) and a place to natural-log probabilities (n, L - place, V) of the symbols from that place on, each
given what stands before it in its window. One that has few distributions says so (``TableScorer``): then each is quantised once, and
each symbol's interval in it is looked up.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.functions.config import grouped_widths
from strandworks.operators.blocks import recut
from strandworks.operators.coding import CODED_INTERVALS, Decoder, TableScorer, encode_many, quantise
from strandworks.sources.fasta import blocks_of

Scorer = Callable[[np.ndarray, int], np.ndarray]
MODES = ("non_overlap", "overlap", "sliding")
#: Probabilities that are held at a time.
HELD = 1 << 20


@dataclass(frozen=True)
class Mode:
    """How symbols meet the scorer: windows side by side, windows a stride apart of which the later ones score their end only, or a window that ends at each symbol."""

    name: str
    length: int
    stride: int | None = None

    def __post_init__(self):
        if self.name not in MODES or self.length < 1:
            raise ValueError(f"a mode is one of {MODES} with a positive length")
        if (self.stride is None) == (self.name == "overlap") or (self.stride is not None and not 0 < self.stride < self.length):
            raise ValueError("overlap, and no other mode, takes a stride in (0, length)")

    def block(self, size: int) -> int:
        """Symbols of a code block of about ``size``: whole windows where these lie side by side."""
        return -(-size // self.length) * self.length

    @property
    def reach(self) -> tuple[int, int]:
        """How far windows reach over a code block's begin and end."""
        return {"non_overlap": (0, 0), "overlap": (self.length, self.stride), "sliding": (self.length - 1, 0)}[self.name]


# --- blocks of symbols ---------------------------------------------------------------------------


def symbol_blocks(sequences: DataFrame, keys: list[str], k: int, alphabet: str, eos: int | None, block: int = 1 << 15) -> DataFrame:
    """``keys, first_token, tokens`` of cleaned sequences in blocks of ``block`` tokens; what is left of a k-mer at the end drops out, then ``eos`` follows."""
    cut = blocks_of(sequences.select(*keys, "seq"), block * k).select(*keys, (F.col("start") / k).cast("long").alias("first_token"), S.kmer_ids(F.col("seq"), k, alphabet).alias("tokens"))
    if eos is None:
        return cut
    ends = sequences.select(*keys, F.floor(F.length("seq") / k).cast("long").alias("first_token"), F.array(F.lit(eos).cast("long")).alias("tokens"))
    return cut.unionByName(ends)


def scored_places(mode: Mode, symbols: np.ndarray, begin: int, lo: int, hi: int, pad: int, vocab: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Windows, the place from which they score, and the places (n, L - place) of the scored symbols, for the symbols lo .. hi - 1.

    Places outside lo .. hi - 1 are not to be counted. Windows are views of the symbols.
    """
    n, s = mode.length, mode.stride
    if mode.name == "sliding":
        starts, first = np.arange(lo - n + 1, hi - n + 1), n - 1
    elif mode.name == "non_overlap":
        starts, first = np.arange(lo // n * n, hi, n), 0
    else:
        last = max(0, -(-(hi - n) // s))
        starts, first = np.arange(max(1, (lo - n) // s + 1), last + 1) * s, n - s
    left = max(0, begin - (int(starts[0]) if len(starts) else 0))
    if mode.name == "overlap" and lo < n:
        left = max(left, begin)
    room = (int(starts[-1]) if len(starts) else 0) + n - begin
    right = max(0, max(room, n - begin) - len(symbols))
    padded = np.concatenate([np.full(left, pad, np.int64), symbols, np.full(right, pad, np.int64)])
    views = np.lib.stride_tricks.sliding_window_view(padded, n)
    at = left - begin
    if mode.name == "overlap" and lo < n:
        yield views[at : at + 1], 0, np.arange(n)[None, :]
    many = max(1, min(HELD // (vocab * (n - first)), HELD // n))
    for i in range(0, len(starts), many):
        s0 = starts[i : i + many]
        step = int(s0[1] - s0[0]) if len(s0) > 1 else 1
        yield views[s0[0] + at : s0[-1] + at + 1 : step], first, s0[:, None] + np.arange(first, n)[None, :]


# --- intervals -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Steps:
    """Coding of a merged token of k letters in steps of m; ids behind the letters**k regular ones are reserved.

    The root has the mass of all reserved tokens as symbol 0, then that of each first group; a reserved token takes one step more, among the reserved.
    """

    k: int
    m: int
    letters: int

    def intervals(self, p: np.ndarray, target: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """``cum_low, cum_high`` (rows, steps) of the targets; -1 where a row has no such step."""
        widths, regular = [self.letters**w for w in grouped_widths(self.k, self.m)], self.letters**self.k
        n, reserved = len(p), target >= regular
        lo, hi = np.full((n, max(len(widths), 2)), -1, np.int64), np.full((n, max(len(widths), 2)), -1, np.int64)

        def put(rows: np.ndarray, step: int, dist: np.ndarray, symbol: np.ndarray) -> None:
            mass = dist.sum(1, keepdims=True)
            cum = quantise(np.where(mass > 0, dist, 1.0), total)
            at = np.arange(len(rows))
            lo[rows, step], hi[rows, step] = cum[at, symbol], cum[at, symbol + 1]

        rest = p[:, :regular].reshape(n, widths[0], regular // widths[0])
        digit, below = np.where(reserved, 0, target), regular // widths[0]
        put(np.arange(n), 0, np.hstack([p[:, regular:].sum(1, keepdims=True), rest.sum(2)]), np.where(reserved, 0, digit // below + 1))
        rows = np.flatnonzero(~reserved)
        digit, rest = digit[rows], rest[rows, digit[rows] // below]
        for step, w in enumerate(widths[1:], 1):
            digit, below = digit % below, below // w
            rest = rest.reshape(len(rows), w, below)
            put(rows, step, rest.sum(2), digit // below)
            rest = rest[np.arange(len(rows)), digit // below]
        rows = np.flatnonzero(reserved)
        if len(rows):
            put(rows, 1, p[rows, regular:], target[rows] - regular)
        return lo, hi


def whole_intervals(p: np.ndarray, target: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """``cum_low, cum_high`` (rows, 1) of the targets among all symbols."""
    cum, at = quantise(p, total), np.arange(len(p))
    return cum[at, target][:, None], cum[at, target + 1][:, None]


#: Pairs of a distribution and a symbol of which intervals are kept.
PAIRS = 1 << 22


class _Intervals:
    """Bits and intervals of symbols: of each symbol by itself, or looked up by (distribution, symbol), each of which is made when it is first met."""

    def __init__(self, scorer: Scorer, vocab: int, total: int, codings: dict[str, Steps | None]):
        self.scorer, self.vocab, self.total = scorer, vocab, total
        self.of = {c: steps.intervals if steps else whole_intervals for c, steps in codings.items()}
        self.kept = isinstance(scorer, TableScorer) and scorer.table.size <= PAIRS
        if self.kept:
            self.known, self.bounds = np.zeros(scorer.table.size, bool), {}

    def _learn(self, pair: np.ndarray) -> None:
        met = np.zeros(len(self.known), bool)
        met[pair] = True
        new = np.flatnonzero(met & ~self.known)
        many = max(1, HELD // self.vocab)
        for i in range(0, len(new), many):
            part = new[i : i + many]
            p = np.exp(self.scorer.table[part // self.vocab])
            for c, f in self.of.items():
                low, high = f(p, part % self.vocab, self.total)
                if c not in self.bounds:
                    self.bounds[c] = np.full((2, len(self.known), low.shape[1]), -1, np.int32)
                self.bounds[c][0, part], self.bounds[c][1, part] = low, high
        self.known |= met

    def __call__(self, windows: np.ndarray, first: int, own: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, tuple[np.ndarray, np.ndarray]], float]:
        """Bits, ``cum_low, cum_high`` of each coding, and the seconds that the latter took; ``own`` are the places of the targets."""
        if self.kept:
            pair = self.scorer.states(windows, first)[own] * self.vocab + target
            log, began = self.scorer.table.ravel()[pair], time.perf_counter()
            if not self.known[pair].all():
                self._learn(pair)
            found = {c: (low[pair], high[pair]) for c, (low, high) in self.bounds.items()} if len(pair) else {}
        else:
            logs = self.scorer(windows, first)[own]
            log, p, began = logs[np.arange(len(target)), target], np.exp(logs), time.perf_counter()
            found = {c: f(p, target, self.total) for c, f in self.of.items()}
        out = {}
        for c, (low, high) in found.items():
            there = low >= 0
            out[c] = low[there].astype(np.int32), high[there].astype(np.int32)
        return -float(log.sum()) / np.log(2), out, time.perf_counter() - began


# --- the job -------------------------------------------------------------------------------------

RESULT = "mode string, coding string, code_block long, symbols long, emitted long, bits double, cum_low long, coded binary, score_seconds double, code_seconds double"


def evaluate(blocks: DataFrame, keys: list[str], modes: list[Mode], scorer: Scorer, vocab: int, pad: int, total: int, codings: dict[str, Steps | None], size: int = 1 << 15) -> DataFrame:
    """A row of ``RESULT`` for each key, mode, coding and code block of ``symbol_blocks``.

    ``codings`` maps a name to the steps that tokens are coded in (none: whole). ``emitted`` are the intervals coded, ``cum_low`` their
    lower bounds' sum. All modes share one shuffle; code blocks hold whole windows of each mode and are coded apart.
    """
    block = int(np.lcm.reduce([m.length for m in modes if m.name == "non_overlap"] or [1]))
    block *= -(-size // block)
    before, after = (max(m.reach[i] for m in modes) for i in (0, 1))
    names = [*keys, *(c.split()[0] for c in RESULT.split(", "))]

    def one(of: _Intervals, mode: Mode, symbols: np.ndarray, begin: int, lo: int, hi: int) -> list[tuple]:
        """``mode, coding, symbols, bits, cum_lows, cum_highs, score_seconds, code_seconds``: a code block before it is coded."""
        bits, began, spent = 0.0, time.perf_counter(), 0.0
        bounds = {c: ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)]) for c in codings}
        for windows, first, places in scored_places(mode, symbols, begin, lo, hi, pad, vocab):
            own = (places >= lo) & (places < hi)
            more, found, took = of(windows, first, own, symbols[places[own] - begin])
            bits, spent = bits + more, spent + took
            for c, both in found.items():
                for held, new in zip(bounds[c], both, strict=True):
                    held.append(new)
        seconds = time.perf_counter() - began - spent
        return [(mode.name, c, hi - lo, bits, np.concatenate(low), np.concatenate(high), seconds, spent / len(codings)) for c, (low, high) in bounds.items()]

    def coded(held: list[tuple]) -> list[tuple]:
        """``RESULT`` behind the keys of code blocks, coded side by side; the seconds are shared out by intervals."""
        sizes, began = np.array([len(r[-4]) for r in held], np.int64), time.perf_counter()
        data = encode_many(np.concatenate([r[-4] for r in held]), np.concatenate([r[-3] for r in held]), total, sizes)
        each = (time.perf_counter() - began) / max(int(sizes.sum()), 1)
        return [
            (*key, mode, coding, code_block, symbols, len(low), bits, int(low.sum(dtype=np.int64)), d, scoring, quantising + each * len(low))
            for (*key, code_block, mode, coding, symbols, bits, low, _, scoring, quantising), d in zip(held, data, strict=True)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n, types = _Intervals(scorer, vocab, total, codings), [], 0, []

        def row_batch() -> pa.RecordBatch:
            columns = list(zip(*coded(held), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, types[j]) if j < len(types) else pa.array(c) for j, c in enumerate(columns)], names)

        for batch in batches:
            types = [batch.schema.field(j).type for j in range(len(keys))]
            for i in range(len(batch)):
                head, code_block, begin = [batch.column(j)[i].as_py() for j in range(len(keys))], batch.column(len(keys))[i].as_py(), batch.column(len(keys) + 1)[i].as_py()
                symbols = batch.column(len(keys) + 2)[i].values.to_numpy()
                lo = code_block * block
                hi = min(lo + block, begin + len(symbols))
                for mode in modes:
                    more = [(*head, code_block, *r) for r in one(of, mode, symbols, begin, lo, hi)]
                    held += more
                    n += sum(len(r[-4]) for r in more)
                if n >= CODED_INTERVALS:
                    yield row_batch()
                    held, n = [], 0
        if held:
            yield row_batch()

    cut = recut(blocks, keys, block, before, after)
    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    return cut.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), RESULT]))


def per_source(results: DataFrame, keys: list[str], k: int, eos: bool) -> DataFrame:
    """``keys, mode, coding, bases, symbols, emitted, bits, coded_bytes, blocks, cum_low, seconds``: code blocks summed up."""
    s = results.groupBy(*keys, "mode", "coding").agg(
        F.sum("symbols").alias("symbols"), F.sum("emitted").alias("emitted"), F.sum("bits").alias("bits"), F.sum(F.length("coded").cast("long")).alias("coded_bytes"),
        F.count("*").alias("blocks"), F.sum("cum_low").alias("cum_low"), F.sum(F.col("score_seconds") + F.col("code_seconds")).alias("seconds"),
    )
    return s.withColumn("bases", (F.col("symbols") - int(eos)) * k)


def decode_block(coded: bytes, n: int, length: int, scorer: Scorer, pad: int, total: int) -> np.ndarray:
    """The n symbols of a code block of windows side by side, coded whole; the scorer must look at what stands before a place only."""
    d, out = Decoder(coded), np.full(-(-n // length) * length, pad, np.int64)
    for t in range(n):
        w = t // length * length
        cum = quantise(np.exp(scorer(out[None, w : w + length], t - w)[:, 0]), total)[0]
        out[t] = d.decode(cum)
    return out[:n]


def repeat_scorer(vocab: int, boost: float = 1.5) -> Scorer:
    """A stand-in scorer of our own: a fixed distribution that falls from the first symbol to the last, with the symbol before raised; the first place of a window stands behind the last but one symbol."""
    x = np.linspace(2, -2, vocab)
    weights = np.exp(x)
    table = x[None, :] - np.log(weights.sum() + weights * (np.exp(boost) - 1))[:, None]
    np.fill_diagonal(table, table.diagonal() + boost)

    def states(windows: np.ndarray, first: int) -> np.ndarray:
        return windows[:, first - 1 : -1] if first else np.hstack([np.full((len(windows), 1), vocab - 2), windows[:, :-1]])

    return TableScorer(table, states)
