"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A text's lines (split at ``\\n``) are a chain of two states. A line's features are counts of character kinds, words and
repeats as shares, its neighbours' shares beside its own, and whether it is first or last. Forward-backward gives each
line's probability of being good; the document's score is their mean, weighted by the lines' bytes plus one.

Fitting: every line of a labelled document takes the document's label. At most ``TRAIN_DOCS`` labelled ids, those of the smallest hashes,
are fitted on, with their texts of at most ``TRAIN_LINES_EACH`` lines, ``TRAIN_DOCS`` rows again at most: the bounded sample, fetched by
one broadcast look-up and a scan. Features are made where the rows are; the driver gets those of the sample (52 MB at the
most) and fits some seventy numbers. Everything is scored: whole texts, no shuffle, one pass. Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text is one empty line and has a score; labels that are null, or that disagree for an id, are left out;
without labels of both kinds the scores are all (1 + good) / (2 + all labels); repeated rows are scored one by one; a null id is never
held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import SPACED_WORD, groups_of, mix, narrow, parted, utf8, words_of

#: Bounds of the sample that is fitted on: labelled documents, lines of each, lines of all.
TRAIN_DOCS, TRAIN_LINES_EACH, TRAIN_LINES = 4_000, 128, 200_000
#: Bytes of text that are looked at together.
GROUP_BYTES = 4 << 20

# --- features ------------------------------------------------------------------------------------

_KINDS = (
    ("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("space", (0x20, 0x09, 0x0B, 0x0C, 0x0D)),
    ("stop", b".?"), ("shout", b"!"), ("comma", b",;:"), ("bar", b"|"), ("symbol", b"#*$%&"), ("angle", b"<>{}[]"), ("slash", b"/\\=+_~^`"),
    ("quote", b"'\"()-"), ("lead", range(0xC0, 0x100)), ("more", range(0x80, 0xC0)),
)
KINDS = [k for k, _ in _KINDS]
_KIND = np.full(256, len(KINDS), np.int64)  # the last kind: control characters and what else there is
for _i, (_, _chars) in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
FEATURES = [*KINDS, "control", "length", "words", "word_length", "short_words", "long_words", "repeated_windows", "earlier_windows", "distinct_words", "empty"]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of ``FEATURES`` for each line, each line's bytes, and each text's number of lines."""
    data, offsets = parted(data, offsets, 0x0A)
    end = np.flatnonzero(data == 0x0A)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    n, size = len(end), end - start
    lines = np.diff(np.searchsorted(end, offsets))
    of_line = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(of_line * 16 + _KIND[data], minlength=n * 16).reshape(n, 16)[:, : len(KINDS) + 1]
    kinds[:, -1] -= 1  # the line's own end
    out = np.zeros((n, len(FEATURES)), np.float32)
    out[:, : len(KINDS) + 1] = kinds / np.maximum(size, 1)[:, None]
    # words, and windows of three that occur again in their text
    a, b = words_of(data, SPACED_WORD)
    line, text = of_line[a], np.searchsorted(offsets, a, "right") - 1
    words = np.bincount(line, minlength=n)
    per = lambda mask: np.bincount(line[mask], minlength=n) / np.maximum(words, 1)
    packed = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)), pa.py_buffer(data[SPACED_WORD[data]])])
    ids = packed.dictionary_encode().indices.to_numpy().astype(np.uint64)
    again, earlier = np.zeros(len(a), bool), np.zeros(len(a), bool)
    if len(a) > 2:
        same = text[2:] == text[:-2]
        with np.errstate(over="ignore"):
            window = mix(mix(mix(ids[:-2] + np.uint64(1)) + ids[1:-1]) + ids[2:]) + text[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(same)
        order = at[np.argsort(window[at], kind="stable")]
        tie = window[order][1:] == window[order][:-1]
        earlier[order[1:]] = tie
        again[order[1:]] = tie
        again[order[:-1]] |= tie
    pair = np.unique(line * (int(ids.max()) + 1 if len(ids) else 1) + ids.astype(np.int64))
    distinct = np.bincount(pair // (int(ids.max()) + 1 if len(ids) else 1), minlength=n)
    length = b - a
    rest = [
        np.log1p(size) / 8, np.log1p(words) / 6, np.minimum((size - kinds[:, KINDS.index("space")]) / np.maximum(words, 1), 40) / 20,
        per(length <= 3), per(length >= 12), per(again), per(earlier), distinct / np.maximum(words, 1), size == 0,
    ]
    out[:, len(KINDS) + 1 :] = np.stack(rest, axis=1)
    return out, size, lines


def chained(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and behind it (zeros at a text's ends), first, last, and one."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, behind, ends = np.zeros_like(x), np.zeros_like(x), np.zeros((len(x), 3), x.dtype)
    before[1:], behind[:-1] = x[:-1], x[1:]
    before[first], behind[last] = 0, 0
    ends[first, 0], ends[last, 1], ends[:, 2] = 1, 1, 1
    return np.hstack([x, before, behind, ends])


# --- the chain -----------------------------------------------------------------------------------


def _step(x: np.ndarray, one: tuple[float, float], zero: tuple[float, float]) -> np.ndarray:
    """log of (e^(x + one[0]) + e^one[1]) / (e^(x + zero[0]) + e^zero[1])."""
    return np.logaddexp(x + one[0], one[1]) - np.logaddexp(x + zero[0], zero[1])


class Chains:
    """The lines of texts in the order that the messages take: all first lines, all second ones, ..."""

    def __init__(self, lines: np.ndarray):
        rank = np.empty(len(lines), np.int64)
        rank[np.argsort(-lines, kind="stable")] = np.arange(len(lines))
        text = np.repeat(np.arange(len(lines)), lines)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
        self.order = np.lexsort((rank[text], step))
        self.active = np.bincount(step) if len(step) else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)

    def messages(self, odds: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good by what lies before each line and itself, and by what lies behind it; ``t[i, j]`` is the score of j after i."""
        e = odds[self.order]
        a, b = e.copy(), np.zeros_like(e)
        for k in range(1, len(self.active)):
            lo, n = self.begin[k], self.active[k]
            a[lo : lo + n] += _step(a[self.begin[k - 1] : self.begin[k - 1] + n], (t[1, 1], t[0, 1]), (t[1, 0], t[0, 0]))
        for k in range(len(self.active) - 2, -1, -1):
            lo, n = self.begin[k + 1], self.active[k + 1]
            b[self.begin[k] : self.begin[k] + n] = _step(e[lo : lo + n] + b[lo : lo + n], (t[1, 1], t[1, 0]), (t[0, 1], t[0, 0]))
        return a, b

    def marginals(self, odds: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        a, b = self.messages(odds, t)
        out = np.empty(len(odds))
        out[self.order] = 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))
        return out

    def expected_pairs(self, odds: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and the weighted expected number of neighbours (i, j); ``weight`` is a line's own."""
        a, b = self.messages(odds, t)
        e, w, pairs = odds[self.order], weight[self.order], np.zeros((2, 2))
        for k in range(1, len(self.active)):
            lo, n, up = self.begin[k], self.active[k], self.begin[k - 1]
            here, there = a[up : up + n], e[lo : lo + n] + b[lo : lo + n]
            score = np.stack([np.full(n, t[0, 0]), there + t[0, 1], here + t[1, 0], here + there + t[1, 1]])
            p = np.exp(score - score.max(0))
            pairs += (p / p.sum(0) * w[lo : lo + n]).sum(1).reshape(2, 2)
        out = np.empty(len(odds))
        out[self.order] = 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))
        return out, pairs


# --- fitting -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray  # (2, 2)
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return chained(np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32), lines) @ self.weights


def gradient(x: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, w: np.ndarray, t: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted log likelihood of lines' labels ``y``, whose weighted neighbours (i, j) are ``pairs``, less the penalty."""
    p, expected = chains.expected_pairs(x @ w, t, weight)
    return x.T @ ((y - p) * weight) - ridge * w, pairs - expected - ridge * t


def fit(features: list[np.ndarray], labels: list[int], steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Fit by Adam on texts' line features and labels; a text weighs one, however many lines it has."""
    width = len(FEATURES)
    counts, y = np.array([len(f) for f in features], np.int64), np.array(labels, float)
    if len(set(labels)) < 2:
        w = np.zeros(3 * width + 3)
        w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Model(w, np.zeros((2, 2)), np.zeros(width), np.ones(width))
    x = np.vstack(features).astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    chains, per_line = Chains(counts), np.repeat(1 / counts / len(counts), counts)
    x = chained(np.clip((x - mean) / scale, -6, 6).astype(np.float32), counts)
    of_line = np.repeat(y, counts)
    # the neighbours of a text are all of its own label
    same = ((counts - 1) / counts / len(counts))
    pairs = np.array([[(same * (1 - y)).sum(), 0], [0, (same * y).sum()]])
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        gw, gt = gradient(x, chains, of_line, per_line, pairs, params[:-4], params[-4:].reshape(2, 2), ridge)
        g = np.concatenate([gw, gt.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params += rate * min(1.0, 3 * (1 - k / (steps + 1))) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return Model(params[:-4], params[-4:].reshape(2, 2), mean, scale)


def held_out(doc_id: Column) -> Column:
    """Whether an id's labels are kept from fitting."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labelled documents that are not held out, from the bounded sample."""
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    ids = ids.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    chosen = one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups_of(offsets, GROUP_BYTES):
                x, _, lines = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.concatenate([[0], np.cumsum(lines)])
                good = [i for i in range(hi - lo) if lines[i] <= TRAIN_LINES_EACH]
                cols = [batch.column(0)[lo:hi].take(pa.array(good, pa.int64())), batch.column(2)[lo:hi].take(pa.array(good, pa.int64())), pa.array([x[at[i] : at[i + 1]].tobytes() for i in good], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "label", "x"])

    # the ids are TRAIN_DOCS at the most, which bounds what is broadcast
    found = narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("x")).limit(TRAIN_DOCS).select("label", "x").collect()
    features = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows]
    most = int(np.searchsorted(np.cumsum([len(f) for f in features]), TRAIN_LINES, "right"))
    return fit(features[:most], [r["label"] for r in rows[:most]])


# --- scoring -------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, line_scores`` of each row: the document's and its lines' probabilities of being good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups_of(offsets, GROUP_BYTES):
                x, size, lines = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p = Chains(lines).marginals(model.odds(x, lines), model.moves)
                at = np.concatenate([[0], np.cumsum(lines)])
                whole = np.add.reduceat(p * (size + 1), at[:-1]) / np.add.reduceat(size + 1.0, at[:-1])
                each = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(p))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.clip(whole, 0, 1)), each], ["doc_id", "score", "line_scores"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, line_scores array<double>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document under a model of the labels that are not held out."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
