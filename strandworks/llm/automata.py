"""Weighted acyclic automata over phrases of up to three words: count transducers that are built, united, cut and composed.

An automaton reads three labels (0 where a phrase has ended) and gives a weight. Labels are places in its own sorted vocabulary, from 1. Entries come
in sorted order; once the order has passed a prefix its state is closed, and a closed state whose arcs are those of a
registered one is that one (by a 128-bit sum of its arcs' hashes), so what n-grams share behind their prefixes is stored once.
Work is done on slices of entries by array operations; between slices only the last first word stays open.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from strandworks.llm.common import U64, mix

#: Entries that a builder closes at a time.
SLICE = 1 << 16
#: Entries that are held before automata are summed up.
HELD = 1 << 20


def _small(a: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _packed(w: np.ndarray) -> np.ndarray:
    """One number for each row of three labels, in the rows' order."""
    bits = int(w.max()).bit_length() if len(w) else 1
    w = w.astype(U64)
    if 3 * bits <= 64:
        return (w[:, 0] << U64(2 * bits)) | (w[:, 1] << U64(bits)) | w[:, 2]
    _, pair = np.unique((w[:, 0] << U64(32)) | w[:, 1], return_inverse=True)
    return (pair.astype(U64) << U64(32)) | w[:, 2]


def summed(w: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their weights."""
    if not len(w):
        return w, weights
    key = _packed(w)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return w[order[head]], np.add.reduceat(weights[order], head)


def ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's label and the sorted vocabulary; bytes decide the order."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    label = np.empty(len(order), np.int64)
    label[order.to_numpy()] = np.arange(1, len(order) + 1)
    return label[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64), coded.dictionary.take(order)


def _register(known: dict, signatures: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state of each signature, and which of them are new (the first of each)."""
    order = np.lexsort(signatures.T)
    s = signatures[order]
    head = np.append(True, (s[1:] != s[:-1]).any(1))
    first = np.minimum.reduceat(order, np.flatnonzero(head))
    ids, new = np.empty(len(first), np.int64), np.zeros(len(signatures), bool)
    rank = np.argsort(first)  # states are numbered in the order that they close
    for k, sig in zip(rank.tolist(), map(tuple, signatures[first[rank]].tolist()), strict=True):
        at = known.get(sig)
        if at is None:
            at = known[sig] = len(known)
            new[first[k]] = True
        ids[k] = at
    out = np.empty(len(order), np.int64)
    out[order] = ids[np.cumsum(head) - 1]
    return out, new


def _signatures(label: np.ndarray, value: np.ndarray, heads: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = mix(mix(label.astype(U64) + U64(1)) + value.astype(U64))
        b = mix(a ^ U64(0x5851F42D4C957F2D))
        return np.stack([np.add.reduceat(a, heads), np.add.reduceat(b, heads)], axis=1)


class Builder:
    """Takes sorted distinct entries, slice after slice."""

    def __init__(self):
        self.known2, self.known1 = {}, {}
        self.parts = {k: [] for k in ("size2", "label3", "weight", "size1", "label2", "target2", "label1", "target1")}
        self.open = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))

    def add(self, w: np.ndarray, weights: np.ndarray) -> None:
        """Close the states of all first words but the last, which may go on."""
        w, weights = np.concatenate([self.open[0], w]), np.concatenate([self.open[1], weights])
        ready = int(np.searchsorted(w[:, 0], w[-1, 0])) if len(w) else 0
        self.open = w[ready:], weights[ready:]
        if ready:
            self._close(w[:ready], weights[:ready])

    def _close(self, w: np.ndarray, weights: np.ndarray) -> None:
        put = lambda k, a: self.parts[k].append(a)
        two = np.flatnonzero(np.append(True, (w[1:, :2] != w[:-1, :2]).any(1)))
        size2 = np.diff(np.append(two, len(w)))
        state2, new = _register(self.known2, _signatures(w[:, 2], weights, two), size2)
        stored = np.repeat(new, size2)
        put("size2", size2[new]), put("label3", w[stored, 2]), put("weight", weights[stored])
        w = w[two]
        one = np.flatnonzero(np.append(True, w[1:, 0] != w[:-1, 0]))
        size1 = np.diff(np.append(one, len(w)))
        state1, new = _register(self.known1, _signatures(w[:, 1], state2, one), size1)
        stored = np.repeat(new, size1)
        put("size1", size1[new]), put("label2", w[stored, 1]), put("target2", state2[stored])
        put("label1", w[one, 0]), put("target1", state1)

    def finish(self, vocabulary: pa.Array) -> Automaton:
        if len(self.open[0]):
            self._close(*self.open)
        self.open = self.open[0][:0], self.open[1][:0]
        return Automaton(vocabulary, {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in self.parts.items()})


class Automaton:
    def __init__(self, vocabulary: pa.Array, arrays: dict[str, np.ndarray]):
        self.vocabulary, self.arrays = vocabulary, arrays
        a = {k: v.astype(np.int64) for k, v in arrays.items()}
        self.label1, self.target1, self.label2, self.target2, self.label3, self.weight = (a[k] for k in ("label1", "target1", "label2", "target2", "label3", "weight"))
        self.at1, self.at2 = (np.concatenate([[0], np.cumsum(a[k])]).astype(np.int64) for k in ("size1", "size2"))

    @staticmethod
    def of(vocabulary: pa.Array, w: np.ndarray, weights: np.ndarray) -> Automaton:
        """From sorted distinct entries; of the vocabulary only what they use is kept."""
        used = np.zeros(len(vocabulary) + 1, bool)
        used[w] = True
        used[0] = True
        w = (np.cumsum(used) - 1)[w]
        b = Builder()
        for i in range(0, len(w), SLICE):
            b.add(w[i : i + SLICE], weights[i : i + SLICE])
        return b.finish(vocabulary.filter(pa.array(used[1:])))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows of labels in order, and their weights."""
        w1, s1 = self.label1, self.target1
        n = self.at1[s1 + 1] - self.at1[s1]
        arc = np.repeat(self.at1[s1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        w1, w2, s2 = np.repeat(w1, n), self.label2[arc], self.target2[arc]
        n = self.at2[s2 + 1] - self.at2[s2]
        arc = np.repeat(self.at2[s2] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.stack([np.repeat(w1, n), np.repeat(w2, n), self.label3[arc]], axis=1), self.weight[arc]

    def dumps(self) -> bytes:
        words = self.vocabulary.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = words.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(words) else b""
        return zstandard.compress(pickle.dumps(({k: _small(v) for k, v in self.arrays.items()}, _small(np.diff(offsets)), data), 5), 1)

    @staticmethod
    def loads(data: bytes) -> Automaton:
        arrays, sizes, words = pickle.loads(zstandard.decompress(data))
        offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).astype(np.int64)
        return Automaton(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(words)]), arrays)

    def labels_of(self, words: pa.Array) -> np.ndarray:
        """Each word's label here, -1 for unknown ones."""
        at = pc.index_in(words, self.vocabulary)
        return at.fill_null(-2).to_numpy().astype(np.int64) + 1

    def composed(self, w: np.ndarray) -> np.ndarray:
        """The weights of rows of this automaton's labels: state by state along their arcs; 0 where there is no such path."""
        span = len(self.vocabulary) + 1
        at = np.searchsorted(self.label1, w[:, 0])
        ok = (at < len(self.label1)) & (w >= 0).all(1)
        ok &= self.label1[np.where(ok, at, 0)] == w[:, 0] if len(self.label1) else False
        state = self.target1[np.where(ok, at, 0)] if len(self.label1) else at
        for label, place, target, k in ((self.label2, self.at1, self.target2, 1), (self.label3, self.at2, self.weight, 2)):
            arcs = np.repeat(np.arange(len(place) - 1), np.diff(place)) * span + label
            asked = state * span + w[:, k]
            at = np.searchsorted(arcs, asked)
            ok &= at < len(arcs)
            at = np.where(ok, at, 0)
            ok &= arcs[at] == asked if len(arcs) else False
            state = target[at] if len(arcs) else at
        return np.where(ok, state, 0)


def united(automata: Iterable[Automaton]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Vocabulary, entries and weights of the union; weights of equal entries are summed. Held: the union and ``HELD`` entries more."""
    held: list[tuple] = []
    n = 0

    def merge() -> tuple:
        words = pa.concat_arrays([v.cast(pa.large_binary()) for v, _, _ in held])
        label, vocabulary = ranked(words)
        label, at, rows = np.concatenate([[0], label]), 0, []
        for v, w, _ in held:
            rows.append(np.where(w > 0, label[w + at], 0))
            at += len(v)
        return (vocabulary, *summed(np.concatenate(rows), np.concatenate([c for _, _, c in held])))

    for a in automata:
        w, c = a.entries()
        held.append((a.vocabulary, w, c))
        n += len(w)
        if n > max(HELD, 2 * len(held[0][1])):
            held = [merge()]
            n = len(held[0][1])
    if not held:
        return pa.array([], pa.large_binary()), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return merge()
