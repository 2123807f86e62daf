"""The tree of a vocabulary's pieces as flat arrays, and the coding of tokens along its paths.

Nodes are numbered level by level, in the order of their spelling, so a node's children stand side by side and the mass at or under all nodes is
one segment sum for each level, from the deepest up. The tree is made once and broadcast; rows of probabilities stay in their task,
and only the target's steps leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.operators.coding import OTHER, quantise

#: Masses that are held at a time.
HELD = 1 << 22
#: Nodes of a tree at most: what is broadcast takes some 100 bytes for each.
NODES = 1 << 22


class PieceTree:
    """``pieces`` in the order of their ids; ``<...>`` are reserved. Depth 0 is the root."""

    def __init__(self, pieces: list[str], letters: str = "NAGCT"):
        self.letters, self.vocab = letters, len(pieces)
        plain = [i for i, p in enumerate(pieces) if not re.fullmatch("<.*>", p)]
        self.plain, self.reserved = np.array(plain, np.int64), np.setdiff1d(np.arange(len(pieces)), plain)
        rank = {c: i for i, c in enumerate(letters)}
        spelled = [tuple(rank[c] for c in pieces[i]) for i in plain]
        self.longest = max(map(len, spelled), default=0)
        levels = [sorted({s[:d] for s in spelled if len(s) >= d} | ({()} if d == 0 else set())) for d in range(self.longest + 1)]
        self.level = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)
        if self.level[-1] > NODES:
            raise ValueError(f"a tree has at most {NODES} nodes")
        at = {s: i for i, s in enumerate(s for x in levels for s in x)}
        self.prefixes = ["".join(letters[c] for c in s) for s in at]
        #: For each node its child by letter, -1 where there is none.
        self.child = np.full((len(at) + 1, len(letters)), -1, np.int64)
        for s, i in at.items():
            if s:
                self.child[at[s[:-1]], s[-1]] = i
        self.node = np.array([at[s] for s in spelled], np.int64)
        #: For each id its letters (-1 behind the last), its length (-1: reserved) and its node.
        self.spelling = np.full((len(pieces), max(self.longest, 1)), -1, np.int64)
        self.length, self.node_of = np.full(len(pieces), -1, np.int64), np.full(len(pieces), -1, np.int64)
        for i, s in zip(plain, spelled, strict=True):
            self.spelling[i, : len(s)], self.length[i], self.node_of[i] = s, len(s), at[s]

    def masses(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mass at or under each node, mass at it, and mass of the reserved pieces, of rows of probabilities; one more column of zeros stands for what is no node."""
        exact = np.zeros((len(p), len(self.prefixes) + 1))
        exact[:, self.node] = p[:, self.plain]
        under = exact.copy()
        for d in range(self.longest - 1, -1, -1):
            nodes = np.arange(self.level[d], self.level[d + 1])
            many = (self.child[nodes] >= 0).sum(1)
            nodes, many = nodes[many > 0], many[many > 0]
            first = np.cumsum(many) - many
            under[:, nodes] += np.add.reduceat(under[:, self.level[d + 1] : self.level[d + 2]], first, axis=1)
        return under, exact, p[:, self.reserved].sum(1)

    def steps(self, p: np.ndarray, target: np.ndarray, m: int, stops: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``step, rows, masses, symbols``: the steps of the targets, those of each step together.

        With ``stops`` (m = 1) a step is one letter, and symbol 0 means "ends here" (at the root "reserved"); a piece of the
        greatest length needs no stop. Else a step is m letters: reserved (at the root only), then "ends after 1, 2, ... letters"
        number by number, then "goes on after m letters" if longer pieces can follow.
        """
        if (self.length[target] < 0).any():
            raise ValueError("only targets that are pieces of letters have steps; reserved ones do not")
        under, exact, other = self.masses(p)
        n, depth = len(self.letters), 0
        rows, node = np.arange(len(target)), np.zeros(len(target), np.int64)
        step = 0
        while len(rows):
            room, take, left = self.longest - depth, min(m, self.longest - depth), self.length[target[rows]] - depth
            below, parts, starts = node[:, None], [], []
            root = [other[rows, None]] if depth == 0 and not stops else []
            width = len(root)
            if stops:
                parts.append(exact[rows, node][:, None] + (other[rows, None] if depth == 0 else 0))
                width = 1
            for c in range(1, take + 1):
                below = self.child[below].reshape(len(rows), -1)  # -1 is the row of no node: its children are -1 again
                starts.append(width)
                if not stops:
                    parts.append(exact[rows[:, None], below])
                    width += n**c
            starts.append(width)
            parts.append(under[rows[:, None], below] - (0 if stops else exact[rows[:, None], below]))
            if not stops and room <= m:
                parts.pop()
            number, ends = np.zeros(len(rows), np.int64), left <= take
            for j in range(take):
                number = np.where(j < left, number * n + self.spelling[target[rows], np.minimum(depth + j, self.longest - 1)], number)
            if stops:
                symbol = np.where(left == 0, 0, number + 1)
                goes = left > 0
            else:
                symbol = np.where(ends, np.array(starts)[np.clip(left, 1, take) - 1], starts[-1]) + number
                goes = ~ends
            yield step, rows, np.hstack(root + parts), symbol
            depth, step = depth + take, step + 1
            if depth >= self.longest:
                return
            step_to = below[np.arange(len(rows)), number]
            rows, node = rows[goes], step_to[goes]


class TreeSteps:
    """Coding of tokens along the tree, for ``evaluation.evaluate``: letter by letter, or m letters at a time."""

    def __init__(self, tree: PieceTree, m: int | None = None):
        self.tree, self.m, self.stops = tree, m or 1, m is None

    def intervals(self, p: np.ndarray, target: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """``cum_low, cum_high`` (rows, steps) of the targets; -1 where a row has no such step."""
        most = self.tree.longest + 1
        lo, hi = np.full((len(p), most), -1, np.int64), np.full((len(p), most), -1, np.int64)
        many = max(1, HELD // (len(self.tree.prefixes) + 1))
        for i in range(0, len(p), many):
            for step, rows, masses, symbol in self.tree.steps(p[i : i + many], target[i : i + many], self.m, self.stops):
                cum, at = quantise(np.where(masses.sum(1, keepdims=True) > 0, masses, 1.0), total), np.arange(len(rows))
                lo[i + rows, step], hi[i + rows, step] = cum[at, symbol], cum[at, symbol + 1]
        return lo, hi


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tree_of(vocabulary: DataFrame, letters: str = "NAGCT") -> PieceTree:
    """The tree of a vocabulary (piece, id) of ids 0, 1, ...; its size is checked before it is fetched."""
    rows = vocabulary.select("piece", "id").limit(NODES + 1).toPandas().sort_values("id")
    if rows["id"].tolist() != list(range(len(rows))):
        raise ValueError("ids of a vocabulary are 0, 1, 2, ...")
    return PieceTree(rows["piece"].tolist(), letters)


def subtree_masses(probs: DataFrame, tree: PieceTree) -> DataFrame:
    """``key, prefix, mass, exact`` from ``key, p`` (probabilities by id): a row for each node, and ``OTHER`` for what is reserved."""
    shared = probs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        names, nodes = pa.array([*t.prefixes, OTHER]), len(t.prefixes) + 1
        many = max(1, HELD // nodes)
        for batch in batches:
            for i in range(0, len(batch), many):
                part = batch.slice(i, many)
                under, exact, other = t.masses(_rows(part.column(1)))
                under[:, -1] = other
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), nodes)))
                prefix = names.take(pa.array(np.tile(np.arange(nodes), len(part))))
                yield pa.RecordBatch.from_arrays([keys, prefix, pa.array(under.ravel()), pa.array(exact.ravel())], ["key", "prefix", "mass", "exact"])

    return probs.select(F.col("key").cast("long").alias("key"), "p").mapInArrow(run, "key long, prefix string, mass double, exact double")


def target_steps(rows: DataFrame, tree: PieceTree, m: int | None = None) -> DataFrame:
    """``key, step, symbol, width, p`` of each row (key, p, target): the target's steps, by letters or by m of them, of which the p's product is the target's share."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        many = max(1, HELD // (len(t.prefixes) + 1))
        for batch in batches:
            for i in range(0, len(batch), many):
                part = batch.slice(i, many)
                for step, at, masses, symbol in t.steps(_rows(part.column(1)), part.column(2).to_numpy().astype(np.int64), m or 1, m is None):
                    whole, own = masses.sum(1), masses[np.arange(len(at)), symbol]
                    p = np.divide(own, whole, out=np.full(len(at), np.nan), where=whole > 0)
                    n = len(at)
                    cols = [part.column(0).take(pa.array(at)), pa.array(np.full(n, step, np.int32)), pa.array(symbol), pa.array(np.full(n, masses.shape[1])), pa.array(p, from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "step", "symbol", "width", "p"])

    return rows.select(F.col("key").cast("long").alias("key"), "p", "target").mapInArrow(run, "key long, step int, symbol long, width long, p double")
