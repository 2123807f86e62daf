"""The tree of pieces against sums over spellings, and its coding against a decoder."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import evaluation as E
from strandworks.operators import trie as T
from strandworks.operators.coding import Decoder, Encoder, quantise

PIECES = ["N", "<a>", "A", "AC", "ACG", "ACT", "ACTN", "TT", "<b>", "C"]


def probabilities(pieces, rows, seed=5):
    return np.random.default_rng(seed).dirichlet(np.ones(len(pieces)), rows)


@pytest.mark.parametrize("pieces", [PIECES, ["A", "<x>"], ["<x>", "GG"], [*map("".join, itertools.product("NAGCT", repeat=2)), "N", "A", "<e>"]])
def test_masses_against_sums_over_spellings(pieces):
    tree, p = T.PieceTree(pieces), probabilities(pieces, 4)
    under, exact, other = tree.masses(p)
    plain = [i for i, x in enumerate(pieces) if x[0] != "<"]
    assert sorted(tree.prefixes) == sorted({pieces[i][:n] for i in plain for n in range(len(pieces[i]) + 1)})
    for j, prefix in enumerate(tree.prefixes):
        assert np.allclose(under[:, j], sum(p[:, i] for i in plain if pieces[i].startswith(prefix)))
        assert np.allclose(exact[:, j], sum([p[:, i] for i in plain if pieces[i] == prefix], np.zeros(4)))
    assert np.allclose(other, p.sum(1) - p[:, plain].sum(1))


def test_steps_multiply_to_the_pieces_share(spark):
    tree, plain = T.PieceTree(PIECES), [i for i, x in enumerate(PIECES) if x[0] != "<"]
    p = probabilities(PIECES, len(plain))
    rows = spark.createDataFrame([(k, p[k].tolist(), i) for k, i in enumerate(plain)], "key int, p array<double>, target int")
    symbols = {}
    for m in (None, 1, 2, 3, 4, 5):
        product, got = dict.fromkeys(range(len(plain)), 1.0), T.target_steps(rows, tree, m).collect()
        for r in got:
            product[r.key] *= r.p
            assert 0 <= r.symbol < r.width
        assert np.allclose([product[k] for k in range(len(plain))], [p[k, i] for k, i in enumerate(plain)])
        symbols[m] = {(PIECES[plain[r.key]], r.step): (r.symbol, r.width) for r in got}
    # letters: 0 ends, N A G C T are 1 to 5; the longest piece needs no end
    assert [symbols[None]["ACG", s][0] for s in range(4)] == [2, 4, 3, 0] and ("ACTN", 3) in symbols[None] and ("ACTN", 4) not in symbols[None]
    # twos: reserved, 5 that end after one, 25 after two, 25 that go on
    assert symbols[2]["A", 0] == (2, 56) and symbols[2]["AC", 0] == (6 + 1 * 5 + 3, 56) and symbols[2]["ACTN", 0] == (31 + 8, 56) and symbols[2]["ACTN", 1] == (5 + 4 * 5, 30)
    assert symbols[3]["ACTN", 1] == (0, 5) and symbols[4]["ACTN", 0][1] == 1 + 5 + 25 + 125 + 625 == symbols[5]["ACTN", 0][1]


def test_reserved_targets_are_refused():
    with pytest.raises(ValueError):
        list(T.PieceTree(PIECES).steps(probabilities(PIECES, 1), np.array([1]), 1, True))


@pytest.mark.parametrize("m", [None, 1, 2, 3])
def test_coded_along_the_tree_and_decoded(monkeypatch, m):
    monkeypatch.setattr(T, "HELD", 40)
    tree, plain = T.PieceTree(PIECES), [i for i, x in enumerate(PIECES) if x[0] != "<"]
    p = probabilities(PIECES, 300)
    target = np.random.default_rng(6).choice(plain, 300)
    lo, hi = T.TreeSteps(tree, m).intervals(p, target, 1 << 15)
    e = Encoder()
    e.encode_all(lo[lo >= 0], hi[lo >= 0], 1 << 15)
    d = Decoder(e.finish())
    wanted = {}
    for step, rows, masses, symbol in tree.steps(p, target, m or 1, m is None):
        for r, x, s in zip(rows.tolist(), masses, symbol.tolist()):
            wanted[r, step] = (quantise(x[None], 1 << 15)[0], s)
    for key in sorted(wanted):
        assert d.decode(wanted[key][0]) == wanted[key][1]


def test_tree_coding_in_the_evaluation(spark):
    letters, pieces = "ACGTN", [*map("".join, itertools.product("ACGTN", repeat=3)), "<p>", "<q>"]
    df = spark.createDataFrame([("a", "ACGTN" * 300), ("b", "GGC")], "source_name string, seq string")
    blocks = E.symbol_blocks(df, ["source_name"], 3, letters, None)
    codings = {"whole": None, "letters": T.TreeSteps(T.PieceTree(pieces, letters)), "twos": T.TreeSteps(T.PieceTree(pieces, letters), 2)}
    r = E.evaluate(blocks, ["source_name"], [E.Mode("non_overlap", 32)], E.repeat_scorer(127), 127, 125, 1 << 15, codings)
    rows = {(x.source_name, x.coding): x for x in E.per_source(r, ["source_name"], 3, False).collect()}
    assert {rows["a", c].emitted for c in codings} == {500, 1500, 1000} and {rows["b", c].symbols for c in codings} == {1}
    for c in codings:
        # floors and ends that never happen cost some bits; the mass of reserved tokens costs the first step
        assert abs(8 * rows["a", c].coded_bytes - rows["a", c].bits) < 0.02 * rows["a", c].bits + 128


def test_large_vocabulary_in_time(spark):
    """V = 19,564 over 10,000 rows: only targets' steps leave the tasks."""
    pieces = ["".join(x) for k in range(1, 7) for x in itertools.product("NAGCT", repeat=k)]
    pieces += [f"<r{i}>" for i in range(19_564 - len(pieces))]
    tree = T.PieceTree(pieces)
    v = len(pieces)
    rows = spark.range(10_000, numPartitions=8).select(F.col("id").alias("key"), (F.col("id") * 7 % 19_530).cast("int").alias("target"), F.transform(F.sequence(F.lit(1), F.lit(v)), lambda i: F.lit(1.0) / v).alias("p"))
    began = time.time()
    s = T.target_steps(rows, tree).groupBy("key").agg(F.sum(F.log("p")).alias("x")).agg(F.count("*"), F.min("x"), F.max("x")).first()
    assert time.time() - began < 60
    assert s[0] == 10_000 and np.allclose([s[1], s[2]], -np.log(v))
