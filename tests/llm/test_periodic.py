import random
import time

import brute_force
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.llm import periodic

RESULT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repetitive(rng):
    letters, words = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])], []
    while rng.random() < 0.8 and len(words) < 150:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return rng.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize("slab", [8, 1 << 16])
def test_groups_against_brute_force(monkeypatch, slab):
    monkeypatch.setattr(periodic, "SLAB", slab)
    rng = random.Random(slab)
    rows = [(i, repetitive(rng)) for i in range(600)]
    texts = [t.encode() for _, t in rows]
    out = periodic._group([i for i, _ in rows], np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), True)
    assert [(r[0], *r[2:7], *r[8:]) for r in out] == [brute_force.periodic(*r) for r in rows]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, repetitive(rng)) for i in range(600)]
    got = [tuple(r[c] for c in RESULT) for r in spark.createDataFrame(rows, "doc_id long, text string").transform(lambda d: periodic.periodic_runs(d, planted=True)).collect()]
    assert sorted(got) == sorted(brute_force.periodic(*r) for r in rows)


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for m in (2, 8, 256):
        a = rng.integers(0, periodic.PRIME, (m, 3), dtype=np.uint64)
        assert (periodic.backward(periodic.forward(a)) == (a.astype(object) * m % periodic.PRIME).astype(np.uint64)).all()
    x = rng.integers(0, 3, 200, dtype=np.uint64)
    for block in (1, 2, 4, 8):
        j, q = periodic.zero_mismatches(x, 160, block)
        want = [(b, d) for b in range(160 // block) for d in range(block, 2 * block) if (x[b * block : (b + 1) * block] == x[b * block + d : (b + 1) * block + d]).all()]
        assert sorted(zip(j.tolist(), q.tolist())) == want


def test_sums_that_are_zero_by_the_modulus_alone_are_found_out():
    x = np.array([1, 2] * 8 + [7, 2] + [1, 2] * 8 + [9], np.uint64)
    got = list(periodic._settled(x, 2, np.array([0]), np.array([15]), np.array([2])))
    assert got == [(0, 14, 2), (18, 32, 2)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 9), (5, "x"), (5, "a b " * 5), (5, "a b " * 5), (7, "é ü " * 8 + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "n_runs": F.lit(None).cast("string"), "period": F.lit(1)})
    got = [tuple(r[c] for c in RESULT) for r in periodic.periodic_runs(docs, planted=True).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute_force.periodic(*r)) for r in rows)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_one_word_repeated_takes_no_quadratic_time(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "la " * n), (2, "ab cd " * (n // 2) + "ab x")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodic.periodic_runs(docs).collect()}
    assert got == {1: (1, 0, n, 1), 2: (1, 0, n + 1, 2)}
    assert time.time() - began < 60
