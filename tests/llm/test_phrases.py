import random
from collections import Counter

import brute_force
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandworks.llm import automata as A
from strandworks.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def automaton(counts):
    entries = sorted(counts)
    label, vocabulary = A.ranked(pa.array([x for e in entries for x in e if x], pa.binary()))
    w = np.zeros((len(entries), 3), np.int64)
    w[np.array([[bool(x) for x in e] for e in entries])] = label
    return A.Automaton.of(vocabulary, *A.summed(w, np.array([counts[e] for e in entries], np.int64)))


def test_build_unite_compose(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        monkeypatch.setattr(A, "SLICE", rng.choice([1, 3, 1 << 16]))
        monkeypatch.setattr(A, "HELD", rng.choice([1, 5, 1 << 20]))
        shards, total = [], Counter()
        for _ in range(rng.randrange(1, 6)):
            c = Counter()
            for _ in range(rng.randrange(1, 60)):
                k = rng.randrange(1, 4)
                c[tuple(rng.choice(["a", "b", "é", "zz", "a\x01", "c d"]).encode() for _ in range(k)) + (b"",) * (3 - k)] += rng.choice([1, 1, 2, 5 << 40])
            total += c
            shards.append(A.Automaton.loads(automaton(c).dumps()))
        vocabulary, w, c = A.united(shards)
        words = [b"", *vocabulary.to_pylist()]
        got = {tuple(words[i] for i in row): n for row, n in zip(w.tolist(), c.tolist())}
        assert got == total and list(got) == sorted(got)
        one = A.Automaton.of(vocabulary, w, c)
        asked = [(b"a", b"b", b""), (b"zz", b"", b""), (b"a", b"a", b"a"), (b"q", b"", b""), *total]
        rows = np.where([[not x for x in e] for e in asked], 0, one.labels_of(pa.array([x for e in asked for x in e], pa.large_binary())).reshape(-1, 3))
        assert one.composed(rows).tolist() == [total.get(e, 0) for e in asked]


def test_equal_states_are_stored_once():
    tails = {(b"x",): 1, (b"y",): 2}
    a = automaton({(f"w{i}".encode(), b"m", t[0]): n for i in range(50) for t, n in tails.items()})
    assert len(a.label3) == 2 and len(a.label2) == 1 and len(a.label1) == 50


def texts(rng, n):
    words = "a b c d e f the of and x1 é ſ a\x01 İ".split(" ")
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words[: rng.choice([3, 8, 14])]) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "EN", None, "und", "de"]), rng.choice([t, t, t.upper(), "the of and " * rng.randrange(12)])))
    return out


@pytest.mark.parametrize("shard,tasks", [(1_500_000, 3), (50, 7), (1, 2)])
def test_against_brute_force(spark, monkeypatch, shard, tasks):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    rng = random.Random(shard)
    rows = texts(rng, 60 if shard > 1 else 25)
    monkeypatch.setattr(phrases, "partitions", lambda _: tasks)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumns({"a": F.lit(1), "phrase": F.lit("x"), "rank": F.lit(None).cast("string")})
    got = [tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, least=3, top=40).collect()]
    want = brute_force.collocations(rows, least=3, top=40)
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_odd_rows(spark):
    long = "very long text of words " * 20_000
    rows = [(None, None), ("en", None), ("en", ""), ("en", " ,.\n"), ("de", long), ("de", long), (None, "one two " * 10), ("und", "one two")]
    got = [tuple(r[c] for c in COLUMNS) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()]
    assert sorted(got) == sorted(brute_force.collocations(rows))
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits():
    a, l, r = (np.array([x], np.int64) for x in (3_000_000_000, 7_000_000_001, 5_000_000_003))
    assert phrases._ratio(a, l, r).tolist() == [1_000_000 * 3_000_000_000**2 // (7_000_000_001 * 5_000_000_003)]
