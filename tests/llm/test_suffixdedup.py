import random
from unittest import mock

import brute_force
import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import anchors, suffixdedup


def corpus(seed, n=70):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    shared = [say(rng.choice([90, 99, 100, 101, 130, 400])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else say(rng.randrange(160)) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if docs and rng.random() < 0.3:  # a near copy
            text = list(rng.choice(docs)[1] or "")
            for _ in range(rng.randrange(4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("xyz")
            text = "".join(text)
        docs.append((i, text))
    return docs + [(500, None), (501, ""), (502, "a" * 1000), (503, "ab" * 300), (504, docs[3][1]), (505, "q" * 99), (506, "z" * 100)]


def test_against_brute_force(spark):
    for seed, held, strings, at_once in ((1, suffixdedup.HELD_ROWS, suffixdedup.HELD_STRINGS, anchors.HELD), (2, 5, 3, 4), (3, 50, 40, 1)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).repartition(4)
        with mock.patch.multiple(suffixdedup, HELD_ROWS=held, HELD_STRINGS=strings), mock.patch.object(anchors, "HELD", at_once):
            got = suffixdedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
        assert sorted(map(tuple, got)) == sorted(brute_force.repeated_bytes(docs))


def test_repeated_and_null_ids_and_empty_table(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(60)) + "0123456789" * 5
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "zz" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixdedup.dedup(df).collect())
    n = len(t)
    assert got == [("1", 0), ("1", 0), ("2", n), ("None", n)]
    assert suffixdedup.dedup(df.limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for n, top, lengths in ((500, 3, [500]), (500, 40, [200, 0, 1, 299]), (64, 1, [64]), (0, 1, [])):
        keys = rng.integers(0, top, (n, 6)).astype(np.uint64)
        order, shared = anchors.multikey_quicksort(lambda r, c: keys[r, c], 6, np.array(lengths, np.int64))
        at = 0
        for m in lengths:
            rows = [tuple(r) for r in keys[order[at : at + m]].tolist()]
            assert sorted(order[at : at + m].tolist()) == list(range(at, at + m)) and rows == sorted(rows)
            for i in range(1, m):
                assert shared[at + i] == next((c for c in range(6) if rows[i][c] != rows[i - 1][c]), 6)
            at += m


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    rule = anchors.Rule(100, 32, "later")
    shared = rng.integers(0, 4, 140)
    found = []
    for _ in range(5):
        lead = rng.integers(0, 4, rng.integers(0, 200))
        data = np.concatenate([lead, shared, rng.integers(0, 4, 50)]).astype(np.uint8)
        _, first, count, dist, h = anchors.runs(lambda a, b, data=data: anchors.byte_grams(data[a:b], 32), np.array([0, len(data)]), rule)
        at = {}
        for f, c, d, x in zip(first, count, dist, h, strict=True):
            for j in range(c):
                at[f + j - len(lead)] = (d - j, x)
        found.append([at[i] for i in range(41)])
    assert all(f == found[0] for f in found)


def test_long_texts_are_cut_into_stretches(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh é") for _ in range(9000))
    docs = [(0, long), (1, "x" + long[100:4000] + "y" + long[3900:]), (2, long[:150]), (3, "z" * 7000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    with mock.patch.object(anchors, "CHUNK", 512):
        got = suffixdedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force.repeated_bytes(docs))


def test_a_common_phrase_is_dealt_out(spark):
    """4,000 texts around one phrase of 95 bytes, too short to repeat by itself: no task has twice the median."""
    rng = random.Random(4)
    phrase = "".join(rng.choice("abcdefghijkl") for _ in range(95))
    noise = lambda: "".join(rng.choice("mnopqrstuvwxyz0123456789") for _ in range(150))
    docs = [(i, noise() + phrase + noise()) for i in range(4000)]
    df = spark.createDataFrame(docs, "rid long, text string").repartition(8)
    rule = anchors.Rule(100, 32, "later")
    marked = anchors.marks(df, rule, suffixdedup.encode, lambda c: anchors.byte_grams(c, 32), False, "phrase")
    around = suffixdedup.contexts(df, marked, rule)
    assert around.count() > 4000
    key = F.expr("substring(context, cast(dist as int) + 1)")
    ordered = around.repartitionByRange(8, key, "rid").sortWithinPartitions(key, "rid", "first")
    sizes = sorted(r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    out = suffixdedup.dedup(df.withColumnRenamed("rid", "doc_id"))
    want = sum(x[2] for x in brute_force.repeated_bytes(docs))  # by chance a few letters beside the phrase agree
    assert out.agg(F.sum("n_removed")).first()[0] == want


def test_words_of_one_polynomial_hash_differ(spark):
    """Two words that collide under any polynomial modulo 2**64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(0, word), (1, other), (2, "q" + word), (3, other[:500])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffixdedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force.repeated_bytes(docs))
