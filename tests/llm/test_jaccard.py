import random

import brute_force
import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import jaccard


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        docs.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 40, 120, 300])))))
    k = n
    for _ in range(150):
        words = rng.choice(docs)[1].split()
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((k, rng.choice([str, str.upper])(rng.choice([" ", ", ", "\n"]).join(words))))
        k += 1
    return docs + [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "One!"), (905, "a " * 3000), (906, "a " * 50)]


def test_against_all_pairs(spark):
    for seed, block in ((1, jaccard.BLOCK), (2, 6)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("comp", F.lit(1)).repartition(4)
        got = jaccard.near_duplicates(df, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(brute_force.links(docs))


def test_keep_one_and_edge_rows(spark):
    t = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (None, t, "b"), (2, t + " y", "c"), (3, None, "d"), (4, "", "e"), (5, "other words", "f")], "doc_id long, text string, lang string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.lang) for r in kept.collect()) == [("1", "a"), ("3", "d"), ("4", "e"), ("5", "f")]
    got = {str(r.doc_id): (r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()}
    assert got["2"] == (1, 2) and got["None"] == (1, 2) and got["3"] == (3, 0)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    assert list(least) == sorted(least) and least[-1] / jaccard.HASHES < jaccard.THRESHOLD
    rng = np.random.default_rng(0)
    one = rng.integers(0, 256, jaccard.HASHES).astype(np.uint8)
    kept = {s: 0 for s in (0.3, 0.8, 0.9)}
    for s in kept:
        others = np.where(rng.random((2000, jaccard.HASHES)) < s, one, rng.integers(0, 256, (2000, jaccard.HASHES))).astype(np.uint8)
        kept[s] = len(jaccard.survivors(one, others))
    assert kept[0.3] == 0 and kept[0.8] == 2000 and kept[0.9] == 2000
    assert jaccard.pruning_loss(0.8) < 1e-6 and jaccard.pruning_loss(0.9) < 1e-11


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.v: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for x in list(up)}


def test_words_of_one_polynomial_hash_differ_and_long_texts_are_whole(spark):
    """Two words that collide under any polynomial modulo 2**64; texts that differ in their last words only; very long words."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    few = [f"q{i}" for i in range(11)]
    docs = [(0, " ".join([*few, word])), (1, " ".join([*few, other])), (2, word), (3, other)]
    long = " ".join(f"v{i % 700}x{i}" for i in range(40_000))
    docs += [(10, long), (11, long + " one more"), (12, long[: len(long) // 2]), (13, "z" * 300_000), (14, "z" * 300_001)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == sorted(brute_force.links(docs))


def test_query_against_all_pairs_of_given_texts(spark):
    """Recall and precision on the smallest given table, of all pairs by brute force."""
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    from strandworks.llm.queries import QUERIES

    got = sorted(map(tuple, QUERIES["op7_jaccard_join"](spark, sf).collect()))
    assert got == sorted(brute_force.links(docs))


def test_differences_give_intersections():
    rng = np.random.default_rng(2)
    pool = np.stack([np.arange(60), rng.integers(0, 2**60, 60)], 1).astype(np.uint64)
    pool[1::9, 0] = pool[::9, 0][: len(pool[1::9])]  # hashes that stand for two shingles
    pool = pool[np.argsort(pool[:, 0], kind="stable")]
    for _ in range(50):
        a, b = (pool[rng.random(60) < 0.5] for _ in range(2))
        have = {tuple(x) for x in b.tolist()}
        assert jaccard.absent(a, b).tolist() == [tuple(x) not in have for x in a.tolist()]
