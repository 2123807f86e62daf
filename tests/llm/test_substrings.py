import random
from unittest import mock

import brute_force
import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import anchors, substrings


def corpus(seed, n=80):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("a b c d e f g é".split()) for _ in range(k)]
    shared = [say(rng.choice([33, 34, 35, 36, 50, 160])) for _ in range(8)]
    docs = []
    for i in range(n):
        words = [w for _ in range(rng.randrange(6)) for w in (rng.choice(shared) if rng.random() < 0.6 else say(rng.randrange(70)))]
        if docs and rng.random() < 0.3:  # a near copy
            words = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("xyz")
        docs.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    return docs + [(500, None), (501, ""), (502, "a " * 400), (503, "a b " * 100), (504, docs[3][1]), (505, " ".join("q" * 34)), (506, " ".join("z" * 35))]


def test_against_brute_force(spark):
    for seed, group, windows, at_once in ((1, substrings.GROUP, substrings.HELD_WINDOWS, anchors.HELD), (2, 4, 3, 4), (3, 30, 50, 1)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("n", F.lit(1)).repartition(4)
        with mock.patch.object(substrings, "HELD_WINDOWS", windows), mock.patch.object(anchors, "HELD", at_once):
            got = substrings.dedup(df, group=group).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
        assert sorted(map(tuple, got)) == sorted(brute_force.repeated_words(docs))


def test_repeated_and_null_ids_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.dedup(df).collect()] == [0, 0]
    df = df.union(spark.createDataFrame([(None, "zz " + t)], df.schema))
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.dedup(df).collect()) == [("1", 60), ("1", 60), ("None", 60)]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_deep_nodes_are_those_of_the_suffix_tree():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2, (200, 7)).astype(np.uint64)
    _, shared = anchors.multikey_quicksort(lambda r, c: keys[r, c], 7, np.array([200]))
    for depth in (3, 5, 7):
        got = set(zip(*(x.tolist() for x in substrings.deep_nodes(shared, depth)), strict=True))
        want = set()
        for a in range(200):
            for b in range(a + 2, 201):
                if shared[a + 1 : b].min() >= depth and (a == 0 or shared[a] < depth) and (b == 200 or shared[b] < depth):
                    want.add((a, b))
        assert got == want


def test_a_common_passage_among_different_neighbours_is_dealt_out(spark):
    """Many different runs under one anchor: no row group reaches a task as a whole, and results stay exact."""
    rng = random.Random(5)
    middle = [f"m{i}" for i in range(20)]
    docs = [(i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(30)), *middle, *(f"b{rng.randrange(10**6)}" for _ in range(30))])) for i in range(200)]
    docs += [(1000 + i, f"x{i} " + " ".join(docs[i][1].split()[3:70]) + f" y{i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rule = anchors.Rule(substrings.LENGTH, substrings.GRAM, "any")
    texts = df.withColumnRenamed("doc_id", "rid")
    around = substrings.contexts(texts, anchors.marks(texts, rule, substrings.encode, lambda c: substrings.grams(c, substrings.GRAM), True, "test-runs"), rule).cache()
    small, large = substrings.prefix_groups(around, 20)
    assert small.count() + large.count() == around.count() and large.count() > 100
    assert not small.groupBy("grp").count().filter("count > 20").count()
    apart = substrings.windows_apart(large, rule)
    assert apart.filter("grp is not null").groupBy("grp").count().agg(F.max("count")).first()[0] <= apart.rdd.getNumPartitions()
    want = sorted(brute_force.repeated_words(docs))
    for group in (20, 500, 2000):  # it only deals rows out
        got = substrings.dedup(df, group=group).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
        assert sorted(map(tuple, got)) == want


def test_words_decide_where_hashes_agree(spark):
    """Whole windows of one hash are told apart by their words."""
    rows = [(7, i, 0, 0, 1, (" ".join(f"w{k}" for k in range(34)) + f" {x}").encode()) for i, x in enumerate("aabc")]
    df = spark.createDataFrame(rows, "grp long, rid long, first long, dist long, n long, context binary")
    assert sorted((r.rid, r.first, r.last) for r in substrings.solve_groups(df.coalesce(1), 35).collect()) == [(0, 0, 35), (1, 0, 35)]
    apart = substrings.windows_apart(df.coalesce(1), anchors.Rule(35, 8, "any")).collect()
    assert sorted((r.rid, r.first, r["last"]) for r in apart if r.grp is None) == [(0, 0, 35), (1, 0, 35)] and sorted(r.rid for r in apart if r.grp is not None) == [0, 2, 3]


def test_words_of_one_polynomial_hash_differ_and_long_texts_are_cut(spark):
    """Two words that collide under any polynomial modulo 2**64, and texts of several stretches."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    plain = [f"p{i}" for i in range(40)]
    docs = [(0, " ".join([*plain[:17], word, *plain[18:35]])), (1, " ".join([*plain[:17], other, *plain[18:35]]))]
    docs += [(2, " ".join(long)), (3, "\n".join(long[500:1500] + ["x"] + long[2000:2034])), (4, "q" * 5000 + " " + " ".join(long[2500:2600]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (anchors.CHUNK, 512):
        with mock.patch.object(anchors, "CHUNK", chunk):
            got = substrings.dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
        assert sorted(map(tuple, got)) == sorted(brute_force.repeated_words(docs))
