import random

import brute_force
import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import decontam

COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Ça", "x1", "the", "ÉE"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    long = [" ".join(rng.choice(["w%d" % i for i in range(50)]) for _ in range(rng.choice([13, 14, 40]))) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(long)] + [(20, "one two three"), (21, "Solo!"), (22, ""), (23, None), (None, long[0]), (24, say(13)), (25, "b " * 30)]
    docs = []
    for i in range(60):
        bits = [say(rng.randrange(30)), rng.choice(long), say(rng.randrange(5)), rng.choice(long).upper()[rng.randrange(9) :], rng.choice(["ONE-two  three", "solo", "x y", "b " * 14])]
        docs.append((i, " ".join(rng.sample(bits, rng.randrange(1, 6)))))
    return docs + [(70, None), (71, ""), (72, "..."), (3, docs[3][1]), (3, docs[3][1]), (None, docs[0][1]), (73, "tail " * 5000 + long[1])], items


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("items", F.lit("x")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, brute_force.contaminated(docs, items)))
    for size in (decontam.BLOCK_BYTES, 90):
        got = decontam.contamination(d, b, block_bytes=size).select(*COLS).collect()
        assert sorted(map(str, map(tuple, got))) == want


def test_every_long_shared_span_has_a_fingerprint():
    rng = np.random.default_rng(3)
    w = decontam.WINDOW - decontam.K + 1
    for _ in range(200):
        shared = rng.integers(0, 2**63, w).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 2**63, 9).astype(np.uint64)])
        kept = set(a[decontam.fingerprint_places(a, w)].tolist()) & set(shared.tolist())
        assert kept & set(shared[decontam.fingerprint_places(shared, w)].tolist())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (row,) = decontam.contamination(docs, items.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)


def test_clean_documents_keep_their_columns(spark):
    docs, items = cases(2)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("tags", F.array(F.lit("x"))).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {(r[0]) for r in brute_force.contaminated(docs, items) if r[5]}
    for size in (decontam.BLOCK_BYTES, 90):
        kept = decontam.clean_documents(d, b, block_bytes=size)
        assert kept.columns == d.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_one_block_at_a_time_and_long_items_in_pieces(spark, monkeypatch):
    import weakref

    live, most = weakref.WeakSet(), []

    build = decontam.Block.__init__

    def watched(self, names, texts, *rest):
        build(self, names, texts, *rest)
        live.add(self)
        most.append((len(live), sum(map(len, texts))))

    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate((90, 5, 14, 200))]
    docs = [(k, "lead " + " ".join(t.split()[a : a + 30])) for k, (_, t) in enumerate(items) for a in (0,)] + [(9, " ".join(items[3][1].split()[17:60])), (10, "none")]
    monkeypatch.setattr(decontam.Block, "__init__", watched)
    out = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=200)
    assert len(most) > 5 and max(n for n, _ in most) <= 2 and max(n for _, n in most) <= 400
    monkeypatch.undo()
    got = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(brute_force.contaminated(docs, items))


def test_memory_of_a_block_follows_its_bytes():
    """About ten bytes for a byte of text, however many items have one text."""
    import pickle

    texts = [" ".join(f"word{i}n{j}" for j in range(60)).encode() for i in range(2000)]
    block = decontam.Block([str(i) for i in range(2000)], texts)
    size = sum(map(len, texts))
    assert len(pickle.dumps(block)) < 12 * size
    same = decontam.Block([str(i) for i in range(2000)], texts[:1] * 2000)
    assert len(same.by_length[13].owners) == 1 and len(same.by_length[13].h) == 48
