import random

import brute_force
from pyspark.sql import functions as F

from strandworks.llm import common, linededup


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["alpha", " alpha ", "beta", "gamma\t", "", "  ", "delta é", "x" * 50] + [f"line {i}" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(25)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "a\nb"), (203, docs[5][1]), (204, "a\n" * 3000)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("gone", F.lit(1)).repartition(5)
    got = linededup.dedup(df).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got)) == sorted(brute_force.without_repeated_lines(docs))
    clean = linededup.clean_documents(df)
    assert clean.columns == df.columns
    kept = {d: t for d, _, _, t in brute_force.without_repeated_lines(docs)}
    assert all((r.text or "") == kept[r.doc_id] and (r.text is None) == (r.doc_id == 200) for r in clean.collect())


def test_repeated_and_null_ids_and_empty_table(spark):
    t = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "zero\n" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in linededup.dedup(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 4), ("None", 4)]
    assert linededup.dedup(df.limit(0)).count() == 0


def test_a_very_common_window_is_split(spark):
    """Both sides of the join are plain exchanges, and the adaptive plan splits the common window's occurrences."""
    docs = [(i, f"head {i}\na\nb\nc\ntail {i}") for i in range(30_000)]
    df = spark.createDataFrame(docs, "rid long, text string").repartition(6)
    found = linededup.materialise(linededup.windows(df), "w")
    skew = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    with common.session_conf(spark, skew):
        later = linededup.later_windows(found)
        assert later.count() == 29_999
        later.collect()
        assert "isSkew=true" in later._jdf.queryExecution().executedPlan().toString() or "skew=true" in later._jdf.queryExecution().executedPlan().toString()
