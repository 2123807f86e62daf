import random
import re

from pyspark.sql import functions as F

from strandworks.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(p + j for p in at for j in range(3))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocab = ["the", "and", "a", "é", "x1", "Haus#", "|", "*", " b", "...", "日本語"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "w " * 20_000, "\n".join(["same line"] * 30), "x y z x y z"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "kept": F.lit(1)})
    slim = df.select("doc_id", "text")
    got = quality.score(slim).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *brute(t))) for d, t in rows)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    good = sorted(str(r.doc_id) for r in quality.score(slim).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == good
    assert quality.score(slim.limit(0)).count() == 0


def test_long_texts_take_the_other_way(spark):
    old, quality.PLACE_BITS = quality.PLACE_BITS, 4
    try:
        texts = ["a b c d " * 10, " ".join(f"w{i}" for i in range(100)) + " w5 w6 w7", "p q r s t u v w x y z p q r"]
        got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_repeat_words").collect()
    finally:
        quality.PLACE_BITS = old
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_native_and_compiled_from_the_table(spark):
    df = spark.createDataFrame([(1, "the house of the man and the dog " * 2)], "doc_id long, text string")
    plan = quality.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    strict = quality.score(df, [quality.Rule("tiny", "n_words", None, 3)]).first()
    assert strict.failed_rules == ["tiny"] and not strict.kept


def test_windows_of_one_hash_hide_no_repeat(spark, monkeypatch):
    """With one bit of hash left, windows collide and interleave by place; what repeats is found all the same."""
    from pyspark.sql import functions as fn

    texts = ["a b c x y z a b c q r s a b c", " ".join(f"w{i % 9}" for i in range(60)), "p q r s t u v w x y"]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *cols: fn.length(cols[0]).cast("long"))
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_columns_of_the_table_stay_and_the_filter_stays_above_the_measures(spark):
    df = spark.createDataFrame([(1, "the house of the man and the dog " * 8, "w", "l", "k")], "doc_id long, text string, _words string, _lines string, _keys string")
    row = quality.score(df).first()
    assert (row["_words"], row["_lines"], row["_keys"], row["n_words"]) == ("w", "l", "k", 64)
    plan = quality.keep_good(df)._jdf.queryExecution().optimizedPlan().toString()
    conditions = [x for x in plan.splitlines() if "Filter" in x]
    assert len(conditions) == 1 and "split" not in conditions[0] and "rand" not in conditions[0]
