import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import brute_force
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from strandworks.llm import packing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(r.doc_id, r.text) for r in quality.score(docs).select("doc_id", "text", "kept").collect() if r.kept]
    want = [(d, t) for d, _, _, t in brute_force.without_repeated_lines(want)]
    first = {d for d, c, _ in brute_force.links(want) if d == c}
    want = [(d, t) for d, t in want if d in first]
    bad = {r[0] for r in brute_force.contaminated(want, items) if r[5]}
    want = [(d, t) for d, t in want if d not in bad]
    tokens = defaultdict(int)
    for p in corpus_pipeline.run(spark, SF).collect():
        tokens[p.doc_id] += p.length
    coder = packing.coder(packing.tokenizer_path()).tokenizer
    assert tokens == {d: len(coder.encode(t, add_special_tokens=False).ids) + 1 for d, t in want}
    assert 0 < len(want) < docs.count()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_odd_rows_against_brute_force(spark, tmp_path):
    """Null ids and texts, repeated rows, ties, clashing columns, very long texts: every piece against the tokenizer."""
    rng = random.Random(6)
    vocab = "the of and to in that it was for on as with his they at be this had not are but from or have an which one were".split() + [f"noun{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    lines = ["shared line one of it", "shared line two of it", "shared line three of it"]
    texts = [say(rng.choice([20, 80, 200])) for _ in range(40)]
    texts += ["\n".join([say(60), *lines, say(60)]) for _ in range(6)]
    items = [(i, say(30)) for i in range(4)]
    texts += [f"{say(30)} {items[i % 4][1]} {say(30)}" for i in range(5)]
    near = texts[1] + " " + say(100)
    texts += [near, near + " the end", near + " of it", near]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, say(30_000))]
    repeated = [(5, docs[5][1]), (None, near + " it was"), (None, None)]  # these are copies of others, so they go
    tables = tmp_path / "t"
    frame = spark.createDataFrame(docs + repeated, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rid", "kept", "_row", "_words", "comp", "n_words", "key", "digest", "items")})
    frame.repartition(3).write.parquet(str(tables / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tables / "benchmark.parquet"))
    want = [(d, t) for d, t in docs if quality_kept(t)]
    want = [(d, t) for d, _, _, t in brute_force.without_repeated_lines(want)]
    first = {d for d, c, _ in brute_force.links(want) if d == c}
    bad = {r[0] for r in brute_force.contaminated(want, items) if r[5]}
    coder = packing.coder(packing.tokenizer_path()).tokenizer
    want = {d: [*coder.encode(t, add_special_tokens=False).ids, 2] for d, t in want if d in first and d not in bad}
    out = corpus_pipeline.run(spark, str(tables))
    got, filled = defaultdict(int), defaultdict(int)
    for p in out.collect():
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert got == {d: len(ids) for d, ids in want.items()} and 20 < len(want) < len(docs) - 8
    assert all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in filled.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(0), str(tables)).columns == frame.columns, name
    assert corpus_pipeline.curve_packing(spark, frame.limit(0), str(tables)).count() == 0


def quality_kept(text):
    """The production rules by definition, for texts without symbols, bullets and ellipses."""
    words = brute_force.SPACED.findall(text or "")
    if len(words) < 50:
        return False
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeated = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(3)}
    stops = sum(w in quality.STOP_WORDS or w.lower() in quality.STOP_WORDS and w == w.capitalize() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    return 100 * len(repeated) <= 50 * len(words) and stops >= 0.02 * len(words) and 2 <= sum(map(len, words)) / len(words) <= 12 and len(lines) - len(set(lines)) <= 0.5 * len(lines)
