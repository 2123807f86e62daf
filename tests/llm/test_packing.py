import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandworks.llm import packing


def check(docs, pieces):
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(list)
    for d, text in docs:
        want[d].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, texts))
        for p in by_doc[d]:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in texts)
        if len(texts) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == packing.SEQUENCE or at & (at - 1) == 0


def test_pieces_round_trip(spark):
    docs = [(i, f"word{i % 7} the of And " * (i * 13 % 900)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  x\tÉ<|endoftext|>é 'S don't 12 ﬁ ½ \r\n ٣٤"), (103, "long " * 20000), (104, "x" * 5000), (None, "null id"), (7, "other text of a repeated id"), (105, "same"), (105, "same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    check(docs, packing.pack(df).collect())
    assert packing.pack(df.limit(0)).count() == 0


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(df).collect()
    check([(r.doc_id, r.text) for r in df.collect()], pieces)
    assert sum(p.length for p in pieces) % packing.SEQUENCE != 1  # nothing is padded: sequences are full or powers of two


def test_hilbert_is_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(cells, bits=3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike():
    m = packing.projection()
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 49000, 40) for _ in range(30)]
    docs = [rng.choice(topics[i % 30], 200) for i in range(300)]
    order = np.argsort(packing.curve_key(docs, m), kind="stable") % 30
    assert (order[1:] == order[:-1]).mean() > 0.3


def test_words_alone_give_the_ids_of_whole_texts():
    coder = packing.WordIds(packing.tokenizer_path())
    rng = np.random.default_rng(7)
    pieces = ["The", "don't", "e\u0301", "É", "İ", "ǅ", "ß", "ﬁ", "日本", "ab,", "x.", "x..", "¼", "\u00a0", "\t", "\n", " ", "  ", "K", "'ll", "ñandú", "ªº", "ʰ", "१२", "naïve.", "<b>", "😀", "\u200b", "a\u0300\u0323", "ΑΣ", "İi"]
    texts = ["".join(rng.choice(pieces + [" "] * 12, rng.integers(0, 40))) for _ in range(600)]
    got = coder.rows(pa.array(texts))
    want = [e.ids + [2] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_capitals_with_marks_that_compose_in_lower_case_only():
    coder = packing.WordIds(packing.tokenizer_path())
    pieces = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "E\u0301", "Y\u030a"]
    texts = [*pieces, *(f"THE {p}AMZA, and {p}. Ab{p}C." for p in pieces), "".join(pieces), "AB. " + " ".join(pieces) + "\nÉCOLE X."]
    got = coder.rows(pa.array(texts))
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [g.tolist() for g in got] == want


def test_words_of_one_polynomial_hash_and_long_texts():
    """Two words that collide under any polynomial modulo 2**64 have ids of their own; a long text is cut at spaces."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    coder = packing.WordIds(packing.tokenizer_path())
    old, packing.CHUNK = packing.CHUNK, 64
    try:
        texts = [f"x {word}", f"x {other}", " ".join(f"Word{i} don't, É." for i in range(200)), "y" * 1000, "z " + "y" * 1000 + " z " * 100]
        got = coder.rows(pa.array(texts))
    finally:
        packing.CHUNK = old
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [g.tolist() for g in got] == want


def test_rows_of_one_id_and_text_spread(spark):
    """Rows that agree in id and text tie nowhere: no range holds them all."""
    df = spark.createDataFrame([(None, "the same words " * 40)] * 400, "doc_id long, text string").repartition(4)
    pieces = packing.pack(df)
    parts = pieces.groupBy((F.col("sequence_id") / (1 << 40)).cast("long")).agg(F.sum("length").alias("n")).collect()
    assert len(parts) > 1 and max(r.n for r in parts) < 0.6 * sum(r.n for r in parts)
