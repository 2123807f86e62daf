"""Coding is held against exact inverses and invariants."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandworks.operators import coding as K
from strandworks.streaming import events as E


def decode(data: bytes, n: int, tables) -> list[int]:
    """The inverse of the coder, for tests only. ``tables[i]`` is the cumulative table of symbol i."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist() + [0] * 64
    low, high, at = 0, (1 << 32) - 1, 32
    value = int("".join(map(str, bits[:32])), 2)
    out = []
    for i in range(n):
        cum = tables[i]
        total = int(cum[-1])
        span = high - low + 1
        scaled = ((value - low + 1) * total - 1) // span
        s = int(np.searchsorted(cum, scaled, "right")) - 1
        out.append(s)
        high, low = low + span * int(cum[s + 1]) // total - 1, low + span * int(cum[s]) // total
        while True:
            if high < 1 << 31:
                sub = 0
            elif low >= 1 << 31:
                sub = 1 << 31
            elif low >= 1 << 30 and high < 3 << 30:
                sub = 1 << 30
            else:
                break
            low, high, value = (low - sub) * 2, (high - sub) * 2 + 1, (value - sub) * 2 + bits[at]
            at += 1
    return out


def test_quantise():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50) * 0.1, 40)
    cum = K.quantise(p, 32768)
    assert (cum[:, 0] == 0).all() and (cum[:, -1] == 32768).all() and (np.diff(cum, axis=1) >= 1).all()
    x = np.exp(np.linspace(0, -12, 19564))
    x /= x.sum()
    penalty = [float((x * (np.log2(x) - np.log2(np.diff(K.quantise(x[None], t))[0] / t))).sum()) for t in (1 << 15, 1 << 21)]
    assert penalty[0] > 0.1 and penalty[1] < 0.2 * penalty[0]


def test_coded_blocks_decode(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(8), 300)
    cum = K.quantise(p, 4096)
    symbols = [int(rng.choice(8, p=q)) for q in p]
    rows = [("a", i, int(cum[i, s]), int(cum[i, s + 1]), 4096) for i, s in enumerate(symbols)]
    df = spark.createDataFrame(rows, "source_name string, pos long, cum_low long, cum_high long, total long").repartition(3)
    for block in (64, 1000):
        got = []
        for r in K.encode_blocks(df, ["source_name"], block).orderBy("code_block").collect():
            got += decode(bytes(r.coded), r.symbols, cum[r.code_block * block :])
        assert got == symbols


def test_coded_sequences_decode(spark):
    rng = np.random.default_rng(2)
    seqs = {f"s{i}": "".join(rng.choice(list("ACGTN"[: 1 + i % 5]), n)) for i, n in enumerate((1, 30, 64, 65, 200, 0))}
    df = spark.createDataFrame(list(seqs.items()), "source_name string, seq string")
    from strandworks.sources.fasta import blocks_of

    tables = {r.source_name: (r.letters, np.cumsum([0, *r.counts])) for r in K.letter_tables(df).collect()}
    back = {k: "" for k in seqs}
    for r in K.encode_sequences(blocks_of(df, 64), K.letter_tables(df)).orderBy("source_name", "block_id").collect():
        letters, cum = tables[r.source_name]
        back[r.source_name] += "".join(letters[i] for i in decode(bytes(r.coded), r.symbols, [cum] * r.symbols))
    assert back == seqs


def test_scores_depend_on_window_place_and_context(spark):
    def score(ids):
        x = np.sin(ids[..., None] * 1.3 + np.arange(ids.shape[1])[None, :, None] * 0.7 + np.arange(5)[None, None, :])
        return x - np.log(np.exp(x).sum(-1, keepdims=True))

    rows = [("a", 4 * i, [i, 1, 2, 3], [0, 4, -100, i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "source_name string, start long, input_ids array<long>, labels array<long>").repartition(3)
    got = {r.pos: (r.target, round(r.log2p, 9)) for r in K.score_windows(df, score, 32768).collect()}
    want = {}
    for _, start, ids, labels in rows:
        lp = score(np.array([ids]))[0]
        want |= {start + j: (t, round(float(lp[j, t] / np.log(2)), 9)) for j, t in enumerate(labels) if t >= 0}
    assert got == want


def test_csr_and_residuals(spark):
    cells = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 0, -2), (1, 1, 2, 3), (2, 4, 0, 7)], "matrix int, row int, col int, value int")
    rows = [(r.matrix, r.row, r.start, r.indices, r.data) for r in K.csr(cells).orderBy("matrix", "row").collect()]
    assert rows == [(1, 0, 0, [1], [1]), (1, 1, 1, [0, 2], [-2, 3]), (2, 4, 0, [0], [7])]
    d = K.residuals(spark.createDataFrame([(1, [1, 2, 3, 4], [1, 2, 2, 1])], "id int, codes array<int>, prediction array<int>"), "id")
    r = d.withColumn("back", K.restored(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(1)), F.col("indices"), F.col("data"))).first()
    assert (r.nonzeros, r.indices, r.data, r.back) == (2, [2, 3], [1, 3], [1, 2, 3, 4])


def test_column_form_of_the_quantiser(spark):
    """Within one of the numpy form everywhere; and both take back from the largest where too much was given."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(20) * 0.3, 60)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "key int, p array<double>")
    got = np.zeros(p.shape, np.int64)
    for r in K.quantised(df, "key", "p", 1 << 15).collect():
        got[r.key, r.idx] = r.freq
    want = np.diff(K.quantise(p, 1 << 15), axis=1)
    assert (got.sum(1) == 1 << 15).all() and (got >= 1).all() and np.abs(got - want).max() <= 1
    ones = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "key int, p array<double>")
    assert [r.freq for r in K.quantised(ones, "key", "p", 10).orderBy("idx").collect()] == [8, 1, 1]


def test_steps_multiply_to_the_tokens_own_probability(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(29))
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(p)], "key int, token int, p double")
    rows = K.step_probabilities(df, 3, 2, 3).collect()
    product, symbols = {}, {}
    for r in rows:
        product[r.token] = product.get(r.token, 1.0) * r.p
        symbols.setdefault(r.token, {})[r.step] = (r.symbol, r.width)
    assert np.allclose([product[i] for i in range(29)], p)
    assert symbols[14] == {0: (5, 10), 1: (2, 3)} and symbols[28] == {0: (0, 10), 1: (1, 2)}


def test_tail_side_info(spark):
    r = spark.createDataFrame([("",), ("A",)], "t string").select(K.tail_side_info(F.col("t")).alias("x"), K.tail_bits(F.col("t")).alias("b")).collect()
    assert [(x.x, x.b) for x in r] == [("00", 3), ("24", 6)]


EVENTS = [(1, 1, "train", None, "10", 0.9, 1.0), (1, 2, "eval", "val", "20", 0.8, 0.6), (1, 3, "train", None, "30", 0.7, 1.0), (2, 1, "eval", "val", "5", 0.5, 0.7), (2, 2, "eval", "test", "6", 0.5, 0.1), (2, 3, "eval", "val", "7", 0.5, 0.65), (2, 4, "note", None, "x", 0.5, 0.6)]
SCHEMA = "run long, seq long, event string, split string, step string, loss_nats_per_token double, bits_per_base double"


def log(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).withColumns({"epoch": F.lit("1"), "learning_rate": F.lit(0.1), "tokens_per_second": F.lit(5.0)})


def test_resume(spark):
    new = E.undelivered(log(spark).filter("run = 1"), 2)
    assert {r.step for r in E.metric_rows(new).collect()} == {30}
    assert {r.step for r in E.metric_rows(E.undelivered(log(spark).filter("run = 1"), None)).collect()} == {10, 20, 30}
    best = {r.run: (r.reported_best, r.true_best) for r in E.best_validation(log(spark), 2).collect()}
    assert best == {1: (0.6, 0.6), 2: (0.65, 0.65)}
    assert {r.metric for r in E.metric_rows(log(spark).filter("run = 2 and seq = 1")).collect()} == {"val/loss", "val/bpb", "eval/loss", "eval/bpb"}


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((EVENTS[:2] + EVENTS[3:4], EVENTS[2:3] + EVENTS[4:])):
        spark.createDataFrame(part, SCHEMA).withColumns({"epoch": F.lit("1"), "learning_rate": F.lit(0.1), "tokens_per_second": F.lit(5.0)}).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for name, f in (("metrics", E.metric_rows), ("best", E.running_best_stream)):
        q = f(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    batch = E.metric_rows(log(spark))
    assert sorted(map(str, spark.table("metrics").collect())) == sorted(map(str, batch.collect()))
    assert sorted(map(str, spark.table("best").collect())) == sorted(map(str, E.running_best(log(spark)).collect()))


def test_long_residuals_are_restored_by_place(spark):
    """20,000 residuals of one row: no look-up of each place in a map of all."""
    n = 20_000
    rows = spark.createDataFrame([(1, [i % 4 + 1 for i in range(n)], [9] * n), (2, [], []), (3, [9, 8], [9, 9])], "id int, codes array<int>, prediction array<int>")
    d = K.residuals(rows, "id", "codes", "prediction").withColumn("back", K.restored(F.col("prediction"), F.col("indices"), F.col("data")))
    assert "map_from_arrays" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.nonzeros, r.back == r.codes) for r in d.orderBy("id").collect()] == [(1, n, True), (2, 0, True), (3, 1, True)]


def test_windows_of_few_distributions_quantise_each_once(spark):
    """A scorer of one distribution against the same one as a plain function; more windows than are scored at a time."""
    rows = spark.createDataFrame([(f"s{i % 3}", 4 * i, [i % 5, 1, 2, 3], [i % 5, -100, 4, 0]) for i in range(300)], "source_name string, start long, input_ids array<long>, labels array<long>")
    few = K.fixed_scores(9)
    assert isinstance(few, K.TableScorer) and few.table.shape == (1, 9)
    got = [sorted(map(tuple, K.score_windows(rows, f, 1 << 15).collect())) for f in (few, lambda ids: few(ids))]
    assert got[0] == got[1] and len(got[0]) == 900


def test_letter_tables_are_counted_in_batches(spark):
    """Blocks of a source together, letters beyond Latin-1, and none; no array of single letters is made."""
    t = K.letter_tables(spark.createDataFrame([("a", "GATTACA"), ("a", "AN"), ("b", "é€A€"), ("c", ""), ("d", None)], "source_name string, seq string"))
    assert "split(" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, t.collect())) == [("a", "ACGNT", [4, 1, 1, 1, 2]), ("b", "Aé€", [1, 1, 2])]


def test_contexts_are_counted_without_a_row_for_each_token(spark):
    """Against counts by hand: rows too short for a context, ids below zero, keys that pass 64 bits, and more rows than are counted together."""
    rng = random.Random(9)
    rows = [(f"s{i % 3}", [rng.choice((-5, 0, 1, 2**40)) for _ in range(rng.choice((0, 1, 2, 9)))]) for i in range(600)] + [("wide", list(range(3000)) * 2)]
    df = spark.createDataFrame(rows, "source_name string, tokens array<long>").coalesce(1)
    for order in (0, 1, 2, 6):
        want = {}
        for name, t in rows:
            for i in range(len(t) - order):
                want[name, tuple(t[i : i + order]), t[i + order]] = want.get((name, tuple(t[i : i + order]), t[i + order]), 0) + 1
        got = K.context_tallies(df, order, "source_name").groupBy("source_name", "context", "next").agg(F.sum("n").alias("n")).collect()
        assert {(r.source_name, tuple(r.context), r.next): r.n for r in got} == want and len(got) == len(want)
        assert K.context_counts(df, order).agg(F.sum("n")).first()[0] == sum(want.values())
    assert "transform(" not in K.context_counts(df, 1)._jdf.queryExecution().optimizedPlan().toString()
