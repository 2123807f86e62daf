"""Blocks against whole sources: every phase, short last blocks, windows over several blocks."""

import bisect
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from strandworks.functions import sequence as S
from strandworks.operators import blocks as B
from strandworks.operators import corpus as C
from strandworks.operators import metrics as M
from strandworks.operators import windows as W
from strandworks.sources.fasta import blocks_of


def sources(spark):
    rng = random.Random(2)
    seq = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    rows = [("s", f"s:{i}", i, seq(n)) for i, n in enumerate((0, 1, 2, 3, 49, 50, 51, 100, 101, 463, 1000))]
    return spark.createDataFrame(rows, "species string, source_name string, i int, seq string")


def test_tokens_windows_and_counts_over_blocks(spark):
    src = sources(spark)
    for size in (50, 64):
        blocks = blocks_of(src.select("source_name", "seq"), size)
        for k in (1, 3, 4):
            whole = src.select("source_name", S.kmer_ids(F.col("seq"), k).alias("tokens"))
            want = {r.source_name: list(r.tokens) for r in whole.collect()}
            tokens = B.block_tokens(blocks, k)
            got = {n: [] for n in want}
            for r in tokens.orderBy("source_name", "block_id").collect():
                assert r.first_token == len(got[r.source_name]) or not r.tokens
                got[r.source_name] += r.tokens
            assert got == want
            key = lambda rows: sorted(map(str, rows))
            names = ["source_name", "window_id", "input_ids", "valid"]
            assert key(B.tumbling(tokens, 9, -7, 2).select(names).collect()) == key(W.tumbling(whole, 9, -7, 2).select(names).collect())
            names = ["source_name", "pos", "input_ids"]
            assert key(B.sliding(tokens, 6, -7).select(names).collect()) == key(W.sliding(whole, 6, -7).select(names).collect())
        counts = {}
        for r in src.collect():
            for i in range(len(r.seq) - 3):
                if "N" not in r.seq[i : i + 4]:
                    counts[r.source_name, r.seq[i : i + 4]] = counts.get((r.source_name, r.seq[i : i + 4]), 0) + 1
        assert {(r.source_name, r.kmer): r["count"] for r in B.kmer_counts(blocks, 4).collect()} == counts


def test_joined_species_in_blocks(spark):
    src = sources(spark)
    starts = C.concat_offsets(src.select("source_name", "i", "species", F.length("seq").alias("length")), 7, "i").select("source_name", "start")
    rows = B.concatenated(src.select("species", "source_name", "seq"), starts, "N" * 7, 60).orderBy("block_id").collect()
    assert "".join(r.seq for r in rows) == ("N" * 7).join(r.seq for r in src.orderBy("i").collect())
    assert all(r.start == 60 * r.block_id and len(r.seq) == 60 for r in rows[:-1])


def test_what_reaches_over_several_blocks(spark):
    """Blocks shorter than what a window or a k-mer needs."""
    src = sources(spark)
    blocks, key = blocks_of(src.select("source_name", "seq"), 7), lambda rows: sorted(map(str, rows))
    whole = {r.source_name: r.seq for r in src.collect()}
    for n in (1, 6, 7, 8, 40, 2000):
        for r in B.with_after(blocks, n).collect():
            assert r.after == whole[r.source_name][r.start + 7 : r.start + 7 + n]
    tokens = B.block_tokens(blocks, 3)
    names = ["source_name", "pos", "input_ids"]
    want = W.sliding(src.select("source_name", S.kmer_ids(F.col("seq"), 3).alias("tokens")), 20, -7)
    assert key(B.sliding(tokens, 20, -7, 9).select(names).collect()) == key(want.select(names).collect())
    assert {(r.source_name, r.kmer) for r in B.kmer_counts(blocks_of(src.select("source_name", F.regexp_replace("seq", "N", "A").alias("seq")), 7), 10).collect()} == {
        (n, s[i : i + 10]) for n, s in ((n, s.replace("N", "A")) for n, s in whole.items()) for i in range(len(s) - 9)
    }


def test_regular_blocks_of_raw_ones(spark):
    rng = random.Random(4)
    raw = {f"r{n}": "".join(rng.choice("ACGTNacgtn\n\r RYé-7") for _ in range(n)) for n in (0, 1, 5, 99, 100, 1001, 3000)}
    raw["empty blocks"] = "\n" * 500 + "ACG" + "\n" * 700 + "T" * 50
    df = spark.createDataFrame(list(raw.items()), "source_name string, seq string")
    clean = {r.source_name: r.seq for r in df.select("source_name", S.clean(F.col("seq"), "ACGTN").alias("seq")).collect()}
    for cut, size in ((1, 13), (100, 13), (100, 1 << 12), (7, 64)):
        got = dict.fromkeys(raw, "")
        for r in B.regular(blocks_of(df, cut), lambda c: S.clean(c, "ACGTN"), size).orderBy("source_name", "block_id").collect():
            assert r.start == r.block_id * size == len(got[r.source_name]) and len(r.seq) <= size
            got[r.source_name] += r.seq
        assert got == clean


def test_runs_of_blocks_are_lifted_by_the_runs_before(spark):
    df = spark.createDataFrame([("a", "AC\n" * 2100)], "source_name string, seq string")
    rows = B.regular(blocks_of(df, 3), lambda c: S.clean(c, "ACGTN"), 1000).orderBy("block_id").collect()
    assert "".join(r.seq for r in rows) == "AC" * 2100 and [r.start for r in rows] == [0, 1000, 2000, 3000, 4000]


def test_windows_fetched_over_blocks(spark):
    src = sources(spark).select("source_name", "seq")
    whole = {r.source_name: r.seq for r in src.collect()}
    picks = [(i, n, s) for i, (n, s) in enumerate((n, s) for n, q in whole.items() for s in range(0, len(q), 13))] + [(9999, "s:0", 0), (9998, "s:10", 26)]
    got = {r.sample_index: r.seq for r in B.fetched(blocks_of(src, 20), spark.createDataFrame(picks, "sample_index long, source_name string, start long"), 64, 20).collect()}
    assert got == {i: whole[n][s : s + 64] for i, n, s in picks if whole[n][s : s + 64]}


def test_draws_follow_the_weights(spark):
    weighted = spark.createDataFrame([(f"s{i}", 10 * (i + 1), float(i + 1)) for i in range(10)], "source_name string, available long, weight double")
    rows = C.sample_windows(weighted, 20_000, 5, "source_name").collect()
    assert sorted(r.sample_index for r in rows) == list(range(20_000))
    for i in range(10):
        own = [r.start for r in rows if r.source_name == f"s{i}"]
        assert abs(len(own) / 20_000 - (i + 1) / 55) < 0.02 and set(own) <= set(range(10 * (i + 1))) and len(set(own)) > 9 * (i + 1)
    again = C.sample_windows(weighted.repartition(3), 20_000, 5, "source_name").collect()
    assert sorted(rows) == sorted(again) and sorted(rows) != sorted(C.sample_windows(weighted, 20_000, 6, "source_name").collect())


def test_masks_and_lines_over_blocks(spark):
    rng = random.Random(6)
    rows = [(f"m{n}", "".join(rng.choice(["ACGT", "AC", "NNA", "GGG"]) for _ in range(n))) for n in (0, 1, 2, 30, 90)]
    src = spark.createDataFrame(rows, "source_name string, seq string")
    top = M.top_kmers(M.kmer_counts(src, "source_name", 4), "source_name", 2, 3)
    want = {(r.source_name, r.pos): r.level for r in M.repeat_mask(src, top, "source_name", 4).collect()}
    lines = {(r.source_name, r.line): (round(r.repeat_fraction, 9), r.meter) for r in M.repeat_lines(src, M.repeat_mask(src, top, "source_name", 4), "source_name", 10).collect()}
    assert len(want) > 50
    for size in (1, 2, 7, 10, 500):
        mask = B.repeat_mask(blocks_of(src, size), top, 4, size)
        assert {(r.source_name, r.pos): r.level for r in mask.collect()} == want
        if size % 10 == 0:
            assert {(r.source_name, r.line): (round(r.repeat_fraction, 9), r.meter) for r in B.repeat_lines(blocks_of(src, size), mask, 10, size).collect()} == lines


def test_offsets_of_a_species_that_holds_nearly_all_rows(spark):
    rows = [("big", i, (i * 37) % 11) for i in range(500)] + [("small", 3, 4), ("small", 1, 2), (None, 9, 5), (None, 7, 1)]
    want, at = {}, {}
    for species, i, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[species, i] = at.get(species, 0)
        at[species] = want[species, i] + n + 6
    table = spark.createDataFrame(rows, "species string, i long, length int")
    for edges in (1, 7, 128):
        got = C.concat_offsets(table, 6, "i", edges).collect()
        assert len(got) == len(rows) and {(r.species, r.i): r.start for r in got} == want
    assert C.concat_offsets(table.limit(0), 6, "i").collect() == []


def test_sliding_windows_put_their_halo_together_once_a_block(spark):
    """The halo stands below the explode that makes a row for each token; beside it, it was made anew for each."""
    t = spark.createDataFrame([("a", 0, list(range(9))), ("a", 9, [9])], "source_name string, first_token long, tokens array<long>")
    out = B.sliding(t, 3, -1, 4)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "array_repeat" not in above and "flatten" not in above
    assert [r.input_ids for r in out.orderBy("pos").collect()] == [[i if i >= 0 else -1 for i in range(p - 2, p + 1)] for p in range(10)]


def test_left_contexts_of_no_tokens_and_of_ids_below_zero(spark):
    from strandworks.operators import windows as W

    rows = spark.createDataFrame([(1, []), (2, [5, -1, 7, 8])], "id int, tokens array<long>")
    got = [(r.id, r.pos, r.context) for r in W.left_contexts(rows, 3, 0, [9], 2).orderBy("id", "pos").collect()]
    assert got == [(2, 0, [0, 9]), (2, 1, [0, 9, 5]), (2, 2, [9, 5, -1]), (2, 3, [5, -1, 7])]


def test_halos_of_blocks_of_any_length(spark):
    src = sources(spark).select("source_name", "seq")
    whole = {r.source_name: r.seq for r in src.collect()}
    for size, n in ((1, 3), (2, 3), (7, 3), (7, 20), (50, 1)):
        blocks = blocks_of(src, size)
        rows = B.halos(blocks, n).collect()
        assert len(rows) == blocks.count()
        for r in rows:
            s, a, b = whole[r.source_name], r.start, r.start + size
            assert (r.before, r.tail, r.after) == (s[max(0, a - n) : a], s[a:b][-n:], s[b : b + n]) and a == r.block_id * size


def test_masks_make_rows_of_covered_places_and_counts_shuffle_no_block(spark):
    """A row for each letter was made and thrown away again; every block met what is behind it in a join."""
    src = spark.createDataFrame([("a", "ACGTACGT" + "N" * 100 + "ACGTT"), ("b", "N" * 50), ("c", "GGGGG")], "source_name string, seq string")
    blocks = blocks_of(src, 10)
    counts = B.kmer_counts(blocks, 4)
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()
    top = M.top_kmers(counts, "source_name", 2, 5)
    for mask in (B.repeat_mask(blocks, top, 4, 10), M.repeat_mask(src, top, "source_name", 4)):
        assert "posexplode" not in mask._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(mask.collect()) == [*(("a", i, 1) for i in (*range(8), *range(108, 112))), *(("c", i, 1) for i in range(5))]
    lines = B.repeat_lines(blocks, B.repeat_mask(blocks, top, 4, 10), 5, 10).orderBy("source_name", "line").collect()
    assert len(lines) == 23 + 10 + 1
    assert {(r.source_name, r.line): r.meter for r in lines if r.meter > 4} == {("a", 0): 100, ("a", 1): 60, ("a", 21): 40, ("a", 22): 66, ("c", 0): 100}


def test_windows_from_letters_equal_those_of_tokens(spark):
    src = sources(spark).select("source_name", "seq")
    key = lambda df: sorted(map(str, df.select("source_name", "window_id", "input_ids", "valid").collect()))
    for size, k, length, prefix in ((7, 3, 9, 0), (50, 3, 5, 2), (64, 4, 128, 0), (1000, 1, 10, 1)):
        blocks = blocks_of(src, size)
        want = key(W.tumbling(src.select("source_name", S.kmer_ids(F.col("seq"), k).alias("tokens")), length, -7, prefix))
        found = B.block_windows(blocks, k, length, -7, prefix)
        assert key(found) == want == key(B.tumbling(B.block_tokens(blocks, k), length, -7, prefix))
        assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Union" not in plan


def test_a_long_source_is_cut_piece_by_piece(spark):
    """Of 400,000 letters, blocks of 10: each was looked for from the source's first letter."""
    rng = random.Random(12)
    whole = "".join(rng.choices("ACGTNé", k=400_000))
    df = spark.createDataFrame([("a", whole), ("b", ""), ("c", whole[:321])], "source_name string, seq string")
    assert str(blocks_of(df, 10)._jdf.queryExecution().optimizedPlan()).count("Generate explode") == 2
    rows = blocks_of(df, 10).collect()
    assert {(r.source_name, r.block_id): (r.start, r.seq) for r in rows} == {(n, i // 10): (i, s[i : i + 10]) for n, s in (("a", whole), ("c", whole[:321])) for i in range(0, len(s), 10)}
    assert len(rows) == 40_000 + 33


def test_draws_and_sources_meet_in_as_many_cells_as_draws(spark):
    """10,000 sources and 10,000 draws against a search in sums; weights are read once."""
    n = 10_000
    weighted = spark.range(n).selectExpr("concat('s', id) source_name", "id % 7 + 1 available", "cast(id % 7 + 1 as double) weight")
    out = C.sample_windows(weighted, n, 3, "source_name")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "4096" not in plan
    rows = sorted(weighted.collect(), key=lambda r: (hashlib.md5(r.source_name.encode()).hexdigest()[:2], r.source_name))
    upto = list(itertools.accumulate(r.available for r in rows))
    draw = lambda tag, i: int(hashlib.md5(f"3:{tag}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = [(i, r.source_name, int(draw("start", i) * r.available)) for i in range(n) for r in (rows[bisect.bisect_right(upto, draw("source", i) * upto[-1])],)]
    assert sorted(tuple(r) for r in out.collect()) == want
