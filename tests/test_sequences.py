"""Small cases of cleaning, splits, tokens and windows with known results."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandworks.functions import config
from strandworks.functions import sequence as S
from strandworks.operators import corpus as C
from strandworks.operators import windows as W
from strandworks.sources import fasta


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "seq string").select(column.alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, ">chrI\nacgtrxnn\n", S.clean(F.col("seq"))) == "ACGTNNNN"
    assert one(spark, "ac-gtr", S.clean(F.col("seq"), "ACGT")) == "ACGT"
    assert one(spark, "«ê", S.clean(F.col("seq"))) == "NNN"
    r = one(spark, ">h\nACGNT\nacg-\n", S.strict_clean(F.col("seq")))
    assert (r.sequence, r.raw_bytes, r.removed_non_acgt, r.skipped_header_lines) == ("ACGTACG", 14, 2, 1)


def test_split_of_a_flat_file(spark):
    rows = C.split_sequences(spark.createDataFrame([("Legacy", "Legacy", "ACGTNACGTN")], "species string, source_name string, seq string")).collect()
    assert {r.split: r.seq for r in rows} == {"train": "ACGTNA", "val": "CG", "test": "TN"}
    sizes = spark.createDataFrame([("YeMi", "YeMi", "A" * 73689)], "species string, source_name string, seq string")
    assert [r["size"] for r in C.split_table(sizes).orderBy("start").collect()] == [44213, 14737, 14739]


def test_tokens(spark):
    assert one(spark, "AC-GT", S.kmer_ids(F.col("seq"), 2)) == [1, 13]
    assert one(spark, "ACGTNACGTNAC", S.kmer_ids(F.col("seq"), 2))[:2] == [1, 13]
    assert one(spark, "ACGTN", S.tail(F.col("seq"), 3)) == "TN"
    assert one(spark, "ACGTACGT", S.base_codes(F.col("seq"))) == [1, 2, 3, 4, 1, 2, 3, 4]
    with pytest.raises(Exception, match="base codes"):
        one(spark, "ACGN", S.base_codes(F.col("seq")))
    assert one(spark, "ACGT", S.byte_tokens(F.col("seq"))) == [65, 67, 71, 84]
    vocab = spark.createDataFrame([("ACG", 5), ("TN", 6)], "piece string, id long")
    rows = spark.createDataFrame([("a", " acgTTTtn")], "source_name string, seq string")
    r = W.dictionary_tokens(rows, vocab, 3, 99).first()
    assert (r.token_ids, r.base_lengths, r.tail_sequence) == ([5, 99, 6], [3, 3, 2], "")


def test_windows(spark):
    rows = spark.createDataFrame([("a", [5, 6, 7])], "source_name string, tokens array<long>")
    t = W.targets(rows, 5, 1)
    i, lab = W.decoder_window(F.col("target"), [9], 5, 0)
    r = t.select(i.alias("i"), lab.alias("l")).first()
    assert (r.i, r.l) == ([0, 9, 5, 6, 0], [-100, 5, 6, 7, -100])
    i, m, lab = W.encoder_window(F.col("target"), [9], 5, 0)
    r = t.select(i.alias("i"), m.alias("m"), lab.alias("l")).first()
    assert (r.i, r.m, r.l) == ([9, 5, 6, 7, 0], [1, 1, 1, 1, 0], [-100, 5, 6, 7, -100])
    n = spark.createDataFrame([(7,)], "n int")
    got = W.overlap_ranges(n, 4, 2).orderBy("start").collect()
    assert [(r.start, r.scored_from, r.scored_to) for r in got] == [(0, 0, 4), (2, 4, 6), (4, 6, 7)]
    assert one(spark, "ACGTA", F.lit(1)) == 1
    c = W.chunks(spark.createDataFrame([("a", [1, 2, 3, 4, 1])], "source_name string, tokens array<long>"), 4).orderBy("chunk_id").collect()
    assert [(r.codes, r.padding) for r in c] == [([1, 2, 3, 4], 0), ([1, 1, 1, 1], 3)]
    long = spark.createDataFrame([("a", list(range(50)))], "source_name string, tokens array<long>")
    small = {r.pos: r.input_ids for r in W.sliding(long, 8, -7, block=3).collect()}
    assert small == {r.pos: r.input_ids for r in W.sliding(long, 8, -7, block=4096).collect()} and small[0] == [-7] * 7 + [0]


def test_overlap_scores_each_token_once(spark):
    n = spark.range(1, 60).select(F.col("id").cast("int").alias("n"), F.col("id").alias("k"))
    for length, stride in ((2, 1), (5, 3), (8, 7)):
        w = W.overlap_ranges(n, length, stride).groupBy("k").agg(F.sum(F.col("scored_to") - F.col("scored_from")).alias("s"), F.max("scored_to").alias("m"))
        assert w.filter("s <> k or m <> k").count() == 0


def test_config():
    assert config.frequency_total(19564) == 2_097_152 and config.frequency_total(259) == 32_768
    assert S.normalize_alphabet("ac g tA") == "ACGT" and S.vocabulary(3, "ACGTN") == (127, 125, 126) and S.vocabulary(1, "AC")[1:] == (257, 258)
    assert config.overlap_stride(4, 9, 8) == 32 and config.overlap_stride(None, 9, 8) == 9 and config.overlap_stride(None, None, 8) == 8
    for bad in ({"train": 0.9}, {"strategy": "x"}, {"overlap_stride": 2000}, {"overlap_stride": 3, "patch_size": 2}):
        with pytest.raises(ValueError):
            config.DataConfig(**bad)
    with pytest.raises(ValueError):
        S.normalize_alphabet("A a")
    with pytest.raises(ValueError):
        config.max_target_tokens(4, 4)


def test_fasta_folder(spark, tmp_path):
    dna = tmp_path / "yeast" / "dna"
    dna.mkdir(parents=True)
    (dna / "Y.dna.chromosome.I.fa").write_text(">chrI\nacgtrxnn\n")
    with gzip.open(dna / "Y.dna.chromosome.II.fa.gz", "wt") as f:
        f.write(">chrII\nTTGGTT\nGGTTGG\n")
    (tmp_path / "yeast" / "other.fa").write_text(">x\nAAAA\n")
    (tmp_path / "worm").mkdir()
    (tmp_path / "worm" / "w.fa").write_text(">w\nCCCC\n")
    root = str(tmp_path)
    assert {(r.species, r.sequence_key) for r in fasta.discover_fasta(spark, root).collect()} == {("yeast", "I"), ("yeast", "II"), ("worm", "w")}
    whole = {}
    for block in (5, 1 << 20):
        rows = fasta.fasta_blocks(spark, root, block=block).orderBy("sequence_key", "block_id").collect()
        assert all(r.start == r.block_id * block for r in rows)
        joined = {}
        for r in rows:
            joined[r.sequence_key] = joined.get(r.sequence_key, "") + r.seq
        whole[block] = joined
    assert whole[5] == whole[1 << 20] == {"I": "ACGTNNNN", "II": "TTGGTTGGTTGG", "w": "CCCC"}
    assert {r.source_mode for r in fasta.source_modes(spark, root, ["yeast", "worm"]).collect()} == {"fasta_dir"}
    with pytest.raises(ValueError, match="neither"):
        fasta.source_modes(spark, root, ["fish"])
    files = fasta.discover_fasta(spark, root)
    manifest = fasta.manifest_of(files, "ACGTN")
    assert fasta.status_totals(fasta.cache_status(files, manifest, "ACGTN")).first().hit == 3
    assert fasta.status_totals(fasta.cache_status(files, manifest, "ACGT")).first().rebuilt == 3
    assert fasta.status_totals(fasta.cache_status(files, manifest.limit(0), "ACGTN")).first().created == 3
    assert fasta.status_totals(fasta.cache_status(files, manifest, "ACGTN", enabled=False)).first().disabled == 3


def test_requested_keys(spark):
    s = spark.createDataFrame([("human", "1", "A" * 12), ("human", "2", "C" * 12), ("worm", "I", "G")], "species string, sequence_key string, seq string")
    want = spark.createDataFrame([("human", " 2 ")], "species string, sequence_key string")
    assert sorted(r.sequence_key for r in C.select_keys(s, want).collect()) == ["2", "I"]
    with pytest.raises(ValueError, match="worm"):
        C.require_keys(s, spark.createDataFrame([("worm", "X")], "species string, sequence_key string"))
    with pytest.raises(ValueError, match="worm"):
        C.require_sources(spark.createDataFrame([("human", "A"), ("worm", ""), ("worm", None)], "species string, seq string"))
    C.require_sources(s)
    with pytest.raises(ValueError, match="w:I"):
        C.require_splits(C.split_table(s.withColumn("source_name", F.lit("w:I"))))


def test_prefix_ids(spark):
    vocabulary = spark.createDataFrame([("A", 0), ("<H>", 7)], "piece string, id long")
    rows = spark.createDataFrame([("human",), ("worm",), ("fish",)], "species string")
    got = {r.species: r.p for r in rows.select("species", W.prefix_ids(F.col("species"), {"human": "H", "worm": " "}, vocabulary).alias("p")).collect()}
    assert got == {"human": [7], "worm": [], "fish": []}
    with pytest.raises(ValueError, match="<Z>"):
        W.prefix_ids(F.col("species"), {"human": "Z"}, vocabulary)


def test_records_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.fa").write_text("dropped\n>one two\nac gt\n  nn  \n\n>empty\n>three\nAC\n")
    with gzip.open(tmp_path / "a" / "y.fa.gz", "wt") as f:
        f.write(">z\n" + "acgtn" * 30 + "\n" + "tt\n")
    for block in (4, 1 << 20):
        got = {}
        for r in fasta.read_records(spark, str(tmp_path), block).orderBy("path", "record", "block_id").collect():
            key = (r.path[-4:], r.record, r.header)
            assert r.start == r.block_id * block == len(got.get(key, ""))
            got[key] = got.get(key, "") + r.seq
        assert got == {("x.fa", 0, "one two"): "AC GTNN", ("x.fa", 1, "empty"): "", ("x.fa", 2, "three"): "AC", ("a.gz", 0, "z"): "ACGTN" * 30 + "TT"}


def test_flat_files_stay_as_they_are(spark, tmp_path):
    body = bytes(range(1, 256)) * 3
    (tmp_path / "HoSa").write_bytes(body)
    rows = fasta.flat_blocks(spark, str(tmp_path), 100).orderBy("block_id").collect()
    assert "".join(r.seq for r in rows).encode("latin-1") == body and {r.species for r in rows} == {"HoSa"} and [r.start for r in rows] == list(range(0, len(body), 100))


def test_clean_table_is_kept_up(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "table")
    (root / "yeast").mkdir(parents=True)
    (root / "yeast" / "a.fa").write_text(">a\nacgt\n")
    (root / "yeast" / "b.fa").write_text(">b\nttxx\n")
    state = lambda **o: [(sorted((r.sequence_key, r.seq) for r in b.collect()), {r.sequence_key: r.status for r in s.collect()}) for b, s in [fasta.refresh_clean(spark, str(root), table, **o)]][0]
    assert state() == ([("a", "ACGT"), ("b", "TTNN")], {"a": "created", "b": "created"})
    assert state() == ([("a", "ACGT"), ("b", "TTNN")], {"a": "hit", "b": "hit"})
    (root / "yeast" / "b.fa").write_text(">b\nggggg\n")
    (root / "yeast" / "c.fa").write_text(">c\nc\n")
    assert state() == ([("a", "ACGT"), ("b", "GGGGG"), ("c", "C")], {"a": "hit", "b": "rebuilt", "c": "created"})
    (root / "yeast" / "b.fa").write_text(">b\n\n\n")
    assert state() == ([("a", "ACGT"), ("c", "C")], {"a": "hit", "b": "rebuilt", "c": "hit"})
    assert state(alphabet="ACG")[1] == {"a": "rebuilt", "b": "rebuilt", "c": "rebuilt"}
    assert state(enabled=False) == ([("a", "ACGT"), ("c", "C")], {"a": "disabled", "b": "disabled", "c": "disabled"})


def test_token_table_is_kept_up(spark, tmp_path):
    table, calls = str(tmp_path / "t"), []

    def tokenise(rows):
        calls.append(rows.count())
        return rows.select("cache_key", "source_name", S.kmer_ids(F.col("seq"), 2).alias("tokens"))

    def state(rows):
        wanted = spark.createDataFrame(rows, "source_name string, split string, seq string")
        identity = [F.lit(1).alias("version"), F.col("source_name"), F.col("split"), F.sha2("seq", 256).alias("payload")]
        out, statuses = fasta.refresh_tokens(wanted, identity, tokenise, table)
        return sorted((r.source_name, tuple(r.tokens)) for r in out.collect()), sorted(r.status for r in statuses.collect())

    first = [("a", "train", "ACGT"), ("a", "val", "ACGT")]  # the same bytes in two splits are two entries
    want = sorted([("a", (1, 13)), ("a", (1, 13))])
    assert state(first) == (want, ["created", "created"])
    assert state(first) == (want, ["hit", "hit"])
    assert state([*first, ("b", "train", "CC")]) == (sorted([*want, ("b", (6,))]), ["created", "hit", "hit"])
    assert calls == [2, 1]


def test_csv_and_events(spark, tmp_path):
    fasta.write_csv([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3)], "c int, a int")], str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["a", "b", "c"] and back.count() == 2
    fasta.write_csv([], str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    (tmp_path / "log.jsonl").write_text('{"event":"train","step":10}\n\n[1]\n{"event":"eval","step":20}\n')
    assert [r.step for r in fasta.read_events(spark, str(tmp_path / "log.jsonl"), "event string, step long").orderBy("step").collect()] == [10, 20]
    (tmp_path / "bad.jsonl").write_text('{"event":\n')
    with pytest.raises(Exception, match="malformed line [0-9]+ in .*bad.jsonl"):
        fasta.read_events(spark, str(tmp_path / "bad.jsonl"), "event string, step long").collect()
    for name in ("r2", "r1", "deep/r0"):
        run = tmp_path / "runs" / name
        run.mkdir(parents=True)
        (run / "compression_compare.json").write_text('{"name": "%s"}' % name)
    rows = fasta.read_results(spark, str(tmp_path / "runs"), "name string").orderBy("run_dir").collect()
    assert [r.name for r in rows] == ["deep/r0", "r1", "r2"] and rows[1].run_dir.endswith("runs/r1")


def test_cleaning_is_looked_up_and_not_replaced_letter_by_letter(spark):
    """Odd bytes, header lines at either kind of line end, and nulls; no replacement by a pattern is left in the plan."""
    texts = [None, "", "ê\x85>a\rC", ">h\nac\r>gx\n \t>no\nT", "a>c\x1c>g\x0bt", "ßÿµ€\U0001f600k", "x" * 3000 + "ACGT"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", S.clean(F.col("t")).alias("c"), S.clean(F.col("t"), "ACGT").alias("d"), S.strict_clean(F.col("t"), 9).alias("s"))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r for r in out.collect()}
    assert [got[i].c for i in range(7)] == [None, "", "NNNAC", "ACGNT", "ACGT", "NNNNNNN", "N" * 3000 + "ACGT"]
    assert [got[i].d for i in range(6)] == [None, "", "AC", "ACGT", "ACGT", ""]
    assert [tuple(got[i].s) if got[i].s else None for i in range(1, 5)] == [("", 0, 0, 0), ("C", 8, 3, 1), ("AC", 9, 0, 2), ("ACT", 8, 1, 1)]
