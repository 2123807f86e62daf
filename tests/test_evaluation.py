"""The evaluation job against plain windows, one coder for each block, and a decoder."""

import bz2
import gzip
import lzma
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions.config import frequency_total
from strandworks.operators import evaluation as E
from strandworks.operators.coding import LZMA_HELD, Decoder, Encoder, Lzma, decode_many, encode_many, quantise, streamed_sizes
from strandworks.sources.fasta import blocks_of

VOCAB, PAD, EOS, K = 127, 125, 126, 3
TOTAL = frequency_total(VOCAB)


def scorer_of_contexts():
    """A scorer that depends on all that stands before a place in its window; a closure, so that it goes to the tasks by value."""
    vocab = VOCAB

    def score(windows, first):
        seen = np.cumsum(windows * np.arange(1, windows.shape[1] + 1), axis=1)
        seen = np.hstack([np.zeros((len(windows), 1), np.int64), seen[:, :-1]])[:, first:]
        x = np.sin(seen[:, :, None] % 1009 + np.arange(vocab)) * 2
        return x - np.log(np.exp(x).sum(2, keepdims=True))

    return score


context_scorer = scorer_of_contexts()


def sequences(spark, lengths=(0, 1, 2, 3, 40, 191, 192, 193, 500, 1331)):
    rng = random.Random(3)
    rows = [(f"s{n}", "".join(rng.choice("ACGTN") for _ in range(n))) for n in lengths]
    return spark.createDataFrame(rows, "source_name string, seq string"), dict(rows)


def symbols_of(seq):
    digits = ["ACGTN".index(c) for c in seq]
    return [25 * a + 5 * b + c for a, b, c in zip(*[iter(digits)] * 3)] + [EOS]


def plain_rows(mode, t, scorer):
    """For each symbol its probability row: whole windows, padded, kept in a list."""
    n, out = mode.length, []
    if mode.name == "sliding":
        padded = [PAD] * (n - 1) + t
        return [scorer(np.array([padded[i : i + n]]), n - 1)[0, -1] for i in range(len(t))]
    starts = range(0, len(t), n) if mode.name == "non_overlap" else [0, *(mode.stride * i for i in range(1, max(0, -(-(len(t) - n) // mode.stride)) + 1))]
    for s in starts:
        chunk = t[s : s + n]
        local = 0 if mode.name == "non_overlap" or s == 0 else min(n - mode.stride, len(chunk))
        out += list(scorer(np.array([chunk + [PAD] * (n - len(chunk))]), 0)[0, local : len(chunk)])
    return out


MODES = [E.Mode("non_overlap", 16), E.Mode("overlap", 16, 5), E.Mode("sliding", 16)]


@pytest.mark.parametrize("cut,size,held", [(4, 16, 1 << 20), (7, 48, 300), (1 << 15, 1 << 15, 1 << 20)])
def test_modes_against_plain_windows(spark, monkeypatch, cut, size, held):
    """Blocks shorter than a window too: what a window needs comes from as many as hold it."""
    monkeypatch.setattr(E, "HELD", held)
    df, seqs = sequences(spark)
    blocks = E.symbol_blocks(df, ["source_name"], K, "ACGTN", EOS, cut)
    codings = {"whole": None, "steps": E.Steps(K, 2, 5)}
    rows = E.evaluate(blocks, ["source_name"], MODES, context_scorer, VOCAB, PAD, TOTAL, codings, size).collect()
    for mode in MODES:
        for name, seq in seqs.items():
            t = symbols_of(seq)
            logs = plain_rows(mode, t, context_scorer)
            assert len(logs) == len(t)
            for coding in codings:
                own = sorted((r for r in rows if (r.source_name, r.mode, r.coding) == (name, mode.name, coding)), key=lambda r: r.code_block)
                assert sum(r.symbols for r in own) == len(t)
                assert np.isclose(sum(r.bits for r in own), -sum(x[i] for x, i in zip(logs, t)) / np.log(2))
                for r in own:
                    lo = r.code_block * (-(-size // 16) * 16)
                    d = Decoder(bytes(r.coded))
                    for x, i in zip(logs[lo : lo + r.symbols], t[lo : lo + r.symbols]):
                        assert decoded(d, np.exp(x), coding, i) == i
                    assert abs(8 * len(r.coded) - r.bits) <= r.bits / 100 + 128
                if coding == "whole":
                    assert sum(r.cum_low for r in own) == sum(int(quantise(np.exp(x)[None], TOTAL)[0, i]) for x, i in zip(logs, t))
                else:
                    assert sum(r.emitted for r in own) == 2 * len(t)


def decoded(d, p, coding, _):
    if coding == "whole":
        return d.decode(quantise(p[None], TOTAL)[0])
    groups = p[:125].reshape(25, 5)
    first = d.decode(quantise(np.append(p[125:].sum(), groups.sum(1))[None], TOTAL)[0])
    return 125 + d.decode(quantise(p[None, 125:], TOTAL)[0]) if first == 0 else 5 * (first - 1) + d.decode(quantise(groups[None, first - 1], TOTAL)[0])


def test_a_block_is_decoded_from_its_bytes_alone(spark):
    df, seqs = sequences(spark, (100, 400))
    rows = E.evaluate(E.symbol_blocks(df, ["source_name"], K, "ACGTN", EOS), ["source_name"], MODES[:1], context_scorer, VOCAB, PAD, TOTAL, {"whole": None}, 64).collect()
    for name, seq in seqs.items():
        own = sorted((r for r in rows if r.source_name == name), key=lambda r: r.code_block)
        got = np.concatenate([E.decode_block(bytes(r.coded), r.symbols, 16, context_scorer, PAD, TOTAL) for r in own])
        assert got.tolist() == symbols_of(seq)


@pytest.mark.parametrize("k,m", [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3), (4, 3)])
def test_steps_of_every_width(k, m):
    """Intervals of reserved and regular tokens against sums over the tokens of each group."""
    rng, regular = np.random.default_rng(k * 10 + m), 3**k
    p = rng.dirichlet(np.ones(regular + 2), 2 * (regular + 2))
    target = np.tile(np.arange(regular + 2), 2)
    lo, hi = E.Steps(k, m, 3).intervals(p, target, 1 << 15)
    for row, t, a, b in zip(p, target, lo, hi):
        want, left, group, here = [], k, 0, row[:regular]
        w = min(m, left)
        masses = np.append(row[regular:].sum(), here.reshape(3**w, -1).sum(1))
        if t >= regular:
            steps = [(masses, 0), (row[regular:], t - regular)]
        else:
            steps, rest = [], t
            while left:
                w = min(m, left)
                left -= w
                group, rest = divmod(rest, 3**left)
                masses = here.reshape(3**w, -1).sum(1)
                steps.append((masses, group) if steps else (np.append(row[regular:].sum(), masses), group + 1))
                here = here.reshape(3**w, -1)[group]
        for dist, s in steps:
            cum = quantise(dist[None], 1 << 15)[0]
            want.append((int(cum[s]), int(cum[s + 1])))
        assert [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x >= 0] == want


def test_modes_are_checked():
    for bad in (("other", 4), ("sliding", 0), ("overlap", 4), ("overlap", 4, 4), ("overlap", 4, 0), ("sliding", 4, 2)):
        with pytest.raises(ValueError):
            E.Mode(*bad)


def test_streamed_sizes_equal_whole_ones(spark):
    df, seqs = sequences(spark, (0, 1, 5000, 300_000))
    blocks = blocks_of(df, 999).select("source_name", "start", "seq").union(df.filter("seq = ''").selectExpr("source_name", "0L", "seq"))
    got = {r.source_name: r for r in streamed_sizes(blocks, ["source_name"]).collect()}
    for name, seq in seqs.items():
        b = seq.encode()
        assert (got[name].ascii, got[name].two_bit) == (len(b), (2 * len(b) + 7) // 8)
        assert (got[name].gzip, got[name].bz2, got[name].lzma) == (len(gzip.compress(b, 9, mtime=0)), len(bz2.compress(b)), len(lzma.compress(b)))


def lzma_size(*parts):
    codec = Lzma()
    for part in parts:
        codec.compress(part)
    return codec.flush()


def test_lzma_sizes_of_short_samples_without_a_large_dictionary():
    """The same sizes as by the default codec, for samples of all kinds and lengths, and at most half its time for short ones."""
    rng = random.Random(3)
    some = [bytes(rng.choices(b"ACGTN", w, k=n)) for n in (0, 1, 2, 3, 4, 700, 4095, 4096, 4097, 70_000) for w in ((1, 1, 1, 1, 0), (1, 1, 1, 1, 30), (9, 1, 1, 9, 2))]
    some += [x * m for x in some[15:18] for m in (2, 90)] + [b"N" * 65_537, bytes(rng.choices(b"ACGT", k=LZMA_HELD)), bytes(rng.choices(b"ACGT", k=LZMA_HELD + 1)), bytes(rng.choices(b"ACGTRY", k=9000))]
    for x in some:
        assert lzma_size(x) == len(lzma.compress(x)) == lzma_size(x[:999], x[999:2500], x[2500:])
    short = [bytes(rng.choices(b"ACGTN", k=300)) for _ in range(300)]

    def seconds(f):
        began = time.process_time()
        for x in short:
            f(x)
        return time.process_time() - began

    assert 2 * min(seconds(lzma_size) for _ in range(3)) < min(seconds(lzma.compress) for _ in range(3))


def test_an_empty_sample_keeps_a_block(spark):
    df, _ = sequences(spark, (0, 1, 5000))
    cut = blocks_of(df, 999, keep_empty=True)
    assert sorted((r.start, len(r.seq)) for r in cut.collect()) == sorted([(0, 0), (0, 1), *((i * 999, min(999, 5000 - i * 999)) for i in range(6))])
    assert blocks_of(df, 999).count() == 7
    assert {r.ascii for r in streamed_sizes(cut, ["source_name"]).collect()} == {0, 1, 5000}


def test_long_windows_in_bounded_memory(spark):
    """L = 4,096: a source of 60,000 symbols, each scored once, from blocks shorter than the window."""
    df = spark.createDataFrame([("a", "ACGT" * 45_000)], "source_name string, seq string")
    blocks = E.symbol_blocks(df, ["source_name"], K, "ACGTN", EOS, 1000)
    r = E.evaluate(blocks, ["source_name"], [E.Mode("sliding", 4096), E.Mode("overlap", 4096, 512)], E.repeat_scorer(VOCAB), VOCAB, PAD, TOTAL, {"whole": None}, 1 << 14)
    out = E.per_source(r, ["source_name"], K, True).select("mode", "symbols", F.round("bits", 4).alias("bits"), "bases").collect()
    assert {(x["mode"], x["symbols"], x["bases"]) for x in out} == {("sliding", 60_001, 180_000), ("overlap", 60_001, 180_000)}
    assert len({x["bits"] for x in out}) == 1


@pytest.mark.parametrize("lanes", [1, 7, 40])
def test_lanes_give_the_bytes_of_one_coder_each(lanes):
    """Lanes of every length, none too; tables of one letter that is nearly sure, of even ones, and totals that are no power of two."""
    rng = np.random.default_rng(lanes)
    for kind in range(3):
        sizes = rng.integers(0, 120, lanes)
        n = [rng.integers(1, 9, (lanes, 5)), np.tile([1, 10**6, 1, 1, 1], (lanes, 1)), np.full((lanes, 5), (1 << 27) + 1)][kind]
        cum = np.hstack([np.zeros((lanes, 1), np.int64), np.cumsum(n, axis=1)])
        lane = np.repeat(np.arange(lanes), sizes)
        symbols = rng.integers(0, 5, len(lane)) if kind != 1 else np.where(rng.random(len(lane)) < 0.02, 4, 1)
        coded = encode_many(cum[lane, symbols], cum[lane, symbols + 1], cum[:, -1], sizes)
        for i in range(lanes):
            e = Encoder()
            e.encode_all(cum[i, symbols[lane == i]], cum[i, symbols[lane == i] + 1], int(cum[i, -1]))
            assert e.finish() == coded[i]
        assert (decode_many(coded, sizes, cum) == symbols).all()


def test_few_distributions_are_quantised_once_and_give_what_single_symbols_give(spark, monkeypatch):
    """A scorer with a table against the same one without: 8,000 symbols in three modes quantise no more rows than there are pairs."""
    df, _ = sequences(spark, (0, 5, 3000, 20_000))
    blocks, codings, scorer = E.symbol_blocks(df, ["source_name"], K, "ACGTN", EOS, 999), {"whole": None, "steps": E.Steps(K, 2, 5)}, E.repeat_scorer(VOCAB)
    plain = lambda windows, first: scorer(windows, first)
    rows = lambda s: sorted((r.source_name, r.mode, r.coding, r.code_block, r.emitted, r.cum_low, bytes(r.coded), round(r.bits, 6)) for r in E.evaluate(blocks, ["source_name"], MODES, s, VOCAB, PAD, TOTAL, codings, 1024).collect())
    assert rows(scorer) == rows(plain)
    seen = []
    monkeypatch.setattr(E, "quantise", lambda p, total: seen.append(len(p)) or quantise(p, total))
    of, rng = E._Intervals(scorer, VOCAB, TOTAL, {"whole": None}), np.random.default_rng(1)
    for _ in range(3):
        windows = rng.integers(0, 5, (2000, 16))
        of(windows, 0, np.ones(windows.shape, bool), windows.ravel())
    assert sum(seen) <= 6 * 5
