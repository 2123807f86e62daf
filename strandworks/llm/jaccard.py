"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are lower-cased and cut into words (runs of letters, digits and everything beyond ASCII);
a text is the set of its ``SHINGLE``-word shingles (a shorter text is one shingle). Two documents are
linked if the Jaccard similarity of their sets is ``THRESHOLD`` or more.

1. Documents of equal sets are one class; only its first document (by id) goes on.
2. ``HASHES`` MinHash values per class; classes that agree on all ``ROWS`` values of one of
   ``HASHES // ROWS`` bands are candidates. A pair at the threshold is missed with probability
   (1 - 0.8**6)**42, about 3e-6, and with less above it.
3. Candidates are compared ``STEP`` MinHash values at a time. After each step the posterior
   probability that the similarity reaches the threshold, given the matches so far and a uniform
   prior, decides: below ``TOLERANCE`` the pair is dropped. Over all steps a pair at the threshold is
   lost with probability 1e-6 (``pruning_loss``).
4. What survives is joined into components of candidates. Within a component each pair whose set sizes
   allow the threshold is verified exactly on its shingle sets. Shingles are compared by 128 bits, two
   independent hashes of words that are told apart by themselves (``common.word_keys``).

No pair is ever a row. Band groups and components are cut into blocks; a task holds two blocks,
compares them in memory, and returns link counts and a spanning forest. Texts travel once. What is dealt to
blocks is how a class's set differs from that of its component's first class (16 bytes a shingle), which
for near copies is little, and the sizes of intersections follow from these differences exactly. A component of g
classes is sent g / VERIFY_BLOCK times over. The number of links of g texts that are all alike takes g * g / 2
comparisons in any case.

Results: per document its class (the least id that it is linked to, over any number of links) and
its number of links: the other documents of similarity at the threshold or above, copies included.
Texts without words are in no class but their own and have no links. Repeated or null ids as in
``common.keyed``; a null id takes part, and is a class's id only if it is alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import LOWER, PLAIN_WORD, U64, discard, folded, groups_of, keyed, materialise, mix, parted, partitions, utf8, word_keys, words_of
from strandworks.llm.decontam import grams

SHINGLE = 5
THRESHOLD = 0.8
HASHES, ROWS, STEP = 252, 6, 21
TOLERANCE = 1e-7
BLOCK, VERIFY_BLOCK = 1024, 512
#: Shingles of one block at most, on average: long texts make more blocks.
BLOCK_SHINGLES = 2_000_000
CHUNK = 1 << 20
#: MinHash values are compared by their low byte: unequal values agree by chance once in 256.
CHANCE = 1 / 256

_A = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (rows of two hashes) of each text, one after the other, and their offsets."""
    text, off = parted(data, offsets)
    text = LOWER[text]
    starts, ends = words_of(text, PLAIN_WORD)
    lo, hi = word_keys(text, starts, ends)
    both = folded(lo, hi, 1), folded(hi, lo, 2)
    first = np.searchsorted(starts, off)
    g = np.stack([grams(h, size) for h in both], 1)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = g[a : b - size + 1]
            s = s[np.argsort(s[:, 0], kind="stable")]
            sets.append(s[np.concatenate([[True], (s[1:] != s[:-1]).any(1)])])
        else:
            sets.append(np.stack([grams(h[a:b], b - a)[:1] for h in both], 1) if b > a else np.zeros((0, 2), U64))
    return (np.concatenate(sets) if sets else np.zeros((0, 2), U64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of one set, by multiply-add hashing of folded and mixed shingles."""
    x = mix(shingles[:, 0])
    x = (x ^ (x >> U64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), 256):
            part = x[a : a + 256]
            h = _A[:, None] * part[None, :] + _B[:, None]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            np.minimum(out, h.min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature (rows)."""
    parts = sig.reshape(len(sig), HASHES // ROWS, ROWS).astype(U64)
    with np.errstate(over="ignore"):
        key = np.zeros(parts.shape[:2], U64)
        for r in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r] + U64(r + 1))
        return mix(key + np.arange(HASHES // ROWS, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values (STEP, 2 STEP, ...): the fewest matches that keep a pair.

    With a uniform prior on the similarity s and m of n matches, the posterior weight of s is
    p**m * (1 - p)**(n - m) with p = s + (1 - s) * CHANCE; it is summed over a fine grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) * CHANCE
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            w = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(w - w.max())
            if w[s >= threshold].sum() >= tolerance * w.sum():
                break
        out.append(m)
    return tuple(out)


def pruning_loss(similarity: float) -> float:
    """The probability that a pair of this similarity is dropped after one of the steps."""
    p = similarity + (1 - similarity) * CHANCE
    step = np.array([math.comb(STEP, k) * p**k * (1 - p) ** (STEP - k) for k in range(STEP + 1)])
    going, lost = np.ones(1), 0.0
    for least in least_matches():
        going = np.convolve(going, step)
        lost += float(going[:least].sum())
        going[:least] = 0
    return lost


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the other signatures (rows of bytes) are not dropped against ``one``, step by step."""
    at = np.arange(len(others))
    matches = np.zeros(len(others), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (others[at, part] == one[part]).sum(1, dtype=np.int32)
        keep = matches >= least
        if not keep.all():
            at, matches = at[keep], matches[keep]
        if not len(at):
            break
    return at


# --- step 1: classes -----------------------------------------------------------------------------


def signed(texts: DataFrame) -> DataFrame:
    """``rid, n_shingles, set_key, low, bands``: also the MinHash values' low bytes and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, off = utf8(batch.column(1))
            sizes, keys, low, band = [], [], [], []
            for a, b in groups_of(off, CHUNK):
                values, cut = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                sizes += np.diff(cut).tolist()
                keys += [hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                sig = np.stack([signature(values[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)])
                low += [r.tobytes() for r in (sig & np.uint32(255)).astype(np.uint8)]
                band += list(bands(sig).view(np.int64))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.binary()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "n_shingles", "set_key", "low", "bands"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, n_shingles long, set_key binary, low binary, bands array<long>")


# --- blocks: pairs in memory, never as rows ------------------------------------------------------


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Deal each group out so that every two of its members meet in one task: columns ``i, j, side``.

    A group of one block is one cell; a larger one has a cell per pair of blocks. Members are dealt
    to blocks by a hash of their id; ``blocks`` is the group's number of them.
    """
    n = F.greatest(blocks.cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("rid"), n.cast("long")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(mine <= o, 0).otherwise(1).alias("side")),
    )
    return rows.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell")


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows come sorted by ``keys``); one or more groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(len(batch), bool)
        for c in cols:
            same &= c == c[-1]
        cut = int(np.argmax(same))
        if held:
            last = held[-1]
            goes_on = all(last.column(k)[len(last) - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if cut == 0 and goes_on:
                held.append(batch)
                continue
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            else:
                yield pa.Table.from_batches(held)
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def cuts_of(table: pa.Table, keys: list[str]) -> list[int]:
    change = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change |= c[1:] != c[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]


class Forest:
    """Union-find over positions; ``join`` says whether two trees became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def candidate_edges(grouped: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the pairs that survive in each cell of a band group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, ["band", "i", "j"]):
            left, right = [], []
            cuts = cuts_of(table, ["band", "i", "j"])
            rid, side, cell_i, cell_j = (table.column(c).to_numpy() for c in ("rid", "side", "i", "j"))
            low = np.frombuffer(utf8(table.column("low"))[0], np.uint8).reshape(len(table), HASHES)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                forest = Forest(b - a)
                same_block = cell_i[a] == cell_j[a]
                ones = range(a, b) if same_block else np.flatnonzero(side[a:b] == 0) + a
                far = None if same_block else np.flatnonzero(side[a:b] == 1) + a
                for x in ones:
                    others = np.arange(x + 1, b) if far is None else far
                    if not len(others):
                        continue
                    for y in others[survivors(low[x], low[others])].tolist():
                        if forest.join(int(x) - a, y - a):
                            left.append(rid[x])
                            right.append(rid[y])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return grouped.select("band", "i", "j", "side", "rid", "low").mapInArrow(run, "a long, b long")


VERIFIED = "rid long, links long, other long"


def verified(grouped: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (rid, links, null): weighted links of a class in a cell; rows (rid, null, other): a forest of true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, ["comp", "i", "j"]):
            cuts = cuts_of(table, ["comp", "i", "j"])
            rid, side, cell_i, cell_j, weight, size_, minus_, base = (table.column(c).to_numpy() for c in ("rid", "side", "i", "j", "weight", "size", "minus", "base"))
            packed, off = utf8(table.column("packed"))
            packed, off = packed.view(U64).reshape(-1, 2), off // 16
            rows: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                values, cut = packed[off[a] : off[b]], off[a : b + 1] - off[a]
                by = np.lexsort((values[:, 1], values[:, 0]))
                codes = np.zeros(len(by), np.int64)
                codes[by[1:]] = np.cumsum((values[by][1:] != values[by][:-1]).any(1))
                size, minus, n_diff = size_[a:b], minus_[a:b], np.diff(cut)
                flags = np.zeros(len(by), bool)
                links, forest = np.zeros(b - a, np.int64), Forest(b - a)
                same_block = cell_i[a] == cell_j[a]
                near = np.arange(b - a) if same_block else np.flatnonzero(side[a:b] == 0)
                far = None if same_block else np.flatnonzero(side[a:b] == 1)
                for x in near.tolist():
                    others = np.arange(x + 1, b - a) if far is None else far
                    others = others[(size[others] >= threshold * size[x] - 1e-9) & (size[x] >= threshold * size[others] - 1e-9)]
                    if not len(others):
                        continue
                    mine = codes[cut[x] : cut[x + 1]]
                    flags[mine] = True
                    n = n_diff[others]
                    end = np.cumsum(n)
                    at = np.repeat(cut[others] - (end - n), n) + np.arange(int(n.sum()))
                    alike = np.concatenate([[0], np.cumsum(flags[codes[at]])])
                    flags[mine] = False
                    # of the base's shingles those that neither lacks, and of the others those that both have
                    both = base[a] - minus[x] - minus[others] + alike[end] - alike[end - n]
                    true = others[both >= threshold * (size[x] + size[others] - both) - 1e-9]
                    links[x] += weight[a + true].sum()
                    links[true] += weight[a + x]
                    for y in true.tolist():
                        if forest.join(x, y):
                            rows.append((rid[a + x], None, rid[a + y]))
                rows += [(rid[a + x], links[x], None) for x in np.flatnonzero(links).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["rid", "links", "other"])

    return grouped.select("comp", "i", "j", "side", "rid", "weight", "size", "minus", "base", "packed").mapInArrow(run, VERIFIED)


def absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which shingles of one sorted set the other doesn't have."""
    if not len(b):
        return np.ones(len(a), bool)
    if (b[1:, 0] == b[:-1, 0]).any():  # one hash may stand twice, for different shingles
        return ~np.isin(a.view("V16").ravel(), b.view("V16").ravel())
    at = np.minimum(np.searchsorted(b[:, 0], a[:, 0]), len(b) - 1)
    return (b[at] != a).any(1)


DIFFERENCES = "rid long, comp long, weight long, blocks long, size long, minus long, base long, packed binary"


def differences(members: DataFrame) -> DataFrame:
    """The members with their sets' differences from their component's first set, ``base_text``'s.

    ``packed`` has the shingles that just one of the two sets has; ``minus`` of them are the base's, which has ``base`` in all.
    """
    names = [x.split()[0] for x in DIFFERENCES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, np.zeros((0, 2), U64))  # rows of one component often follow each other
        for batch in batches:
            data, off = utf8(batch.column(4))
            comps = batch.column(1).to_pylist()
            for a, b in groups_of(off, CHUNK):
                values, cut = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                sizes, minus, base, packed = [], [], [], []
                for i in range(a, b):
                    if held[0] != comps[i]:
                        held = comps[i], shingle_sets(*utf8(batch.column(5).slice(i, 1)))[0]
                    mine, first = values[cut[i - a] : cut[i - a + 1]], held[1]
                    lacks, has = first[absent(first, mine)], mine[absent(mine, first)]
                    sizes.append(len(mine))
                    minus.append(len(lacks))
                    base.append(len(first))
                    packed.append(np.concatenate([lacks, has]).tobytes())
                cols = [*(batch.column(i).slice(a, b - a) for i in range(4)), *(pa.array(x, pa.int64()) for x in (sizes, minus, base)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return members.select("rid", "comp", "weight", "blocks", "text", "base_text").mapInArrow(run, DIFFERENCES)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``v, comp``: the least vertex of each vertex's component, for the vertices of ``edges`` (a, b).

    Alternates two steps until nothing changes: every vertex hangs its larger neighbours, then
    its smaller ones, on its least neighbour. Minima are partial sums, written before they are joined, so
    that Spark can split the edges of a vertex with very many neighbours. Each round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), name)
    # the rows of two rounds are the same if their number and two sums of 64-bit hashes are
    h = F.xxhash64("hi", "lo")
    summed = lambda t: t.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    before = summed(now)
    while True:
        both = now.union(now.select("lo", "hi")).toDF("v", "w")
        least = materialise(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("m", "v").alias("m")), name)
        large = both.join(least, "v").filter("w > v").select(F.col("w").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
        large = materialise(large, name)
        under = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), name)
        hung = large.join(under, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialise(hung.union(under.toDF("hi", "lo")).filter("hi > lo").distinct(), name)
        discard(now, least, large, under)
        now, last, before = after, before, summed(after)
        if before == last:
            break
    return now.select(F.col("hi").alias("v"), F.col("lo").alias("comp")).union(now.select(F.col("lo"), F.col("lo")).distinct())


# --- the join ------------------------------------------------------------------------------------


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, keep_row: bool = False) -> tuple[DataFrame, bool]:
    """``doc_id, rid, class_rid, n_links`` of every row (and ``_row``, if asked for); and whether rids are the ids."""
    rows, texts, plain = keyed(docs, id_col, text_col, keep_row)
    deal = lambda df, *keys: df.repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    described = materialise(signed(texts), "signatures")
    worded = described.filter("n_shingles > 0")
    classes = materialise(worded.groupBy("set_key").agg(F.min("rid").alias("rep"), F.count("*").alias("weight")), "classes")
    reps = worded.join(classes.select("rep", "weight"), F.col("rid") == F.col("rep"))

    # candidates: classes that share a band, compared step by step
    banded = reps.select("rid", F.explode("bands").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "shared-bands")
    meeting = materialise(banded.join(shared, "band"), "bands")
    carried = meeting.join(worded.select("rid", "low"), "rid")
    edges = candidate_edges(deal(in_blocks(carried, F.ceil(F.col("size") / block)), "band", "i", "j"))
    comps = components(edges, "candidates")
    discard(shared, meeting)

    # components of survivors, verified exactly
    in_comp = materialise(comps.join(reps.select("rid", "weight", "n_shingles"), F.col("v") == F.col("rid")).select("rid", "comp", "weight", "n_shingles"), "members")
    n_blocks = F.greatest(F.ceil(F.count("*") / (VERIFY_BLOCK * block // BLOCK or 1)), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = materialise(in_comp.groupBy("comp").agg(n_blocks.cast("long").alias("blocks")), "component-sizes")
    firsts = materialise(sizes.join(texts, F.col("comp") == F.col("rid")).select("comp", "blocks", F.col("text").alias("base_text")), "first-texts")
    with_texts = materialise(in_comp.join(texts, "rid"), "member-texts")
    different = differences(with_texts.join(firsts, "comp"))
    checked = materialise(verified(deal(in_blocks(different, F.col("blocks")), "comp", "i", "j"), threshold), "links")
    discard(in_comp, sizes, firsts, with_texts)
    links = checked.groupBy("rid").agg(F.sum("links").alias("links")).filter("links is not null")
    joined = components(checked.filter("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")), "true")

    per_class = (
        classes.join(links.withColumnRenamed("rid", "l_rid"), F.col("rep") == F.col("l_rid"), "left")
        .join(joined, F.col("rep") == F.col("v"), "left")
        .select("set_key", F.coalesce("comp", "rep").alias("class_rid"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    # classes of one document keep their own row; only the others need the join by set
    per_text = described.select("rid", "set_key", "n_shingles").join(per_class, "set_key", "left").select(
        F.col("rid").alias("p_rid"),
        F.when(F.col("n_shingles") > 0, F.col("class_rid")).otherwise(F.col("rid")).alias("class_rid"),
        F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return rows.drop("text").join(per_text, F.col("rid") == F.col("p_rid")).drop("p_rid"), plain


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document."""
    out, plain = linked(docs, id_col, text_col, threshold, block)
    if plain:
        return out.select("doc_id", F.col("class_rid").alias("class_id"), "n_links")
    out = materialise(out, "classes")
    names = out.groupBy(F.col("rid").alias("c_rid")).agg(F.min("doc_id").alias("class_id"))
    names = materialise(names, "names")
    return out.join(names, F.col("class_rid") == F.col("c_rid")).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first document (by id) of each class, in the columns that came in; texts without words all stay."""
    kept = linked(docs, id_col, text_col, threshold, keep_row=True)[0].filter(F.col("rid") == F.col("class_rid"))
    return kept.dropDuplicates(["rid"]).select("_row.*")
