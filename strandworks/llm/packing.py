"""Packing along a space-filling curve: similar documents come to lie in the same sequences.

Each document's tokens are hashed into ``BUCKETS`` counts, damped, scaled to unit length and
projected to ``DIMS`` dimensions by a fixed pseudo-random matrix; the coordinates are cut to
``BITS`` bits and interleaved along the Hilbert curve. Documents are sorted by (key, id) over
range partitions - ties by id keep copies of one text from filling one task - and each
partition's token stream is cut into sequences of ``SEQUENCE`` tokens. What is left at a partition's
end is cut at powers of two, so no sequence needs padding.

Token ids come from the tokenizer, word by word: its normaliser and splitter never join what
white space parts, so a bounded cache of words gives the same ids as whole texts. A hash finds a
word's place in the cache; a word is taken from there only if it is the same by its key (``common.word_keys``).
Long texts are coded in stretches that are cut at spaces.

Defined results: a null or empty text is the end token alone; equal ids and repeated rows are
packed one by one, parted by their place in the input, so that they spread over tasks too; a null id sorts first; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import LOWER, U64, discard, folded, groups_of, materialise, mix, narrow, parted, partitions, session_conf, utf8, word_keys

SEQUENCE = 4096
END = 2
BUCKETS = 512
DIMS = 3
BITS = 16
#: Words whose ids a worker remembers (a power of two), and bytes of text coded at a time.
CACHE_SLOTS, CHUNK = 1 << 21, 1 << 20
#: Tokens of one row. Longer documents travel in several, so that ranges of rows are ranges of tokens too.
SHARD = 1024
#: Rows of each partition that the splitters are taken from (Spark takes a million in all at most).
SAMPLED_ROWS = 200


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The normaliser and splitter under which words can be coded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_chars() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


class WordIds:
    """Token ids of texts, through a bounded cache of words; one per worker process.

    Words are stretches that the tokenizer codes alone: what white space parts, with a lone stop or
    comma behind a letter as a word of its own. Words of ASCII alone are lower-cased first, as the
    normaliser would; others go to it unchanged, as it composes letters and marks before it lowers
    them. Texts that may spell a special token are coded whole instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        form = json.loads(self.tokenizer.to_str())
        #: Whether words may be coded one by one, and letters by the model alone.
        self.by_word = form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == PRE_TOKENIZER
        self.model = self.tokenizer.model
        self.lo, self.hi = np.zeros(CACHE_SLOTS, U64), np.zeros(CACHE_SLOTS, U64)  # no word's key is 0
        self.entry = np.zeros(CACHE_SLOTS, np.int64)
        self.reset()

    def reset(self) -> None:
        self.hi[:] = 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.n, self.filled = np.zeros(1 << 18, np.uint32), 0, 0

    def learn(self, words: list[str]) -> int:
        """Code new words; returns the first one's entry.

        A word of normalised lower-case letters is what normaliser and splitter would leave as it
        is, so the model codes it alone; the rest take the whole way.
        """
        coded: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w.isalpha() and (w.isascii() or (w == w.lower() and unicodedata.is_normalized("NFC", w))):
                mapped = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS)
                coded[i] = [t.id for t in self.model.tokenize(mapped)]
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
                coded[i] = e.ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        n, filled = self.n + len(coded), self.filled + len(flat)
        while len(self.start) < n:
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while len(self.flat) < filled:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : filled] = flat
        self.length[self.n : n] = sizes
        self.start[self.n : n] = self.filled + np.cumsum(sizes) - sizes
        first, self.n, self.filled = self.n, n, filled
        return first

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows of UTF-8 bytes, and the place where each row's begin."""
        if self.n > CACHE_SLOTS // 2:
            self.reset()
        text, off = parted(data, offsets)
        inside = (text != 0x20) & (text != 0x0A)
        lone = np.zeros(len(text), bool)
        lone[1:-1] = ((text[1:-1] == 0x2E) | (text[1:-1] == 0x2C)) & ((text[:-2] | 0x20) >= 0x61) & ((text[:-2] | 0x20) <= 0x7A) & ~inside[2:]
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | lone[1:]]))
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | lone[1:], [True]])) + 1
        first = np.searchsorted(starts, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        text = lowered(text, starts, ends)
        lo, hi = word_keys(text, starts, ends)
        slot = (folded(lo, hi) >> U64(40)).astype(np.int64) & (CACHE_SLOTS - 1)
        entry = self.entry[slot]
        missed = np.flatnonzero((self.lo[slot] != lo) | (self.hi[slot] != hi))
        if len(missed):
            by = missed[np.lexsort((hi[missed], lo[missed]))]
            new_word = np.concatenate([[True], (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])])
            at = by[new_word]
            words = [text[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            new = self.learn(words) + np.arange(len(at))
            entry[by] = new[np.cumsum(new_word) - 1]
            # two new words of one slot: the later one stays, whole
            put = np.unique(slot[at][::-1], return_index=True)[1]
            at, new = at[::-1][put], new[::-1][put]
            self.lo[slot[at]], self.hi[slot[at]], self.entry[slot[at]] = lo[at], hi[at], new
        size = self.length[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first]

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row of a string column, with the end token."""
        data, off = utf8(column)
        out: list[np.ndarray] = []
        end = np.array([END], np.uint32)
        for a, b in groups_of(off, CHUNK):
            part = data[off[a] : off[b]]
            if not self.by_word or _special(part):
                whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in column.slice(a, b - a).to_pylist()]
                out += [np.array([*ids, END], np.uint32) for ids in whole]
                continue
            if len(part) > 2 * CHUNK:  # one long text
                cuts = spaced_cuts(part, CHUNK)
                ids = [self.chunk(part[i:j], np.array([0, j - i]))[0] for i, j in zip(cuts, cuts[1:], strict=False)]
                out.append(np.concatenate([*ids, end]))
                continue
            ids, place = self.chunk(part, off[a : b + 1] - off[a])
            out += [np.concatenate([ids[i:j], end]) for i, j in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        return out


def spaced_cuts(data: np.ndarray, size: int) -> list[int]:
    """Cut bytes about every ``size`` at a space; where there is none, the stretch goes on."""
    cuts = [0]
    while len(data) - cuts[-1] > 2 * size:
        at = cuts[-1] + size
        while at < len(data) and not (near := np.flatnonzero(data[at : at + size] == 0x20)).size:
            at += size
        if at >= len(data):
            break
        cuts.append(at + int(near[0]))
    return [*cuts, len(data)]


def lowered(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, but for words that hold a byte beyond ASCII."""
    out = LOWER[text]
    high = np.concatenate([[0], np.cumsum(text >= 0x80)])
    other = np.flatnonzero(high[ends] > high[starts])
    if len(other):
        edge = np.zeros(len(text) + 1, np.int8)
        edge[starts[other]] += 1
        edge[ends[other]] -= 1
        kept = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
        out[kept] = text[kept]
    return out


def _special(data: np.ndarray) -> bool:
    """Whether ``<|`` is anywhere in the bytes."""
    return bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """The worker's own tokenizer and cache, kept from task to task."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def projection() -> np.ndarray:
    """A fixed BUCKETS x DIMS matrix of pseudo-random values about 0."""
    cells = mix(np.arange(1, BUCKETS * DIMS * 4 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64
    return (cells.reshape(BUCKETS, DIMS, 4).sum(2) - 2.0) * np.sqrt(3.0)


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (any number of dimensions)."""
    x = [c.astype(np.int64) for c in np.asarray(coords).T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections, from the top bit down
        p = q - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            t = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key



def curve_key(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document's token ids."""
    vectors = np.zeros((len(ids), BUCKETS))
    for i, a in enumerate(ids):
        slot = (mix(a.astype(U64) + U64(1)) >> U64(55)).astype(np.int64)
        vectors[i] = np.bincount(slot, minlength=BUCKETS)
    np.log1p(vectors, out=vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    place = (vectors / np.where(norm == 0, 1, norm)) @ matrix
    # unit vectors of non-negative counts project to a narrow band; spread it over the whole grid
    cells = np.clip((np.tanh(place * 0.8) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, key, n_tokens, row, shard, ids``: ids as uint16 or uint32 bytes, long documents in several shards.

    ``row`` tells documents of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        words, matrix = coder(path), projection()
        small = words.tokenizer.get_vocab_size() <= 1 << 16
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                ids = words.rows(batch.column(1))
                keys = curve_key(ids, matrix)
                rows = []
                for doc, key, a in zip(batch.column(0).to_pylist(), keys.tolist(), ids, strict=True):
                    row += 1
                    for s in range(0, len(a), SHARD):
                        rows.append((doc, key, len(a), row, s // SHARD, a[s : s + SHARD].astype("<u2" if small else "<u4").tobytes()))
                names = ["doc_id", "key", "n_tokens", "row", "shard", "ids"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, key long, n_tokens long, row long, shard int, ids binary")


def tail_cuts(n: int) -> list[int]:
    """A rest of fewer than SEQUENCE tokens as powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_sorted(rows: DataFrame, wide: bool) -> DataFrame:
    """Cut each partition's stream of documents into sequences. Holds the open sequence's pieces only."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []  # finished pieces
        open_: list[tuple] = []  # (doc, start, doc_tokens, ids) of the sequence under way
        filled = 0

        def close(sizes: list[int]) -> None:
            """Turn the open pieces into sequences of the given sizes."""
            nonlocal sequence, open_, filled
            pieces = iter(open_)
            cur = next(pieces, None)
            for size in sizes:
                at = 0
                while at < size:
                    doc, start, total, ids = cur
                    take = min(size - at, len(ids))
                    part = ids[:take]
                    out.append((doc, start, take, zlib.crc32(part.astype("<u4").tobytes()), total, sequence, at))
                    at += take
                    cur = (doc, start + take, total, ids[take:]) if take < len(ids) else next(pieces, None)
                sequence += 1
            open_, filled = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc, total, shard, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, start = np.frombuffer(raw, kind), shard * SHARD
                while len(ids):
                    take = min(SEQUENCE - filled, len(ids))
                    open_.append((doc, start, total, ids[:take]))
                    filled, start, ids = filled + take, start + take, ids[take:]
                    if filled == SEQUENCE:
                        close([SEQUENCE])
                if len(out) >= 20_000:
                    yield flush()
        if filled:
            close(tail_cuts(filled))
        if out:
            yield flush()

    return rows.select("doc_id", "n_tokens", "shard", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    The tokens are written once, so that sampling the splitters doesn't tokenise again. Rows hold up to
    ``SHARD`` tokens and splitters come from a large sample, so ranges hold about equal numbers of tokens.
    """
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16
    coded = materialise(tokenised(narrow(docs, id_col, text_col), path), "tokens")
    order = [F.col("key"), F.col("doc_id"), F.col("row"), F.col("shard")]
    spread = coded.repartitionByRange(partitions(docs.sparkSession), *order)
    with session_conf(docs.sparkSession, {"spark.sql.execution.rangeExchange.sampleSizePerPartition": str(SAMPLED_ROWS)}):
        pieces = materialise(pack_sorted(spread.sortWithinPartitions(*order), wide), "pieces")
    discard(coded)
    return pieces
