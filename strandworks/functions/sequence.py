"""Column expressions over nucleotide sequences held as strings (one row per sequence or block)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin-1 letters among the bytes of UTF-8 text, besides A-Z and a-z.
_HIGH_LETTERS = "\\xAA\\xB5\\xBA\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\xFF"


def normalize_alphabet(alphabet: str) -> str:
    """Upper case, no white space, first occurrences only; at least two letters."""
    out = "".join(dict.fromkeys(c for c in alphabet.upper() if not c.isspace()))
    if len(out) < 2:
        raise ValueError("an alphabet needs at least two different characters")
    return out


def vocabulary(k: int, alphabet: str) -> tuple[int, int, int]:
    """(size, pad id, eos id) of k-mers over an alphabet; byte tokens for k <= 1."""
    if k <= 1:
        return 259, 257, 258
    n = len(normalize_alphabet(alphabet)) ** k
    if n + 2 > 2**63 - 1:
        raise ValueError(f"{k}-mers over {len(alphabet)} letters do not fit a BIGINT")
    return n + 2, n, n + 1


def byte_view(text: Column) -> Column:
    """Each UTF-8 byte as one character."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def without_headers(text: Column) -> Column:
    """Without FASTA header lines; lines end at a line feed only."""
    return F.regexp_replace(text, "(?md)^[ \\t\\r\\f\\x0B]*>.*$", "")


#: A FASTA header in bytes, as ``without_headers`` has it.
_HEADER = re.compile(rb"(?m)^[ \t\r\f\x0B]*>[^\n]*")
_LINE_ENDS = re.compile(rb"\r\n|[\r\n\x0B\x0C\x1C\x1D\x1E\x85]")
#: Rows whose bytes are looked up at a time.
CLEANED_ROWS = 256


def _strings(parts: list[np.ndarray], sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """Strings of ASCII bytes, null where ``like`` is."""
    data = np.concatenate([np.zeros(0, np.uint8), *parts])
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(cut), pa.py_buffer(data)])
    return out if not like.null_count else pc.if_else(pc.is_valid(like), out, None)


def _looked_up(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What a table makes of each byte (0: gone), and how many are left in each row."""
    parts, sizes = [], np.zeros(len(off) - 1, np.int64)
    for i in range(0, len(sizes), CLEANED_ROWS):
        at = off[i : i + CLEANED_ROWS + 1]
        found = table[data[at[0] : at[-1]]]
        there = found > 0
        upto = np.concatenate([[0], np.cumsum(there, dtype=np.int64)])[at - at[0]]
        sizes[i : i + len(at) - 1] = np.diff(upto)
        parts.append(found[there])
    return parts, sizes


def clean(text: Column, alphabet: str = "ACGTN") -> Column:
    """Letters of the alphabet in upper case; other letters as N if the alphabet has it, else gone; the rest gone.

    Bytes are looked up in a table in Arrow batches: a replacement for each letter takes many times as long.
    """
    alphabet = normalize_alphabet(alphabet)
    if not alphabet.isascii():
        letters = F.regexp_replace(without_headers(byte_view(text)), f"[^A-Za-z{_HIGH_LETTERS}]", "")
        return F.upper(F.regexp_replace(letters, f"[^{alphabet + alphabet.lower()}]", "N" if "N" in alphabet else ""))
    table = np.zeros(256, np.uint8)
    for c in map(chr, range(256)):
        if c.isascii() and c.isalpha() or re.match(f"[{_HIGH_LETTERS}]", c):
            table[ord(c)] = ord(c.upper()) if c.isascii() and c.upper() in alphabet else ord("N") if "N" in alphabet else 0

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        data, off = letters_of(column)
        if (data == ord(">")).any():
            data, off = letters_of(pa.array([_HEADER.sub(b"", x) if x and b">" in x else x for x in column.cast(pa.large_binary()).to_pylist()], pa.large_binary()))
        return _strings(*_looked_up(data, off, table), column)

    return of(text)


def strict_clean(text: Column, max_bytes: int | None = None) -> Column:
    """struct(sequence, raw_bytes, removed_non_acgt, skipped_header_lines): only ACGT stays; the cap comes first."""
    bases, ends = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in "ACGTacgt":
        bases[ord(c)] = ord(c.upper())
    ends[list(b"\r\n\x0B\x0C\x1C\x1D\x1E\x85")] = 1

    @F.arrow_udf("sequence string, raw_bytes long, removed_non_acgt long, skipped_header_lines long")
    def of(column: pa.Array) -> pa.Array:
        if max_bytes:
            column = pc.binary_slice(column.cast(pa.large_binary()), 0, max_bytes)
        data, off = letters_of(column)
        raw, headers = np.diff(off), np.zeros(len(column), np.int64)
        if (data == ord(">")).any():
            bodies = column.cast(pa.large_binary()).to_pylist()
            for i, x in enumerate(bodies):
                if x and b">" in x:
                    lines = _LINE_ENDS.split(x)
                    headers[i] = sum(line.startswith(b">") for line in lines)
                    bodies[i] = b"".join(line for line in lines if not line.startswith(b">"))
            data, off = letters_of(pa.array(bodies, pa.large_binary()))
        parts, sizes = _looked_up(data, off, bases)
        body = np.diff(off) - _looked_up(data, off, ends)[1]
        longs = [pa.array(x, pa.int64(), mask=np.array(column.is_null())) for x in (raw, body - sizes, headers)]
        return pa.StructArray.from_arrays([_strings(parts, sizes, column), *longs], ["sequence", "raw_bytes", "removed_non_acgt", "skipped_header_lines"])

    return of(text)


def in_alphabet(seq: Column, alphabet: str) -> Column:
    """Only the characters of the alphabet, in upper case."""
    return F.regexp_replace(F.upper(seq), f"[^{normalize_alphabet(alphabet)}]", "")


def kmers(seq: Column, k: int) -> Column:
    """Non-overlapping groups of k characters; an incomplete tail is left out."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{{k}}}"), F.lit(0))


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def letter_codes(alphabet: str) -> np.ndarray:
    """The digit of each byte: its place in the alphabet, 255 elsewhere."""
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(alphabet.encode("ascii"), np.uint8)] = np.arange(len(alphabet), dtype=np.uint8)
    return table


def ids_of(k: int, alphabet: str) -> Callable[[pa.Array], pa.Array]:
    """K-mer ids of sequences in the alphabet, batch by batch."""
    table, n = letter_codes(alphabet), len(alphabet)

    def ids(column: pa.Array) -> pa.Array:
        data, off = letters_of(column)
        size = np.diff(off) // k
        cut = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(cut[-1], np.int64)
        for i in range(0, len(size), CLEANED_ROWS):  # what is made on the way is held for a few rows only
            here = cut[i : i + CLEANED_ROWS + 1]
            at = np.repeat(off[i : i + len(here) - 1] - here[:-1] * k, np.diff(here)) + np.arange(here[0], here[-1]) * k
            ids = out[here[0] : here[-1]]
            for j in range(k):
                ids *= n
                ids += table[data[at + j]]
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(out))

    return ids


def kmer_ids(seq: Column, k: int, alphabet: str = "ACGTN") -> Column:
    """Ids of non-overlapping k-mers, the first base most significant; characters outside the alphabet drop out first.

    The letters are turned into numbers in Arrow batches: as an expression over arrays this takes many times as long.
    """
    alphabet = normalize_alphabet(alphabet)
    if not 1 <= k or len(alphabet) ** k > 2**63 - 1 or len(alphabet) > 36 or not alphabet.isascii():
        raise ValueError("k-mer ids must fit a BIGINT over at most 36 ASCII letters")
    ids = ids_of(k, alphabet)

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        return ids(column)

    return of(in_alphabet(seq, alphabet))


def kmer_places(k: int, letters: str) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple]]:
    """Of the bytes of rows and their offsets, a few rows at a time: the first row, the rows' offsets, and of each k-mer of these letters its row (from the first), place and id.

    As many rows as can be told apart beside an id in 64 bits are looked through at once, ``CLEANED_ROWS`` at most.
    """
    codes, n = letter_codes(letters), len(letters)
    rows = max(1, min(CLEANED_ROWS, (2**63 - 1) // n**k))

    def places(data: np.ndarray, off: np.ndarray) -> Iterator[tuple]:
        for first in range(0, len(off) - 1, rows):
            here = off[first : first + rows + 1]
            digits = codes[data[here[0] : here[-1]]]
            m = len(digits) - k + 1
            if m <= 0:
                continue
            row = np.repeat(np.arange(len(here) - 1), np.diff(here))
            ok = row[:m] == row[k - 1 :]
            for j in range(k):
                ok &= digits[j : j + m] < 255
            at = np.flatnonzero(ok)
            ids = np.zeros(len(at), np.int64)
            for j in range(k):
                ids *= n
                ids += digits[at + j]
            yield first, here - here[0], row[at], at, ids

    return places


def kmer_tally(seq: Column, k: int, letters: str = "ACGTU") -> Column:
    """``array<struct<kmer, count>>`` of the overlapping k-mers of these letters in each sequence."""
    if len(letters) ** k > 2**63 - 1:
        raise ValueError("k-mers must fit a BIGINT")
    places = kmer_places(k, letters)

    @F.arrow_udf("array<struct<kmer:string,count:long>>")
    def of(column: pa.Array) -> pa.Array:
        data, off = letters_of(column)
        kmers, counts, sizes = [], [], np.zeros(len(column), np.int64)
        for first, here, row, _, ids in places(data, off):
            key, n = np.unique(row * len(letters) ** k + ids, return_counts=True)
            kmers.append(key % len(letters) ** k)
            counts.append(n)
            sizes[first : first + len(here) - 1] = np.bincount(key // len(letters) ** k, minlength=len(here) - 1)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        value = np.concatenate([np.zeros(0, np.int64), *kmers])
        text = np.zeros((len(value), k), np.uint8)
        alphabet = np.frombuffer(letters.encode(), np.uint8)
        for j in range(k - 1, -1, -1):
            text[:, j] = alphabet[value % len(letters)]
            value = value // len(letters)
        names = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer((np.arange(len(text) + 1) * k).astype(np.int32)), pa.py_buffer(text.tobytes())])
        pairs = pa.StructArray.from_arrays([names, pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())], ["kmer", "count"])
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)

    return of(seq)


def tail(seq: Column, k: int) -> Column:
    """What is left after the last whole group of k."""
    n = F.length(seq)
    return F.substr(seq, n - n % k + 1)


def byte_tokens(seq: Column) -> Column:
    """Byte values as tokens."""
    return F.transform(F.filter(F.split(byte_view(seq), ""), lambda c: c != ""), lambda c: F.ascii(c))


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 1 to 4; anything else is an error."""
    table = letter_codes("ACGT") + np.uint8(1)  # 0 elsewhere

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        data, off = letters_of(column)
        codes = table[data]
        if column.null_count or not codes.all():
            raise ValueError("base codes take A, C, G and T only")
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(codes.astype(np.int32)))

    return of(seq)


def from_base_codes(codes: Column, length: Column | None = None) -> Column:
    """The sequence of base codes, cut to its original length if given."""
    letters = np.frombuffer(b"ACGT", np.uint8)

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        if column.null_count or flat.null_count:
            raise ValueError("base codes are 1 to 4")
        data = flat.to_numpy()
        if len(data) and not 1 <= data.min() <= data.max() <= 4:
            raise ValueError("base codes are 1 to 4")
        return _strings([letters[data - 1]], pc.list_value_length(column).to_numpy(), column)

    seq = of(codes)
    return seq if length is None else F.substr(seq, F.lit(1), length)


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """(G + C) / (A + C + G + T + U); 0 if there is none."""
    return F.coalesce(F.try_divide(count_of(seq, "GC"), count_of(seq, "ACGTU")), F.lit(0.0))


def non_acgt_fraction(seq: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(seq) - count_of(seq, "ACGTU"), F.length(seq)), F.lit(0.0))


def split_points(length: Column, train: float = 0.6, val: float = 0.2) -> tuple[Column, Column]:
    """(end of train, end of validation): double products, cut off."""
    train_end = (length.cast("double") * F.lit(train)).cast("long")
    return train_end, train_end + (length.cast("double") * F.lit(val)).cast("long")


def two_bit_bytes(n: Column) -> Column:
    return F.floor((n * 2 + 7) / 8).cast("long")


def sequence_key(file_name: Column) -> Column:
    """The key that a FASTA file's name gives its sequence."""
    chromosome = F.regexp_extract(file_name, "(?i)\\.dna\\.chromosome\\.(.+?)\\.fa(\\.gz)?$", 1)
    assembly = F.regexp_extract(file_name, "(?i)\\.dna\\.primary_assembly\\.(.+?)\\.fa(\\.gz)?$", 1)
    plain = F.regexp_replace(F.regexp_replace(file_name, "\\.gz$", ""), "\\.fa$", "")
    return F.when(chromosome != "", chromosome).when(assembly != "", assembly).when(file_name.rlike("(?i)\\.dna\\.nonchromosomal\\."), "nonchromosomal").otherwise(plain)


def fasta_records(text: Column) -> Column:
    """``array<struct<header, sequence>>`` of a FASTA text; what stands before the first header drops out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n[ \\t\\r\\f\\x0B]*>"), 2, 1 << 30)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "\n", 1)).alias("header"),
            F.upper(F.array_join(F.transform(F.slice(F.split(p, "\n"), 2, 1 << 30), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), "")).alias("sequence"),
        ),
    )
