"""Secret scans: keyword and shape patterns, and sliding-window Shannon entropy per character class.

Pattern spans (``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches per kind of
fixed patterns over the whole text; matches that are too short are dropped. The entropy scan looks
at every maximal run of ``[A-Za-z0-9+/_=-]`` of 20 characters or more, less the pattern spans and
known shapes in it (identifiers, digests by name, placeholders). For each class of ``CLASSES`` a window slides over every stretch of
the class's own characters, symbol counts are kept up incrementally, and so is the sum of ``c * log2(c)`` that the
entropy follows from. Windows that reach the threshold of their class are merged into spans, and
each span, not the run around it, is held against the allow-list: numbers, words and names in words, paths of these.
So letters of one case alone count as words. Only spans of the entropy scan are ever suppressed.

Defined results: null and empty texts have no spans; places are code points, end exclusive;
repeated rows are scanned one by one; other columns are ignored. The time of a text grows with its length,
however many spans it has.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from strandworks.llm.common import narrow

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns of the result's definition.
_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 or more: the same matches as HEX, less the short ones


@dataclass(frozen=True)
class CharClass:
    """Windows of ``window`` characters of ``alphabet`` with ``least`` bits a character or more are suspicious."""

    name: str
    alphabet: frozenset
    window: int
    least: float


_HEX_CHARS = frozenset("0123456789abcdefABCDEF")
_BASE36 = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_BASE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
CLASSES = (
    CharClass("hex", _HEX_CHARS, 20, 3.0),
    CharClass("base36", _BASE36, 20, 3.5),
    CharClass("base64", _BASE64, 20, 3.7),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_STRETCHES = [re.compile(f"[{re.escape(''.join(sorted(c.alphabet)))}]{{{c.window},}}") for c in CLASSES]

#: Shapes that look random and are no secrets: they are cut out of a run before it is judged.
KNOWN = re.compile(
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"  # UUID
    r"|(?i:example|sample|dummy|placeholder|xxxxx|00000|abcdefgh|12345678)"
    r"|(?<![A-Za-z0-9])(?:[sS][hH][aA](?:1|224|256|384|512)|[mM][dD]5)[-=_][A-Za-z0-9+/]+={0,2}"  # digests by name
)
#: What a span may be, as a whole, without being reported.
ALLOW = (
    re.compile(r"[0-9+/_=-]+"),  # numbers and rules
    # paths of words: a word is capitals, or small letters in twos behind a capital or none; four digits or fewer end a part
    re.compile(r"(?:(?:[A-Z]{2,}+|[A-Z]?[a-z]{2,}+)*+[0-9]{0,4}(?:[+/_=-]++|$))*+"),
)


def allowed(span: str) -> bool:
    """Whether a span of high entropy is on the allow-list."""
    return any(p.fullmatch(span) for p in ALLOW)


def entropy_spans(run: str, cls: CharClass) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose entropy reaches the class's threshold, in one pass."""
    w = min(cls.window, len(run))
    xlogx = [0.0, 0.0] + [c * math.log2(c) for c in range(2, w + 2)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    most = w * (math.log2(w) - cls.least) + 1e-9  # entropy = log2(w) - sum(c log2 c) / w
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += xlogx[c + 1] - xlogx[c]
        if i >= w:
            gone = run[i - w]
            c = counts[gone]
            counts[gone] = c - 1
            total += xlogx[c - 1] - xlogx[c]
        if i >= w - 1 and total <= most:
            if out and out[-1][1] >= i - w + 1:
                out[-1][1] = i + 1
            else:
                out.append([i - w + 1, i + 1])
    return [(a, b) for a, b in out]


def less(start: int, end: int, taken: list[list[int]]) -> Iterator[tuple[int, int]]:
    """What is left of [start, end) without the intervals ``taken``, which are in order and disjoint."""
    for a, b in taken:
        if a > start:
            yield start, min(a, end)
        start = max(start, b)
        if start >= end:
            return
    if start < end:
        yield start, end


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def random_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of high entropy in a stretch of a run."""
    for a, b in less(start, end, [list(m.span()) for m in KNOWN.finditer(text, start, end)]):
        hot = []
        for cls, stretch in zip(CLASSES, _STRETCHES, strict=True):
            for m in stretch.finditer(text, a, b):
                hot += [(m.start() + x, m.start() + y) for x, y in entropy_spans(m[0], cls)]
        for x, y in union(hot):
            if not allowed(text[x:y]):
                yield x, y


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span, in order of start and kind."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    taken = union([(a, b) for a, _, b in base])
    more, k = [], 0
    for m in CANDIDATE.finditer(text):
        # both lists are in order: go on from the last pattern span that this run reaches
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < m.end():
            j += 1
        for a, b in less(m.start(), m.end(), taken[k:j]):
            more += [(x, 3, y) for x, y in random_spans(text, a, b)]
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: every span as ``array<struct<kind, start, end, secret>>``; no shuffle."""
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append([{"kind": KINDS[k], "start": a, "end": b, "secret": text[a:b]} for a, k, b in find(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(struct))], ["doc_id", "spans"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,secret:string>>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind and the joined spans of each document."""
    from pyspark.sql import functions as F

    found = scan(docs, id_col, text_col)
    say = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, say), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", say), ",").alias("spans"),
        of("entropy").alias("n_entropy"),
    )
