"""The operators' results by definition, for tests. Nothing here is shared with the code under test."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeated_bytes(docs, length=100):
    """op5: (id, bytes, removed, spans, kept digest); ids must be unique."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[d] = (d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[d] for d, _ in docs]


def repeated_words(docs, length=35):
    """op10: (id, words, removed, kept digest); ids must be unique."""
    table, split = {}, {d: SPACED.findall(t or "") for d, t in docs}
    for w in split.values():
        for i in range(len(w) - length + 1):
            table[tuple(w[i : i + length])] = table.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for d, _ in docs:
        w, gone = split[d], set()
        for i in range(len(w) - length + 1):
            if table[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def links(docs, threshold=0.8, size=5):
    """op7: (id, class, links) by comparing all pairs; ids must be unique."""
    sets = {}
    for d, text in docs:
        w = PLAIN.findall(lower(text))
        n = min(size, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    ids = sorted(sets)
    up, count = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                count[a] += 1
                count[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(d, root(d), count[d]) for d, _ in docs]


def contaminated(docs, items, window=13):
    """op3: (id, words, hit words, items, digest of items, verdict)."""
    table = {}
    for name, text in items:
        w = PLAIN.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            table.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    lengths, out = {len(x) for x in table}, []
    for name, text in docs:
        w, hit, got = PLAIN.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in table:
                    hit.update(range(i, i + n))
                    got |= table[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((name, len(w), len(hit), len(got), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def without_repeated_lines(docs, window=3):
    """op4: (id, counting lines, removed lines, kept text); ids must be unique."""
    seen, out, space = {}, [], " \t\n\x0b\x0c\r"
    tables = {d: [(i, x.strip(space)) for i, x in enumerate((t or "").split("\n")) if x.strip(space)] for d, t in docs}
    for d in sorted(tables):
        t = tables[d]
        for p in range(len(t) - window + 1):
            seen.setdefault(tuple(x for _, x in t[p : p + window]), (d, p))
    for d, text in docs:
        t, gone = tables[d], set()
        for p in range(len(t) - window + 1):
            if seen[tuple(x for _, x in t[p : p + window])] != (d, p):
                gone.update(i for i, _ in t[p : p + window])
        out.append((d, len(t), len(gone), "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)))
    return out


ALNUM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def stretches(text, chars, least=1):
    """(start, end) of the maximal runs of some characters."""
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        if end - at >= least and end > at:
            yield at, end
        at = max(end, at + 1)


def base_secrets(text):
    """op1: (start, kind, end) of the pattern spans, character by character."""
    out, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            seen = text[i : i + len(word)]
            if len(seen) == len(word) and seen.isascii() and seen.lower() == word:
                j = i + len(word)
                j += j < len(text) and text[j] in "\"'"
                while j < len(text) and text[j] == " ":
                    j += 1
                if j < len(text) and text[j] in ":=":
                    j += 1
                    while j < len(text) and text[j] == " ":
                        j += 1
                    j += j < len(text) and text[j] in "\"'"
                    end = j
                    while end < len(text) and (text[end] in ALNUM or text[end] in "+/_.=-"):
                        end += 1
                    if end == j:
                        end = None
                break
        if end is not None:
            if end - j >= 6:
                out.append((i, 0, end))
            i = end
        else:
            i += 1
    i = text.find("AKIA")
    while i >= 0:
        end = i + 4
        while end < len(text) and text[end] in ALNUM and not text[end].islower():
            end += 1
        if end - i >= 20:
            out.append((i, 1, end))
        i = text.find("AKIA", end if end > i + 4 else i + 1)
    out += [(a, 2, b) for a, b in stretches(text, set("0123456789abcdef"), 24)]
    return sorted(out)


def wordy(part):
    """Whether a path's part is made of words: capitals in twos, or small letters in twos behind a capital or none; digits at the end."""
    n = len(part.rstrip("0123456789"))
    if len(part) - n > 4:
        return False
    i = 0
    while i < n:
        j = i
        while j < n and part[j].isupper():
            j += 1
        if j - i >= 2:
            i = j
            continue
        k = j
        while k < n and part[k].islower():
            k += 1
        if k - j < 2:
            return False
        i = k
    return True


def secrets(text):
    """op1: counts by kind, digest of the pattern spans, all spans; every window's entropy counted anew."""
    text = text or ""
    base = base_secrets(text)
    blocked = set()
    for a, _, b in base:
        blocked.update(range(a, b))
    hot = set()
    for a, b in stretches(text, ALNUM | set("+/_=-"), 20):
        free = [i in blocked for i in range(a, b)]
        start = a
        for end in [*(a + i for i, x in enumerate(free) if x), b]:
            piece = text[start:end]
            known = [m.span() for m in KNOWN_SHAPES.finditer(text, start, end)]
            gone = {i for x, y in known for i in range(x, y)}
            for least, window, chars in ((3.0, 20, set("0123456789abcdefABCDEF")), (3.5, 20, set("0123456789abcdefghijklmnopqrstuvwxyz")), (3.7, 20, ALNUM | set("+/_=-"))):
                for i in range(start, start + len(piece) - window + 1):
                    w = text[i : i + window]
                    if set(w) <= chars and not gone & set(range(i, i + window)):
                        h = -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w))
                        if h >= least - 1e-12:
                            hot.add((i, i + window))
            start = end + 1
    merged = []
    for a, b in sorted(hot):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kinds = ("assign", "access", "hex", "entropy")
    more = [(a, 3, b) for a, b in merged if not all(wordy(x) for x in re.split("[+/_=-]+", text[a:b])) and not set(text[a:b]) <= set("0123456789+/_=-")]
    say = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more)))


_HEX = "[0-9a-fA-F]"
KNOWN_SHAPES = re.compile(
    rf"(?<![0-9A-Za-z]){_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}(?![0-9A-Za-z])"
    r"|(?i:example|sample|dummy|placeholder|xxxxx|00000|abcdefgh|12345678)|(?<![A-Za-z0-9])(?i:sha1|sha224|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/]+={0,2}"
)


def periodic(doc_id, text, planted=True):
    """op13: (id, runs, start, length, period, thousandths, runs digest, collapsed digest) by trying every period at every place."""
    w = SPACED.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + s] for k in range(i, j + q - s)) for s in range(1, q)):
                runs.append((i, j + q - i, q))
            i = max(j, i + 1)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *([*best, 1000 * best[1] // best[2]] if best else [None] * 4), *digests)


def collocations(docs, least=10, cover=50, top=2000):
    """op12: (lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, totals = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = (lang, *w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, *p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (counts[(lang, *p[:k])] * counts[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[(lang, *p)] = (a, counts[(lang, *p[:k])], counts[(lang, *p[k:])], score)
    out = []
    for lang in totals:
        rows = []
        for (g, *p), (a, l, r, score) in found.items():
            inside = any(h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for (h, *q), (b, *_) in found.items() if len(p) == 2)
            if g == lang and not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out
