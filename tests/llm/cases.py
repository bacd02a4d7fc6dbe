"""Documents that hold the awkward cases, and brute-force versions of the contracts."""

import hashlib
import re
from collections import Counter

SCHEMA = "doc_id bigint, text string, bands string, hits int, ranges string, _id string, n int"


def awkward(spark, texts, first=0):
    """Texts as documents with columns whose names the operators use inside."""
    rows = [(first + i, t, "x", 1, "y", "z", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def digest(data):
    return hashlib.sha256(data).hexdigest()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def valid(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        if kind == "card":
            twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
            return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return True

    return [
        (number, m.start(), m.end())
        for number, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


def repeats(texts, length):
    """(bytes, removed ranges, kept) of each text, by looking at every string."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                mark[at : at + length] = b"\1" * length
            seen.add(window)
        spans, at = [], 0
        while at < len(mark):
            end = at
            while end < len(mark) and mark[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        out.append((len(data), spans, bytes(b for b, m in zip(data, mark) if not m)))
    return out


def near_components(texts, percent, words):
    """Smallest number that each text reaches over links, by comparing all pairs."""
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def contamination(text, items, window=13):
    """(words, hit words, items) of a text, window by window."""
    words = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    )
    listed, hit, found = words(text), set(), set()
    for item, content in items:
        own = words(content)
        n = min(window, len(own))
        if not n:
            continue
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for at in range(len(listed) - n + 1):
            if tuple(listed[at : at + n]) in grams:
                hit.update(range(at, at + n))
                found.add(item)
    return len(listed), len(hit), sorted(found)


def fills(pieces):
    """Ids in each sequence; fails where one has a gap or an overlap."""
    at = Counter()
    for sequence, offset, length in sorted(pieces):
        assert offset == at[sequence], (sequence, offset)
        at[sequence] += length
    return at
