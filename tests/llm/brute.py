"""Brute-force versions, text by text and pair by pair."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def simhash(t, k=3):
    w = WORD.findall(ascii_lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, radius=3, roots=False):
    """rows of (id, text) to (id, fingerprint, smallest id reachable), row by
    row; with ``roots``, to a number of the row's component."""
    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= radius).tolist():
            a, b = find(i), find(j)
            if a != b:
                group[max(a, b)] = min(a, b)
    if roots:
        return [find(i) for i in range(len(rows))]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, f"{int(p):016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]


def quality_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w))


def repeats_removed(texts, size=200):
    seen = Counter(b[i:i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), len(re.findall("x+", "".join("x" if g else "." for g in gone))),
                    hashlib.sha256(kept).hexdigest()))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def all_secrets(t, scope=400):
    """Base spans, and weak candidates with a complementary part near them."""
    from paperweave.llm import secrets as s

    t = t or ""
    base = base_secrets(t)
    weak = [(m.start(), k, m.end()) for k, p in ((3, s.BLOB), (4, s.IDENT), (5, s.ENDPOINT)) for m in re.finditer(p, t, re.ASCII)]
    weak = [w for w in weak if all(w[2] <= b[0] or b[2] <= w[0] for b in base)]
    parts, role = base + weak, ("secret", "ident", "secret", "secret", "ident", "endpoint")
    if not any(role[p[1]] == "secret" for p in parts):
        return base
    linked = set()
    for a in parts:
        for b in parts:
            if a[0] <= b[0] <= a[2] + scope and role[a[1]] != role[b[1]] and "secret" in (role[a[1]], role[b[1]]):
                linked |= {a, b}
    return sorted(base + [w for w in weak if w in linked])
