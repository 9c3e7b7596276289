"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix(rows, width=400):
    """rows of (id, text) -> sorted (id, n_bytes, n_removed, n_spans, kept hash)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + width] for _, b in raw for k in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def phrases(rows, width=13):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (LAST if i is None else i):
                gone[k : k + width] = [1] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def fingerprint(text, shingle=3):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, distance=2):
    """prints: (id, fingerprint) -> sorted (id, least id reachable)."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), LAST), LAST if d is None else d)
    return sorted(((d, None if least[root(i)] == LAST else least[root(i)]) for i, (d, _) in enumerate(prints)), key=str)


def groups(prints, distance=2):
    """How many components there are."""
    seen, n = set(), 0
    for i in range(len(prints)):
        if i not in seen:
            n += 1
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += [j for j in range(len(prints)) if (prints[k][1] ^ prints[j][1]).bit_count() <= distance]
    return n


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, again = Counter(runs), [0] * len(w)
    for k, r in enumerate(runs):
        if count[r] > 1:
            again[k : k + 8] = [1] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again)
