"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, budget=3):
    """position -> smallest id that links reach; prints: [(id, fingerprint)]."""
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= budget:
                group[find(i)] = find(j)
    best = defaultdict(list)
    for i, (name, _) in enumerate(prints):
        best[find(i)] += [name] if name is not None else []
    return [min(best[find(i)], default=None) for i in range(len(prints))]


def contamination(text, items):
    """(n_words, n_hit, ids) against items [(id, text)]."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = cut(text)
    hit, found = [False] * len(w), set()
    for name, other in items:
        o = cut(other)
        size = min(10, len(o))
        for i in range(len(o) - size + 1 if o else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == o[i : i + size]:
                    hit[j : j + size] = [True] * size
                    found.add(name)
    return len(w), sum(hit), found


def substrings(docs, size=20):
    """[(n_words, n_removed, kept)] of [(id, text)] in the order of ids."""
    seen, out = set(), []
    for _, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def held_out(name):
    return name is not None and zlib.crc32(str(name).encode()) % 3 == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
