"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring(docs, k=13):
    """{doc_id: (n_words, n_removed, sha)} of [(doc_id, text)]."""
    words = {d: WS.findall(t or "") for d, t in docs}
    least = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - k + 1):
            least.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def contamination(docs, items, k=10):
    win = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UP))
        if w:
            for a in range(max(len(w) - k, 0) + 1):
                win[tuple(w[a : a + k])].add(str(i))
    sizes = {len(x) for x in win}
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(UP))
        hit, own = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in win:
                    hit.update(range(a, a + n))
                    own |= win[x]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def shingles(text, k=5):
    w = WS.findall((text or "").translate(UP))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes(docs, k=5):
    sets = {d: shingles(t, k) for d, t in docs}
    inv = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inv[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tried = set()
    for d in sorted(sets):
        for e in {e for x in sets[d] for e in inv[x] if e < d}:
            a, b = sets[d], sets[e]
            if (e, d) not in tried and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def media(text):
    raw = (text or "").encode()
    pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])
