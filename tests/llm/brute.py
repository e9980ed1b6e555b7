"""Plain versions of the operators, for small tables."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def edited_texts(docs):
    """doc_id -> (text, edited, next text) of {doc_id: text}."""
    order = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(order):
        t, n = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        out[d] = t, t[: len(t) - k] + n[:k], n
    return out


def rule_measures(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def dedup_lines(docs, min_words):
    """doc_id -> text without repeated runs, of [(doc_id, text)] in order."""
    where, kept = defaultdict(list), defaultdict(set)
    for d, text in docs:
        lines = [(i, x.strip(WHITE), len(words(x))) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        found = set()
        for step in (1, -1):
            for s in range(len(lines)):
                n, e = 0, s
                while 0 <= e < len(lines):
                    n += lines[e][2]
                    if n >= min_words:
                        found.add((min(s, e), max(s, e)))
                        break
                    e += step
        for s, e in sorted(found):
            where[tuple(x[1] for x in lines[s : e + 1])].append((d, range(lines[s][0], lines[e][0] + 1)))
    gone = defaultdict(set)
    for places in where.values():
        for d, r in places[1:]:
            gone[d].update(r)
        if len(places) > 1:  # the first occurrence stays whole
            kept[places[0][0]].update(places[0][1])
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d] - kept[d]) for d, t in docs}


def simhash(text):
    import xxhash

    w = [x.decode() for x in (text or "").encode().lower().split()]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, bits=3):
    """doc_id -> least doc_id reachable, of {doc_id: fingerprint}."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target of {source: size}, by sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        weight = sum(w[s] for s in names if s not in stopped)
        out = {s: most * sizes[s] if s in stopped else rest * w[s] / weight for s in names}
        more = {s for s in names if s not in stopped and out[s] > most * sizes[s]}
        if not more:
            return out
        stopped |= more


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
