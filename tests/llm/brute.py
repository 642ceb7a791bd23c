"""Plain versions of the operators' contracts, for small data."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(words) < 10 or 100 * len(hit) > 20 * len(words),
    }


def base_secrets(text):
    text = text or ""
    out = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    spans = sorted((s, k, e) for k, kind in enumerate(out) for s, e in out[kind])
    joined = ",".join(f"{list(out)[k]}:{s}:{e}" for s, k, e in spans)
    return {f"n_{k}": len(v) for k, v in out.items()} | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest()}


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source, sharing the excess again and again as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, closed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(closed.values()), [s for s in names if s not in closed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: float(most * sizes[s]) for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return closed | share
        closed |= over


def windows_of(text, n=10):
    words = ALNUM.findall((text or "").translate(LOWER))
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def contamination(docs, items, n=10):
    """``{doc: (n_words, n_hit, n_items, sha256)}``."""
    by_length = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for w in windows_of(text, n):
            by_length[len(w)][w].add(item)
    out = {}
    for doc, text in docs:
        words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for size, table in by_length.items():
            for i in range(len(words) - size + 1):
                if (items_ := table.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= items_
        ids = ",".join(sorted(map(str, found)))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest())
    return out


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_groups(docs, percent=75):
    """``{doc: smallest doc reachable}`` by comparing all documents that share a shingle."""
    sets = {doc: shingles(text) for doc, text in docs}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for doc, s in sets.items():
        for shingle in s:
            holders[shingle].append(doc)
    seen = set()
    for docs_ in holders.values():
        for i, a in enumerate(docs_):
            for b in docs_[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}
