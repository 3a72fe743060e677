"""Plain versions of the operators' definitions, quadratic where that is simplest."""

from __future__ import annotations

import hashlib
import re

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def alnum_words(text):
    return ALNUM.findall(lower(text or ""))


def blank_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = blank_words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_duplicates(docs: dict, size=2, percent=80):
    sets = {k: shingles(t, size) for k, t in docs.items()}
    ids = sorted(docs)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return components(ids, links), {k: len(s) for k, s in sets.items()}


def removed(docs: list[tuple], width=20):
    """docs: (doc_id, text) with distinct ids; doc_id to (n_words, n_removed, sha256 of the kept words)."""
    first, out = {}, {}
    for k, text in sorted(docs):
        w = blank_words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (k, i)) != (k, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[k] = len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def contamination(text, items, window=10):
    w, hit, found = alnum_words(text), set(), set()
    for k, item in items:
        x = alnum_words(item)
        n = min(len(x), window)
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(k)
    return len(w), len(hit), found


def licences(text, rules, priorities=4):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    w = alnum_words(text)
    x, all_found = f" {' '.join(w)} ", []
    for _, label, _keyword, priority, base, pattern in rules:
        for m in re.finditer(pattern, x):
            a = x[: m.start()].count(" ") - 1
            all_found.append((label, priority, base, a, a + m.group().count(" ") + 1))

    def inside(d, o):
        return o[3] <= d[3] and o[4] >= d[4] and (o[1] > d[1] or o[1] == d[1] and o[4] - o[3] > d[4] - d[3])

    kept = [d for d in all_found if d[2] or not any(inside(d, o) for o in all_found)]
    base = [d[3] for d in kept if d[2]]
    return (
        len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({d[0] for d in kept if d[2]})),
        ",".join(sorted({d[0] for d in kept})), max((min(d[1], priorities) for d in kept), default=0) / priorities,
    )
