"""Plain Python versions that the operators are held against."""

import re


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_duplicates(rows, n, percent=80):
    """{id: (set size, component)} of (id, text) rows."""
    sets = {i: shingles(t, n) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    got = components(ids, links)
    return {i: (len(sets[i]), got[i]) for i in ids}
