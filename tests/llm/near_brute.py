"""Near copies by brute force."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(texts, percent=85):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: find(parent, k) for k in sets}
