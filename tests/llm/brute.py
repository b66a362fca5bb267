"""Slow, plain versions that tests compare with."""

import re

WS = " \t\n\x0b\x0c\r"


def _find(root, x):
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def jaccard_groups(rows, n, num, den):
    """Smallest id of each document's group: n-word shingle sets linked at num / den."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root, ids = {d: d for d in sets}, sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and c * den >= num * len(sets[a] | sets[b]):
                p, q = sorted((_find(root, a), _find(root, b)))
                root[q] = p
    return {d: _find(root, d) for d in ids}


def kept_lines(rows, num=8, den=10):
    """Texts without lines that an earlier line (by id, place) stands for; texts left blank go."""
    lines = sorted((d, i, x.strip(WS)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(WS))
    sh = {x: ({x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}) for _, _, x in lines}
    by = {}
    for x, s in sh.items():
        for g in s:
            by.setdefault(g, set()).add(x)
    root = {x: x for x in sh}
    for x, s in sh.items():
        rare = sorted(s, key=lambda g: (len(by[g]), g))[: len(s) - -(-len(s) * num // den) + 1]
        for y in {y for g in rare for y in by[g] if x < y}:
            c = len(s & sh[y])
            if c * den >= num * (len(s) + len(sh[y]) - c):
                root[_find(root, x)] = _find(root, y)
    first, gone = {}, {}
    for d, i, x in lines:
        if first.setdefault(_find(root, x), (d, i)) != (d, i):
            gone.setdefault(d, set()).add(i)
    out = {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) if d in gone else t for d, t in rows}
    return {d: t for d, t in out.items() if d not in gone or t.strip(WS)}
