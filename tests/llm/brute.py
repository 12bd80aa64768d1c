"""Plain versions of the operators, to compare with."""

import re
from collections import defaultdict


def word_sets(rows, n=5):
    """{row index: set of n-word shingles} of rows (doc_id, text)."""
    out = []
    for _, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def similar(rows, n=5, percent=80):
    """[(doc_id, n_shingles, component_id)]"""
    sets, up = word_sets(rows, n), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common = defaultdict(int)
        for g in s:
            for j in index[g]:
                common[j] += 1
        for j, c in common.items():
            if j < i and rows[j][0] is not None and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                up[b] = a
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]
