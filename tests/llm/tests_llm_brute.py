"""Plain versions that the operators are compared with."""
import hashlib
from collections import Counter, defaultdict

import numpy as np


def repeated_bytes(rows, length):
    """(key is null, key, bytes, removed, runs, sha256 of what is left) per row."""
    seen = Counter(t[p:p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        starts = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((k is None, k, len(t), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def removed_lines(rows, least):
    """(key, line) of every line with an earlier line of the same words or, both of at least ``least``
    words, within one word edit; a null key comes first."""
    all_lines = []
    for k, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = tuple(x for x in line.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
                      .replace("\t", " ").split(" ") if x)
            if w:
                all_lines.append(((k is not None, k or 0, i), k, i, w))
    first = {}
    for place, _, _, w in all_lines:
        first[w] = min(first.get(w, place), place)
    by_size = defaultdict(list)
    for w in first:
        by_size[len(w)].append(w)
    earlier = {w: min([first[w], *(first[x] for n in (len(w) - 1, len(w), len(w) + 1) if min(n, len(w)) >= least
                                   for x in by_size[n] if _one_edit(w, x))]) for w in first}
    return [(k, i) for place, k, i, w in all_lines if earlier[w] < place]


def near_components(rows, bits):
    """Counter of (key, fingerprint, smallest key reachable) over rows (key, fingerprint)."""
    fps = sorted({f for _, f in rows})
    a = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits).tolist():
            root[find(j)] = find(i)
    low = {}
    at = {f: i for i, f in enumerate(fps)}
    for k, f in rows:
        r = find(at[f])
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return Counter((k, f, low.get(find(at[f]))) for k, f in rows)


def semi_global(pattern, text):
    """Least edit distance of the pattern against any stretch of the text."""
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())
