"""Plain versions of the operators, for comparison on small tables."""

import collections
import hashlib
import re

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return frozenset(tuple(w[a : a + width]) for a in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_groups(docs, width, percent=80):
    """{doc_id: (size of its set, smallest reachable id)} by comparing all pairs of different sets."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, s in sorted(sets.items()):
        if s and s in first:
            parent[find(i)] = find(first[s])
        elif s:
            first[s] = i
    distinct = sorted(first.items(), key=lambda x: len(x[0]))
    for k, (s, i) in enumerate(distinct):
        for t, j in distinct[k + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            shared = len(s & t)
            if 100 * shared >= percent * (len(s) + len(t) - shared):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in sets:
        least[find(i)].append(i)
    return {i: (len(s), min(least[find(i)])) for i, s in sets.items()}


def contamination(docs, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    lengths, out = {len(x) for x in windows}, {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if got := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def repeats(docs, size=50):
    """({doc_id: repeated words}, {doc_id: those that an earlier document has}) of passages in several documents."""
    where = collections.defaultdict(set)
    split = {i: (t or "").encode().split() for i, t in docs}
    for i, w in split.items():
        for a in range(len(w) - size + 1):
            where[tuple(w[a : a + size])].add(i)
    every, later = collections.defaultdict(set), collections.defaultdict(set)
    for i, w in split.items():
        for a in range(len(w) - size + 1):
            got = where[tuple(w[a : a + size])]
            if len(got) > 1:
                every[i].update(range(a, a + size))
                if min(got) < i:
                    later[i].update(range(a, a + size))
    return every, later


def covered(rows):
    out = collections.defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out
