"""Plain re-statements of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def shingles(t, k):
    w = SPACED.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(docs, k=2, percent=80):
    """{doc_id: (n_shingles, component)}"""
    sets, root = {i: shingles(t, k) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_rows(docs, window=13):
    """(doc_id, text, n_words, n_removed, sha of what is kept), where ids may repeat"""
    first = {}
    for i, t in sorted(docs):
        w = SPACED.findall(t or "")
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = []
    for i, t in docs:
        w = SPACED.findall(t or "")
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                keep[a : a + window] = [False] * window
        out.append((i, t, len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k))))
    return out


def substring(docs, window=13):
    """{doc_id: (n_words, n_removed, sha of what is kept)}"""
    return {i: x for i, _, *x in substring_rows(docs, window)}


def leaks(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, sha of item ids)}"""
    known = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            known[tuple(w[a : a + n])].add(str(i))
    sizes, out = {len(k) for k in known}, {}
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if x := known.get(tuple(w[a : a + n])):
                    found |= x
                    hit[a : a + n] = [True] * n
        out[i] = len(w), sum(hit), len(found), sha(",".join(sorted(found)))
    return out


def rules(t):
    w, seen, dup = SPACED.findall(t or ""), set(), 0
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n, mark = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2)), set()
    for a in range(len(w) - 2):
        if n[tuple(w[a : a + 3])] > 1:
            mark |= {a, a + 1, a + 2}
    failed = len(w) < 50 or 100 * len(mark) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(mark), failed


def license_base(t):
    w, at, labels = ALNUM.findall(low(t)), [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        for a in range(len(w) - len(p) + 1):
            if w[a : a + len(p)] == p:
                at.append(a)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
