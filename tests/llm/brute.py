"""Plain Python versions of the contracts, row by row, for tests."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def lines(docs, min_chars=40, min_docs=5):
    """docs: (doc_id, text). {row number: (doc_id, n_lines, n_dropped, sha)}"""
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    at = defaultdict(set)
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    at[key(line)].add(d)
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if d is None or len(at.get(key(x), ())) < min_docs or max(at[key(x)]) == d]
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(windows)
        hit = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
        worded = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(worded) - len(set(worded)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def shingle_set(text, n=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(docs, percent=75):
    """{doc_id: (n_shingles, component_id)}; ids must be distinct."""
    sets = {d: shingle_set(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def base_scores(docs):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    tokens = [WORD.findall(lower(t)) + [None] for _, t in docs]
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for (d, _), h, w in zip(docs, held, tokens, strict=True)]
