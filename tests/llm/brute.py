"""Plain single-process versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def lowered(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())


def repeats(rows: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> n_words, n_removed, kept words' digest."""
    rows = sorted(rows)
    first: dict[tuple, tuple[int, int]] = {}
    split = {d: words(t) for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(rows: list[tuple[int, str | None]], n: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id -> set size, smallest doc_id reachable by links."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    seen = set()
    for group in holders.values():
        group = sorted(group)
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        ra, rb = find(a), find(b)
                        root[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def equal_texts(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool, str]]:
    """doc_id -> keep_id, group_size, kept, digest."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[lowered(t)].append(d)
    return {d: (max(g), len(g), d == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g}


def line_spread(rows: list[tuple[int, str | None, str | None]], min_sites: int = 5) -> dict[int, tuple[int, int, str]]:
    """doc_id -> lines, removed lines, digest of the text left."""
    sites, first = defaultdict(set), {}
    strip = " \t\r\x0b\x0c"
    for d, t, s in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            sites[line.strip(strip)].add(s)
            first.setdefault(line.strip(strip), (d, i))
    out = {}
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(lines) if not x.strip(strip) or len(sites[x.strip(strip)]) < min_sites or first[x.strip(strip)] == (d, i)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def nearest(rows: list[tuple[int, list[float] | None]], asked, k: int) -> dict[int, list[tuple[int, float]]]:
    """query id -> ids and products, nearest first."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if asked(i):
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> int:
    """Sequences that one-by-one best fit, largest first, needs."""
    import bisect

    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i < len(gaps):
            left = gaps.pop(i) - s
        else:
            n, left = n + 1, capacity - s
        if left:
            bisect.insort(gaps, left)
    return n


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all stretches of at least 6 words and 4 smallest periods that cannot be extended."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def bigram_model(texts: list[tuple[str | None, bool]], level, value, add: float = 0.1, prior: float = 50.0) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base, score) of each (text, learnt) with exact counts, scores on their levels."""
    from collections import Counter
    from math import log10

    seen = [["<s>", *WORD.findall(lowered(t)), "</s>"] for t, _ in texts]
    one, two = Counter(), Counter()
    for tokens, (_, learnt) in zip(seen, texts, strict=True):
        if learnt:
            one.update(tokens)
            two.update(zip(tokens, tokens[1:]))
    starts = one["<s>"]
    n, v = sum(one.values()) - starts, len(one) - (starts > 0)
    near = lambda c: value(level(c))
    out = []
    for tokens in seen:
        base = score = 0.0
        for a, b in zip(tokens, tokens[1:]):
            base += log10((one[b] + add) / (n + add * (v + 1)))
            p = (near(one[b]) + add) / (n + add * (v + 1))
            score += log10((min(near(two[a, b]), near(one[a])) + prior * p) / (near(one[a]) + prior))
        out.append((len(tokens) - 1, sum(one[t] > 0 for t in tokens[1:]), base, score))
    return out


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows: list[tuple[str | None, str | None, str | None]], min_docs: int, top: int) -> set[tuple]:
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    from collections import Counter

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "" for x in r) for r in rows):
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def rates(count):
            total = sum(count(t) for t in kept)
            return [1 + 10**9 * (count(t) + 2) // (total + 2 * len(kept)) for t in kept]

        p = {s: rates(lambda t, s=s: counts[lang, s][t]) for s in sources}
        q = rates(lambda t: sum(counts[lang, s][t] for s in sources))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            own = [(f(a, b), t) for a, b, t in zip(p[s], q, kept, strict=True) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found if part == "pair" else found[:top], 1)}
    return out
