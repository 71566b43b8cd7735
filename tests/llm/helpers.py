"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def invented(n_words: int, seed: int, kinds: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}x{seed % 7}" for _ in range(n_words))


def cut(text) -> list[bytes]:
    return (text or "").encode().split()


def repeats(rows, window=50):
    """(n_words, n_removed, sha256 of kept words) of each (doc_id, text)."""
    first: dict[tuple, int] = {}
    for doc_id, text in rows:
        w = cut(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if doc_id is not None:
                first[g] = min(doc_id, first.get(g, doc_id))
    out = []
    for doc_id, text in rows:
        w = cut(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5) -> dict:
    w = cut(text)
    counts = Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else {}
    return {s: 1 + math.log(n) for s, n in counts.items()}


def probability_jaccard(x: dict, y: dict) -> float:
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in set(x) & set(y))


def classes(rows, least=0.8):
    """Smallest id of each id's component."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and (x == y or probability_jaccard(x, y) >= least - 1e-9):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def katz_scores(rows, order, discounts):
    """(score, base score) of each (held, text) by dictionaries of n-grams."""

    def tokens(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        return [*low.split(), "end"]

    counts = [Counter() for _ in range(order)]
    for held, text in rows:
        if not held:
            y = ["start"] * (order - 1) + tokens(text)
            for p in range(order - 1, len(y)):
                for n in range(order):
                    counts[n][tuple(y[p - n : p + 1])] += 1
    taken = []
    for c in counts:
        times = Counter(c.values())
        taken.append(discounts([times.get(r, 0) for r in range(1, 7)]))
    follow = [defaultdict(list) for _ in range(order)]
    for n in range(order):
        for g, k in counts[n].items():
            follow[n][g[:-1]].append((g[-1], k * (taken[n][k - 1] if k <= 5 else 1), k))

    def mass(n, h):
        rows = follow[n].get(h, [])
        total, kept = sum(k for _, _, k in rows), sum(d for _, d, _ in rows)
        return total + (total > 0 and kept >= total), kept

    def chance(n, h, w):
        total, kept = mass(n, h)
        k = counts[n].get((*h, w), 0)
        if k:
            return k * (taken[n][k - 1] if k <= 5 else 1) / total
        if n == 0:
            return 1 - kept / total if total else 1.0
        lower = chance(n - 1, h[1:], w)
        if not total:
            return lower
        return (1 - kept / total) / (1 - sum(chance(n - 1, h[1:], v) for v, _, _ in follow[n][h])) * lower

    total, types = sum(counts[0].values()), len(counts[0])
    out = []
    for _, text in rows:
        y = ["start"] * (order - 1) + tokens(text)
        places = range(order - 1, len(y))
        out.append((
            sum(math.log10(chance(order - 1, tuple(y[p - order + 1 : p]), y[p])) for p in places),
            sum(math.log10((counts[0][(y[p],)] + 0.1) / (total + 0.1 * (types + 1))) for p in places),
        ))
    words = [g[0] for g in counts[0]] + ["unknown"]
    for h in [*list(follow[order - 1])[:10], ("never",) * (order - 1)]:
        assert abs(sum(chance(order - 1, h, w) for w in words) - 1) < 1e-9
    return out


def test_words(text) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


test_words.__test__ = False


def contaminated(rows, items, window=10):
    """(doc_id, n_words, n_hit, items, contaminated) of each row."""
    phrases = defaultdict(set)
    for item, text in items:
        w = test_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in rows:
        w = test_words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := phrases.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit)))
    return out
