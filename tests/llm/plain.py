"""Brute-force versions of operators, without Spark."""

import hashlib
import math
from collections import Counter, defaultdict

from tests.llm.conftest import fold, plain_words


def shingle_set(text, width=5):
    w = plain_words(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(rows, percent=75):
    """doc_id -> (set size, smallest id reached); every pair is compared."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, x in enumerate(ids):
        for y in ids[p + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def mix(rows):
    """(doc_id, text, source) rows -> list of (doc_id, size, source_size, target, taken)."""
    size = [len(plain_words(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 3 * total[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)

    def h(i):
        return int(hashlib.md5(("mix" if i is None else f"mix:{i}").encode()).hexdigest()[:15], 16)

    out = [None] * len(rows)
    for s in names:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        budget = target[s] - whole * total[s]
        by_hash = Counter()
        for i in mine:
            by_hash[h(rows[i][0])] += size[i]
        again, at = set(), 0
        for value in sorted(by_hash):
            if at + by_hash[value] <= budget or (at <= budget and 2 * (budget - at) > by_hash[value]):
                again.add(value)
            at += by_hash[value]
        for i in mine:
            times = min(3, whole + (h(rows[i][0]) in again and total[s] > 0))
            out[i] = (rows[i][0], size[i], total[s], target[s], size[i] * times)
    return out


def least_padding(lengths, buckets):
    """Least padding over all choices of bounds, by recursion over distinct lengths."""
    counts = sorted(Counter(lengths).items())
    n = len(counts)
    best = {(0, 0): 0}

    def cost(i, j):
        return sum(c * (counts[j - 1][0] - x) for x, c in counts[i:j])

    for k in range(1, buckets + 1):
        for j in range(1, n + 1):
            best[k, j] = min(
                (best[k - 1, i] + cost(i, j) for i in range(j) if (k - 1, i) in best), default=math.inf
            )
    return min((best[k, n] for k in range(1, buckets + 1) if (k, n) in best), default=0)
