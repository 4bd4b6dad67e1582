"""Hard negatives, ranked search and toxicity against brute force and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagfield.llm import hard_negatives, lexical_search, toxicity

# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=5, percent=80):
    """All scores of all anchors; vectors are padded with zeros."""
    rows = [
        (i, v, lab)
        for i, v, lab in rows
        if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    rows = [(i, [math.floor(x) for x in v], lab) for i, v, lab in rows]
    anchors = {}
    for i, v, lab in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if is_anchor(i):
            anchors.setdefault(i, (v, lab))
    out = Counter()
    for a, (av, alab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == alab][:positives]:
            found = [(n, i) for n, i, lab in scored if lab != alab and percent * -s <= 100 * -n <= 100 * -s]
            for rank, (n, i) in enumerate(found[:negatives], 1):
                out[a, p, rank, i, -s, -n] += 1
    return out


def mined(spark, rows, every, clash=None, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("id", "vector", "anchor", "ids", "of", "best", "place")}) if clash else df
    got = hard_negatives.mine_hard_negatives(df, F.col("id") % every == 0, **more).collect()
    return Counter(tuple(r) for r in got)


@pytest.mark.parametrize("block", [4096, 5])
def test_negatives_equal_all_scores(spark, block):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 60) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 25) for x in c], rng.randrange(3)))
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert mined(spark, rows, 10, anchor_block=block) == want


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [3.0, 4.0], 1), (0, [3.0, 4.0], 1), (1, [3.0, 4.0], 1), (2, [3.0, 4.0], 1), (3, [3.0, 4.0], 2),
        (4, [3.0, 4.0], 2), (4, [3.0, 4.0], 2), (5, [2.5, 4.0], 2), (6, [6.0], 1), (7, [], 2), (8, [], 1),
        (9, None, 1), (10, [1.0, None], 1), (11, [nan, 1.0], 2), (12, [inf, 1.0], 2), (13, [3.0, 4.0], None),
        (None, [3.0, 4.0], 2), (20, [-5.0, 2.0], 3), (30, [0.0, 0.0], 1), (31, [9.0, -9.0], 7),
    ]
    assert mined(spark, rows, 10, clash=True) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, [], 10) == Counter()
    assert mined(spark, [(1, [1.0], 1)], 10) == Counter()
    huge = [(0, [1e300, 1.0], 1), (10, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 1.5], 2)]
    assert mined(spark, huge, 10) == plain_negatives(huge[1:], lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-(1 << 28), 1 << 28)) for _ in range(8)], rng.randrange(2)) for i in range(80)]
    assert mined(spark, rows, 4) == plain_negatives(rows, lambda i: i % 4 == 0)


def test_bounds_spare_scores():
    """Candidates far from the window are not scored again, and none inside it is left out."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 2000, (6, 16))
    anchors = np.floor(np.repeat(centres, 10, 0) + rng.normal(0, 20, (60, 16))).astype(np.int64)
    rows = np.floor(centres[rng.integers(0, 6, 900)] + rng.normal(0, 20, (900, 16))).astype(np.int64)
    block = hard_negatives.Block(range(60), pa.array(["a"] * 60), anchors)
    exact = rows @ anchors.T
    scored = Counter()
    least = int(np.quantile(exact, 0.97))
    met = {k: set() for k in range(60)}

    def visit(k, scores, ids):
        scored["n"] += len(ids)
        met[k].update(ids[scores >= least].tolist())
        assert (scores == exact[ids, k]).all()

    block.scored((np.arange(900), None, rows), visit, lambda k: (least, np.inf, np.ones(900, bool)))
    assert all(met[k] == set(np.flatnonzero(exact[:, k] >= least).tolist()) for k in range(60))
    assert scored["n"] < 0.6 * exact.size


# ranked search


def plain_search(docs, items, top=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (i, b), n in zip(bags, size):
            s = 0
            for t, k in Counter(split(text)).items():
                if b[t]:
                    m = 75 + (25 * n * n_docs) // total
                    s += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("length", "places", "query", "score", "rank")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit("x"))
    return Counter(tuple(r) for r in lexical_search.search(d.repartition(3), q, **more).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_equals_all_scores(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(0, 300, 7)]  # copies: equal scores
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)]
    monkeypatch.setattr(lexical_search, "FIRST_READ", 2)
    assert searched(spark, docs, items, query_block=10 if seed == 1 else 2000) == plain_search(docs, items)


def test_search_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "Ünder ünder a.b_c9 !!"), (4, "A B c9\x00c9"), (4, "A B c9\x00c9"), (None, "a b"), (None, "a b"), (5, "x " * 50_000 + "a"), (6, "--- ...")]
    items = [(1, "a A b"), (1, "c9 Ünder"), (2, None), (3, ""), (None, "a"), (4, "nowhere"), (5, "x " * 3000)]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, docs, items, top=1) == plain_search(docs, items, 1)
    assert searched(spark, [], items) == Counter() and searched(spark, docs, []) == Counter()


def test_lists_are_not_read_to_the_end():
    """Where the best are settled by the heads of the lists, the tails stay unread."""
    n = 5000
    count = np.maximum(1, 60 - np.arange(n) // 10)
    lists = lexical_search.ImpactLists(np.arange(n), np.full(n, 100), np.arange(n), np.zeros(n, np.int64), count, np.array([1000]))
    best = lexical_search.Best(20)
    read = []
    lists.impact = _Watched(lists.impact, read)
    lists.search((np.array([0]), np.array([1])), best)
    assert best.ids.tolist() == list(range(20)) and max(read) < 1000


class _Watched:
    """An array that notes how far slices reach."""

    def __init__(self, values, read):
        self.values, self.read = values, read

    def __getitem__(self, at):
        if isinstance(at, slice):
            self.read.append(at.stop)
        return self.values[at]


# toxicity


def test_misspelt_words_share_vectors():
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 8))) for _ in range(400)]
    bad = ["horrid", "wretched", "villain"]
    known: dict = {}
    bags, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randrange(20, 80))
        if i % 3 == 0:
            for k in range(0, len(words), 15):
                words[k] = rng.choice(bad)
        bags.append(toxicity.bag(" ".join(words), known))
        labels.append(int(i % 3 == 0))
    model = toxicity.SubwordClassifier(1 / 3).fit(bags, labels)
    table = toxicity._Words(model.margins())
    usual = np.quantile([table[w] for w in plain], 0.99)
    for word, misspelt in (("wretched", "wretchedd!"), ("villain", "vvillain"), ("horrid", "horridd,")):
        assert table[misspelt] > max(usual, 0.3 * table[word])
    base = " ".join(rng.choices(plain, k=30))
    scores = toxicity.score_texts(model, table, [base, base + " wretchedd, villainn! wretchedd horridd villainns", "", None])
    assert scores[0] < 0.5 < 0.7 < scores[1]
    assert scores[2] == scores[3] == 1 / 3


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 2:
            words[3] = words[20] = "wretched"
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    extra = [(None, "wretched " * 5), (400, None), (401, ""), (402, "word " * 30_000), (5, docs[5][1]), (5, "other text")]
    marks = [(None, 1), (400, 1), (400, None), (401, 0), (7, 1), (8, None), (9, 5), (999, 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumns({c: F.lit(2.5) for c in ("doc", "label", "score", "ids")})
    lab = spark.createDataFrame(labels + marks, "doc_id long, toxic int").withColumn("doc", F.lit("x"))
    model = toxicity.train(d, lab)
    got = toxicity.predict(d, model).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    fresh = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(fresh) > 80 and np.mean([r.predicted == r.doc_id % 2 for r in fresh if r.doc_id != 5]) > 0.95
    assert len({r.score for r in got if r.doc_id in (400, 401)}) == 1
    assert toxicity.train(d, lab.where("toxic = 0")) is None and toxicity.train(d, lab.limit(0)) is None
    assert [r.score for r in toxicity.predict(d.limit(1), None).collect()] == [0.0]
    assert toxicity.predict(d.limit(0), model).collect() == []


def test_sample_is_bounded_and_whole_otherwise(spark):
    docs = spark.createDataFrame([(i, f"text {i % 2} of {i}") for i in range(200)], "doc_id long, text string")
    lab = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    a, b = (toxicity.train(docs, lab, label_docs=20) for _ in range(2))
    assert np.array_equal(a.margins(), b.margins()) and abs(a.prior - 0.5) < 0.1
