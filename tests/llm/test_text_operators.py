"""Packing, quality rules, n-gram join, mixing and exact copies on small inputs with awkward rows."""

import random

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lagfield.llm import mixing, ngram_join, packing
from lagfield.llm.components import connected_components
from lagfield.llm.exact_dedup import drop_copies, exact_dedup_files, remember
from lagfield.llm.quality import quality_rules
from lagfield.llm.shingles import mix
from tests.llm import plain
from tests.llm.conftest import fold, plain_words

LONG = " ".join(f"w{i}" for i in range(60_000))
AWKWARD = [None, "", " \n\t ", "one", "one", "One", LONG, "a b c d e f", "A b c d e f", "é ü ß\x0bx", "a | b | c\nAll rights reserved."]


def prose(rng, n, vocabulary=400):
    return " ".join(f"t{rng.randrange(vocabulary)}" for _ in range(n))


# packing


def test_bounds_have_least_padding():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        for k in (1, 2, 3, 5):
            values = sorted(set(lengths))
            bounds = packing.optimal_bounds(values, [lengths.count(v) for v in values], k)
            assert len(bounds) <= k and bounds[-1] == max(lengths)
            padding = sum(min(b for b in bounds if b >= x) - x for x in lengths)
            assert padding == plain.least_padding(lengths, k)


def test_pack(make, clash):
    rng = random.Random(2)
    texts = [*AWKWARD, *(prose(rng, rng.randrange(1, 40)) for _ in range(300))]
    docs = make(texts)
    rows = packing.pack(clash(docs), buckets=4, batch_tokens=100, slice_rows=20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    lengths = {i: len(plain_words(t)) for i, t in enumerate(texts)}
    assert all(r.n_tokens == lengths[r.doc_id] and r.padding == r.bound - r.n_tokens >= 0 for r in rows)
    assert sum(r.padding for r in rows) == plain.least_padding(list(lengths.values()), 4)
    for b in {r.bucket for r in rows}:
        mine = [r for r in rows if r.bucket == b]
        capacity = max(1, 100 // max(1, mine[0].bound))
        places = sorted(r.batch * capacity + r.slot for r in mine)
        assert places == list(range(len(mine)))
    assert packing.pack(docs.limit(0)).collect() == []


def test_long_lengths_are_binned(make):
    docs = make(["a " * n for n in (1, 5, 9, 100, 101)])
    lengths = docs.select(F.size(F.split(F.trim("text"), " ")).alias("n_tokens"))
    assert packing.length_bounds(lengths, 2, max_bins=5) == [9, 101]
    assert packing.length_bounds(lengths, 2, max_bins=3) == [16, 104]


def test_bounds_are_exact_for_any_number_of_lengths(spark):
    lengths = spark.range(1, 5001).select(F.col("id").alias("n_tokens"))
    # all lengths from 1 to 5000 once: two buckets are best in halves; rounding would give multiples of 2 only
    assert packing.length_bounds(lengths, 2) == [2500, 5000]
    odd = lengths.where("n_tokens % 2 = 1 OR n_tokens < 4000")
    bounds = packing.length_bounds(odd, 3)
    values = [r.n_tokens for r in odd.collect()]
    assert bounds[-1] == 4999 and set(bounds) <= set(values)


# quality rules


def test_quality(make, clash):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(30)) + "." for i in range(3))
    texts = [
        *AWKWARD,
        good,
        good + "\nAll rights reserved.",
        good + "\nHome | News | About | Contact",
        " ".join(f"w{i}!!" for i in range(80)),
        " | ".join(f"w{i}" for i in range(80)),
        " ".join(["a b c"] * 40),
        good + "\n" + good,
    ]
    rows = {r.doc_id: r for r in quality_rules(clash(make(texts))).collect()}
    n = len(AWKWARD)
    assert [rows[i].kept for i in range(n)] == [False] * 6 + [True] + [False] * (n - 7)
    assert rows[n].kept and rows[n].clean_text == good
    assert rows[n + 1].kept and rows[n + 1].clean_text == good and rows[n + 1].n_lines_removed == 1
    assert rows[n + 2].kept and rows[n + 2].clean_text == good
    assert not rows[n + 3].kept and not rows[n + 3].base_failed
    assert not rows[n + 4].kept and not rows[n + 4].base_failed
    assert rows[n + 5].base_failed and rows[n + 5].n_repeat_words == 120
    assert rows[n + 6].n_dup_lines == 3
    assert quality_rules(make([])).collect() == []


def test_lines_are_judged_by_their_share_and_runs(make):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(30)) + "." for i in range(3))
    long = " ".join(f"w{i}" for i in range(5000)) + " see our privacy policy " + " ".join(f"v{i}" for i in range(100))
    menu = "Home\nAbout us\nNews\nContact"
    texts = [
        long,
        "Introduction\n" + good + "\nSecond part\n" + good.replace("x", "y"),
        menu + "\n" + good + "\n" + menu,
        good + "\nRead our privacy policy and terms of use",
        "Home\nAbout\n\nNews\n" + good,
    ]
    rows = {r.doc_id: r for r in quality_rules(make(texts)).collect()}
    assert all(r.kept for r in rows.values())
    assert rows[0].clean_text == long and rows[1].clean_text == texts[1] and rows[4].clean_text == texts[4]
    assert rows[2].clean_text == good and rows[2].n_lines_removed == 8 and rows[3].clean_text == good


def test_repeated_words(make):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules(make(texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        assert got[i] == len(covered), t


# n-gram join


def near_texts(rng):
    """Groups of near copies of several depths, a passage that many share, and others."""
    texts = list(AWKWARD[:6]) + AWKWARD[7:]
    for _ in range(6):
        base = prose(rng, rng.randrange(20, 120)).split()
        for _ in range(rng.randrange(2, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.6, 1))]
            texts.append(" ".join(copy))
    passage = prose(rng, 30)
    texts += [passage + " " + prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,few,most", [(1, 32, 8), (2, 2, 8), (3, 2, 1), (4, 3, 4), (5, 4, 8)])
def test_components_equal_brute_force(make, monkeypatch, seed, few, most):
    # a low limit sends most groups through leaders
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(seed)
    texts = near_texts(rng)
    got = ngram_join.near_components(make(texts), few=few, most_matches=most).collect()
    want = plain.components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)


def drifting_sets(seed):
    """Sets that come from each other by small changes, so that long lists stay within groups on several levels."""
    rng = random.Random(seed)
    size = rng.randrange(8, 26)
    sets = [frozenset(rng.sample(range(size), rng.randrange(4, size)))]
    for _ in range(rng.randrange(10, 50)):
        now = set(rng.choice(sets))
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5 and len(now) > 4:
                now.discard(rng.choice(sorted(now)))
            else:
                now.add(rng.randrange(size))
        sets.append(frozenset(now))
    return list(dict.fromkeys(sets))


def linked(sets, percent=75):
    """id -> smallest id reached; every pair is compared."""
    found = {i: i for i in sets}
    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and found[x] != found[y]:
                a, b = sorted((found[x], found[y]))
                found = {i: a if c == b else c for i, c in found.items()}
    return found


def test_groups_of_three_levels_keep_all_members(make, monkeypatch):
    # every word is a shingle here: the families whose links need members of all levels are small and of exact sizes
    def word_sets(column):
        sets = [sorted({int(w) for w in t.split()}) for t in column.to_pylist()]
        return np.array([v for s in sets for v in s], np.uint64), np.cumsum([0, *map(len, sets)])

    monkeypatch.setattr(ngram_join, "shingle_sets", word_sets)
    cloudpickle.register_pickle_by_value(ngram_join)
    try:
        families = [drifting_sets(seed) for seed in (556, 1444)]
        sets = {1000 * f + i: {1000 * f + v for v in s} for f, family in enumerate(families) for i, s in enumerate(family)}
        docs = make([(i, " ".join(map(str, s)), "en", "s") for i, s in sets.items()]).coalesce(1)
        want = {i: c for f in range(len(families)) for i, c in linked({i: s for i, s in sets.items() if i // 1000 == f}).items()}
        got = ngram_join.near_components(docs, few=1, most_matches=1).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    finally:
        cloudpickle.unregister_pickle_by_value(ngram_join)


def test_components_of_awkward_tables(make, clash):
    docs = make([(1, "a b c d e f g", "en", None), (1, "a b c d e f g", "en", None), (None, "a b c d e f g", "en", "s"), (0, "A b c d e f g", None, "s"), (5, None, "en", "s")])
    got = sorted(ngram_join.near_components(clash(docs)).collect(), key=repr)
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [
        (False, 0, 3, 0), (False, 1, 3, 0), (False, 1, 3, 0), (False, 5, 0, 5),
    ]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.near_components(make([])).collect() == []
    kept = ngram_join.keep_one(clash(docs))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 5]
    assert kept.columns == clash(docs).columns


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7000, 7000), (-3, -4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, -3: -4, -4: -4}


def test_rare_shingles_travel_as_bits_and_a_place():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 2**63, n).tolist() for n in (3, 0, 5, 2)] + [[-5, 7]]
    # numbers of two files, one after the other
    places = pa.array([4, 5, 6, 7 + (1 << 33), 8 + (1 << 33)], pa.int64())
    batch = pa.RecordBatch.from_arrays([places, pa.array(lists, pa.list_(pa.int64()))], names=["at", "few"])
    got = set()
    for part in ngram_join._packed([batch]):
        for bucket, first, keys, who in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            got |= {(bucket, key % 2**32, first + w) for key, w in zip(keys, who, strict=True)}
    want = set()
    for at, values in zip(places.to_pylist(), lists, strict=True):
        bits = [int(v) >> 22 for v in mix(np.array(values, np.int64).view(np.uint64))]
        want |= {(b >> 32, b % 2**32, at) for b in bits}
    assert got == want


def test_documents_that_surely_stay_are_not_shuffled(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, text if i < 3 else f"{text} {i} {i + 1} {i * 7} {i * i} x y {i}") for i in range(400)] + [(None, text)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = ngram_join.keep_one(docs)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r[0] is not None, r[0] or 0) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(False, 0), (True, 0)] + [(True, i) for i in range(3, 400)]
    stay, doubtful = ngram_join._split(docs.withColumnRenamed("doc_id", "doc"), spark.createDataFrame([(1,), (2,)], "doc long"))
    assert {1, 2} <= {r["doc"] for r in doubtful.collect()} and doubtful.count() < 10
    assert stay.count() + doubtful.count() == 401
    # the join that shuffles whole rows has only the doubtful ones on its left
    assert plan.count("LeftAnti") == 1 and "Union" in plan


def test_only_doubtful_documents_meet_the_ids_that_go(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, text if i < 3 else f"{text} {i * 7} {i * i} x y {i} a b") for i in range(60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = ngram_join.keep_one(docs)
        lines = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert sorted(r[0] for r in kept.collect()) == [0, *range(3, 60)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    anti = next(i for i, line in enumerate(lines) if "Join LeftAnti" in line)
    left = next(i for i in range(anti + 1, len(lines)) if depth(lines[i]) == depth(lines[anti]) + 3)
    inner = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert left <= inner and depth(lines[inner]) > depth(lines[anti])


def test_prefixes_avoid_shingles_that_meet_by_chance(spark, make, monkeypatch):
    """Shingles of common words meet in different texts, though no block of a large table sees any of them twice."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") if rng.random() < 0.6 else f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc", "text"])
    monkeypatch.setattr(ngram_join, "COUNT_BLOCK", 1)
    parts = [p for i in range(300) for p in ngram_join._read([batch.slice(i, 1)])]
    read = spark.createDataFrame(pa.Table.from_batches(parts).combine_chunks())
    common = SimpleNamespace(value=ngram_join._common(read, 1 << 20))
    holders = {}
    for out in ngram_join._prefixes(common, 75, 8)([batch]):
        for doc, few, many in zip(*(out.column(c).to_pylist() for c in ("doc", "few", "many")), strict=True):
            for s in few + many:
                holders.setdefault(s, set()).add(doc)
    # of 300 texts, with the order of shingles by their hash alone, hundreds meet
    assert sum(len(h) - 1 for h in holders.values()) < 30


# mixing


def test_mix_equals_brute_force(make, clash):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 50)), "en", rng.choice(["a", "b", "B", "é", None])) for i in range(200)]
    rows += [(500 + i, t, "en", "odd") for i, t in enumerate(AWKWARD) if t != LONG]
    rows += [(900, None, "en", "empty"), (901, "x y", "en", "tiny"), (1, rows[1][1], "en", rows[1][3]), (None, "x", "en", "b")]
    got = mixing.mix_sources(clash(make(rows))).collect()
    want = plain.mix([(i, t, s) for i, t, _, s in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4])
    assert sorted(key((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got) == sorted(map(key, want))
    again = mixing.mix_sources(make(rows)).collect()
    assert sorted(map(repr, (r.asDict() for r in again))) == sorted(map(repr, (r.asDict() for r in got)))
    assert mixing.mix_sources(make([])).collect() == []


def test_mixes_of_growing_budgets_are_nested(spark):
    rng = random.Random(4)
    rows = [(s, rng.randrange(1 << 60), rng.randrange(1, 9)) for s in (1, 2) for _ in range(300)]
    sizes = spark.createDataFrame(rows, "source_no int, hash long, size long")
    last = {1: -1, 2: -1}
    for budget in (0.0, 10.0, 200.0, 900.0):
        cut = mixing.thresholds(sizes, spark.createDataFrame([(1, budget), (2, budget)], "source_no int, budget double"))
        for r in cut.collect():
            assert r.below >= last[r.source_no]
            last[r.source_no] = r.below
            assert abs(sum(n for s, h, n in rows if s == r.source_no and h < r.below) - budget) <= 4


def test_mixed_rows(make):
    rows = [(i, "a b c", "en", "xyz"[i % 3]) for i in range(60)]
    docs = make(rows)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.repeats for r in mixing.mix_sources(docs).collect() if r.repeats}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


# exact copies


def dedup_want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted((i, max(g), len(g)) for g in groups.values() for i in g)


def test_exact_dedup(make, clash, spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate([*AWKWARD, *AWKWARD, "É", "é"])]
    clash(make(rows)).repartition(3).write.parquet(str(tmp_path / "d"))
    got = exact_dedup_files(spark, str(tmp_path / "d"), batch_bytes=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == dedup_want([(r[0], r[1]) for r in rows])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_equal_digests_are_settled_by_full_texts(make, spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(["aa", "ab", "AA", "b", "ab", "ac", "b", "c"])]
    make(rows).write.parquet(str(tmp_path / "d"))
    got = exact_dedup_files(spark, str(tmp_path / "d"), digest=lambda t: F.substring(t, 1, 1)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == dedup_want([(r[0], r[1]) for r in rows])


def test_state_goes_on_with_new_files(make, spark, tmp_path):
    path, folder = str(tmp_path / "d"), str(tmp_path / "state")
    make([(1, "x", "en", "s"), (2, "y", "en", "s")]).write.parquet(path)
    assert {r.keep.doc_id: r.n for r in remember(spark, path, folder=folder).collect()} == {1: 1, 2: 1}
    make([(7, "X", "en", "s")]).write.mode("append").parquet(path)
    assert {r.keep.doc_id: r.n for r in remember(spark, path, folder=folder).collect()} == {7: 2, 2: 1}


def test_drop_copies(make):
    docs = make([(1, "x", None, "s"), (1, "x", None, "s"), (2, "X", "en", None), (3, None, "en", "s"), (4, "", "en", "s"), (None, "q", "en", "s")])
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [2, 4, None]
    assert drop_copies(make([])).collect() == []
    twice = drop_copies(make([(1, "x", "en", "s"), (1, "x", "en", "s")]))
    assert [r.doc_id for r in twice.collect()] == [1]
