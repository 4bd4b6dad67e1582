"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

The anchors of a block, and the origin, are joined by a minimum spanning tree.  The score of a candidate with a child
differs from that with its parent by at most the length of the edge times the length of the candidate (Cauchy-Schwarz),
so a walk down the tree gives every score an interval.  Only candidates whose interval meets the window that is wanted
are scored again; what a task has found so far narrows the window.  Rows are read twice for each block of anchors: for
the positives, whose scores are the windows' ends, and for the negatives.  No row meets another row but an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.llm.common import materialize, passing_tables, scratch

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST_PERCENT = 80
#: Anchors that are broadcast together, about; one pair of passes over all rows answers them.
ANCHOR_BLOCK = 4096
#: Rows that go down the tree together.
CHUNK = 1024
#: Vectors whose squared length reaches this have scores beyond 64 bits.
TOO_LONG = 2.0**62


class Tree:
    """Minimum spanning tree over the rows of ``vectors`` and the origin, from the origin down.

    ``order`` lists rows so that a parent comes before its children; ``parent`` is -1 below the origin; ``edge`` is the
    length of the edge to the parent.
    """

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        real = vectors.astype(np.float64)
        square = (real * real).sum(1)
        self.length = np.sqrt(square)
        near, parent = square.copy(), np.full(n, -1)
        left = np.ones(n, bool)
        order = []
        for _ in range(n):
            k = int(np.argmin(np.where(left, near, np.inf)))
            left[k] = False
            order.append(k)
            gap = np.maximum(square + square[k] - 2.0 * (real @ real[k]), 0.0)
            closer = left & (gap < near)
            near[closer] = gap[closer]
            parent[closer] = k
        self.order, self.parent = order, parent
        exact = real - np.where(parent[:, None] >= 0, real[parent], 0.0)
        # a little more than the length, for the rounding of the intervals
        self.edge = np.sqrt((exact * exact).sum(1)) * (1 + 1e-9) + 1e-9 * self.length
        self.children = np.bincount(parent[parent >= 0], minlength=n)


class Top:
    """The best ``size`` of what was added: scores falling, equal scores by rising id."""

    def __init__(self, size):
        self.size = size
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self):
        return self.scores[-1] if len(self.scores) >= self.size else None

    def add(self, scores, ids):
        if len(self.scores) >= self.size:
            some = scores >= self.scores[-1]
            scores, ids = scores[some], ids[some]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.size]
            self.scores, self.ids = scores[order], ids[order]


class Block:
    """Anchors with their tree; ``positives``, once known, are the scores of each anchor's positives."""

    def __init__(self, ids, labels: pa.Array, vectors: np.ndarray):
        self.ids, self.vectors = np.asarray(ids, np.int64), vectors
        self.kinds = labels.unique()
        self.code = np.asarray(pa.compute.index_in(labels, value_set=self.kinds))
        self.tree = Tree(vectors)
        self.most = float(np.abs(vectors).max(initial=0))
        self.positives: list | None = None

    def scored(self, rows, visit, window):
        """Walk ``rows`` (ids, label codes, vectors) down the tree.

        ``window(k)`` gives the least and the largest wanted score of anchor ``k`` and which rows may count;
        ``visit(k, scores, ids)`` gets the rows inside.
        """
        ids, _, vectors = rows
        tree = self.tree
        real = vectors.astype(np.float64)
        length = np.sqrt((real * real).sum(1))
        # whole numbers below 2^53 are exact as doubles, whose products are fast
        small = float(np.abs(vectors).max(initial=0)) * self.most * vectors.shape[1] < 2.0**53
        source = real if small else vectors
        anchors = self.vectors.astype(np.float64) if small else self.vectors
        held: dict = {-1: (np.zeros(len(ids)), np.zeros(len(ids)), 0)}
        for k in tree.order:
            up = int(tree.parent[k])
            low, high, waiting = held[up]
            reach = tree.edge[k] * length
            most = tree.length[k] * (1 + 1e-9) * length
            low, high = np.maximum(low - reach, -most), np.minimum(high + reach, most)
            if up >= 0:
                if waiting == 1:
                    del held[up]
                else:
                    held[up] = (*held[up][:2], waiting - 1)
            least, largest, may = window(k)
            if largest is not None:
                wanted = may & (low <= largest)
                if least is not None:
                    wanted &= high >= least
                at = np.flatnonzero(wanted)
                if len(at):
                    scores = source[at] @ anchors[k]
                    low[at] = high[at] = scores
                    visit(k, scores.astype(np.int64), ids[at])
            if tree.children[k]:
                held[k] = (low, high, int(tree.children[k]))


def _chunks(batches, block: Block):
    """Ids, label codes in the block (-1 elsewhere) and vectors padded with zeros, some rows at a time."""
    width = block.vectors.shape[1]
    for batch in batches:
        for first in range(0, len(batch), CHUNK):
            part = batch.slice(first, CHUNK)
            sizes = part.column(2).value_lengths().to_numpy()
            vectors = np.zeros((len(part), width), np.int64)
            vectors[np.arange(width) < sizes[:, None]] = part.column(2).flatten().to_numpy()
            code = pa.compute.index_in(part.column(1), value_set=block.kinds).fill_null(-1).to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(), code, vectors


def _lists(tops):
    return [pa.array([t.ids for t in tops], pa.list_(pa.int64())), pa.array([t.scores for t in tops], pa.list_(pa.int64()))]


def _find_positives(shared, size):
    def run(batches):
        block = shared.value
        tops = [Top(size) for _ in block.ids]
        for rows in _chunks(batches, block):
            ids, code, _ = rows

            def window(k, ids=ids, code=code):
                return tops[k].least(), np.inf, (code == block.code[k]) & (ids != block.ids[k])

            block.scored(rows, lambda k, scores, ids: tops[k].add(scores, ids), window)
        some = [k for k, t in enumerate(tops) if len(t.ids)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), *_lists([tops[k] for k in some])], names=["anchor", "ids", "scores"]
        )

    return run


def _find_negatives(shared, size, percent):
    def run(batches):
        block = shared.value
        # scores from percent * p / 100 up to p: none if p is below 0
        ends = [[(-(-percent * p // 100), p) for p in mine] for mine in block.positives]
        tops = [[Top(size) if p >= 0 else None for p in mine] for mine in block.positives]

        def window_of(k):
            """From the least score that any positive of the anchor still needs to the largest."""
            least, largest = None, None
            for (low, p), top in zip(ends[k], tops[k], strict=True):
                if top is not None:
                    have = top.least()
                    need = low if have is None else max(low, int(have))
                    least = need if least is None else min(least, need)
                    largest = p if largest is None else max(largest, p)
            return least, largest

        def visit(k, scores, ids):
            for (low, p), top in zip(ends[k], tops[k], strict=True):
                if top is not None:
                    inside = (scores >= low) & (scores <= p)
                    top.add(scores[inside], ids[inside])

        for rows in _chunks(batches, block):
            code = rows[1]
            block.scored(rows, visit, lambda k, code=code: (*window_of(k), code != block.code[k]))
        some = [(k, j) for k, mine in enumerate(tops) for j, t in enumerate(mine) if t is not None and len(t.ids)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in some], pa.int32()),
                pa.array([j for _, j in some], pa.int32()),
                *_lists([tops[k][j] for k, j in some]),
            ],
            names=["anchor", "place", "ids", "scores"],
        )

    return run


def _merged(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best of what the tasks found, a few rows of each."""
    pairs = F.flatten(F.collect_list(F.arrays_zip("scores", "ids")))
    ranked = F.transform(pairs, lambda p: F.struct((-p["scores"]).alias("fall"), p["ids"].alias("id")))
    return parts.groupBy(*keys).agg(F.slice(F.array_sort(ranked), 1, size).alias("best"))


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``id, label, vector`` of the rows that take part, with whole numbers as components."""
    whole = F.transform(vector, lambda x: F.floor(x).cast("long"))
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound & (length < TOO_LONG)
    ).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), whole.alias("vector"))


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of whole-number vectors (fractions are cut down to whole numbers).  ``is_anchor`` is a
    condition on the column ``id``.  Rows with a null id, label, vector or component, with a component that is not
    finite, or whose squared length reaches 2^62 take no part.  A vector of fewer components counts as padded with zeros.
    Repeated rows are candidates each for itself and may fill several ranks; an id is an anchor once, by its first label
    and vector, and no row of its id is its positive or negative.  Anchors without positives, and positives without
    negatives, have no rows; an empty table gives none.  Further columns are not looked at.
    """
    spark = rows.sparkSession
    out = scratch(spark, "hard-negatives")
    schema = T.StructType(
        [
            T.StructField(name, T.IntegerType() if name == "rank" else T.LongType())
            for name in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        ]
    )
    spark.createDataFrame([], schema).write.parquet(out)
    with passing_tables(spark):
        base = materialize(usable(rows, vec_id, vector, label), "hard-rows")
        first = base.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("of"))
        anchors = materialize(first.select("id", "of.label", "of.vector"), "hard-anchors")
        blocks = -(-anchors.count() // anchor_block)
        width = base.agg(F.max(F.size("vector"))).first()[0] or 0
        # as many tasks at any size: each gives at most a few rows for an anchor
        source = base.coalesce(2 * spark.sparkContext.defaultParallelism)
        for b in range(blocks):
            mine = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
            found = _mine_block(spark, source, mine, width, positives, negatives, percent)
            if found is not None:
                found.select(*schema.names).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _mine_block(spark, source, anchors, width, positives, negatives, percent):
    table = anchors.toArrow().sort_by("id").combine_chunks()
    if not table.num_rows:
        return None
    vectors = np.zeros((table.num_rows, width), np.int64)
    for i, v in enumerate(table["vector"].to_pylist()):
        vectors[i, : len(v)] = v
    block = Block(table["id"].to_numpy(), table["label"].combine_chunks(), vectors)
    shared = spark.sparkContext.broadcast(block)
    parts = source.mapInArrow(_find_positives(shared, positives), "anchor int, ids array<bigint>, scores array<bigint>")
    known = _merged(parts, ["anchor"], positives).collect()
    block.positives = [[] for _ in block.ids]
    names = []
    for row in known:
        block.positives[row["anchor"]] = [-p["fall"] for p in row["best"]]
        names += [(row["anchor"], j, p["id"], -p["fall"], int(block.ids[row["anchor"]])) for j, p in enumerate(row["best"])]
    shared = spark.sparkContext.broadcast(block)
    parts = source.mapInArrow(
        _find_negatives(shared, negatives, percent), "anchor int, place int, ids array<bigint>, scores array<bigint>"
    )
    # a few rows for each anchor of the block
    named = spark.createDataFrame(names, "anchor int, place int, positive_id long, positive_score long, anchor_id long")
    best = _merged(parts, ["anchor", "place"], negatives).select("anchor", "place", F.posexplode("best").alias("pos", "of"))
    return best.join(F.broadcast(named), ["anchor", "place"]).select(
        "anchor_id",
        "positive_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("of.id").alias("negative_id"),
        "positive_score",
        (-F.col("of.fall")).alias("negative_score"),
    )
