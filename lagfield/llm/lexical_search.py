"""Ranked lexical search by sequential reads of impact-sorted lists (no random access, NRA).

A first pass over the documents counts what the weights need and writes each document's occurrences of query terms.  A
second pass turns them, block of documents by block, into one list for each term, sorted by impact.  For every query
the lists are read from the top: a document's score lies between what has been read of it (its lower bound) and that
plus the next impact of every list in which it has not been met (its upper bound).  Reading goes on until no document
outside the best can reach them and all scores among the best are exact.  The best of a task, and of all tasks, are
then merged; the score a task already has for its last place stops the lists of its later blocks early.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.llm.common import materialize

TOP = 20
#: Queries that one pass over the documents answers; they and their terms go to every task.
QUERY_BLOCK = 2000
#: Documents whose lists are sorted and read together, and entries of a list that one read takes at first.
DOC_BLOCK = 8192
FIRST_READ = 32

#: Term characters are letters and digits of ASCII and all beyond it; A-Z are lower-cased; constants of the score.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SCALE, _TF, _MASS, _SLOPE, _FLAT = 1_000_000_000, 1000, 12, 25, 100 - 25

_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as bytes; none for null."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def _occurrences(vocabulary):
    """For each document its number of terms, and place and count of the query terms it holds."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            length, places, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                found = Counter(map(known.get, words))
                found.pop(None, None)
                length.append(len(words))
                places.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(length, pa.int64()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "length", "places", "counts"],
            )

    return run


def _frequencies(size):
    """Documents with terms, all their terms, and the documents of each query term; one row for a task's documents."""

    def run(batches):
        docs = total = 0
        held = np.zeros(size, np.int64)
        for batch in batches:
            length = batch.column(0).to_numpy()
            docs += int((length > 0).sum())
            total += int(length.sum())
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *range(size)], pa.int32()), pa.array([docs, total, *held.tolist()], pa.int64())],
            names=["place", "n"],
        )

    return run


class Best:
    """The best documents of a query so far: scores falling, equal scores by rising id."""

    def __init__(self, size):
        self.size = size
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self):
        """The score a document has to reach; anything above 0 while places are free."""
        return int(self.scores[-1]) if len(self.scores) >= self.size else 1

    def add(self, scores, ids):
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[order], ids[order]


class ImpactLists:
    """Lists of one block of documents: for each term its documents, those of the greatest impact first."""

    def __init__(self, ids, mass, doc, place, count, weights):
        impact = weights[place] * (_SCALE * count // (_TF * count + _MASS * mass[doc]))
        order = np.lexsort((doc, -impact, place))
        self.ids = ids
        self.doc, self.impact, place = doc[order], impact[order], place[order]
        self.start = np.searchsorted(place, np.arange(len(weights) + 1))
        self.row = np.full(len(ids), -1, np.int64)

    def search(self, query, best: Best):
        """Put what this block has for ``query`` (places and how often each is asked) into ``best``."""
        places, times = query
        starts, stops = self.start[places], self.start[places + 1]
        some = stops > starts
        starts, stops, times = starts[some], stops[some], times[some]
        # a list's first impact bounds what it gives; lists that begin with 0 give nothing
        top = self.impact[starts] * times if len(starts) else starts
        starts, stops, times = starts[top > 0], stops[top > 0], times[top > 0]
        if not len(starts):
            return
        at, read = starts.copy(), FIRST_READ
        met: list = []  # documents in the order in which they were met
        lower = np.zeros(0, np.int64)
        seen = np.zeros((0, len(starts)), bool)
        n_met = 0
        try:
            while True:
                heads = np.where(at < stops, self.impact[np.minimum(at, stops - 1)] * times, 0)
                least, bound = best.least(), int(heads.sum())
                if n_met:
                    upper = lower[:n_met] + heads.sum() - seen[:n_met] @ heads
                    if n_met >= best.size:
                        least = max(least, int(np.partition(lower[:n_met], n_met - best.size)[n_met - best.size]))
                    alive = upper >= least
                    # nobody unmet can enter, and whoever can is known exactly
                    if bound < least and bool((upper[alive] == lower[:n_met][alive]).all()):
                        rows = np.flatnonzero(alive)
                        best.add(lower[rows], self.ids[np.concatenate(met)[rows]])
                        return
                elif bound < least:
                    return
                # read on: the lists whose next entries weigh most, by a slice that doubles
                for k in np.flatnonzero(heads >= max(1, int(heads.max()) // 4)):
                    stop = min(at[k] + read, stops[k])
                    docs, got = self.doc[at[k] : stop], self.impact[at[k] : stop] * times[k]
                    new = docs[self.row[docs] < 0]
                    if len(new):
                        self.row[new] = np.arange(n_met, n_met + len(new))
                        met.append(new)
                        n_met += len(new)
                        if n_met > len(lower):
                            room = max(2 * n_met, 1024)
                            lower = np.concatenate([lower, np.zeros(room - len(lower), np.int64)])
                            seen = np.concatenate([seen, np.zeros((room - len(seen), seen.shape[1]), bool)])
                    rows = self.row[docs]
                    lower[rows] += got
                    seen[rows, k] = True
                    at[k] = stop
                read *= 2
        finally:
            for docs in met:
                self.row[docs] = -1


def _rank(plan, top):
    """The best documents of a task for every query: query, doc_id, score."""

    def run(batches):
        queries, weights, docs, total = plan.value
        best = [Best(top) for _ in queries]
        held: list = []
        rows = 0

        def search():
            nonlocal held, rows
            ids = np.concatenate([h[0] for h in held])
            length = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            place = np.concatenate([h[3] for h in held])
            count = np.concatenate([h[4] for h in held])
            held, rows = [], 0
            for first in range(0, len(ids), DOC_BLOCK):
                block = slice(first, first + DOC_BLOCK)
                entries = slice(int(sizes[:first].sum()), int(sizes[: first + DOC_BLOCK].sum()))
                n = length[block]
                if int(n.max()) * _SLOPE * docs > _NO_ID:
                    n = n.astype(object)  # the product leaves 64 bits, the quotient does not
                mass = (_FLAT + (_SLOPE * n * docs) // total).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), sizes[block])
                lists = ImpactLists(ids[block], mass, doc, place[entries], count[entries], weights)
                for query, mine in zip(queries, best, strict=True):
                    lists.search(query, mine)

        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            lists, counts = batch.column(2), batch.column(3)
            held.append((ids, batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), counts.flatten().to_numpy()))
            rows += len(ids)
            if rows >= DOC_BLOCK:
                search()
        if rows:
            search()
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["query", "doc_id", "score"]
        )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every row of ``items``, of all rows of ``docs``.

    Each row of either table counts for itself, repeated ones too; a null text has no terms, an item without terms or
    matches no rows.  Equal scores go by ascending ``doc_id``, null ids last.  Empty tables give no rows; further columns
    are not looked at.  Queries are answered ``query_block`` at a time, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = materialize(
        items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("part", F.spark_partition_id()),
        "search-items",
    )
    parts = [r["part"] for r in asked.select("part").distinct().orderBy("part").collect()]
    kind = asked.schema["item_id"].dataType
    schema = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    found = []
    for part in parts:
        # a partition of the items at a time, and of it a block
        rows = asked.where(F.col("part") == part).drop("part").toLocalIterator()
        block: list = []
        for row in rows:
            block.append(row)
            if len(block) == query_block:
                found.append(_answer(texts, block, top, kind))
                block = []
        if block:
            found.append(_answer(texts, block, top, kind))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def _answer(texts: DataFrame, block, top: int, kind) -> DataFrame:
    """Results of one block of queries."""
    spark = texts.sparkSession
    vocabulary: dict = {}
    queries = []
    for row in block:
        counts = Counter(terms(row["text"]))
        places = [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        queries.append((np.array(places, np.int64), np.array(list(counts.values()), np.int64)))
    shared = spark.sparkContext.broadcast(vocabulary)
    index = materialize(
        texts.mapInArrow(_occurrences(shared), "doc_id bigint, length bigint, places array<int>, counts array<bigint>"),
        "search-occurrences",
    )
    counted = index.select("length", "places").mapInArrow(_frequencies(len(vocabulary)), "place int, n bigint")
    n = {r["place"]: r["n"] for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    docs, total = n.get(-2, 0), max(1, n.get(-1, 0))
    weights = np.array(
        [math.floor(1000 * math.log((2 * docs + 2) / (2 * n.get(p, 0) + 1))) for p in range(len(vocabulary))], np.int64
    )
    plan = spark.sparkContext.broadcast((queries, weights, docs, total))
    # few long runs of blocks: a task gives at most ``top`` rows for a query, and its own last place prunes
    wide = spark.sparkContext.defaultParallelism * 2
    ranked = index.coalesce(wide).mapInArrow(_rank(plan, top), "query int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(
        [(i, row["item_id"]) for i, row in enumerate(block)],
        T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)]),
    )
    # one row for each query of the block
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
