"""Packing by optimal length buckets.

The histogram of all lengths goes to a dynamic program that chooses bucket bounds with the least padding.  Rows of a
bucket are padded to its bound and packed into batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagfield.llm.common import materialize, n_words

SLICE_ROWS = 50_000


def optimal_bounds(lengths, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding; ``lengths`` ascend.

    Padding of bucket (i, j] is ``length[j] * count - tokens``, from running sums; bounds are always lengths that occur.
    For each i it is a line over ``length[j]``, and slopes fall with i, so the lower hull of the lines gives every j its
    best i: time grows with the number of lengths, not its square.  Whole numbers throughout, so nothing is rounded.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.cumsum(counts).tolist(), np.cumsum(counts * lengths).tolist()
    lengths = lengths.tolist()
    best = [length * r - t for length, r, t in zip(lengths, rows, tokens, strict=True)]  # one bucket for the first j lengths
    came = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, via = list(best), np.zeros(n, np.int64)
        hull, first = [], 0  # (slope, value at 0, i), steeper and steeper
        for j in range(1, n):
            _add(hull, first, (-rows[j - 1], best[j - 1] + tokens[j - 1], j - 1))
            x = lengths[j]
            while first + 1 < len(hull) and hull[first + 1][0] * x + hull[first + 1][1] < hull[first][0] * x + hull[first][1]:
                first += 1
            cost = hull[first][0] * x + hull[first][1] + x * rows[j] - tokens[j]
            if cost < new[j]:
                new[j], via[j] = cost, hull[first][2] + 1
        came.append(via)
        best = new
    bounds, j, layer = [], n - 1, len(came) - 1
    while j >= 0:
        bounds.append(lengths[j])
        via = came[layer][j]
        if via == 0:
            break
        j, layer = int(via) - 1, layer - 1
    return bounds[::-1]


def _add(hull: list, first: int, line: tuple) -> None:
    """Put ``line``, at least as steep as all before it, at the end of the lower hull; lines up to ``first`` stay."""
    m, c, _ = line
    while len(hull) > first:
        m2, c2, _ = hull[-1]
        if m == m2:
            if c >= c2:
                return
        else:
            if len(hull) - 1 == first:
                break
            m1, c1, _ = hull[-2]
            # the last line is needed only if it falls below the one before it ahead of the new one
            if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                break
        hull.pop()
    hull.append(line)


def length_bounds(lengths: DataFrame, buckets: int = 16, max_bins: int | None = None) -> list[int]:
    """Bounds from the histogram of the column ``n_tokens`` over all rows, the exact optimum whatever the lengths.

    The histogram has no more rows than the longest text has tokens.  A caller who wants fewer can set ``max_bins``:
    lengths are then rounded up to multiples of the smallest power of two that leaves at most so many, and the result is
    the optimum among such bounds.
    """
    hist = materialize(lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").count(), "pack-histogram")
    if max_bins is None:
        exact = hist.toPandas().sort_values("n_tokens")
        return optimal_bounds(exact["n_tokens"].to_numpy(), exact["count"].to_numpy(), buckets)
    grain = 1
    while True:
        bins = hist.groupBy((F.ceil(F.col("n_tokens") / grain) * grain).cast("long").alias("n")).agg(
            F.sum("count").alias("rows")
        )
        if bins.count() <= max_bins:
            break
        grain *= 2
    rows = sorted((r["n"], r["rows"]) for r in bins.collect())
    return optimal_bounds([r[0] for r in rows], [r[1] for r in rows], buckets)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = 16,
    batch_tokens: int = 65_536,
    n_tokens=n_words,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, bucket, bound, batch, slot, padding``.

    Batches of a bucket hold ``batch_tokens // bound`` rows (one row if the bound exceeds the budget), all full but the
    last.  ``batch`` counts within its bucket.  Rows of a bucket are numbered in slices of about ``slice_rows`` rows
    and the slices' counts are added up, so no task sees a whole bucket.  A null text has length 0; repeated rows get
    places of their own; an empty table gives no rows; further columns are not looked at.
    """
    lengths = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), n_tokens(F.col(text)).alias("n_tokens")), "pack-lengths"
    )
    bounds = length_bounds(lengths, buckets)
    edges = F.array(*map(F.lit, bounds)).cast("array<long>")
    number = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    placed = lengths.withColumn("bucket", number).withColumn("bound", F.coalesce(F.get(edges, number), F.lit(0)))
    totals = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}  # at most ``buckets`` rows
    slices = F.array(*[F.lit(1 + totals.get(i, 0) // slice_rows) for i in range(max(1, len(bounds)))])
    placed = placed.withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.get(slices, F.col("bucket")).cast("long"))
    )
    counts = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "slice").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    place = F.col("offset") + F.col("i") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bound")))).cast("long")
    return (
        placed.withColumn("i", F.row_number().over(within))
        .join(offsets, ["bucket", "slice"])
        .select(
            "doc_id",
            "n_tokens",
            F.col("bucket").cast("long").alias("bucket"),
            F.col("bound").cast("long").alias("bound"),
            F.floor(place / capacity).alias("batch"),
            (place % capacity).alias("slot"),
            (F.col("bound") - F.col("n_tokens")).cast("long").alias("padding"),
        )
    )
