"""Mixing sources to target weights by hash thresholds.

Every row has a hash from 0 to 2**60 - 1.  A source takes the rows whose hash lies below its threshold.  Histograms of
tokens by source and leading hash bits find the bucket in which the budget runs out; only rows of that bucket are
counted again with the next bits, until one hash value is left.  No row is sorted.  A larger budget has a higher
threshold, so the mixes of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagfield.llm.common import hash60, materialize, n_words

HASH_BITS = 60
MAX_REPEATS = 3


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources: one row per source with ``source, source_size`` gets ``target`` (double).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at
    ``max_repeats`` times its source, the excess is shared again by weight.  The rows here are one per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    s = s.withColumns(
        {
            "cap": (max_repeats * F.col("source_size")).cast("double"),
            "limit": max_repeats * F.col("source_size") / F.col("weight"),
        }
    )
    # sources reach their caps in the order of cap / weight
    order = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    s = s.withColumn("share", F.col("left") / F.col("rest"))
    share = F.min(F.when(F.col("limit") >= F.col("share"), F.struct("limit", "share"))).over(everything)["share"]
    target = F.least("cap", F.col("weight") * share)
    return s.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "target")


def thresholds(sizes: DataFrame, budgets: DataFrame, bits: int = 12) -> DataFrame:
    """For each source the hash below which rows are taken, so that their sizes come nearest to its budget.

    ``sizes``: ``source_no, hash, size``; ``budgets``: ``source_no, budget`` (0 <= budget).  Returns
    ``source_no, below`` (take rows with hash < below).  Rows of equal hash stay together.
    """
    state = budgets.select("source_no", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    shift = HASH_BITS
    while shift > 0:
        step = min(bits, shift)
        inside = F.shiftright("hash", shift) == F.col("prefix") if shift < HASH_BITS else F.lit(True)
        hist = (
            sizes.join(state, "source_no")
            .where(inside)
            .groupBy("source_no", "left", F.shiftright("hash", shift - step).alias("bucket"))
            .agg(F.sum("size").alias("sum"))
        )
        upto = Window.partitionBy("source_no").orderBy("bucket")  # at most 2**bits rows for each source
        edge = hist.withColumn("cum", F.sum("sum").over(upto)).where("cum > left")
        state = materialize(
            edge.groupBy("source_no").agg(F.min(F.struct("bucket", "cum", "sum", "left")).alias("b")).select(
                "source_no",
                F.col("b.bucket").alias("prefix"),
                (F.col("b.left") - (F.col("b.cum") - F.col("b.sum"))).alias("left"),
                F.col("b.sum").alias("sum"),
            ),
            "mix-edge",
        )
        shift -= step
    # the last bucket is one hash value: it is taken if that comes nearer to the budget
    below = F.col("prefix") + F.when(2 * F.col("left") > F.col("sum"), 1).otherwise(0)
    found = state.select("source_no", below.alias("below"))
    # a budget no bucket exceeds takes everything
    return budgets.join(found, "source_no", "left").select(
        "source_no", F.coalesce("below", F.lit(1 << HASH_BITS)).alias("below")
    )


def _hash(doc_id: str) -> Column:
    return hash60(F.lit("mix"), F.col(doc_id).cast("string"))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"),
            _hash(doc_id).alias("hash"),
        ),
        "mix-sizes",
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source, source_size, target, taken, repeats``.

    ``repeats`` (0 to 3) is how often a row enters the mix, ``taken`` its words times that.  A source is repeated whole
    as often as its target holds it, and the rest is filled by hash threshold.  The hash depends on ``doc_id`` alone,
    so reruns agree and rows of one ``doc_id`` are taken alike.  A null text has size 0; a null source is a source;
    null ids share one hash; an empty table gives no rows; further columns of ``docs`` are not looked at.
    """
    sizes = _sizes(docs, doc_id, text, source)
    return (
        sizes.alias("d")
        .join(mix_plan(sizes).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.size", "d.source", "t.source_size", "t.target", _repeats(F.col("d.hash")).alias("repeats"))
        .withColumn("taken", F.col("size") * F.col("repeats"))
    )


def _repeats(hash_: Column) -> Column:
    """How often a row of ``hash_`` enters, from the plan of its source (``t``)."""
    once_more = F.when(hash_ < F.coalesce("t.below", F.lit(0)), 1).otherwise(0)
    return F.least(F.lit(MAX_REPEATS).cast("long"), F.col("t.whole") + once_more)


def mix_plan(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, whole, below``: rows enter ``whole`` times, and once more if their hash is below.

    ``sizes``: ``source, size, hash`` of every row.  One row for each source, written, so that Spark knows its size.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources).withColumns(
        {
            "source_no": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())),
            "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0)
            .cast("long"),
        }
    )
    targets = materialize(
        targets.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))),
        "mix-targets",
    )
    keyed = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.source_no"
    )
    cut = thresholds(keyed, targets.where("source_size > 0").select("source_no", "budget"))
    return materialize(targets.join(cut, "source_no", "left").drop("source_no", "budget"), "mix-plan")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as the mix takes it (0 to 3 times); same columns.

    The hash of a row is worked out again and held against the plan of its source, so rows stay where they are read.
    """
    sizes = _sizes(docs, doc_id, text, source)
    plan = mix_plan(sizes).select(*[F.col(c).alias(f"__{c}__") for c in ("source", "whole", "below")])
    once_more = F.when(_hash(doc_id) < F.coalesce("__below__", F.lit(0)), 1).otherwise(0)
    repeats = F.least(F.lit(MAX_REPEATS).cast("long"), F.col("__whole__") + once_more)
    met = docs.join(plan, F.col(source).eqNullSafe(F.col("__source__"))).withColumn("__repeats__", repeats)
    return (
        met.where("__repeats__ > 0")
        .withColumn("__copy__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats__"))))
        .select(*docs.columns)
    )
