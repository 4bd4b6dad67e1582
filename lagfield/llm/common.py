"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.session import shared_folder

#: Fixed value: what separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator has written, whatever the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside go when the block ends, but for those it is told to keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def materialize(df: DataFrame, purpose: str, keep: bool = False, outer: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, gives Spark true sizes.

    ``outer`` leaves a table written in an inner :func:`passing_tables` to the block around it.
    """
    path = scratch(df.sparkSession, purpose)
    scopes = _scopes[:-1] if outer else _scopes
    if scopes and not keep:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without keeping them."""
    return F.size(words(text)).cast("long")


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash60(*parts: Column) -> Column:
    """A whole number from 0 to 2**60 - 1 that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")
