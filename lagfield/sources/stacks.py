"""Image series at rest: Parquet in the array layout."""

from pyspark.sql import functions as F

from lagfield.schema import KEYS, frames_schema


def scan_stack(spark, path, channel=0, frames=None, stack_ids=None, pixel_type=None):
    """Images of one channel, optionally a range of frames (both ends included).

    All three conditions reach the Parquet scan; ``channel`` is a folder.
    """
    df = spark.read.schema(frames_schema(pixel_type)).parquet(path).where(F.col("channel") == channel)
    if frames is not None:
        df = df.where(F.col("frame").between(*frames))
    if stack_ids is not None:
        df = df.where(F.col("stack_id").isin(list(stack_ids)))
    return df


def write_frames(frames, path, mode="errorifexists"):
    """Store images by channel, in ranges of series so that file statistics skip other series.

    There is no folder per series: with millions of series that would be
    millions of tiny files.
    """
    columns = [f.name for f in frames_schema().fields]
    (
        frames.select(*columns)
        .repartitionByRange(*KEYS, "frame")
        .sortWithinPartitions(*KEYS, "frame")
        .write.mode(mode)
        .partitionBy("channel")
        .parquet(path)
    )
