"""Grouped statistics of image series; all have partial aggregation."""

from pyspark.sql import functions as F

from lagfield.operators.geometry import crop_center
from lagfield.schema import KEYS, TILE


def frame_stats(pixels, keys=KEYS):
    """Mean intensity and number of samples of every frame."""
    return pixels.groupBy(*keys, "frame").agg(
        F.avg("intensity").alias("mean_intensity"), F.count("intensity").alias("n_pixels")
    )


def mean_projection(pixels, keys=KEYS):
    """Time-averaged image."""
    return pixels.groupBy(*keys, "y", "x").agg(F.avg("intensity").alias("mean_intensity"))


def intensity_trace(df, shape=None, fraction=0.25, keys=KEYS):
    """Mean over a centred region for every frame."""
    region = crop_center(df, fraction, shape, keys)
    if "pixels" in region.columns:
        total = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
        count = F.size(F.filter("pixels", lambda v: v.isNotNull()))
        return region.select(*keys, "frame", (total / F.nullif(count, F.lit(0))).alias("mean_intensity"))
    return region.groupBy(*keys, "frame").agg(F.avg("intensity").alias("mean_intensity"))


def brightness(pixels, keys=KEYS + TILE):
    """Population s.d. of all samples of a tile over all frames."""
    complete = F.count("intensity") == F.count(F.lit(1))
    return pixels.groupBy(*keys).agg(F.when(complete, F.stddev_pop("intensity")).alias("brightness"))


def map_range(local_map, column, keys=KEYS):
    """Median of a map and the 0.5x to 2x range around it, NULLs skipped.

    A group is the pixels of one image.
    """
    return (
        local_map.groupBy(*keys)
        .agg(F.median(column).alias("median"))
        .withColumns({"low": F.col("median") * 0.5, "high": F.col("median") * 2.0})
    )
