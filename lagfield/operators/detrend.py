"""Sliding-window detrending over frames.

A detrended image is the image, minus the per-pixel mean over ``window``
frames around it, plus the image's own spatial mean.  ``window // 2`` frames
are dropped at both ends.  Windows go by the position of a frame in its series.
A missing sample anywhere in the window leaves a missing sample.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from lagfield.operators import kernels
from lagfield.operators.layout import SeriesFacts, number_frames, sound_frames
from lagfield.schema import KEYS, types_of

#: Samples one chunk of consecutive frames may hold.  It bounds the memory of a
#: task (32 MB as doubles) whatever the length of the series.
CHUNK_SAMPLES = 1 << 22
CHUNK_FRAMES = (4, 1024)


def check_window(window):
    if int(window) != window or window < 1 or window % 2 == 0:
        raise ValueError("window must be odd")
    return int(window)


def detrend(pixels, keys=KEYS, window=3):
    """Detrend the long layout with window functions.

    The first window partitions by pixel (as many rows as frames), the second
    by frame, so neither a long series nor a large one is one group.
    """
    window = check_window(window)
    half = window // 2
    around = Window.partitionBy(*keys, "y", "x").orderBy("frame").rowsBetween(-half, half)
    image = Window.partitionBy(*keys, "frame")
    local = pixels.withColumns(
        {
            "_rows": F.count(F.lit(1)).over(around),
            "_seen": F.count("intensity").over(around),
            "_local": F.avg("intensity").over(around),
        }
    ).where(F.col("_rows") == window)
    level = local.withColumns(
        {
            "_mean": F.avg("intensity").over(image),
            "_whole": F.count("intensity").over(image) == F.count(F.lit(1)).over(image),
        }
    )
    usable = (F.col("_seen") == window) & F.col("_whole")
    return level.withColumn(
        "intensity", F.when(usable, F.col("intensity") - F.col("_local") + F.col("_mean"))
    ).select(*keys, "frame", "y", "x", "intensity")


def chunk_frames(height="height", width="width"):
    """Frames per chunk, a constant of a series because its images share a size."""
    low, high = CHUNK_FRAMES
    samples = F.greatest(F.col(height) * F.col(width), F.lit(1))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(CHUNK_SAMPLES) / samples))).cast("int")


def without_mixed(chunked, facts, window, chunk=None):
    """Chunks of the series whose images are all of one size; the others are told apart by their facts alone."""
    low = F.lit(int(chunk) if chunk is not None else CHUNK_FRAMES[0])
    numbers = F.sequence(F.lit(0), F.floor((F.col("last") + window // 2) / low).cast("int"))
    odd = facts.mixed().select(*facts.keys, F.explode(numbers).alias("chunk"))
    return chunked.join(odd, [*facts.keys, "chunk"], "left_anti")


def with_chunks(frames, window, chunk=None):
    """Copy each frame to every chunk whose windows need it.

    Chunks are runs of consecutive frames.  A frame within ``window // 2`` of a
    border also goes to the neighbour, so each chunk can be worked on alone and
    a series of any length spreads over many tasks.  Frames are numbered without
    gaps.  ``chunk`` sets the number of frames; no result depends on it.
    """
    half = window // 2
    span = chunk_frames() if chunk is None else F.lit(int(chunk))
    return frames.withColumn("_span", span).withColumn(
        "chunk",
        F.explode(
            F.expr(
                f"sequence(cast(floor(greatest(frame - {half}, 0) / _span) as int),"
                f" cast(floor((frame + {half}) / _span) as int))"
            )
        ),
    )


def chunk_residuals(chunked, keys=KEYS, window=3, align=None):
    """Residual image (``delta`` = image - sliding mean) of every frame.

    ``delta`` is NULL at the ends of a series; ``level`` is the mean of the
    image.  ``align`` may first shift the
    images of a chunk; it gets the columns ``reference`` and ``first_frame``.
    """
    window = check_window(window)
    half = window // 2
    carried = [c for c in chunked.columns if c not in ("group", "chunk", "_span", "reference", "first_frame", "pixels")]
    schema = T.StructType(
        types_of(chunked, carried)
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("pixels", "delta")]
        + [T.StructField("level", T.DoubleType())]
    )

    def residuals(table):
        table = table.sort_by("frame")
        frame = table["frame"].to_numpy()
        own = np.flatnonzero(frame // table["_span"][0].as_py() == table["chunk"][0].as_py())
        out = table.take(pa.array(own)).select(carried)
        height, width = table["height"][0].as_py(), table["width"][0].as_py()
        size = height * width
        stack = kernels.to_matrix_or_nan(table["pixels"], size)
        if align is not None and size:
            is_first = frame == table["first_frame"][0].as_py()
            images = align(stack.reshape(-1, height, width), table["reference"][0].as_py(), is_first)
            stack = images.reshape(len(frame), size)
        delta = np.full_like(stack, np.nan)
        edge = np.ones(len(frame), dtype=bool)
        if len(frame) >= window:
            middle = slice(half, len(frame) - half)
            delta[middle] = stack[middle] - kernels.sliding_mean(stack, window)
            edge[middle] = False
        out = out.append_column("pixels", kernels.to_lists(stack[own]))
        out = out.append_column("delta", kernels.to_lists(delta[own], edge[own]))
        return out.append_column("level", pa.array(stack[own].mean(axis=1), from_pandas=True))

    return chunked.groupBy(*keys, "chunk").applyInArrow(residuals, schema)


def detrend_frames(frames, keys=KEYS, window=3, chunk=None, gapless=None):
    """Detrend the array layout: one shuffle of whole images, no pixel rows.

    Frames keep their numbers; an image that is absent or damaged is one of
    missing samples.  Images without a key or size, and series of several
    sizes, have no rows (:func:`lagfield.operators.layout.series_status` names
    them).
    """
    window = check_window(window)
    base = sound_frames(frames.select(*keys, "frame", "height", "width", "pixels"), keys)
    base = number_frames(base.withColumn("_number", F.col("frame")), keys, gapless)
    chunked = without_mixed(with_chunks(base, window, chunk), SeriesFacts(base, keys), window, chunk)
    residual = chunk_residuals(chunked, keys, window)
    return residual.where(F.col("delta").isNotNull()).select(
        *keys,
        F.col("_number").alias("frame"),
        "height",
        "width",
        F.transform("delta", lambda v: v + F.col("level")).alias("pixels"),
    )
