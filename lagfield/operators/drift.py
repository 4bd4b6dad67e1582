"""Drift between frames and its correction.

The reference is a region of the first frame of a series.  It has to meet every
later frame of that series, so it is copied to each chunk of frames and joined
on (keys, chunk): a long series spreads over many tasks, and the copies are one
per chunk, not one per frame.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from lagfield.operators import kernels
from lagfield.operators.detrend import chunk_frames
from lagfield.operators.layout import named, sound_images, stack_shape, with_shape
from lagfield.schema import KEYS, types_of

# Fixed value: width of the smoothing of the correlation, in samples.
SIGMA = 2.0


def region(frames, roi=None):
    """Add the region of each image: ``roi`` (row-major), ``roi_h``, ``roi_w``.

    ``roi`` is (y_from, y_to, x_from, x_to), or None for the central square of
    half the smaller side.
    """
    if roi is None:
        side = F.floor(F.least("height", "width") / 2).cast("int")
        bounds = {
            "_y": F.floor((F.col("height") - side) / 2).cast("int"),
            "_x": F.floor((F.col("width") - side) / 2).cast("int"),
            "roi_h": side,
            "roi_w": side,
        }
    else:
        y0, y1, x0, x1 = (int(v) for v in roi)
        bounds = {"_y": F.lit(y0), "_x": F.lit(x0), "roi_h": F.lit(y1 - y0), "roi_w": F.lit(x1 - x0)}
    cut = F.expr("flatten(transform(sequence(_y, _y + roi_h - 1), r -> slice(pixels, r * width + _x + 1, roi_w)))")
    framed = frames.withColumns(bounds)
    return framed.withColumn("roi", F.when((F.col("roi_h") > 0) & (F.col("roi_w") > 0), cut)).drop("_y", "_x")


def first_regions(frames, keys=KEYS, roi=None):
    """The region of the first frame of every series (``head``), with the numbers of its first and last frame.

    Each task keeps the earliest region it reads of a series, so no image but
    these few is shuffled.
    """
    return region(frames, roi).groupBy(*keys).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.min_by(F.struct("roi", "roi_h", "roi_w", "height", "width"), "frame").alias("head"),
    )


def _with_reference(frames, keys, roi):
    """Images with the region of the first frame of their series: one exchange, by chunks of frames.

    An image without a complete key, or of another size than the first one, has no partner.
    """
    chunked = frames.withColumn("chunk", F.floor(F.col("frame") / chunk_frames()).cast("int"))
    heads = first_regions(frames.where(named(keys)), keys, roi)
    span = chunk_frames("head.height", "head.width")
    low, high = (F.floor(F.col(c) / span).cast("int") for c in ("first_frame", "last_frame"))
    copies = heads.select(
        *keys,
        "first_frame",
        F.col("head.roi").alias("reference"),
        F.col("head.roi_h").alias("ref_h"),
        F.col("head.roi_w").alias("ref_w"),
        F.explode(F.sequence(low, high)).alias("chunk"),
    )
    return chunked.join(copies, [*keys, "chunk"], "left")


def _shifts(batch, keys, column, sigma):
    """Shift of each row of a batch, (0, 0) for first frames and NaN where there is none; ``column`` holds regions."""
    out = np.full((len(batch), 2), np.nan)
    frame, first = (batch[c].to_numpy(zero_copy_only=False) for c in ("frame", "first_frame"))
    out[frame == first] = 0
    sizes = [batch[c].to_numpy(zero_copy_only=False) for c in ("roi_h", "roi_w", "ref_h", "ref_w")]
    both = np.asarray(batch[column].is_valid()) & np.asarray(batch["reference"].is_valid()) & (frame != first)
    both &= (sizes[0] == sizes[2]) & (sizes[1] == sizes[3])
    # rows of one series share the reference, and so its spectrum
    groups = {}
    for row, name in zip(np.flatnonzero(both).tolist(), zip(*[batch[k].take(pa.array(np.flatnonzero(both))).to_pylist() for k in keys])):
        groups.setdefault(name, []).append(row)
    for rows in groups.values():
        shape = (int(sizes[0][rows[0]]), int(sizes[1][rows[0]]))
        anchor = kernels.to_matrix(batch["reference"].slice(rows[0], 1)).reshape(shape)
        images = kernels.to_matrix(batch[column].take(pa.array(rows))).reshape(-1, *shape)
        out[rows] = kernels.peak_shifts(anchor, images, sigma)
    return out


def estimate_drift(frames, keys=KEYS, roi=None, sigma=SIGMA):
    """Integer shift (dy, dx) that moves each frame onto the first one.

    One row per frame; the first frame has (0, 0).  NULL where samples of the
    region are missing, the image is damaged or of another size than the first,
    or its key is not complete.
    """
    schema = T.StructType(types_of(frames, [*keys, "frame"]) + [T.StructField(c, T.IntegerType()) for c in ("dy", "dx")])
    base = region(sound_images(frames.select(*keys, "frame", "height", "width", "pixels")), roi)
    pairs = _with_reference(base, keys, roi)

    def shifts(batches):
        for batch in batches:
            found = _shifts(batch, keys, "roi", sigma)
            shift = [pa.array(found[:, i], from_pandas=True).cast(pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch[k] for k in [*keys, "frame"]] + shift, names=schema.names)

    wanted = [*keys, "frame", "first_frame", "roi", "roi_h", "roi_w", "reference", "ref_h", "ref_w"]
    return pairs.select(*wanted).mapInArrow(shifts, schema)


def apply_drift(df, drift, keys=KEYS, shape=None):
    """Shift every frame by its drift, circularly, in either layout."""
    shift = drift.select(*keys, "frame", F.col("dy").alias("_dy"), F.col("dx").alias("_dx"))
    columns = df.columns
    joined = df.join(shift, [*keys, "frame"])
    if "pixels" in columns:
        moved = F.expr(
            "flatten(transform(sequence(0, height - 1), r -> concat("
            "slice(pixels, pmod(r - _dy, height) * width + 1 + pmod(-_dx, width), width - pmod(-_dx, width)),"
            "slice(pixels, pmod(r - _dy, height) * width + 1, pmod(-_dx, width)))))"
        )
        return joined.withColumn("pixels", F.when(F.col("_dy").isNotNull(), moved)).select(*columns)
    sized = with_shape(joined, shape if shape is not None else stack_shape(df, keys), keys)
    return sized.withColumns(
        {
            "y": F.pmod(F.col("y") + F.col("_dy"), F.col("height")).cast("int"),
            "x": F.pmod(F.col("x") + F.col("_dx"), F.col("width")).cast("int"),
        }
    ).select(*columns)


def drift_correct(frames, keys=KEYS, roi=None, sigma=SIGMA):
    """Estimate the drift of every frame and undo it; images are shuffled once.

    An image that cannot be placed has NULL pixels.  Columns beside the layout's
    own stay.
    """
    columns = frames.columns
    base = region(sound_images(frames).withColumn("pixels", F.col("pixels").cast("array<double>")), roi)
    pairs = _with_reference(base, keys, roi)
    carried = [c for c in columns if c != "pixels"]
    schema = T.StructType(types_of(frames, carried) + [T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def move(batches):
        for batch in batches:
            found = _shifts(batch, keys, "roi", sigma)
            placed = np.flatnonzero(~np.isnan(found[:, 0]))
            lists = [None] * len(batch)
            pixels = batch["pixels"]
            sizes = [batch[c].to_numpy(zero_copy_only=False) for c in ("height", "width")]
            for row in placed.tolist():
                dy, dx = (int(v) for v in found[row])
                image = kernels.to_matrix(pixels.slice(row, 1)).reshape(int(sizes[0][row]), int(sizes[1][row]))
                lists[row] = np.roll(image, (dy, dx), axis=(0, 1)).reshape(-1)
            moved = pa.array(lists, pa.list_(pa.float64()), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch[c] for c in carried] + [moved], names=schema.names)

    wanted = [c for c in ("first_frame", "roi", "roi_h", "roi_w", "reference", "ref_h", "ref_w") if c not in carried]
    return pairs.select(*carried, "pixels", *wanted).mapInArrow(move, schema).select(*columns)


def chunk_aligner(roi=None, sigma=SIGMA):
    """``align`` for :func:`lagfield.operators.detrend.chunk_residuals`.

    Gives the same images as :func:`drift_correct` where the frames of a chunk
    are already together, which saves two shuffles.  ``reference`` is the
    region of the first frame; a frame that cannot be placed becomes missing.
    """

    def align(stack, reference, is_first):
        height, width = stack.shape[1:]
        side = min(height, width) // 2
        y0, y1, x0, x1 = roi or (
            (height - side) // 2,
            (height - side) // 2 + side,
            (width - side) // 2,
            (width - side) // 2 + side,
        )
        out = np.full_like(stack, np.nan)
        if reference is None:
            return out
        anchor = np.array(reference, dtype=float).reshape(y1 - y0, x1 - x0)
        shifts = kernels.peak_shifts(anchor, stack[:, y0:y1, x0:x1], sigma)
        shifts[is_first] = 0
        for i in np.flatnonzero(~np.isnan(shifts[:, 0])):
            out[i] = np.roll(stack[i], shifts[i].astype(int), axis=(0, 1))
        return out

    return align
