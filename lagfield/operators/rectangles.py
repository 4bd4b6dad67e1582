"""Tile statistics and maps without a row per sample: running sums of images, and rectangles of equal value."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from lagfield.operators import kernels
from lagfield.operators.correlate import by_shape
from lagfield.operators.geometry import middle_of
from lagfield.operators.layout import as_frames, sound_frames, with_shape
from lagfield.operators.tiles import check_tiles
from lagfield.schema import KEYS, TILE, types_of

BOX = ("y0", "y1", "x0", "x1")


def tile_moments(df, size=32, step=16, keys=KEYS):
    """Sample counts, mean and population s.d. of every tile over all frames.

    ``n_all``, ``n_seen``, ``valid_fraction``, ``mean_intensity`` (of present samples) and ``brightness`` (NULL where a
    sample is missing).  Sums over a tile are the four corners of running sums over its image, so no sample is copied to
    the tiles that cover it; what leaves a task is one row a tile, added up over its images.  Damaged images count as
    missing samples; images without a complete key or size, or smaller than a tile, have no tile.
    """
    size, step = check_tiles(size, step)
    frames = sound_frames(as_frames(df, keys), keys)
    schema = T.StructType(
        types_of(frames, keys)
        + [T.StructField(c, T.IntegerType()) for c in TILE]
        + [T.StructField("n_seen", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("mean", "spread")]
    )

    def measure(batches):
        for batch in batches:
            for h, w, rows in by_shape(batch):
                if min(h, w) < size:
                    continue
                share = max(1, kernels.FFT_SAMPLES // (h * w))
                for first in range(0, len(rows), share):
                    part = batch.take(pa.array(rows[first : first + share]))
                    images = kernels.to_matrix(part["pixels"]).reshape(-1, h, w)
                    tops, lefts = (np.arange(0, n - size + 1, step, dtype=np.int32) for n in (h, w))
                    grid = len(tops) * len(lefts)
                    keyed = part.select(list(keys)).take(pa.array(np.repeat(np.arange(len(part)), grid)))
                    origins = np.meshgrid(tops, lefts, indexing="ij")
                    at = [pa.array(np.tile(o.ravel(), len(part))) for o in origins]
                    n, mean, spread = (m.ravel() for m in _image_moments(images, tops, lefts, size))
                    none = n == 0
                    sums = [pa.array(n.astype(np.int64)), pa.array(mean, mask=none), pa.array(spread, mask=none)]
                    yield pa.RecordBatch.from_arrays([*keyed.columns, *at, *sums], names=schema.names)

    moments = frames.select(*keys, "height", "width", "pixels").mapInArrow(measure, schema)
    area = float(size * size)
    # all images have the same weight where no sample is missing, and nowhere else is the spread asked for
    spread = F.sqrt(F.avg("spread") / area + F.var_pop("mean"))
    totals = moments.groupBy(*keys, *TILE).agg(
        (F.count(F.lit(1)) * F.lit(size * size)).alias("n_all"),
        F.sum("n_seen").alias("n_seen"),
        F.sum(F.col("mean") * F.col("n_seen")).alias("_sum"),
        spread.alias("_spread"),
    )
    return totals.select(
        *keys,
        *TILE,
        "n_all",
        "n_seen",
        (F.col("n_seen") / F.col("n_all")).alias("valid_fraction"),
        (F.col("_sum") / F.nullif("n_seen", F.lit(0))).alias("mean_intensity"),
        F.when(F.col("n_seen") == F.col("n_all"), F.col("_spread")).alias("brightness"),
    )


def _image_moments(images, tops, lefts, size):
    """Present samples, their mean and summed squared deviation for each (image, top, left)."""
    seen = ~np.isnan(images)
    count = seen.sum(axis=(1, 2), keepdims=True)
    # around the mean of the image, so that the difference of squares below loses no digits to it
    centre = np.where(seen, images, 0.0).sum(axis=(1, 2), keepdims=True) / np.maximum(count, 1)
    shifted = np.where(seen, images - centre, 0.0)

    def corners(values):
        run = np.zeros((len(values), values.shape[1] + 1, values.shape[2] + 1))
        run[:, 1:, 1:] = values.cumsum(axis=1).cumsum(axis=2)
        low, high = run[:, tops], run[:, tops + size]
        return high[:, :, lefts + size] - high[:, :, lefts] - low[:, :, lefts + size] + low[:, :, lefts]

    n, total, squares = np.rint(corners(seen.astype(float))), corners(shifted), corners(shifted**2)
    mean = total / np.maximum(n, 1)
    return n, mean + centre, np.maximum(squares - total * mean, 0.0)


def _strips(origin, extent, size, step, smooth):
    """Pieces of the axis that a tile owns: first and last sample, and the tiles that three neighbours lie in.

    0, 1 and 2 name the tile before, the tile itself and the tile after; NULL stands for samples no tile covers.
    """
    is_last = F.col(origin) + step + size > F.col(extent)
    covered = F.when(is_last, size).otherwise(min(size, step))
    stop = F.col(origin) + covered - 1
    end = F.when(is_last, F.col(extent) - 1).otherwise(F.col(origin) + step - 1)

    def strip(first, last, at):
        near = F.lit(None).cast("array<int>") if at is None else F.array(*[F.lit(i) for i in at])
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), near.alias("at"))

    bare = strip(stop + 1, end, None)
    if not smooth:
        pieces = F.array(strip(F.col(origin), stop, (1, 1, 1)), bare)
    else:
        pieces = F.when(covered == 1, F.array(strip(F.col(origin), stop, (0, 1, 2)), bare)).otherwise(
            F.array(
                strip(F.col(origin), F.col(origin), (0, 1, 1)),
                strip(F.col(origin) + 1, stop - 1, (1, 1, 1)),
                strip(stop, stop, (1, 1, 2)),
                bare,
            )
        )
    return F.filter(pieces, lambda s: s["first"] <= s["last"])


def tile_rectangles(tile_results, shape, columns, size=32, step=16, keys=KEYS, smooth=False):
    """The map that tiles paint, as rectangles of equal value (``y0``, ``y1``, ``x0``, ``x1``, both ends included).

    The same map as :func:`lagfield.operators.tiles.paint_tiles`, with ``smooth`` the same as
    :func:`lagfield.operators.geometry.median_filter3` of it.  A tile owns a rectangle, and only at its border does a
    3 x 3 neighbourhood reach into the tiles beside it, so the median has at most nine values a tile, found from tile
    rows alone.  ``tile_results`` has one row for every tile of the grid, failed ones too; a tile with a NULL key or
    origin paints nothing.
    """
    size, step = check_tiles(size, step)
    keys, columns = list(keys), list(columns)
    ty, tx = TILE
    sized = with_shape(tile_results.select(*keys, *TILE, *columns), shape, keys).where(
        F.col(ty).isNotNull() & F.col(tx).isNotNull()
    )
    types = dict(sized.dtypes)
    own = F.struct(*columns)
    cells = sized.withColumn("_cells", F.array(own))
    if smooth:
        void = F.struct(*[F.lit(None).cast(types[c]).alias(c) for c in columns])
        voids = F.array(void, void, void)
        along_x = Window.partitionBy(*keys, ty).orderBy(tx)
        along_y = Window.partitionBy(*keys, tx).orderBy(ty)

        def beside(value, empty, origin, extent, window):
            """What lies before and after: mirrored at the border of the image, nothing where no tile covers it."""
            apart = step > size
            is_last = F.col(origin) + step + size > F.col(extent)
            rest = F.col(origin) + size < F.col(extent)
            before = F.when(F.col(origin) == 0, value).otherwise(empty if apart else F.lag(value).over(window))
            after = F.when(is_last & rest, empty).when(is_last, value)
            return before, after.otherwise(empty if apart else F.lead(value).over(window))

        left, right = beside(own, void, tx, "width", along_x)
        rows = sized.withColumns({"_left": left, "_right": right}).withColumn("_row", F.array("_left", own, "_right"))
        above, below = beside(F.col("_row"), voids, ty, "height", along_y)
        cells = rows.withColumns({"_above": above, "_below": below}).withColumn(
            "_cells", F.concat(F.coalesce("_above", voids), F.col("_row"), F.coalesce("_below", voids))
        )
    pieces = cells.withColumn("_y", F.explode(_strips(ty, "height", size, step, smooth))).withColumn(
        "_x", F.explode(_strips(tx, "width", size, step, smooth))
    )
    covered = F.col("_y.at").isNotNull() & F.col("_x.at").isNotNull()
    near = F.flatten(
        F.transform("_y.at", lambda i: F.transform("_x.at", lambda j: F.get("_cells", i * F.lit(3) + j)))
    )
    box = [F.col(f"_{c[0]}.{'first' if c[1] == '0' else 'last'}").alias(c) for c in BOX]
    if not smooth:
        return pieces.select(*keys, *box, *[F.when(covered, F.col(c)).alias(c) for c in columns])
    # the neighbourhood is a column of its own, so that it is built once for all columns
    gathered = pieces.where(covered).withColumn("_near", near).select(
        *keys, *box, *[F.when(F.col(c).isNotNull(), middle_of("_near", c)).alias(c) for c in columns]
    )
    bare = pieces.where(~covered).select(*keys, *box, *[F.lit(None).cast("double").alias(c) for c in columns])
    return gathered.unionByName(bare)


def paint_rectangles(rectangles, columns, keys=KEYS):
    """One row per pixel from :func:`tile_rectangles`; nothing is shuffled."""
    rows = rectangles.withColumn("y", F.explode(F.sequence("y0", "y1")))
    return rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*keys, "y", "x", *columns)


def rectangle_range(rectangles, column, keys=KEYS):
    """:func:`lagfield.operators.stats.map_range` of the map; a rectangle counts as often as it has pixels."""
    area = (F.col("y1") - F.col("y0") + 1).cast("long") * (F.col("x1") - F.col("x0") + 1)
    middle = F.percentile(column, F.lit(0.5), area)
    return (
        rectangles.groupBy(*keys)
        .agg(middle.alias("median"))
        .withColumns({"low": F.col("median") * 0.5, "high": F.col("median") * 2.0})
    )
