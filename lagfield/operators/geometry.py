"""Crops, cuts and selections of image series."""

from pyspark.sql import Window, functions as F

from lagfield.operators.layout import with_shape
from lagfield.schema import KEYS


def _centre(size, fraction):
    """Start and length of the centred crop of an axis."""
    length = F.floor(size * F.lit(float(fraction))).cast("int")
    return F.floor((size - length) / 2).cast("int"), length


def crop_center(df, crop, shape=None, keys=KEYS):
    """Keep the centred fraction ``crop`` of both axes, counted from 0 again.

    Works on both layouts; ``frames`` rows carry their own shape, ``pixels``
    need one (see :func:`lagfield.operators.layout.with_shape`).
    """
    if "pixels" in df.columns:
        return _crop_frames(df, crop)
    if shape is None:
        raise ValueError("crop_center on pixels needs the image shape")
    columns = df.columns
    y0, ny = _centre(F.col("height"), crop)
    x0, nx = _centre(F.col("width"), crop)
    framed = with_shape(df, shape, keys)
    return (
        framed.where((F.col("y") >= y0) & (F.col("y") < y0 + ny) & (F.col("x") >= x0) & (F.col("x") < x0 + nx))
        .withColumns({"y": (F.col("y") - y0).cast("int"), "x": (F.col("x") - x0).cast("int")})
        .select(*columns)
    )


def _crop_frames(frames, crop):
    if float(crop) == 1.0:
        return frames
    columns = frames.columns
    y0, ny = _centre(F.col("height"), crop)
    x0, nx = _centre(F.col("width"), crop)
    boxed = frames.withColumns({"_y0": y0, "_ny": ny, "_x0": x0, "_nx": nx})
    cut = F.expr(
        "flatten(transform(sequence(_y0, _y0 + _ny - 1), r -> slice(pixels, r * width + _x0 + 1, _nx)))"
    )
    empty = (F.col("_ny") == 0) | (F.col("_nx") == 0)
    return boxed.withColumns(
        {
            "pixels": F.when(empty, F.slice("pixels", 1, 0)).otherwise(cut),
            "height": F.col("_ny"),
            "width": F.col("_nx"),
        }
    ).select(*columns)


def pick_frame(df, which, keys=KEYS):
    """First or last frame of every series.

    The wanted frame number is a pre-aggregated row per series; a semi-join
    brings it back, so no series is gathered in one task.
    """
    if which not in ("first", "last"):
        raise ValueError("which must be 'first' or 'last'")
    pick = F.min("frame") if which == "first" else F.max("frame")
    wanted = df.groupBy(*keys).agg(pick.alias("frame"))
    return df.join(wanted, [*keys, "frame"], "left_semi")


def crop_lags(corr_map, crop_fast, crop_slow, shape=None, keys=KEYS):
    """Keep the central lags of a correlation map; lags keep their values.

    The bounds are floor(n (1 - c) / 2) and floor(n (1 + c) / 2) on the axis
    index, where index n // 2 is lag 0.  The size comes from ``shape``, from
    columns ``height`` and ``width`` of the map, or else from its lags.
    """
    columns = corr_map.columns
    sized = corr_map if shape is None and {"height", "width"} <= set(columns) else None
    if sized is None and shape is None:
        shape = corr_map.groupBy(*keys).agg(
            (F.max("dy") - F.min("dy") + 1).alias("height"), (F.max("dx") - F.min("dx") + 1).alias("width")
        )

    def inside(lag, size, crop):
        index = F.col(lag) + F.floor(F.col(size) / 2)
        low = F.floor(F.col(size) * (1.0 - float(crop)) * 0.5)
        high = F.floor(F.col(size) * 0.5 * (1.0 + float(crop)))
        return (index >= low) & (index < high)

    if sized is None:
        sized = with_shape(corr_map, shape, keys)
    return sized.where(inside("dy", "height", crop_slow) & inside("dx", "width", crop_fast)).select(*columns)


def blank_zero_lag(corr_map, value=0.0, column="g"):
    """Replace the zero lag, which holds the detector noise."""
    zero = (F.col("dy") == 0) & (F.col("dx") == 0)
    return corr_map.withColumn(column, F.when(zero, F.lit(value)).otherwise(F.col(column)))


def fast_axis(corr_map):
    """The row ``dy = 0``."""
    return corr_map.where(F.col("dy") == 0)


def with_distance(df, pixel_um, lag="dx"):
    """Distance axis in um for plots along the fast axis."""
    scale = F.col(pixel_um) if isinstance(pixel_um, str) else F.lit(float(pixel_um))
    return df.withColumn("distance_um", F.col(lag) * scale)


def middle_of(structs, name):
    """Median of field ``name`` of an array of structs, NULLs ignored."""
    values = F.array_sort(F.filter(F.transform(structs, lambda s: s[name]), lambda v: v.isNotNull()))
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0


def median_filter3(local_map, columns, keys=KEYS):
    """3 x 3 median of each column; borders mirrored, NULLs ignored.

    A pixel that is NULL itself stays NULL.  Two passes of lag/lead, along the
    fast and then the slow axis, gather the nine neighbours; a group is one
    image row or column, and no row is copied.
    """
    columns = list(columns)
    along_x = Window.partitionBy(*keys, "y").orderBy("x")
    along_y = Window.partitionBy(*keys, "x").orderBy("y")
    # The row above and below are whole structs, so a NULL struct means "outside".
    own = F.struct(*columns)
    triple = local_map.withColumns(
        {"_left": F.coalesce(F.lag(own).over(along_x), own), "_right": F.coalesce(F.lead(own).over(along_x), own)}
    ).withColumn("_row", F.array("_left", own, "_right"))
    nine = triple.withColumn(
        "_all",
        F.concat(
            F.coalesce(F.lag("_row").over(along_y), F.col("_row")),
            F.col("_row"),
            F.coalesce(F.lead("_row").over(along_y), F.col("_row")),
        ),
    )

    def median(name):
        return F.when(F.col(name).isNotNull(), middle_of("_all", name)).alias(name)

    kept = [c for c in local_map.columns if c not in columns]
    return nine.select(*kept, *[median(c) for c in columns])
