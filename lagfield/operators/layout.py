"""Bridges between the array and the long layout, and image shapes."""

from pyspark.sql import Window, functions as F

from lagfield.schema import KEYS


def to_pixels(frames, keys=KEYS):
    """One row per sample from one row per image."""
    return frames.select(
        *keys, "frame", "width", F.posexplode("pixels").alias("pos", "value")
    ).select(
        *keys,
        "frame",
        F.expr("cast(pos div width as int)").alias("y"),
        F.expr("cast(pos % width as int)").alias("x"),
        F.col("value").cast("double").alias("intensity"),
    )


def to_frames(pixels, keys=KEYS):
    """One row per image from one row per sample.

    A group holds one image.  A missing sample must be a row with NULL
    intensity; an image whose rows do not fill its rectangle gets NULL pixels.
    """
    grouped = pixels.groupBy(*keys, "frame").agg(
        (F.max("y") + 1).cast("int").alias("height"),
        (F.max("x") + 1).cast("int").alias("width"),
        F.array_sort(F.collect_list(F.struct("y", "x", "intensity"))).alias("samples"),
    )
    filled = F.size("samples") == F.col("height") * F.col("width")
    return grouped.select(
        *keys,
        "frame",
        "height",
        "width",
        F.when(filled, F.transform("samples", lambda s: s["intensity"].cast("double"))).alias("pixels"),
    )


def as_frames(df, keys=KEYS):
    """``df`` in the array layout, whichever layout it comes in."""
    return df if "pixels" in df.columns else to_frames(df, keys)


def number_frames(frames, keys=KEYS, gapless=None, listed=None):
    """Frames numbered by their position in the series, from 0.

    Windows and bootstrap draws go by position.  A series whose frame numbers have no gaps is in order as it is; only where
    some series has gaps are positions, found from keys and numbers alone, joined to the images.  Whether any has is
    looked up while the plan is built, unless ``gapless`` says that none has.  ``listed`` may be a cheaper table with the
    same (keys, frame), such as the long layout the images come from.
    """
    if gapless:
        return frames
    keys = list(keys)
    numbers = (frames if listed is None else listed).select(*keys, "frame")
    spans = numbers.groupBy(*keys).agg(
        (F.max("frame") - F.min("frame") + 1 - F.count_distinct("frame")).alias("_gaps")
    )
    if spans.where("_gaps > 0").isEmpty():
        return frames
    order = Window.partitionBy(*keys).orderBy("frame")
    places = numbers.distinct().withColumn("_place", F.row_number().over(order) - 1)
    same = F.lit(True)
    for c in [*keys, "frame"]:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}"))
    placed = frames.alias("i").join(places.alias("p"), same)
    return placed.select(*[F.col("p._place").alias(c) if c == "frame" else F.col(f"i.{c}") for c in frames.columns])


def sound_images(frames):
    """Images whose array is absent or does not fill their rectangle, as images of missing samples."""
    size = F.col("height") * F.col("width")
    blank = F.array_repeat(F.lit(None).cast("double"), size.cast("int"))
    fills = F.size("pixels") == size
    return frames.withColumn("pixels", F.when(fills, F.col("pixels").cast("array<double>")).otherwise(blank))


def named(keys=KEYS):
    """True for images with a complete key, a frame number and a size; others cannot take part in any plan."""
    whole = F.col("height").isNotNull() & F.col("width").isNotNull()
    for c in [*keys, "frame"]:
        whole = whole & F.col(c).isNotNull()
    return whole & (F.col("height") >= 0) & (F.col("width") >= 0)


def sound_frames(frames, keys=KEYS):
    """The images every plan works on: named ones, damaged ones as images of missing samples."""
    return sound_images(frames.where(named(keys)))


FACTS = ("first", "last", "n", "height", "width", "low_height", "low_width")


class SeriesFacts:
    """Frame numbers and sizes of every series, one row each, from columns without pixels.

    The values travel as one array behind an exchange, so that all parts of a plan that ask for some of them read the
    same exchange again.
    """

    def __init__(self, frames, keys=KEYS):
        self.keys = list(keys)
        values = [F.min("frame"), F.max("frame"), F.count(F.lit(1))]
        values += [f(c) for f in (F.max, F.min) for c in ("height", "width")]
        grouped = frames.groupBy(*self.keys).agg(F.array(*[v.cast("long") for v in values]).alias("_facts"))
        self.packed = grouped.repartition(*self.keys)

    def select(self, *names):
        return self.packed.select(*self.keys, *[F.col("_facts")[FACTS.index(c)].cast("int").alias(c) for c in names])

    def mixed(self):
        """Series whose images are not all of one size."""
        sizes = self.select("last", "height", "width", "low_height", "low_width")
        return sizes.where("height <> low_height OR width <> low_width")


def series_status(frames, keys=KEYS, facts=None):
    """One row, with ``status``, for each series that gives no result because of its keys or sizes.

    ``null_key``: images without a complete key or frame number, in one row for each key as it is; ``no_size``: no image
    has a size; ``mixed_sizes``: images of several sizes; ``empty_image``: images without samples.  ``frames`` are the images as they come.  No pixel is read.
    """
    keys = list(keys)
    facts = facts or SeriesFacts(frames.where(named(keys)), keys)
    whole = facts.select("height", "width", "low_height", "low_width")
    mixed = (F.col("height") != F.col("low_height")) | (F.col("width") != F.col("low_width"))
    found = whole.select(
        *keys,
        "height",
        "width",
        F.when(mixed, "mixed_sizes").when(F.col("height") * F.col("width") == 0, "empty_image").alias("status"),
    ).where("status IS NOT NULL")
    unnamed = F.lit(False)
    for c in [*keys, "frame"]:
        unnamed = unnamed | F.col(c).isNull()
    odd = frames.where(~F.coalesce(named(keys), F.lit(False))).select(*keys, unnamed.alias("_unnamed")).distinct()
    odd = odd.groupBy(*keys).agg(F.bool_or("_unnamed").alias("_unnamed"))
    # a series of which some images have a size goes on with these
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}"))
    lone = odd.where("NOT _unnamed").alias("o").join(whole.alias("w"), same, "left_anti")
    unsized = lone.select(*keys, F.lit("no_size").alias("status"))
    nameless = odd.where("_unnamed").select(*keys, F.lit("null_key").alias("status"))
    return found.unionByName(unsized.unionByName(nameless), allowMissingColumns=True)


def stack_shape(df, keys=KEYS):
    """Frame count, height and width of every image series."""
    if "pixels" in df.columns:
        height, width = F.max("height"), F.max("width")
    else:
        height, width = F.max("y") + 1, F.max("x") + 1
    return df.groupBy(*keys).agg(
        (F.max("frame") + 1).cast("int").alias("n_frames"),
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
    )


def with_shape(df, shape, keys=KEYS):
    """Attach ``height`` and ``width``.

    ``shape`` is a pair when all series have one size, which needs no join, or
    a table as :func:`stack_shape` gives.  The table has one row per series, so
    it may grow with the data: Spark decides from its measured size whether to
    broadcast it.
    """
    if isinstance(shape, tuple):
        return df.withColumns({"height": F.lit(shape[0]), "width": F.lit(shape[1])})
    on = [k for k in keys if k in shape.columns]
    return df.join(shape.select(*on, "height", "width"), on)
