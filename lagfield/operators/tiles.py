"""Overlapping square tiles of an image and maps painted from them.

Tile (iy, ix) starts at (iy * step, ix * step); an axis of n samples has
(n - size) div step + 1 tiles, none if it is shorter than a tile.
"""

from pyspark.sql import functions as F

from lagfield.operators.layout import with_shape
from lagfield.schema import KEYS, TILE


def check_tiles(size, step):
    if size < 1 or step < 1:
        raise ValueError("tile size and step must be positive")
    return int(size), int(step)


def assign_tiles(pixels, shape, size=32, step=16, keys=KEYS):
    """Copy each sample to every tile that covers it.

    The tiles of a sample follow from its position, so this is an explode and
    not a range join.  Coordinates count from the tile origin.
    """
    size, step = check_tiles(size, step)

    def origins(axis, extent):
        last = f"least(cast(floor(({extent} - {size}) / {step}) as int), cast(floor({axis} / {step}) as int))"
        first = f"greatest(0, cast(ceil(({axis} - {size} + 1) / {step}) as int))"
        return F.expr(
            f"if({extent} >= {size} and {first} <= {last}, transform(sequence({first}, {last}), i -> i * {step}),"
            " cast(array() as array<int>))"
        )

    sized = with_shape(pixels, shape, keys)
    rows = sized.withColumn(TILE[0], F.explode(origins("y", "height")))
    tiled = rows.withColumn(TILE[1], F.explode(origins("x", "width")))
    return tiled.select(
        *keys,
        *[F.col(c).cast("int").alias(c) for c in TILE],
        "frame",
        (F.col("y") - F.col(TILE[0])).cast("int").alias("y"),
        (F.col("x") - F.col(TILE[1])).cast("int").alias("x"),
        "intensity",
    )


def tile_fill(tiled, keys=KEYS + TILE):
    """Fraction of present samples per tile."""
    return tiled.groupBy(*keys).agg(
        (F.count("intensity") / F.count(F.lit(1))).alias("valid_fraction")
    )


def valid_tiles(tiled, min_valid=0.5, keys=KEYS + TILE):
    """Samples of the tiles with at least ``min_valid`` of them present."""
    good = tile_fill(tiled, keys).where(F.col("valid_fraction") >= min_valid)
    return tiled.join(good.select(*keys), list(keys), "left_semi")


def paint_tiles(tile_results, shape, columns, size=32, step=16, keys=KEYS):
    """Pixel map from tile values; where tiles overlap the later one wins.

    Tiles count row by row.  The last tile over a pixel is the one with the
    largest origin on both axes, so each tile owns the pixels up to the next
    origin (the last tile owns the rest of the axis) and every pixel arises
    once, with no grouping.  Pixels that no tile covers are NULL.
    ``tile_results`` has one row for every tile of the grid, failed ones too.
    """
    size, step = check_tiles(size, step)

    def owned(origin, extent):
        is_last = F.col(origin) + step + size > F.col(extent)
        end = F.when(is_last, F.col(extent) - 1).otherwise(F.col(origin) + step - 1)
        return F.sequence(F.col(origin), end.cast("int"))

    sized = with_shape(tile_results, shape, keys)
    pixels = sized.withColumn("y", F.explode(owned(TILE[0], "height"))).withColumn(
        "x", F.explode(owned(TILE[1], "width"))
    )
    covered = (F.col("y") < F.col(TILE[0]) + size) & (F.col("x") < F.col(TILE[1]) + size)
    return pixels.select(*keys, "y", "x", *[F.when(covered, F.col(c)).alias(c) for c in columns])
