"""Tile moments and maps of rectangles against the forms that copy every sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfield.operators import geometry, layout, rectangles, stats, tiles
from lagfield.plans.local_map import local_diffusion_map
from lagfield.schema import FRAMES, KEYS, TILE
from tests.test_operators import frames_of

rng = np.random.default_rng(11)
RESULTS = "stack_id string, channel int, tile_y0 int, tile_x0 int, v double, w double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size,step", [(4, 2), (3, 5), (9, 1), (1, 1)])
def test_moments_are_those_of_the_copied_samples(spark, size, step):
    stack = rng.random((3, 9, 11)) + 1e6  # spread small against the mean
    holes = np.where(rng.random((4, 10, 9)) < 0.3, np.nan, rng.random((4, 10, 9)))
    df = frames_of(spark, a=stack, b=holes, tiny=np.ones((2, 2, 2)))
    tiled = tiles.assign_tiles(layout.to_pixels(df), layout.stack_shape(df), size, step)
    got = {tuple(r)[:4]: r for r in rectangles.tile_moments(df, size, step).collect()}
    fill = {tuple(r)[:4]: r.valid_fraction for r in tiles.tile_fill(tiled).collect()}
    spread = {tuple(r)[:4]: r.brightness for r in stats.brightness(tiled).collect()}
    mean = {tuple(r)[:4]: r.m for r in tiled.groupBy(*KEYS, *TILE).agg(F.avg("intensity").alias("m")).collect()}
    assert set(got) == set(fill) and got
    for key, row in got.items():
        assert row.valid_fraction == pytest.approx(fill[key])
        assert row.mean_intensity == (None if mean[key] is None else pytest.approx(mean[key], rel=1e-12))
        assert row.brightness == (None if spread[key] is None else pytest.approx(spread[key], abs=1e-7))


def test_moments_of_damaged_images(spark):
    rows = [
        ("a", 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0]),
        ("a", 0, 1, 2, 2, [1.0]),
        ("a", 0, 2, 2, 2, None),
        ("a", 0, 3, None, 2, [1.0]),
        (None, 0, 0, 2, 2, [1.0] * 4),
        ("e", 0, 0, 0, 0, []),
    ]
    (row,) = rectangles.tile_moments(spark.createDataFrame(rows, FRAMES), 2, 1).collect()
    assert (row.n_all, row.n_seen, row.mean_intensity, row.brightness) == (12, 4, 2.5, None)
    assert rectangles.tile_moments(spark.createDataFrame([], FRAMES), 2, 1).count() == 0


def grid_of(spark, h, w, size, step):
    rows = [
        (name, 0, y, x, *[None if rng.random() < 0.2 else float(rng.integers(0, 50)) for _ in "vw"])
        for name in "ab"
        for y in range(0, h - size + 1, step)
        for x in range(0, w - size + 1, step)
    ]
    return spark.createDataFrame(rows, RESULTS)


@pytest.mark.parametrize(
    "h,w,size,step", [(9, 11, 4, 2), (9, 11, 2, 3), (8, 8, 8, 4), (7, 6, 3, 1), (10, 9, 5, 5), (5, 7, 1, 1), (9, 9, 4, 4), (9, 8, 1, 3)]
)
def test_rectangles_are_the_painted_pixels(spark, h, w, size, step):
    results = grid_of(spark, h, w, size, step)
    columns = ["v", "w"]
    painted = tiles.paint_tiles(results, (h, w), columns, size, step)
    boxes = rectangles.tile_rectangles(results, (h, w), columns, size, step)
    assert painted.count() == 2 * h * w
    assert rows_of(rectangles.paint_rectangles(boxes, columns)) == rows_of(painted)
    smooth = rectangles.tile_rectangles(results, (h, w), columns, size, step, smooth=True)
    assert rows_of(rectangles.paint_rectangles(smooth, columns)) == rows_of(geometry.median_filter3(painted, columns))
    assert rows_of(rectangles.rectangle_range(smooth, "v")) == rows_of(stats.map_range(geometry.median_filter3(painted, columns), "v"))


def test_rectangles_of_nothing(spark):
    empty = spark.createDataFrame([], RESULTS)
    assert rectangles.tile_rectangles(empty, (4, 4), ["v"], 2, 2, smooth=True).count() == 0
    odd = spark.createDataFrame([("a", 0, None, 0, 1.0, 1.0)], RESULTS)
    assert rectangles.tile_rectangles(odd, (4, 4), ["v"], 2, 2, smooth=True).count() == 0


def test_pixels_of_a_local_map_are_made_last(spark):
    local = local_diffusion_map(frames_of(spark, a=rng.random((6, 12, 12)) + 5), size=4, step=4, shape=(12, 12), gapless=True)
    plan = local._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {word: [line.index(word) for line in plan if word in line] for word in ("Generate explode(sequence(y0", "Window")}
    assert depth["Window"] and depth["Generate explode(sequence(y0"]
    # a window below the explode of rows lies deeper in the printed tree
    assert min(depth["Window"]) > min(depth["Generate explode(sequence(y0"])
