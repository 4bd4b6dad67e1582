"""Inputs that are not tidy: gaps in frame numbers, damaged images, small images, small amplitudes, several models."""

import random

import pytest
from pyspark.sql import functions as F

from lagfield import correlation_map, local_diffusion_map
from lagfield.operators.detrend import detrend_frames
from lagfield.operators.fit import fit_maps
from lagfield.plans.local_map import with_geometry
from lagfield.sources.results import read_fits, write_fits

SCHEMA = "stack_id string, channel int, frame int, height int, width int, pixels array<double>"


def series(spark, name, numbers, height=3, width=4, seed=1, damage=None):
    rng = random.Random(seed)
    rows = []
    for i, frame in enumerate(numbers):
        pixels = [float(rng.randrange(1, 50)) for _ in range(height * width)]
        rows.append((name, 0, frame, height, width, (damage or {}).get(i, pixels)))
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return sorted(
        (r.dy, r.dx, None if r.g is None else round(r.g, 9), None if r.g_sd is None else round(r.g_sd, 9), r.n_frames, r.status)
        for r in df.collect()
    )


@pytest.mark.parametrize("gaps", [[0, 1, 2, 3, 5, 6, 7, 20, 21, 22, 23, 40], [100 + 3 * i for i in range(12)]])
def test_gaps_change_nothing(spark, gaps):
    want = values(correlation_map(series(spark, "a", range(12)), seed=3))
    for chunk in (None, 2, 5, 100):
        assert values(correlation_map(series(spark, "a", gaps), seed=3, chunk=chunk)) == want
    frames = [r.frame for r in detrend_frames(series(spark, "a", gaps), chunk=3).orderBy("frame").collect()]
    assert frames == gaps[1:-1]


def test_damaged_images_are_left_out(spark):
    short = {4: [1.0, 2.0], 5: None, 6: [1.0] * 40}
    both = series(spark, "bad", range(14), damage=short).union(series(spark, "good", range(14)))
    rows = correlation_map(both, reps=2).collect()
    assert {r.status for r in rows if r.stack_id == "good"} == {"ok"}
    bad = [r for r in rows if r.stack_id == "bad"]
    assert {r.status for r in bad} == {"frames_skipped"} and {r.n_frames for r in bad} == {7}


def test_series_without_samples_has_a_row(spark):
    both = series(spark, "tiny", range(5), 2, 2).union(series(spark, "good", range(5), 8, 8))
    rows = correlation_map(both, crop=0.3, reps=0).collect()
    assert [(r.status, r.g, r.n_frames) for r in rows if r.stack_id == "tiny"] == [("empty_image", None, 0)]
    assert {r.status for r in rows if r.stack_id == "good"} == {"ok"}


def test_image_smaller_than_a_tile(spark):
    both = series(spark, "tiny", range(5), 2, 3).union(series(spark, "good", range(5), 8, 8))
    rows = local_diffusion_map(both, size=4, step=2).collect()
    tiny = [r for r in rows if r.stack_id == "tiny"]
    assert sorted((r.y, r.x) for r in tiny) == [(y, x) for y in range(2) for x in range(3)]
    assert all(r.d is None and r.amp is None and r.brightness is None for r in tiny)
    assert len(rows) == 6 + 64


def scaled_fits(spark, scale):
    from lagfield.functions.physics import shape_text

    lags = spark.createDataFrame([("m", 0, y, x) for y in range(-6, 6) for x in range(-6, 6)], "stack_id string, channel int, dy int, dx int")
    placed = with_geometry(lags, None)
    ripple = "0.002 * (pmod(7 * dy + 3 * dx, 5) - 2)"
    g = F.expr(f"(0.4 * ({shape_text('2D', '2.0D')}) + {ripple}) * {scale}D")
    return fit_maps(placed.withColumn("g", g)).collect()[0]


def test_scale_of_the_map_does_not_change_the_fit(spark):
    want = scaled_fits(spark, "1").diff_coeff
    for scale in ("1e-3", "1e-6", "1e-9", "1e6"):
        got = scaled_fits(spark, scale)
        assert got.status == "ok" and abs(got.diff_coeff - want) < 1e-6 * want
        assert abs(got.amplitude / float(scale) - 0.4) < 0.02


def test_overwriting_a_model_leaves_others(spark, tmp_path):
    path = str(tmp_path / "fits")
    schema = "stack_id string, diff_coeff double, model string"
    for model, value in (("2D", 1.0), ("3D", 2.0), ("2D", 3.0)):
        write_fits(spark.createDataFrame([("a", value, model)], schema), path, "overwrite")
    assert sorted((r.model, r.diff_coeff) for r in read_fits(spark, path, schema).collect()) == [("2D", 3.0), ("3D", 2.0)]
