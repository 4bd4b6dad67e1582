"""Correlation from strips of images against the transform."""

import numpy as np
import pytest

from lagfield.operators import correlate, layout
from lagfield.schema import FRAMES
from tests.test_operators import direct, frames_of, image_of

rng = np.random.default_rng(23)


def values(df):
    return {(r.stack_id, r.channel, r.frame, r.dy, r.dx): r.g for r in df.collect()}


@pytest.mark.parametrize(
    "shape,rows,max_lag",
    [
        ((6, 8), 4, None),
        ((6, 8), 2, (2, 1)),
        ((7, 5), 1, None),
        ((7, 5), 4, (0, 2)),
        ((9, 4), 2, None),
        ((10, 3), 4, (5, 1)),
        ((1, 4), None, None),
        ((5, 1), 3, (1, 1)),
    ],
)
def test_strips_equal_the_transform(spark, shape, rows, max_lag):
    df = frames_of(spark, a=rng.integers(1, 9, (2, *shape)))
    want = values(correlate.autocorr(df, max_lag=max_lag))
    for source in (df, layout.to_pixels(df)):
        got = values(correlate.autocorr_strips(source, max_lag=max_lag, rows=rows))
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_strips_by_the_definition(spark):
    image = rng.integers(1, 9, (11, 6)).astype(float)
    got = correlate.autocorr_strips(layout.to_pixels(frames_of(spark, a=image[None])), rows=3)
    np.testing.assert_allclose(image_of(got, "g"), direct(image), atol=1e-12)


def test_strips_of_odd_images(spark):
    hole = np.ones((1, 4, 4))
    hole[0, 3, 3] = np.nan
    df = frames_of(spark, hole=hole, zero=np.zeros((1, 4, 4)))
    assert [set(values(correlate.autocorr_strips(s, rows=2)).values()) for s in (df, layout.to_pixels(df))] == [{None}] * 2
    rows = [("short", 0, 0, 2, 2, [1.0]), ("none", 0, 0, 2, 2, None), ("empty", 0, 0, 0, 0, []), (None, None, 0, 1, 2, [1.0, 3.0])]
    odd = values(correlate.autocorr_strips(spark.createDataFrame(rows, FRAMES)))
    assert odd == {(None, None, 0, 0, -1): pytest.approx(-0.25), (None, None, 0, 0, 0): pytest.approx(0.25)}
    ragged = layout.to_pixels(frames_of(spark, a=np.ones((1, 3, 3)))).where("y <> 1 OR x <> 1")
    assert correlate.autocorr_strips(ragged).count() == 0
    assert correlate.autocorr_strips(spark.createDataFrame([], FRAMES)).count() == 0


def test_no_row_holds_more_than_a_strip_and_its_reach(spark):
    px = layout.to_pixels(frames_of(spark, a=rng.random((1, 40, 6))))
    got = correlate.image_strips(px, rows=4, reach=3).selectExpr("size(part) AS n", "n_rows").collect()
    assert len(got) == 10 and {(r.n, r.n_rows) for r in got} == {(42, 4)}
