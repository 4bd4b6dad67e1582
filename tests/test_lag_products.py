"""Products of lags and the work space of transforms, without Spark."""

import numpy as np
import pytest

from lagfield.operators import correlate, kernels

rng = np.random.default_rng(11)


@pytest.mark.parametrize("shape", [(6, 8), (7, 5), (1, 4), (4, 1)])
def test_half_lags_name_every_pair_once(shape):
    height, width = shape
    a, b = correlate.half_lags(height, width)
    seen = [frozenset([(p, q), (-p % height, -q % width)]) for p, q in zip(a.tolist(), b.tolist())]
    assert len(set(seen)) == len(seen)
    assert set().union(*seen) == {(p, q) for p in range(height) for q in range(width)}


def test_products_of_strips():
    image = rng.integers(0, 9, (2, 6, 5)).astype(float)
    image[1, 4, 2] = np.nan
    a, b = correlate.half_lags(6, 5, (2, 1))
    # rows 1 and 2 of the image, and the two that lags reach from them
    total, got = kernels.lag_products(image[:, 1:5], 2, a, b)
    np.testing.assert_array_equal(total, image[:, 1:3].sum(axis=(1, 2)))
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
        want = (image[:, 1:3] * np.roll(image, -q, axis=2)[:, 1 + p : 3 + p]).sum(axis=(1, 2))
        np.testing.assert_array_equal(got[:, k], want)


def test_work_space_does_not_depend_on_a_batch(monkeypatch):
    monkeypatch.setattr(kernels, "FFT_SAMPLES", 1000)
    rows = np.arange(10_000)
    runs = correlate.sliced(rows, 256)
    assert np.concatenate(runs).tolist() == rows.tolist()
    assert max(map(len, runs)) * 256 <= 1000
    assert [len(r) for r in correlate.sliced(rows[:3], 5000)] == [1, 1, 1]
