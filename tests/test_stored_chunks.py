"""Correlation maps of stored chunks: the same as from images, without a shuffle of images."""

import re

import numpy as np
import pytest

from lagfield.plans.correlation_job import correlation_map, stored_correlation_map
from lagfield.plans.store import store_chunks
from lagfield.schema import FRAMES
from tests.test_operators import frames_of

rng = np.random.default_rng(31)


@pytest.fixture(scope="module")
def frames(spark):
    good = frames_of(spark, a=rng.random((13, 6, 8)) + 2, b=rng.random((9, 5, 4)) + 2, short=rng.random((2, 4, 4)))
    odd = [
        ("gaps", 0, n, 2, 2, [float(v) for v in rng.integers(1, 9, 4)]) for n in (1, 2, 5, 9, 10, 30)
    ] + [
        ("hurt", 0, 0, 2, 2, [1.0]), ("hurt", 0, 1, 2, 2, None), ("hurt", 0, 2, 2, 2, [1.0, 2.0, 3.0, 4.0]),
        ("mixed", 0, 0, 2, 2, [1.0] * 4), ("mixed", 0, 1, 1, 2, [1.0] * 2),
        (None, 0, 0, 2, 2, [1.0] * 4), ("bare", 0, 0, None, None, [1.0]), ("empty", 0, 0, 0, 0, []),
    ]
    return good.unionByName(spark.createDataFrame(odd, FRAMES))


@pytest.fixture(scope="module")
def table(spark, frames, tmp_path_factory):
    store_chunks(frames, "lagfield_chunks", window=5, reps=2, chunk=4, path=str(tmp_path_factory.mktemp("chunks")), buckets=4)
    yield "lagfield_chunks"
    spark.sql("DROP TABLE lagfield_chunks")
    spark.sql("DROP TABLE lagfield_chunks_status")


def rows_of(maps):
    out = {}
    for r in maps.collect():
        out[(r.stack_id, r.channel, r.dy, r.dx)] = (r.status, r.n_frames, r.g, r.asDict().get("g_sd"))
    return out


@pytest.mark.parametrize("window,reps,drift", [(1, 0, False), (3, 4, False), (5, 2, True)])
def test_stored_maps_equal_those_of_images(spark, frames, table, window, reps, drift):
    want = rows_of(correlation_map(frames, window=window, reps=reps, drift=drift, seed=3))
    got = rows_of(stored_correlation_map(spark, table, window=window, reps=reps, drift=drift, seed=3))
    assert got.keys() == want.keys() and {k[0] for k in got} >= {"a", "gaps", "mixed", "bare", "empty", None}
    for key, (status, n, g, sd) in want.items():
        assert got[key][:2] == (status, n), key
        for mine, other in zip(got[key][2:], (g, sd)):
            assert (mine is None) == (other is None) and (mine is None or mine == pytest.approx(other, abs=1e-10)), key


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_no_exchange_carries_images(spark, table, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        maps = stored_correlation_map(spark, table, window=3, reps=2)
        maps.collect()
        text = spark._jvm.PythonSQLUtils.explainString(maps._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
        assert moved and not any("pixels#" in columns for columns in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_windows_wider_than_stored(spark, table):
    with pytest.raises(ValueError):
        stored_correlation_map(spark, table, window=7)
