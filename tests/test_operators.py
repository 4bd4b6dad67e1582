"""Closed forms, properties and hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfield.operators import correlate, detrend, drift, fit, geometry, kernels, lags, layout, reduce, tiles
from lagfield.plans.correlation_job import correlation_map
from lagfield.plans.fit_job import fit_job
from lagfield.plans.local_map import local_diffusion_map
from lagfield.schema import FRAMES, KEYS
from lagfield.sources import listing, metadata, results, stacks

rng = np.random.default_rng(5)


def frames_of(spark, **stacks_):
    """Frames table from name=(T, H, W) arrays; NaN becomes NULL."""
    rows = []
    for name, stack in stacks_.items():
        for t, image in enumerate(np.asarray(stack, dtype=float)):
            values = [None if np.isnan(v) else float(v) for v in image.ravel()]
            rows.append((name, 0, t, image.shape[0], image.shape[1], values))
    return spark.createDataFrame(rows, FRAMES)


def image_of(df, value, y="dy", x="dx"):
    pdf = df.select(y, x, value).toPandas()
    return pdf.pivot(index=y, columns=x, values=value).to_numpy(dtype=float)


def direct(image):
    """Autocorrelation by the definition, zero lag centred."""
    h, w = image.shape
    out = np.empty((h, w))
    for i, dy in enumerate(range(-(h // 2), (h - 1) // 2 + 1)):
        for j, dx in enumerate(range(-(w // 2), (w - 1) // 2 + 1)):
            out[i, j] = (image * np.roll(image, (-dy, -dx), (0, 1))).sum() / (h * w * image.mean() ** 2) - 1
    return out


def by_hand(stack, window, bessel="reduced"):
    half = window // 2
    maps = []
    for t in range(half, len(stack) - half):
        near = stack[t - half : t + half + 1].mean(axis=0)
        maps.append(direct(stack[t] - near + stack[t].mean()))
    n = len(maps) if bessel == "reduced" else len(stack)
    return np.mean(maps, axis=0) * n / (n - 1)


@pytest.mark.parametrize("shape", [(6, 8), (7, 5), (1, 4)])
@pytest.mark.parametrize("method", ["fft", "lags"])
def test_autocorr_is_the_lag_sum(spark, shape, method):
    image = rng.integers(1, 9, shape).astype(float)
    got = correlate.autocorr(frames_of(spark, a=image[None]), method=method)
    assert got.count() == image.size
    np.testing.assert_allclose(image_of(got, "g"), direct(image), atol=1e-12)


def test_autocorr_closed_forms(spark):
    spot = np.zeros((4, 4))
    spot[1, 2] = 16.0
    stripes = np.tile([0.0, 2.0], (4, 2))
    got = correlate.autocorr(frames_of(spark, flat=np.full((1, 4, 4), 3.0), spot=spot[None], stripes=stripes[None], zero=np.zeros((1, 4, 4))))
    rows = {(r.stack_id, r.dy, r.dx): r.g for r in got.collect()}
    assert all(abs(rows["flat", dy, dx]) < 1e-12 for dy in range(-2, 2) for dx in range(-2, 2))
    assert rows["spot", 0, 0] == pytest.approx(15.0) and rows["spot", 1, 1] == pytest.approx(-1.0)
    assert rows["stripes", 1, 2 - 4] == pytest.approx(1.0) and rows["stripes", 0, 1] == pytest.approx(-1.0)
    assert rows["zero", 0, 0] is None


def test_max_lag_only_crops(spark):
    image = rng.integers(1, 9, (1, 7, 8)).astype(float)
    df = frames_of(spark, a=image)
    full = correlate.autocorr(df).where("abs(dy) <= 2 and abs(dx) <= 1")
    for method in ("fft", "lags"):
        part = correlate.autocorr(df, max_lag=(2, 1), method=method)
        np.testing.assert_allclose(image_of(part, "g"), image_of(full, "g"), atol=1e-12)


@pytest.mark.parametrize("window", [1, 3, 5])
def test_detrend_layouts_agree_across_chunks(spark, monkeypatch, window):
    monkeypatch.setattr(detrend, "CHUNK_FRAMES", (2, 3))
    stack = rng.integers(0, 50, (11, 3, 4)).astype(float)
    df = frames_of(spark, a=stack)
    order = ["stack_id", "frame", "y", "x"]
    long = detrend.detrend(layout.to_pixels(df), window=window).orderBy(*order).toPandas()
    array = layout.to_pixels(detrend.detrend_frames(df, window=window)).orderBy(*order).toPandas()
    assert sorted(set(long.frame)) == list(range(window // 2, 11 - window // 2))
    np.testing.assert_allclose(long.intensity, array.intensity, atol=1e-12)


def test_detrend_window_must_be_odd(spark):
    with pytest.raises(ValueError):
        detrend.detrend(layout.to_pixels(frames_of(spark, a=np.ones((3, 2, 2)))), window=2)


@pytest.mark.parametrize("bessel", ["reduced", "original"])
def test_correlation_map_by_hand_across_chunks(spark, monkeypatch, bessel):
    monkeypatch.setattr(detrend, "CHUNK_FRAMES", (2, 3))
    monkeypatch.setattr(reduce, "FLUSH_DOUBLES", 1)
    stack = rng.integers(1, 50, (10, 5, 6)).astype(float)
    other = rng.integers(1, 50, (4, 4, 4)).astype(float)
    got = correlation_map(frames_of(spark, a=stack, b=other), bessel=bessel, reps=0)
    np.testing.assert_allclose(image_of(got.where("stack_id = 'a'"), "g"), by_hand(stack, 3, bessel), atol=1e-10)
    np.testing.assert_allclose(image_of(got.where("stack_id = 'b'"), "g"), by_hand(other, 3, bessel), atol=1e-10)


def test_job_equals_operators_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(detrend, "CHUNK_FRAMES", (2, 4))
    df = frames_of(spark, a=rng.integers(1, 50, (12, 4, 4)).astype(float))
    job = correlation_map(df, seed=3)
    corr = correlate.autocorr(detrend.detrend_frames(df))
    sd = reduce.bootstrap_sd(corr, seed=3)
    np.testing.assert_allclose(image_of(job, "g_sd"), image_of(sd, "g_sd"), atol=1e-12)
    again = correlation_map(df.orderBy(F.desc("frame")), seed=3)
    np.testing.assert_allclose(image_of(again, "g_sd"), image_of(job, "g_sd"), atol=1e-12)
    assert np.abs(image_of(correlation_map(df, seed=4), "g_sd") - image_of(job, "g_sd")).max() > 1e-6


def test_statuses_instead_of_failures(spark):
    hole = np.ones((5, 2, 2)) + rng.random((5, 2, 2))
    hole[2, 0, 0] = np.nan
    df = frames_of(
        spark, short=np.ones((2, 2, 2)), three=rng.random((3, 2, 2)), dark=np.zeros((5, 2, 2)), hole=hole, fine=rng.random((6, 2, 2)) + 1
    )
    got = {r.stack_id: r.status for r in correlation_map(df, reps=0).where("dy = 0 and dx = 0").collect()}
    assert got == {"short": "too_few_frames", "three": "too_few_frames", "dark": "zero_mean", "hole": "missing_pixels", "fine": "ok"}


def test_crop_formulas(spark):
    image = np.arange(37 * 5, dtype=float).reshape(1, 37, 5)
    got = geometry.crop_center(frames_of(spark, a=image), 0.3).collect()[0]
    assert (got.height, got.width) == (11, 1)
    assert got.pixels == list(image[0, 13:24, 2])
    lag = spark.range(37).selectExpr("'a' stack_id", "0 channel", "cast(id - 18 as int) dy", "0 dx", "1D g")
    kept = [r.dy + 18 for r in geometry.crop_lags(lag, 1.0, 0.3).collect()]
    assert sorted(kept) == list(range(12, 24))


def shifted_blob():
    y, x = np.mgrid[:32, :32]
    blob = np.round(100 * np.exp(-((y - 16) ** 2 + (x - 16) ** 2) / 8.0))
    shifts = [((k % 3) - 1 + 1, (2 * k) % 5 - 2 + 2) for k in range(6)]
    return np.stack([np.roll(blob, s, (0, 1)) for s in shifts]), shifts


def test_drift_finds_known_shifts(spark, monkeypatch):
    monkeypatch.setattr(detrend, "CHUNK_FRAMES", (2, 2))
    stack, shifts = shifted_blob()
    df = frames_of(spark, a=stack)
    found = {r.frame: (r.dy, r.dx) for r in drift.estimate_drift(df).collect()}
    assert found == {k: (-s[0], -s[1]) for k, s in enumerate(shifts)}
    fixed = {r.frame: r.pixels for r in drift.drift_correct(df).collect()}
    assert all(fixed[k] == fixed[0] for k in range(6))
    long = drift.apply_drift(layout.to_pixels(df), drift.estimate_drift(df))
    assert long.groupBy("y", "x").agg(F.countDistinct("intensity").alias("n")).where("n > 1").count() == 0
    windowed = drift.estimate_drift(df, roi=(8, 24, 6, 26)).where("dy is null").count()
    assert windowed == 0


def test_drift_inside_the_job(spark, monkeypatch):
    monkeypatch.setattr(detrend, "CHUNK_FRAMES", (2, 2))
    stack = rng.integers(1, 30, (6, 12, 12)).astype(float)
    df = frames_of(spark, a=stack)
    job = correlation_map(df, drift=True, reps=0)
    steps = correlation_map(drift.drift_correct(df), reps=0)
    np.testing.assert_allclose(image_of(job, "g"), image_of(steps, "g"), atol=1e-12)


def test_smoothing_mirrors_at_half_samples():
    line = np.zeros((1, 5))
    line[0, 0] = 1.0
    taps = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    taps /= taps.sum()
    want = np.zeros(5)
    for p in range(5):
        for k, w in zip(range(-8, 9), taps):
            m = (p + k) % 10
            want[p] += w * line[0, m if m < 5 else 9 - m]
    np.testing.assert_allclose(kernels.smooth(line, 2.0)[0], want, atol=1e-15)


def model_maps(spark, model, truth, half=8):
    rows = spark.createDataFrame([(str(i), 0, *t) for i, t in enumerate(truth)], "stack_id string, channel int, d double, a double, o double")
    span = F.sequence(F.lit(-half), F.lit(half - 1))
    placed = rows.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    placed = lags.with_lag_geometry(lags.with_acq(placed))
    from lagfield.functions.physics import model_value

    return placed.withColumn("g", model_value("2D" if model == "1D" else model, "a", "d", "o"))


@pytest.mark.parametrize("model", ["2D", "3D", "1D"])
def test_fit_recovers_parameters(spark, model):
    truth = [(0.5, 0.4, 0.0), (2.37, 0.8, 0.01), (17.0, 0.2, -0.005)]
    got = fit.fit_maps(model_maps(spark, model, truth), model).orderBy("stack_id").collect()
    for row, (d, a, o) in zip(got, truth):
        assert row.status == "ok"
        assert row.diff_coeff == pytest.approx(d, rel=2e-4)
        assert row.amplitude == pytest.approx(a, rel=1e-3)
        assert row.offset == pytest.approx(o, abs=1e-4)
        assert row.particle_number == pytest.approx((0.35 if model == "3D" else 0.5) / row.amplitude)


def test_fit_cost_matches_direct_evaluation(spark):
    maps = model_maps(spark, "2D", [(0.7, 0.3, 0.002)]).withColumn("g", F.col("g") + F.sin(F.col("dy") * 3 + F.col("dx")) * 0.01)
    fits = fit.fit_maps(maps).collect()[0]
    direct_ = lags.fit_cost(lags.fit_maps_eval(maps, fit.fit_maps(maps), "2D")).collect()[0]
    assert fits.cost == pytest.approx(direct_.cost, rel=1e-8)
    assert fits.residual_mean == pytest.approx(direct_.residual_mean, abs=1e-12)


def test_fit_box_is_the_true_minimum(spark):
    """Box-constrained solution against a fine scan of amplitude and offset."""
    maps = model_maps(spark, "2D", [(1.0, 0.5, 0.0)]).withColumn("g", 0.3 - F.col("g") * 0.5)
    row = fit.fit_maps(maps).collect()[0]
    pdf = maps.where("not (dy = 0 and dx = 0)").select("g", "s_lag", "t_lag").toPandas()
    top = max(pdf.g.max(), 0.0)
    spread = 4 * row.diff_coeff * pdf.t_lag + 0.04
    f = (0.04 / spread * np.exp(-pdf.s_lag / spread)).to_numpy()
    a, o = np.meshgrid(np.linspace(0, 1.5 * top, 301), np.linspace(-top / 10, top / 10, 201))
    cost = ((a[..., None] * f + o[..., None] - pdf.g.to_numpy()) ** 2).sum(axis=-1)
    assert row.cost <= cost.min() + 1e-9


def test_fit_statuses(spark):
    base = model_maps(spark, "2D", [(1.0, 0.5, 0.0)] * 4)
    maps = base.withColumn(
        "g",
        F.when(F.col("stack_id") == "1", -1.0).when((F.col("stack_id") == "2") & (F.col("dy") == 1), F.lit(None)).otherwise(F.col("g")),
    ).withColumn("t_lag", F.when(F.col("stack_id") != "3", F.col("t_lag")))
    got = {r.stack_id: (r.status, r.diff_coeff is None) for r in fit.fit_maps(maps).collect()}
    assert got == {"0": ("ok", False), "1": ("degenerate", True), "2": ("missing_map", True), "3": ("no_acquisition", True)}
    single = base.where("dy = 0 and dx = 0 and stack_id = '0'")
    assert fit.fit_maps(single).collect()[0].status == "degenerate"


def test_fit_keeps_maps_with_null_keys(spark):
    base = model_maps(spark, "2D", [(1.0, 0.5, 0.0), (2.0, 0.5, 0.0), (4.0, 0.5, 0.0)])
    maps = base.withColumn("channel", F.when(F.col("stack_id") == "1", F.lit(None)).otherwise(F.lit(0)).cast("int"))
    maps = maps.withColumn("stack_id", F.when(F.col("stack_id") != "2", F.col("stack_id")))
    got = {(r.stack_id, r.channel): r for r in fit.fit_maps(maps).collect()}
    assert {k: r.status for k, r in got.items()} == dict.fromkeys([("0", 0), ("1", None), (None, 0)], "ok")
    assert [round(got[k].diff_coeff, 2) for k in (("0", 0), ("1", None), (None, 0))] == [1.0, 2.0, 4.0]
    assert len({r.n_lags for r in got.values()}) == 1


def test_fit_shuffles_map_rows_once(spark):
    maps = model_maps(spark, "2D", [(1.0, 0.5, 0.0)]).withColumn("channel", F.length("stack_id"))
    fits = fit.fit_maps(maps)
    fits.collect()
    plan = fits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("- Exchange") == 1 and "ReusedExchange" not in plan


@pytest.mark.parametrize("size,step", [(4, 2), (3, 2), (2, 3), (5, 5)])
def test_tiles_and_paint(spark, size, step):
    h, w = 9, 11
    px = layout.to_pixels(frames_of(spark, a=np.arange(h * w, dtype=float).reshape(1, h, w)))
    tiled = tiles.assign_tiles(px, (h, w), size, step)
    want = np.full((h, w), np.nan)
    rows = []
    for iy in range((h - size) // step + 1):
        for ix in range((w - size) // step + 1):
            value = float(iy * 100 + ix)
            rows.append(("a", 0, iy * step, ix * step, value))
            want[iy * step : iy * step + size, ix * step : ix * step + size] = value
    assert tiled.count() == len(rows) * size * size
    results_ = spark.createDataFrame(rows, "stack_id string, channel int, tile_y0 int, tile_x0 int, v double")
    painted = tiles.paint_tiles(results_, (h, w), ["v"], size, step)
    np.testing.assert_array_equal(image_of(painted, "v", "y", "x"), want)


def test_median_filter(spark):
    grid = rng.random((5, 6))
    grid[1, 1] = np.nan
    rows = [("a", 0, y, x, None if np.isnan(grid[y, x]) else float(grid[y, x])) for y in range(5) for x in range(6)]
    df = spark.createDataFrame(rows, "stack_id string, channel int, y int, x int, v double")
    got = image_of(geometry.median_filter3(df, ["v"]), "v", "y", "x")
    padded = np.pad(grid, 1, mode="symmetric")
    want = np.array([[np.nanmedian(padded[y : y + 3, x : x + 3]) if not np.isnan(grid[y, x]) else np.nan for x in range(6)] for y in range(5)])
    np.testing.assert_allclose(got, want)


def test_local_map_skips_bad_tiles(spark):
    stack = rng.integers(5, 60, (8, 12, 12)).astype(float)
    stack[:, :4, :4] = np.nan
    df = frames_of(spark, a=stack)
    got = local_diffusion_map(df, size=4, step=4, shape=(12, 12), smooth=False)
    d, bright = image_of(got, "d", "y", "x"), image_of(got, "brightness", "y", "x")
    assert np.isnan(d[:4, :4]).all() and np.isnan(bright[:4, :4]).all()
    assert bright[4:8, 4:8] == pytest.approx(stack[:, 4:8, 4:8].std())


def test_metadata_forms(spark):
    docs = [
        ("list", 256, '{"Scaling":{"Items":{"Distance":[{"Value":2e-8}]}},"Information":{"Image":{"Dimensions":{"Channels":{"Channel":[{"LaserScanInfo":{"PixelTime":"5e-5"}},{"LaserScanInfo":{"PixelTime":1e-5}}]}}}}}'),
        ("single", 100, '{"Scaling":{"Items":{"Distance":[{"Value":"4e-8"}]}},"Information":{"Image":{"Dimensions":{"Channels":{"Channel":{"LaserScanInfo":{"PixelTime":2e-5}}}}}}}'),
        ("none", 10, None),
    ]
    meta = spark.createDataFrame(docs, "stack_id string, width int, metadata string")
    got = {r.stack_id: r for r in metadata.extract_acq(meta, channel=1).collect()}
    assert got["list"].pixel_dwell_us == pytest.approx(10) and got["list"].line_time_ms == pytest.approx(2.56)
    assert got["single"].pixel_size_nm == pytest.approx(40) and got["single"].pixel_dwell_us == pytest.approx(20)
    assert got["none"].pixel_size_nm is None


def test_list_inputs(spark, tmp_path):
    for name in ("a_RICScorr.tif", "b_ricsCORR.TIF", "c.tif", "d_RICScorr.czi", "e_RICScorr.tif.bak"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f_RICScorr.tif").write_bytes(b"x")
    got = listing.list_inputs(spark, str(tmp_path), ".tif", "RICScorr")
    assert sorted(r.stem for r in got.collect()) == ["a_RICScorr", "b_ricsCORR"]
    assert listing.list_inputs(spark, str(tmp_path), ".TIF").count() == 3


def test_frames_and_results_at_rest(spark, tmp_path):
    df = frames_of(spark, a=rng.random((4, 4, 4)) + 1, b=rng.random((4, 4, 4)) + 1)
    stacks.write_frames(df, str(tmp_path / "frames"))
    scan = stacks.scan_stack(spark, str(tmp_path / "frames"), 0, frames=(1, 2))
    assert scan.count() == 4
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "PushedFilters: [IsNotNull(frame)" in plan
    maps = correlation_map(df)
    results.write_maps(maps, str(tmp_path / "maps"))
    back = results.read_maps(spark, str(tmp_path / "maps"))
    assert back.exceptAll(maps.select(*back.columns)).count() == 0
    fits = fit_job(back, crop_fast=1.0, crop_slow=1.0)
    results.write_fits(fits, str(tmp_path / "fits"), "overwrite")
    results.write_fits(fits, str(tmp_path / "fits"), "append")
    assert results.read_fits(spark, str(tmp_path / "fits"), fits.schema).count() == 4
    assert results.fit_table(fits).columns == ["filepath", "Particle Number", "Diffusion Coefficient", "residual"]


def test_array_roundtrip_and_ragged(spark):
    px = layout.to_pixels(frames_of(spark, a=rng.random((2, 3, 4))))
    assert layout.to_pixels(layout.to_frames(px)).exceptAll(px).count() == 0
    broken = px.where("not (frame = 1 and y = 1 and x = 1)")
    got = {r.frame: r.pixels is None for r in layout.to_frames(broken).collect()}
    assert got == {0: False, 1: True}


def test_a_series_of_many_parts(spark):
    """Several groups of chunks of one series, each with sums of its own in tasks of their own."""
    stack = rng.random((70, 5, 6)) + 1
    df = frames_of(spark, a=stack)
    whole = {(r.dy, r.dx): (r.g, r.g_sd, r.n_frames) for r in correlation_map(df, reps=3, chunk=128).collect()}
    # small partitions would be merged, and the parts with them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = correlation_map(df, reps=3, chunk=2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = by_hand(stack, 3)
    for r in parts:
        g, sd, n = whole[r.dy, r.dx]
        assert (r.g, r.g_sd, r.n_frames) == (pytest.approx(g, abs=1e-12), pytest.approx(sd, abs=1e-12), n)
        assert r.g == pytest.approx(want[r.dy + 2, r.dx + 3], abs=1e-12)
