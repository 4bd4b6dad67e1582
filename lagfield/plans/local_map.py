"""Local maps of diffusion, amplitude and brightness from overlapping tiles."""

from pyspark.sql import functions as F

from lagfield.functions.physics import particle_number
from lagfield.operators.detrend import check_window
from lagfield.operators.fit import fit_maps
from lagfield.operators.geometry import blank_zero_lag, crop_center, fast_axis, with_distance
from lagfield.operators.lags import attach_acq, fit_maps_eval, with_acq, with_lag_geometry
from lagfield.operators.layout import SeriesFacts, as_frames, named, number_frames, series_status, sound_frames, stack_shape
from lagfield.operators.rectangles import paint_rectangles, tile_rectangles
from lagfield.operators.reduce import finish_sums, partial_sums
from lagfield.operators.tiles import check_tiles
from lagfield.plans.correlation_job import residual_chunks
from lagfield.schema import KEYS, TILE

MAP_COLUMNS = ("d", "amp", "brightness")


def tile_maps(df, size=32, step=16, keys=KEYS, crop=1.0, window=3, gapless=None):
    """Correlation map of every tile, with the tile's sample counts and moments.

    The sliding mean of a sample does not depend on the tile, so it is taken on
    whole images; tiles are cut afterwards, in the task that correlates them.
    Damaged images count as missing samples; series without a complete key,
    without a size or of several sizes have no tiles (see
    :func:`lagfield.operators.layout.series_status`).
    """
    size, step = check_tiles(size, step)
    window = check_window(window)
    images = as_frames(df, keys)
    listed = None if "pixels" in df.columns else df.select(*keys, "frame").distinct()
    frames = crop_center(sound_frames(images.select(*keys, "frame", "height", "width", "pixels"), keys), crop)
    frames = number_frames(frames, keys, gapless, listed)
    residuals = residual_chunks(frames, SeriesFacts(frames, keys), keys, window)
    partials = partial_sums(residuals, keys, tile=(size, step))
    return finish_sums(partials, [*keys, *TILE], "original", window)


def with_geometry(maps, acq=None, defaults=None):
    return with_lag_geometry(with_acq(maps, defaults) if acq is None else attach_acq(maps, acq, defaults))


def tile_fits(maps, model="2D", keys=KEYS, min_valid=0.5, **psf):
    """Fit of every tile, its brightness and whether it can be used.

    ``maps`` comes from :func:`tile_maps` with lag geometry.  A tile with too
    few present samples, no map or no fit keeps a row with its status.
    """
    tile_keys = [*keys, *TILE]
    fits = fit_maps(maps, model, tile_keys, carry=("n_all", "n_seen", "v_sum", "v_sq"), **psf)
    mean = F.col("v_sum") / F.col("n_all")
    spread = F.sqrt(F.greatest(F.col("v_sq") / F.col("n_all") - mean * mean, F.lit(0.0)))
    enough = F.col("n_seen") >= F.col("n_all") * float(min_valid)
    ok = enough & (F.col("status") == "ok")
    return fits.select(
        *tile_keys,
        F.when(ok, F.col("diff_coeff")).alias("d"),
        F.when(ok, F.col("amplitude")).alias("amp"),
        F.when(ok, F.col("offset")).alias("offset"),
        F.when(enough & (F.col("n_seen") == F.col("n_all")), spread).alias("brightness"),
        F.when(ok, particle_number(model, F.col("amplitude"))).alias("particle_number"),
        F.when(ok, F.col("cost")).alias("cost"),
        F.when(~enough, "too_few_pixels").otherwise(F.col("status")).alias("status"),
    )


def local_diffusion_map(
    df,
    acq=None,
    size=32,
    step=16,
    model="2D",
    min_valid=0.5,
    keys=KEYS,
    crop=1.0,
    window=3,
    shape=None,
    smooth=True,
    defaults=None,
    gapless=None,
    columns=MAP_COLUMNS,
    **psf,
):
    """Pixel maps of every image series: ``columns`` of :func:`tile_fits`, by default ``d``, ``amp`` and ``brightness``.

    Tiles are correlated and fitted, painted back (later tiles win) and passed
    through a 3 x 3 median, which is taken of tiles: pixels are the last thing
    made and are not shuffled.  ``amp`` is the fitted amplitude.  ``status`` is
    ``ok`` for pixels; a series that has none because of its keys or sizes has
    one row that names the reason.
    """
    images = as_frames(df, keys)
    frames = crop_center(images, crop)
    maps = with_geometry(tile_maps(frames, size, step, keys, 1.0, window, gapless), acq, defaults)
    fits = tile_fits(maps, model, keys, min_valid, **psf)
    odd = series_status(images, keys).drop("height", "width")
    known = frames.where(named(keys))
    shape = shape or stack_shape(known, keys)
    whole = paint_rectangles(tile_rectangles(fits, shape, columns, size, step, keys, smooth), columns, keys)
    # an image smaller than a tile has a map too, without values
    sizes = stack_shape(known, keys) if isinstance(shape, tuple) else shape
    small = sizes.where(F.least("height", "width") < size).where("height > 0 AND width > 0")
    pixels = small.select(*keys, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select(
        *keys, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    )
    ok = F.lit("ok").alias("status")
    small_maps = pixels.join(odd, list(keys), "left_anti").select("*", ok)
    return whole.select("*", ok).unionByName(small_maps, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True)


def local_fast_axis(maps, fits, model="2D", keys=KEYS, **psf):
    """Data and model along the fast axis of every fitted tile.

    ``maps`` and ``fits`` as for and from :func:`tile_fits`.
    """
    tile_keys = [*keys, *TILE]
    renamed = fits.where(F.col("status") == "ok").select(
        *tile_keys, F.col("amp").alias("amplitude"), F.col("d").alias("diff_coeff"), "offset"
    )
    row = fast_axis(maps).withColumn("pixel_um", F.col("pixel_size_nm") * 1e-3)
    curves = fit_maps_eval(row, renamed, model, tile_keys, carry=("pixel_um",), **psf)
    blanked = blank_zero_lag(with_distance(curves, "pixel_um"))
    return blanked.select(*tile_keys, "dx", "distance_um", "g", "model_g")
