"""Image series to correlation maps, for all series at once."""

from pyspark.sql import functions as F

from lagfield.operators.detrend import CHUNK_FRAMES, check_window, chunk_frames, chunk_residuals, with_chunks
from lagfield.operators.drift import chunk_aligner, first_regions
from lagfield.operators.geometry import crop_center
from lagfield.operators.layout import SeriesFacts, as_frames, number_frames, series_status, sound_frames
from lagfield.operators.reduce import REPLICATES, draw_weights, finish_sums, partial_sums
from lagfield.schema import KEYS
from lagfield.sources.chunks import read_chunks


#: Frames whose sums meet in one task, as a multiple of the sums it gives out.
SHRINK = 4


def _group(reps):
    """Chunks whose sums meet in one task."""
    together = F.ceil(F.lit(SHRINK * (reps + 1)) / F.col("_span"))
    return F.floor(F.col("chunk") / together).cast("int").alias("group")


def place_chunks(frames, facts, keys=KEYS, window=3, reps=0, chunk=None):
    """Images copied to the chunks that need them, with the group of each chunk; series of several sizes are left out.

    ``frames`` are sound and numbered by position, ``facts`` theirs.
    """
    on = [*keys, "group"]
    chunked = with_chunks(frames, window, chunk).select("*", _group(reps))
    low = int(chunk) if chunk is not None else CHUNK_FRAMES[0]
    numbers = F.sequence(F.lit(0), F.floor((F.col("last") + window // 2) / low).cast("int"))
    return chunked.join(facts.mixed().select(*keys, F.explode(numbers).alias("group")), on, "left_anti")


def work_chunks(chunked, frames, facts, keys=KEYS, window=3, drift=False, roi=None, reps=0, seed=0, placed=None):
    """Images of :func:`place_chunks` with their residual, drift-corrected and with bootstrap weights.

    ``frames`` are the same images without copies.  Weights and drift references join on the partitioning that the
    chunks have.  ``placed`` holds the window, replicates and chunk length the chunks were placed with, if they are not
    those of this call.
    """
    wide, group_reps, chunk = placed or (window, reps, None)
    half = wide // 2
    on = [*keys, "group"]
    group = _group(group_reps)
    spans = facts.select("last", "height", "width")
    if reps:
        weights = with_chunks(draw_weights(frames, keys, window, reps, seed, facts).join(spans, list(keys)), wide, chunk)
        # neighbours share frames, so a frame may come twice
        by_group = weights.select(*keys, group, F.struct("frame", "weights").alias("_of")).groupBy(*on).agg(
            F.map_from_entries(F.collect_set("_of")).alias("_by_frame")
        )
        chunked = chunked.join(by_group, on, "left").withColumn(
            "weights", F.element_at("_by_frame", F.col("frame"))
        ).drop("_by_frame")
    align = None
    if drift:
        span = chunk_frames() if chunk is None else F.lit(int(chunk))
        last = spans.select(*keys, F.floor((F.col("last") + half) / span).alias("chunk"), span.alias("_span")).select(*keys, group)
        groups = last.select(*keys, F.explode(F.sequence(F.lit(0), F.col("group"))).alias("group"))
        heads = first_regions(frames, keys, roi).select(*keys, "first_frame", F.col("head.roi").alias("reference"))
        chunked = chunked.join(heads.join(groups, list(keys)), on, "left")
        align = chunk_aligner(roi)
    return chunk_residuals(chunked, on, window, align)


def residual_chunks(frames, facts, keys=KEYS, window=3, drift=False, roi=None, reps=0, seed=0, chunk=None):
    """Images with their residual, drift-corrected and with bootstrap weights.

    The images are shuffled once, so that chunks of consecutive frames are
    together; as many chunks go to one task as it takes for the sums over them
    to be smaller than the images.
    """
    chunked = place_chunks(frames, facts, keys, window, reps, chunk)
    return work_chunks(chunked, frames, facts, keys, window, drift, roi, reps, seed, (window, reps, chunk))


def correlation_map(
    df,
    keys=KEYS,
    crop=1.0,
    window=3,
    drift=False,
    roi=None,
    bessel="reduced",
    reps=REPLICATES,
    seed=0,
    max_lag=None,
    chunk=None,
    gapless=None,
):
    """Correlation map with bootstrap uncertainty of every image series.

    Crop, optional drift correction, detrending, autocorrelation, mean over
    frames.  ``reps=0`` leaves the uncertainty out; ``max_lag`` (slow, fast)
    computes central lags only; ``chunk`` sets the frames of a task's unit of
    work and changes no value.  Frames go by their position in the series;
    ``gapless`` may say that no series has gaps in its frame numbers, which
    saves looking.  A series that gives no map has status rows with NULL ``g``:
    an image that is absent or does not fill its rectangle counts as one of
    missing samples; images without a complete key or size, series of several
    sizes and series without any sample have one row with the reason.

    Two shuffles carry data: the cropped images to chunks of frames, and the
    partial sums to their block of lags.
    """
    window = check_window(window)
    images = as_frames(df, keys)
    listed = None if "pixels" in df.columns else df.select(*keys, "frame").distinct()
    frames = crop_center(sound_frames(images.select(*keys, "frame", "height", "width", "pixels"), keys), crop)
    frames = number_frames(frames, keys, gapless, listed)
    facts = SeriesFacts(frames, keys)
    residuals = residual_chunks(frames, facts, keys, window, drift, roi, reps, seed, chunk)
    partials = partial_sums(residuals, keys, max_lag, reps)
    maps = finish_sums(partials, keys, bessel, window, reps)
    odd = series_status(images, keys, facts).withColumn("n_frames", F.lit(0).cast("long"))
    return maps.unionByName(odd, allowMissingColumns=True)


def stored_correlation_map(
    spark, table, window=3, drift=False, roi=None, bessel="reduced", reps=REPLICATES, seed=0, max_lag=None
):
    """:func:`correlation_map` of images that :func:`lagfield.sources.chunks.write_chunks` has stored.

    The images lie in the partitioning the job works on, so none is shuffled, however often maps are made of them.
    ``window`` may be at most the one they were stored for.
    """
    window = check_window(window)
    stored = read_chunks(spark, table)
    if window > stored.window:
        raise ValueError(f"{table} was stored for windows up to {stored.window}")
    facts = SeriesFacts(stored.frames, KEYS)
    placed = (stored.window, stored.reps, stored.chunk)
    residuals = work_chunks(stored.chunks, stored.frames, facts, KEYS, window, drift, roi, reps, seed, placed)
    maps = finish_sums(partial_sums(residuals, KEYS, max_lag, reps), KEYS, bessel, window, reps)
    odd = stored.status.withColumn("n_frames", F.lit(0).cast("long"))
    return maps.unionByName(odd, allowMissingColumns=True)
