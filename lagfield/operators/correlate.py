"""Circular spatial autocorrelation of every image."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from lagfield.operators import kernels
from lagfield.operators.layout import as_frames
from lagfield.schema import KEYS, types_of

#: Samples of a strip of an image, without the rows its lags reach.
STRIP_SAMPLES = 1 << 16


def by_shape(batch):
    """Rows of an Arrow batch with pixels, grouped by image size."""
    height = batch["height"].to_numpy(zero_copy_only=False)
    width = batch["width"].to_numpy(zero_copy_only=False)
    present = np.asarray(batch["pixels"].is_valid())
    for h, w in sorted(set(zip(height.tolist(), width.tolist()))):
        if h and w:
            rows = np.flatnonzero((height == h) & (width == w) & present)
            if len(rows):
                yield h, w, rows


def sliced(rows, samples):
    """Numbers of rows in runs of about ``kernels.FFT_SAMPLES`` samples, so that work space does not depend on a batch."""
    step = max(1, kernels.FFT_SAMPLES // max(1, samples))
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def autocorr_frames(frames, keys=KEYS, max_lag=None):
    """Correlation of every image as an array of lags, by Fourier transform.

    Works row by row on the array layout, so it needs no shuffle.  ``max_lag``
    (slow, fast) keeps only the central lags; each lag is independent, so this
    changes no value.
    """
    schema = T.StructType(
        types_of(frames, [*keys, "frame"])
        + [T.StructField(c, T.IntegerType()) for c in ("dy0", "dx0", "n_dx")]
        + [T.StructField("g", T.ArrayType(T.DoubleType()))]
    )

    def correlate(batches):
        for batch in batches:
            for h, w, rows in ((h, w, some) for h, w, rows in by_shape(batch) for some in sliced(rows, h * w)):
                part = batch.take(pa.array(rows))
                images = kernels.to_matrix(part["pixels"]).reshape(-1, h, w)
                g = kernels.crop_lag_axes(kernels.circular_autocorr(images), max_lag)
                dy0, _ = kernels.lag_bounds(h, max_lag and max_lag[0])
                dx0, n_dx = kernels.lag_bounds(w, max_lag and max_lag[1])
                fixed = [pa.array(np.full(len(rows), v, dtype=np.int32)) for v in (dy0, dx0, n_dx)]
                lists = kernels.to_lists(g.reshape(len(rows), -1))
                yield pa.RecordBatch.from_arrays(
                    [part[k] for k in [*keys, "frame"]] + fixed + [lists], names=schema.names
                )

    return frames.select(*keys, "frame", "height", "width", "pixels").mapInArrow(correlate, schema)


def autocorr(df, keys=KEYS, max_lag=None, method="fft"):
    """``frame_corr`` rows: keys, frame, dy, dx, g.

    ``fft`` is the default.  ``lags`` forms products of strips, see
    :func:`autocorr_strips`; it costs pixels x lags per image and suits few
    lags.  An image with a missing sample or mean 0 gives NULL.
    """
    if method == "fft":
        frames = as_frames(df, keys)
        arrays = autocorr_frames(frames, keys, max_lag)
        return arrays.select(*keys, "frame", "dy0", "dx0", "n_dx", F.posexplode("g").alias("pos", "g")).select(
            *keys,
            "frame",
            F.expr("cast(pos div n_dx + dy0 as int)").alias("dy"),
            F.expr("cast(pos % n_dx + dx0 as int)").alias("dx"),
            "g",
        )
    if method == "lags":
        return autocorr_strips(df, keys, max_lag)
    raise ValueError("method must be 'fft' or 'lags'")


def image_strips(df, keys=KEYS, rows=None, reach=None):
    """Images cut into strips of ``rows`` rows, each followed by the ``reach`` rows below it (rows below the last are the first).

    ``strip`` counts from 0, ``n_rows`` are its own rows, ``part`` its samples row by row.  By default a strip has about
    ``STRIP_SAMPLES`` samples of its own and reaches half the image.  From the long layout each sample goes straight to
    the strips that need it, so no row ever holds a whole image.  An image whose rows do not fill its rectangle has none.
    """
    keys = list(keys)
    size = f"cast({int(rows)} as int)" if rows else f"greatest(1, cast({STRIP_SAMPLES} div width as int))"
    below = "height div 2" if reach is None else f"least({int(reach)}, height div 2)"
    plan = {"_rows": F.expr(size), "_below": F.expr(f"cast({below} as int)")}
    if "pixels" in df.columns:
        whole = df.where("height > 0 AND width > 0 AND size(pixels) = height * width").withColumns(plan)
        strips = whole.select(
            *keys,
            "frame",
            "height",
            "width",
            F.expr(
                "inline(transform(sequence(0, (height - 1) div _rows), k -> named_struct('strip', cast(k as int),"
                " 'n_rows', cast(least(_rows, height - k * _rows) as int),"
                " 'part', flatten(transform(sequence(k * _rows, least((k + 1) * _rows, height) - 1 + _below),"
                " r -> slice(pixels, cast((r % height) * width + 1 as int), width))))))"
            ),
        )
        return strips.withColumn("part", F.col("part").cast("array<double>"))
    on = [*keys, "frame"]
    sizes = df.groupBy(*on).agg(
        (F.max("y") + 1).cast("int").alias("height"),
        (F.max("x") + 1).cast("int").alias("width"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n = height * width")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    sized = df.alias("p").join(sizes.alias("s"), same).select("p.*", "s.height", "s.width").withColumns(plan)
    # the strips above, round the border: one more than the reach takes, as the last strip may be short
    count = "((height - 1) div _rows + 1)"
    above = f"sequence(0, least({count} - 1, (_below + _rows - 1) div _rows + 2))"
    placed = (
        f"transform({above}, j -> named_struct('strip', cast(pmod(y div _rows - j, {count}) as int),"
        f" 'at', cast(pmod(y - pmod(y div _rows - j, {count}) * _rows, height) as int)))"
    )
    # where a strip and its reach go round the whole image, its first rows come again at the end
    again = f"transform({placed}, p -> named_struct('strip', p.strip, 'at', p.at + height))"
    needed = f"filter(concat({placed}, {again}), p -> p.at < least(_rows, height - p.strip * _rows) + _below)"
    sent = sized.withColumn("_own", F.explode(F.expr(needed)))
    return sent.groupBy(*on, "height", "width", "_rows", F.col("_own.strip").alias("strip")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_own.at").alias("at"), "x", "intensity"))).alias("_samples")
    ).select(
        *on,
        "height",
        "width",
        "strip",
        F.expr("cast(least(_rows, height - strip * _rows) as int)").alias("n_rows"),
        F.transform("_samples", lambda s: s["intensity"].cast("double")).alias("part"),
    )


def half_lags(height, width, max_lag=None):
    """Wanted lags, counted round both axes, one of each pair (dy, dx) and (-dy, -dx)."""
    slow, fast = (height // 2, width // 2) if max_lag is None else (min(int(m), s // 2) for m, s in zip(max_lag, (height, width)))
    shifts = [b % width for b in range(-fast, min(fast, (width - 1) // 2) + 1)]
    # on the rows that are their own mirror image half of the fast axis is enough
    lags = [(a, b) for a in range(slow + 1) for b in shifts if not (a == 0 or 2 * a == height) or b <= width // 2]
    return np.array(lags, dtype=np.int32).reshape(-1, 2).T


def autocorr_strips(df, keys=KEYS, max_lag=None, rows=None):
    """``frame_corr`` rows from lag products of strips, for images too large for a transform, or few lags.

    A strip meets the rows its lags reach, its products are summed within its row, and the sums of an image's strips
    are added up: a few numbers a lag, most of them before the shuffle.  Only wanted lags are formed, one of each pair
    (dy, dx) and (-dy, -dx), which have the same value.  (keys, frame) names one image.  An image with a missing
    sample or mean 0 gives NULL.
    """
    keys = list(keys)
    strips = image_strips(df, keys, rows, None if max_lag is None else max_lag[0])
    named = [*keys, "frame", "height", "width"]
    schema = T.StructType(
        types_of(strips, named)
        + [T.StructField("_total", T.DoubleType())]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a", "b")]
        + [T.StructField("_product", T.ArrayType(T.DoubleType()))]
    )

    def products(batches):
        for batch in batches:
            sizes = [batch[c].to_numpy(zero_copy_only=False) for c in ("height", "width", "n_rows")]
            for h, w, n in sorted(set(zip(*(c.tolist() for c in sizes)))):
                a, b = half_lags(h, w, max_lag)
                samples = (n + (h // 2 if max_lag is None else min(int(max_lag[0]), h // 2))) * w
                alike = np.flatnonzero((sizes[0] == h) & (sizes[1] == w) & (sizes[2] == n))
                for rows in sliced(alike, 2 * samples + len(a)):
                    part = batch.take(pa.array(rows))
                    whole = pc.list_value_length(part["part"]).to_numpy(zero_copy_only=False) == samples
                    strip = np.full((len(rows), samples), np.nan)
                    if whole.any():
                        strip[whole] = kernels.to_matrix(part["part"].filter(pa.array(whole)))
                    total, sums = kernels.lag_products(strip.reshape(len(rows), -1, w), n, a, b)
                    lags = [kernels.to_lists(np.broadcast_to(v, (len(rows), len(a)))) for v in (a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [part[c] for c in named] + [pa.array(total, from_pandas=True), *lags, kernels.to_lists(sums)],
                        names=schema.names,
                    )

    sums = strips.select(*named, "n_rows", "part").mapInArrow(products, schema)
    sums = sums.select(*named, "_total", F.inline(F.arrays_zip("a", "b", "_product")))
    added = sums.groupBy(*keys, "frame", "height", "width", "a", "b").agg(
        F.sum("_product").alias("_product"),
        (F.sum("_total") / (F.col("height") * F.col("width"))).alias("_mean"),
        (F.count("_product") == F.count(F.lit(1))).alias("_whole"),
    )
    scale = F.nullif(F.col("height") * F.col("width") * F.col("_mean") * F.col("_mean"), F.lit(0.0))
    lag = F.expr(
        "array_distinct(array(named_struct('a', a, 'b', b),"
        " named_struct('a', cast((height - a) % height as int), 'b', cast((width - b) % width as int))))"
    )
    both = added.withColumn("g", F.when(F.col("_whole"), F.col("_product") / scale - 1.0)).withColumn("lag", F.explode(lag))

    def centred(lag, size):
        return F.expr(f"cast(if({lag} <= ({size} - 1) div 2, {lag}, {lag} - {size}) as int)")

    return both.select(
        *keys, "frame", centred("lag.a", "height").alias("dy"), centred("lag.b", "width").alias("dx"), "g"
    )
