"""From per-frame correlations to a mean map with its uncertainty."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from lagfield.functions.physics import small_sample_factor
from lagfield.operators import kernels
from lagfield.operators.correlate import by_shape, sliced
from lagfield.schema import KEYS, TILE, types_of

REPLICATES = 10
#: Doubles an accumulator may hold before a task emits its partial sums.
FLUSH_DOUBLES = 1 << 21
#: Lags whose sums travel in one row.
LAG_BLOCK = 4096
COUNTS = ("n_rows", "n_frames", "n_zero")
MOMENTS = ("n_all", "n_seen", "v_sum", "v_sq")


def mean_map(frame_corr, keys=KEYS, bessel="reduced", window=3):
    """Average over frames with the factor n / (n - 1).

    ``reduced`` takes n from the frames averaged; ``original`` from the series
    before detrending, which had ``window - 1`` frames more.
    """
    summed = frame_corr.groupBy(*keys, "dy", "dx").agg(
        F.avg("g").alias("_g"), F.count("g").alias("n_frames"), F.count(F.lit(1)).alias("_rows")
    )
    return summed.select(
        *keys,
        "dy",
        "dx",
        (F.col("_g") * bessel_factor(bessel, F.col("n_frames"), F.col("_rows"), window)).alias("g"),
        "n_frames",
        map_status(bessel, F.col("n_frames"), F.col("_rows"), window).alias("status"),
    )


def bessel_factor(bessel, n_frames, n_rows, window):
    if bessel == "reduced":
        return small_sample_factor(n_frames)
    if bessel == "original":
        return small_sample_factor(n_rows + (window - 1))
    raise ValueError("bessel must be 'reduced' or 'original'")


def map_status(bessel, n_frames, n_rows, window, n_zero=None):
    """Why a map is missing or leaves frames out; ``ok`` otherwise."""
    needed = F.lit(2) if bessel == "reduced" else F.greatest(F.lit(1), F.lit(3 - window))
    none_left = F.when(n_zero > 0, "zero_mean").otherwise("missing_pixels") if n_zero is not None else F.lit("no_valid_frame")
    return (
        F.when(n_rows < needed, "too_few_frames")
        .when(n_frames == 0, none_left)
        .when(n_frames < needed, "too_few_frames")
        .when(n_frames < n_rows, "frames_skipped")
        .otherwise("ok")
    )


def draw_weights(frames, keys=KEYS, window=1, reps=REPLICATES, seed=0, facts=None):
    """How often each frame is drawn in each bootstrap replicate.

    One row per frame that a series keeps after detrending, with an array of
    ``reps`` counts; frames never drawn are absent.  Draw ``d`` of replicate
    ``r`` takes frame md5(seed|r|d) mod n, so results are repeatable on any
    cluster.  Rows are small and grouped by frame, never by series.  ``facts``
    of the same frames save a pass over them.
    """
    if facts is not None:
        spans = facts.select("first", "n").withColumnsRenamed({"first": "_first", "n": "_count"})
    else:
        spans = frames.groupBy(*keys).agg(F.min("frame").alias("_first"), F.count(F.lit(1)).alias("_count"))
    kept = spans.withColumns({"_n": F.col("_count") - (window - 1), "_first": F.col("_first") + window // 2})
    draws = kept.where("_n > 0").select(
        *keys, "_first", "_n", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_draw")
    ).select(
        *keys, "_first", "_n", "_draw", F.explode(F.array([F.lit(r) for r in range(reps)])).alias("_rep")
    )
    index = F.expr(f"cast(conv(substr(md5(concat_ws('|', '{int(seed)}', _rep, _draw)), 1, 8), 16, 10) as bigint) % _n")
    counts = draws.select(*keys, (F.col("_first") + index).cast("int").alias("frame"), "_rep").groupBy(
        *keys, "frame"
    ).agg(*[F.sum(F.when(F.col("_rep") == r, 1).otherwise(0)).cast("double").alias(f"_r{r}") for r in range(reps)])
    return counts.select(*keys, "frame", F.array([F.col(f"_r{r}") for r in range(reps)]).alias("weights"))


def bootstrap_sd(frame_corr, keys=KEYS, reps=REPLICATES, seed=0, frames=None):
    """Population s.d. of the mean map over bootstrap replicates.

    ``frames`` lists the (keys, frame) of the detrended frames; giving it saves
    a second pass over ``frame_corr``.

    One pass: every replicate is a weighted sum of the same rows, so all are
    columns of one aggregate.  Frames without a correlation drop out of a
    replicate, which then divides by the draws that remain.
    """
    listed = (frame_corr if frames is None else frames).select(*keys, "frame").distinct()
    # draws go by position, frames by their numbers
    order = Window.partitionBy(*keys).orderBy("frame")
    places = listed.withColumn("_place", (F.row_number().over(order) - 1).cast("int"))
    drawn = draw_weights(places.select(*keys, F.col("_place").alias("frame")), keys, 1, reps, seed)
    weights = places.join(drawn.withColumnRenamed("frame", "_place"), [*keys, "_place"]).drop("_place")
    # a lag's frames come from as many tasks: they meet first, as sums over one frame each are larger than the rows
    joined = frame_corr.join(weights, [*keys, "frame"], "left").repartition(*keys, "dy", "dx")
    weight = [F.coalesce(F.get("weights", F.lit(r)), F.lit(0.0)) for r in range(reps)]
    known = F.col("g").isNotNull()
    summed = joined.groupBy(*keys, "dy", "dx").agg(
        F.count("g").alias("n_frames"),
        *[F.sum(F.when(known, w * F.col("g"))).alias(f"_s{r}") for r, w in enumerate(weight)],
        *[F.sum(F.when(known, w)).alias(f"_w{r}") for r, w in enumerate(weight)],
    )
    return summed.select(*keys, "dy", "dx", replicate_sd(reps).alias("g_sd"), "n_frames")


def replicate_sd(reps):
    """s.d. over replicates from the sums ``_s0 ..`` and draw counts ``_w0 ..``."""
    values = [F.col(f"_s{r}") / F.nullif(F.col(f"_w{r}"), F.lit(0.0)) for r in range(reps)]
    return replicate_deviation(values) * small_sample_factor(F.col("n_frames"))


def replicate_deviation(values):
    """Population s.d. of the replicates' values."""
    mean = sum(values[1:], values[0]) / len(values)
    square = sum([(v - mean) * (v - mean) for v in values[1:]], (values[0] - mean) * (values[0] - mean))
    return F.sqrt(square / len(values))


def pair_uncertainty(maps, uncertainties, keys=KEYS):
    """Attach the uncertainty map where there is one."""
    return maps.join(uncertainties.select(*keys, "dy", "dx", "g_sd"), [*keys, "dy", "dx"], "left")


def sum_fields(reps, tile):
    """Columns of a partial sum besides keys: whole numbers, counts, and arrays."""
    numbers = [*(TILE if tile else ()), "height", "width", "dy0", "dx0", "n_dx", "block"]
    return numbers, [*COUNTS, *(MOMENTS if tile else ())], (["drawn"] if reps else []) + ["sums"]


def partial_sums(residuals, keys=KEYS, max_lag=None, reps=0, tile=None):
    """Correlate images and add up the correlations inside each task.

    Input rows hold an image and its residual (``pixels``, ``delta``).  Output
    rows hold, for a part of the frames, the sums of a block of
    ``LAG_BLOCK`` lags: ``sums`` lists them for the plain sum and then for each
    replicate, ``drawn`` how many frames each replicate drew, and the counts
    stand once a row.  This is the combine step before the shuffle.  With
    ``tile = (size, step)`` the overlapping tiles are views of the same images,
    so the images are shuffled once and not once per tile; the tile origin
    joins the keys.

    Counts: ``n_rows`` frames with a full window, ``n_frames`` of them with a
    correlation, ``n_zero`` of them with mean 0; per tile, over all frames, the
    samples ``n_all``, the present ones ``n_seen`` and their moments.
    """
    numbers, counts, arrays = sum_fields(reps, tile)
    schema = T.StructType(
        types_of(residuals, keys)
        + [T.StructField(c, T.IntegerType()) for c in numbers]
        + [T.StructField(c, T.DoubleType()) for c in counts]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in arrays]
    )
    columns = [*keys, "height", "width", "pixels", "delta"] + (["weights"] if reps else [])

    def emit(store, key_types):
        for (key, _, _), sums in store.items():
            for whole, parts, lists in sums.blocks():
                rows = pa.array(np.zeros(len(parts[0]), dtype=np.int32))
                names = [pa.array([k], type=t).take(rows) for k, t in zip(key, key_types)]
                values = [pa.array(c) for c in whole + parts] + [kernels.to_lists(c) for c in lists]
                yield pa.RecordBatch.from_arrays(names + values, names=schema.names)

    # how many tiles a sample lies in
    overlap = (-(-tile[0] // tile[1])) ** 2 if tile else 1

    def combine(batches):
        store, held, key_types = {}, 0, None
        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            for h, w, rows in ((h, w, some) for h, w, rows in by_shape(batch) for some in sliced(rows, overlap * h * w)):
                if tile and min(h, w) < tile[0]:
                    continue
                part = batch.take(pa.array(rows))
                images = kernels.to_matrix(part["pixels"]).reshape(-1, h, w)
                delta = kernels.to_matrix_or_nan(part["delta"], h * w).reshape(-1, h, w)
                full = np.asarray(part["delta"].is_valid())
                weights = kernels.to_matrix_or_nan(part["weights"], reps, 0.0) if reps else None
                groups = {}
                for row, key in enumerate(zip(*[part[k].to_pylist() for k in keys])):
                    groups.setdefault(key, []).append(row)
                for key, index in groups.items():
                    slot = (key, h, w)
                    if slot not in store:
                        store[slot] = LagSums(h, w, max_lag, reps, tile)
                        held += store[slot].total.size
                    store[slot].add(images[index], delta[index], full[index], weights[index] if reps else None)
                if held > FLUSH_DOUBLES:
                    yield from emit(store, key_types)
                    store, held = {}, 0
        yield from emit(store, key_types)

    return residuals.select(*columns).mapInArrow(combine, schema)


class LagSums:
    """Running sums of correlations, per tile and lag, of one image series."""

    def __init__(self, height, width, max_lag, reps, tile):
        self.max_lag, self.reps, self.tile = max_lag, reps, tile
        self.height, self.width = (tile[0], tile[0]) if tile else (height, width)
        step = tile[1] if tile else 1
        self.tiles = ((height - self.height) // step + 1, (width - self.width) // step + 1)
        slow, fast = max_lag or (None, None)
        self.dy0, n_dy = kernels.lag_bounds(self.height, slow)
        self.dx0, n_dx = kernels.lag_bounds(self.width, fast)
        self.total = np.zeros((reps + 1, *self.tiles, n_dy, n_dx))
        self.counts = np.zeros((len(COUNTS), *self.tiles))
        self.moments = np.zeros((len(MOMENTS), *self.tiles))
        self.drawn = np.zeros((reps, *self.tiles))

    def add(self, images, delta, full, weights):
        """Add frames; ``full`` marks those with a complete window."""
        if self.tile:
            images, delta = kernels.tile_view(images, *self.tile), kernels.tile_view(delta, *self.tile)
            seen = ~np.isnan(images)
            values = np.where(seen, images, 0.0)
            area = np.full(self.tiles, images.shape[0] * self.height * self.width)
            self.moments += [area, *(a.sum(axis=(0, 3, 4)) for a in (seen, values, values**2))]
        else:
            images, delta = images[:, None, None], delta[:, None, None]
        if not full.any():
            return
        shifted = delta[full] + images[full].mean(axis=(-2, -1), keepdims=True)
        g = kernels.crop_lag_axes(kernels.circular_autocorr(shifted), self.max_lag)
        valid = ~np.isnan(g[..., 0, 0])
        zero_mean = ~valid & ~np.isnan(shifted.sum(axis=(-2, -1)))
        self.counts += [np.full(self.tiles, len(g)), valid.sum(axis=0), zero_mean.sum(axis=0)]
        g = np.where(valid[..., None, None], g, 0.0)
        self.total[0] += g.sum(axis=0)
        if self.reps:
            drawn = weights[full].T
            self.drawn += np.tensordot(drawn, valid.astype(float), axes=1)
            self.total[1:] += np.tensordot(drawn, g, axes=1)

    def blocks(self):
        """Whole numbers, counts and arrays of the partial sums, one row for each tile, for one block of lags after another."""
        n_tiles, n_lags = self.tiles[0] * self.tiles[1], self.total.shape[-2] * self.total.shape[-1]
        sums = self.total.reshape(self.reps + 1, n_tiles, n_lags).transpose(1, 0, 2)
        ty, tx = np.indices(self.tiles, dtype=np.int32).reshape(2, -1)
        origin = [ty * np.int32(self.tile[1]), tx * np.int32(self.tile[1])] if self.tile else []
        counts = list(self.counts.reshape(len(COUNTS), -1))
        moments = list(self.moments.reshape(len(MOMENTS), -1)) if self.tile else []
        drawn = [np.ascontiguousarray(self.drawn.reshape(self.reps, -1).T)] if self.reps else []
        for block, first in enumerate(range(0, n_lags, LAG_BLOCK)):
            place = (self.height, self.width, self.dy0, self.dx0, self.total.shape[-1], block)
            whole = origin + [np.full(n_tiles, n, dtype=np.int32) for n in place]
            part = np.ascontiguousarray(sums[:, :, first : first + LAG_BLOCK]).reshape(n_tiles, -1)
            yield whole, counts + moments, [*drawn, part]


def total_sums(partials, keys=KEYS, reps=0, tile=False):
    """Partial sums of the same block added up, element by element.

    One shuffle on (keys, block).  A task reads its rows in order and holds the
    sums of one block only, however many parts a series has.
    """
    numbers, counts, arrays = sum_fields(reps, tile)
    names = [*keys, *numbers]
    # blocks of one map differ in nothing else, so sizes belong to the key
    ordered = partials.repartition(*[F.col(c) for c in [*keys, *(TILE if tile else ()), "block"]]).sortWithinPartitions(*names)
    schema = partials.schema

    def add(batches):
        held, values = None, None

        def row():
            columns = [pa.array([held[n]], schema.field(n).type) for n in names]
            columns += [pa.array([v]) for v in values[0]]
            return pa.RecordBatch.from_arrays(columns + [kernels.to_lists(v[None]) for v in values[1]], names=schema_names)

        schema_names = [*names, *counts, *arrays]
        for batch in batches:
            schema = batch.schema
            rows = batch.select(names).to_pylist()
            matrix = np.stack([batch[c].to_numpy() for c in counts], 1)
            for i, place in enumerate(rows):
                lists = [batch[c][i].values.to_numpy() for c in arrays]
                if place == held:
                    for total, more in zip([values[0], *values[1]], [matrix[i], *lists]):
                        total += more
                else:
                    if held is not None:
                        yield row()
                    held, values = place, (matrix[i].copy(), [v.copy() for v in lists])
        if held is not None:
            yield row()

    return ordered.mapInArrow(add, schema)


def finish_sums(partials, keys=KEYS, bessel="reduced", window=3, reps=0):
    """Correlation maps from partial sums, one row for each lag.

    ``keys`` include the tile origin where there are tiles.  Status, means and
    deviations are taken once a block, as arrays; lags become rows at the end.
    """
    tiled = MOMENTS[0] in partials.columns
    series = [k for k in keys if k not in TILE] if tiled else list(keys)
    summed = total_sums(partials, series, reps, tiled).withColumn("n_frames", F.col("n_frames").cast("long"))
    rows = F.col("n_rows").cast("long")
    factor = bessel_factor(bessel, F.col("n_frames"), rows, window)
    size = (F.size("sums") / (reps + 1)).cast("int")
    sized = summed.withColumns(
        {
            "_size": size,
            "_factor": factor / F.nullif(F.col("n_frames"), F.lit(0)),
            "_spread": small_sample_factor(F.col("n_frames")),
            "_status": map_status(bessel, F.col("n_frames"), rows, window, F.col("n_zero")),
        }
    )
    # one column of lags for the plain sum and one for each replicate
    sums = F.arrays_zip(*[F.slice("sums", F.col("_size") * r + 1, F.col("_size")).alias(f"s{r}") for r in range(reps + 1)])
    kept = [c for c in sized.columns if c != "sums"]
    exploded = sized.select(*kept, F.posexplode(sums).alias("_pos", "_of")).withColumn("g", F.col("_of.s0") * F.col("_factor"))
    deviation = F.lit(None).cast("double")
    if reps:
        values = [F.col(f"_of.s{r + 1}") / F.nullif(F.get("drawn", F.lit(r)), F.lit(0.0)) for r in range(reps)]
        exploded = exploded.withColumns({f"_v{r}": v for r, v in enumerate(values)})
        deviation = replicate_deviation([F.col(f"_v{r}") for r in range(reps)]) * F.col("_spread")
    lag = F.col("block") * LAG_BLOCK + F.col("_pos")
    placed = exploded.withColumns(
        {
            "dy": (F.floor(lag / F.col("n_dx")) + F.col("dy0")).cast("int"),
            "dx": (lag % F.col("n_dx") + F.col("dx0")).cast("int"),
        }
    )
    # per-tile moments ride on the zero lag, so sums over lags stay right
    at_zero = (F.col("dy") == 0) & (F.col("dx") == 0)
    moments = [F.when(at_zero, F.col(c)).otherwise(0.0).alias(c) for c in MOMENTS if tiled]
    return placed.select(
        *keys, "dy", "dx", "height", "width", "g", deviation.alias("g_sd"), "n_frames", F.col("_status").alias("status"), *moments
    )
