"""Acquisition data and lag geometry of correlation maps."""

from pyspark.sql import functions as F

from lagfield.functions.paths import prefix
from lagfield.functions.physics import lag_space, lag_time, model_value, rescale_acq
from lagfield.schema import KEYS

# Acquisition used where no metadata document is found.
DEFAULT_ACQ = {"pixel_size_nm": 20.0, "pixel_dwell_us": 50.0, "line_time_ms": 12.8}


def attach_acq(maps, acq, defaults=None, name="stack_id"):
    """Attach acquisition columns by the map name up to its first underscore.

    A map without a metadata row gets ``defaults``.  The metadata table has one
    row per series and so grows with the data; it carries no broadcast hint.
    """
    values = dict(DEFAULT_ACQ, **(defaults or {}))
    on = ["_series"] + (["channel"] if "channel" in maps.columns and "channel" in acq.columns else [])
    right = acq.select(F.col("stack_id").alias("_series"), *on[1:], *[F.col(c).alias(f"_{c}") for c in values])
    joined = maps.withColumn("_series", prefix(F.col(name))).join(right, on, "left")
    return joined.select(
        *[joined[c] for c in maps.columns],
        *[F.coalesce(F.col(f"_{c}"), F.lit(float(v))).alias(c) for c, v in values.items()],
    )


def with_acq(maps, values=None):
    """Attach one acquisition to every map."""
    values = dict(DEFAULT_ACQ, **(values or {}))
    return maps.withColumns({c: F.lit(float(v)) for c, v in values.items()})


def with_lag_geometry(maps):
    """Add ``s_lag`` (um^2) and ``t_lag`` (s) from lags and acquisition columns."""
    scaled = rescale_acq(maps)
    return scaled.withColumns(
        {
            "s_lag": lag_space(F.col("dy"), F.col("dx"), F.col("pixel_um")),
            "t_lag": lag_time(F.col("dy"), F.col("dx"), F.col("dwell_s"), F.col("line_s")),
        }
    ).drop("pixel_um", "dwell_s", "line_s")


def fit_maps_eval(maps, fits, model, keys=KEYS, carry=(), **psf):
    """Model and residual (model - data) maps for fitted parameters.

    The residual at the zero lag is 0.  ``carry`` names map columns to keep.
    The parameters, one row for each map, are hashed where their lags are: lags
    are neither sorted nor sent to the driver, however small Spark takes a
    table to be that it has not yet exploded.
    """
    parameters = fits.select(*keys, "amplitude", "diff_coeff", "offset").hint("shuffle_hash")
    value = model_value(model, "amplitude", "diff_coeff", "offset", **psf)
    zero = (F.col("dy") == 0) & (F.col("dx") == 0)
    source = maps.where(F.col("dy") == 0) if model == "1D" else maps
    evaluated = source.join(parameters, list(keys)).withColumn("model_g", value)
    return evaluated.select(
        *keys,
        "dy",
        "dx",
        "g",
        "model_g",
        F.when(zero, F.lit(0.0)).otherwise(F.col("model_g") - F.col("g")).alias("residual"),
        *carry,
    )


def fit_cost(fit_maps, keys=KEYS):
    """Sum of squared residuals and mean residual; the zero lag counts as 0."""
    return fit_maps.groupBy(*keys).agg(
        F.sum(F.col("residual") * F.col("residual")).alias("cost"), F.avg("residual").alias("residual_mean")
    )
