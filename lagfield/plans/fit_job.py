"""Correlation maps to diffusion parameters, for all maps at once."""

from pyspark.sql import functions as F

from lagfield.operators.fit import fit_rows
from lagfield.operators.geometry import crop_lags
from lagfield.operators.lags import DEFAULT_ACQ, attach_acq, with_acq, with_lag_geometry
from lagfield.schema import KEYS


def fit_job(maps, acq=None, model="2D", crop_fast=0.5, crop_slow=0.5, keys=KEYS, defaults=None, shape=None, together=False, **psf):
    """Crop the lags, attach the acquisition and fit every map with one model or several.

    Acquisitions meet one row per map, not its lags, however many maps share a
    name's beginning; they then follow the lags to where their map is fitted.
    So the lags are shuffled once, by map, or not at all where ``together`` says
    that those of a map follow each other in one partition.  The zero lag takes no part in a fit
    and needs no blanking here; see
    :func:`lagfield.operators.geometry.blank_zero_lag` for maps to look at.
    """
    keys = list(keys)
    cropped = crop_lags(maps, crop_fast, crop_slow, shape, keys)
    if not together:
        cropped = cropped.repartition(*keys)
    if acq is None:
        known = with_acq(cropped, defaults)
    else:
        values = dict(DEFAULT_ACQ, **(defaults or {}))
        names = attach_acq(maps.select(*keys).distinct(), acq, defaults)
        own = names.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
        # a map with a NULL in its key has no document; hashed, as a merge would sort the lags
        joined = cropped.join(own.hint("shuffle_hash"), keys, "left")
        known = joined.select(
            *[F.col(c) for c in cropped.columns],
            *[F.coalesce(F.col(f"_{c}"), F.lit(float(v))).alias(c) for c, v in values.items()],
        )
    return fit_rows(with_lag_geometry(known), model, keys, together=together, **psf)
