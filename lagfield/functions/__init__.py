from lagfield.functions.paths import extension, partner_name, prefix, stem
from lagfield.functions.physics import (
    MODELS,
    lag_space,
    lag_time,
    model_value,
    particle_number,
    rescale_acq,
    shape_factor,
    small_sample_factor,
)

__all__ = [
    "MODELS",
    "extension",
    "lag_space",
    "lag_time",
    "model_value",
    "particle_number",
    "partner_name",
    "prefix",
    "rescale_acq",
    "shape_factor",
    "small_sample_factor",
    "stem",
]
