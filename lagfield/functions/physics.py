"""Unit, lag and diffusion-model expressions.

All are plain column expressions, so they stay inside whole-stage code.
"""

from pyspark.sql import Column, functions as F

#: ``1D`` is the two-dimensional model on the fast axis (``dy = 0``).
MODELS = ("2D", "3D", "1D")

# Focal volume shape factors, particle number = factor / amplitude.
PARTICLE_FACTOR = {"2D": 0.5, "3D": 0.35, "1D": 0.5}

# Defaults of the focal volume (lateral size in um, axial/lateral).
PSF_XY_UM = 0.2
PSF_ASPECT = 4.985423166


def rescale_acq(acq):
    """Add metre-scale columns: ``pixel_um``, ``dwell_s`` and ``line_s``."""
    return acq.withColumns(
        {
            "pixel_um": F.col("pixel_size_nm") * 1e-3,
            "dwell_s": F.col("pixel_dwell_us") * 1e-6,
            "line_s": F.col("line_time_ms") * 1e-3,
        }
    )


def lag_space(dy, dx, pixel_um):
    """Squared distance of a lag in um^2."""
    return pixel_um * pixel_um * (dx * dx + dy * dy)


def lag_time(dy, dx, dwell_s, line_s):
    """Time the scanner needs from a pixel to the pixel one lag away."""
    return F.abs(dwell_s * dx + line_s * dy)


def number(value):
    """A double in SQL text; names pass through."""
    return value if isinstance(value, str) else f"{float(value)!r}D"


def shape_text(model, diff, s_lag="s_lag", t_lag="t_lag", psf_xy_um=PSF_XY_UM, psf_aspect=PSF_ASPECT):
    """SQL text of :func:`shape_factor`.

    Fits use dozens of these in one aggregate; text is much cheaper to build
    than column objects.
    """
    waist = float(psf_xy_um) ** 2
    spread = f"(4D * {number(diff)} * {t_lag} + {number(waist)})"
    value = f"({number(waist)} / {spread}) * exp(-{s_lag} / {spread})"
    if model == "3D":
        axial = number(waist * float(psf_aspect) ** 2)
        value = f"{value} / sqrt(1D + 4D * {number(diff)} * {t_lag} / {axial})"
    return f"({value})"


def shape_factor(model, diff, s_lag="s_lag", t_lag="t_lag", **psf):
    """Model value at amplitude 1 and offset 0.

    Arguments are column names or numbers.
    """
    return F.expr(shape_text(model, diff, s_lag, t_lag, **psf))


def model_value(model, amplitude, diff, offset, s_lag="s_lag", t_lag="t_lag", **psf):
    """Amplitude x shape + offset; arguments are column names or numbers."""
    return F.expr(f"{number(amplitude)} * {shape_text(model, diff, s_lag, t_lag, **psf)} + {number(offset)}")


def particle_number(model, amplitude):
    """Mean number of particles in focus; NULL for amplitude 0."""
    if not isinstance(model, Column):
        return F.lit(PARTICLE_FACTOR[model]) / F.nullif(amplitude, F.lit(0.0))
    factor = F.when(model == "3D", PARTICLE_FACTOR["3D"]).otherwise(PARTICLE_FACTOR["2D"])
    return factor / F.nullif(amplitude, F.lit(0.0))


def small_sample_factor(n):
    """n / (n - 1), NULL below two samples."""
    return F.when(n >= 2, n.cast("double") / (n - 1))
