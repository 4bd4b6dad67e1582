"""Raster image correlation on Spark: from image series to diffusion maps."""

import sys

from pyspark import cloudpickle

from lagfield.operators.correlate import autocorr, autocorr_frames, autocorr_strips, image_strips
from lagfield.operators.detrend import detrend, detrend_frames
from lagfield.operators.drift import apply_drift, drift_correct, estimate_drift
from lagfield.operators.fit import fit_maps
from lagfield.operators.geometry import (
    blank_zero_lag,
    crop_center,
    crop_lags,
    fast_axis,
    median_filter3,
    pick_frame,
    with_distance,
)
from lagfield.operators.lags import attach_acq, fit_cost, fit_maps_eval, with_acq, with_lag_geometry
from lagfield.operators.layout import stack_shape, to_frames, to_pixels
from lagfield.operators.rectangles import paint_rectangles, rectangle_range, tile_moments, tile_rectangles
from lagfield.operators.reduce import bootstrap_sd, mean_map, pair_uncertainty
from lagfield.operators.stats import brightness, frame_stats, intensity_trace, map_range, mean_projection
from lagfield.operators.tiles import assign_tiles, paint_tiles, valid_tiles
from lagfield.plans.correlation_job import correlation_map, stored_correlation_map
from lagfield.plans.fit_job import fit_job
from lagfield.plans.local_map import local_diffusion_map, local_fast_axis, tile_fits, tile_maps
from lagfield.plans.store import store_chunks
from lagfield.session import build_session
from lagfield.sources.listing import list_inputs
from lagfield.sources.metadata import extract_acq
from lagfield.sources.results import fit_table, read_fits, read_maps, write_fits, write_local_map, write_maps
from lagfield.sources.stacks import scan_stack, write_frames

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
