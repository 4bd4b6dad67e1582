"""Images stored once in the partitioning of the correlation job."""

from lagfield.operators.detrend import check_window
from lagfield.operators.geometry import crop_center
from lagfield.operators.layout import SeriesFacts, as_frames, number_frames, series_status, sound_frames
from lagfield.operators.reduce import REPLICATES
from lagfield.plans.correlation_job import place_chunks
from lagfield.schema import KEYS
from lagfield.sources.chunks import write_chunks


def store_chunks(df, table, window=3, reps=REPLICATES, crop=1.0, chunk=None, gapless=None, path=None, buckets=None):
    """Store image series for :func:`lagfield.plans.correlation_job.stored_correlation_map`.

    The one shuffle of images that a correlation job needs happens here.  ``window`` is the largest that jobs will use:
    it sets how many frames at the border of a chunk are stored twice.  ``reps`` sets how many chunks share a task and
    changes no value.  Faults are met as in :func:`lagfield.plans.correlation_job.correlation_map`, and their status rows
    are stored beside the images.
    """
    window = check_window(window)
    images = as_frames(df, KEYS)
    listed = None if "pixels" in df.columns else df.select(*KEYS, "frame").distinct()
    frames = crop_center(sound_frames(images.select(*KEYS, "frame", "height", "width", "pixels"), KEYS), crop)
    frames = number_frames(frames, KEYS, gapless, listed)
    facts = SeriesFacts(frames, KEYS)
    placed = place_chunks(frames, facts, KEYS, window, reps, chunk)
    write_chunks(placed, series_status(images, KEYS, facts), table, window, reps, chunk, path, buckets)
