"""Acquisition metadata from nested documents."""

from pyspark.sql import functions as F

# Places of the numbers in a metadata document.
PIXEL_SIZE = "Scaling.Items.Distance[0].Value"
CHANNELS = "Information.Image.Dimensions.Channels.Channel"
DWELL = "LaserScanInfo.PixelTime"


def extract_acq(meta, width_col="width", channel=0, document="metadata", root="$"):
    """Pixel size (nm), dwell time (us) and line time (ms) of one channel.

    ``Channel`` is a list where several channels were recorded and a single
    object otherwise.  Values that are not there come out NULL.
    """
    doc = F.col(document)
    pixel_m = F.get_json_object(doc, f"{root}.{PIXEL_SIZE}").cast("double")
    listed = F.get_json_object(doc, f"{root}.{CHANNELS}[{int(channel)}].{DWELL}")
    single = F.get_json_object(doc, f"{root}.{CHANNELS}.{DWELL}")
    dwell_us = F.coalesce(listed, single).cast("double") * 1e6
    return meta.select(
        "stack_id",
        F.lit(int(channel)).alias("channel"),
        (pixel_m * 1e9).alias("pixel_size_nm"),
        dwell_us.alias("pixel_dwell_us"),
        (dwell_us * F.col(width_col) * 1e-3).alias("line_time_ms"),
    )
