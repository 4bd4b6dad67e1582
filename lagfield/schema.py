"""Table layouts shared by every operator.

Two layouts hold the same samples.  ``pixels`` is long (one row per sample) and
suits work across frames or pixels; ``frames`` is one row per image with a
row-major array and is the layout at rest, because it is smaller by the number
of pixels per image.  Missing samples are NULL, never NaN.
"""

from pyspark.sql import types as T

#: Columns that identify one image series.  Every operator takes ``keys``, so
#: the local map runs the same operators with the tile origin added.
KEYS = ("stack_id", "channel")
TILE = ("tile_y0", "tile_x0")


def _key_fields():
    return [T.StructField("stack_id", T.StringType()), T.StructField("channel", T.IntegerType())]


PIXELS = T.StructType(
    _key_fields()
    + [
        T.StructField("frame", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("intensity", T.DoubleType()),
    ]
)


def frames_schema(pixel_type=None):
    """Schema of ``frames``; ``pixel_type`` is the stored element type.

    Detectors give 16-bit counts, so a table may hold ``ARRAY<INT>`` or
    ``ARRAY<SHORT>``; operators keep that type through their shuffles and widen
    to double inside the task.
    """
    return T.StructType(
        _key_fields()
        + [
            T.StructField("frame", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("pixels", T.ArrayType(pixel_type or T.DoubleType())),
        ]
    )


FRAMES = frames_schema()

CORR_MAP = T.StructType(
    _key_fields()
    + [
        T.StructField("dy", T.IntegerType()),
        T.StructField("dx", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("g", T.DoubleType()),
        T.StructField("g_sd", T.DoubleType()),
        T.StructField("n_frames", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

ACQ = T.StructType(
    _key_fields()
    + [
        T.StructField("pixel_size_nm", T.DoubleType()),
        T.StructField("pixel_dwell_us", T.DoubleType()),
        T.StructField("line_time_ms", T.DoubleType()),
    ]
)


def types_of(df, columns):
    """Struct fields of ``columns`` in ``df``, for the schema of an Arrow function."""
    return [T.StructField(c, df.schema[c].dataType) for c in columns]
