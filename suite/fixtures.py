"""Image series and correlation maps derived from the given tables.

Each fixture exists twice: as a DataFrame and as SQL with the same meaning.
Series multiply with the tables (by supplier, user or part group), so the work
of every query grows with its input.
"""

from pyspark.sql import functions as F

from lagfield.functions.physics import shape_factor
from lagfield.operators.drift import apply_drift
from lagfield.operators.lags import with_acq, with_lag_geometry
from lagfield.operators.layout import to_pixels

SIDE = 16
WIDE = 128
MONTHS = 12
DAYS = 30
HOURS = 24


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_frames(rows, value, n_frames, height, width):
    """Images of summed values; cells without rows are 0.

    The columns of an image row are columns of one aggregate, so the rows of
    the table shrink before the first shuffle.
    """
    keys = ["stack_id", "channel"]
    lines = rows.groupBy(*keys, "frame", "y").agg(
        F.expr("array(" + ", ".join(f"coalesce(sum({value}) FILTER (WHERE x = {x}), 0D)" for x in range(width)) + ")").alias(
            "line"
        )
    )
    images = lines.groupBy(*keys, "frame").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"))
    numbers = F.sequence(F.lit(0), F.lit(n_frames - 1))
    every = images.select(*keys).distinct().withColumn("frame", F.explode(numbers))
    pixels = F.expr(
        f"flatten(transform(sequence(0, {height - 1}), i -> coalesce(try_element_at(lines, i), array_repeat(0D, {width}))))"
    )
    empty = F.expr(f"array_repeat(0D, {height * width})")
    return every.join(images, [*keys, "frame"], "left").select(
        *keys, "frame", F.lit(height).alias("height"), F.lit(width).alias("width"), F.coalesce(pixels, empty).alias("pixels")
    )


def cube_frames(spark, sf_dir):
    """Quantity shipped by month, supplier (y) and part (x)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_returnflag", F.expr(f"l_suppkey div {SIDE}")).alias("stack_id"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("channel"),
        (F.month("l_shipdate") - 1).alias("frame"),
        (F.col("l_suppkey") % SIDE).cast("int").alias("y"),
        (F.col("l_partkey") % SIDE).cast("int").alias("x"),
        "l_quantity",
    )
    return dense_frames(rows, "l_quantity", MONTHS, SIDE, SIDE)


def cube(spark, sf_dir):
    return to_pixels(cube_frames(spark, sf_dir))


def events_frames(spark, sf_dir):
    """Events counted by day, user (y) and hour (x): images that are not square."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stack_id"),
        F.expr("cast(user_id div 64 as int)").alias("channel"),
        (F.dayofmonth("ts") - 1).alias("frame"),
        (F.col("user_id") % SIDE).cast("int").alias("y"),
        F.hour("ts").alias("x"),
    )
    return dense_frames(rows, "1D", DAYS, SIDE, HOURS)


def vec_frames(spark, sf_dir):
    """Embeddings as 8 x 8 images; adding 1 keeps the mean away from 0."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("stack_id"),
        (F.col("label") % 2).cast("int").alias("channel"),
        F.col("vec_id").cast("int").alias("frame"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.transform("embedding", lambda v: v.cast("double") + 1.0).alias("pixels"),
    )


def holes(spark, sf_dir):
    """The cube with missing samples, most of them in the first 8 x 8 tile."""
    phase = (F.col("y") + F.col("x") + F.col("frame")) % 3
    hole = (F.col("y") < 8) & ((phase == 0) | ((F.col("x") < 8) & (phase == 2)))
    return cube(spark, sf_dir).withColumn("intensity", F.when(~hole, F.col("intensity")))


def hole_frames(spark, sf_dir):
    """:func:`holes` in the array layout."""
    def punched(value, at):
        y, x = F.floor(at / SIDE), at % SIDE
        phase = (y + x + F.col("frame")) % 3
        hole = (y < 8) & ((phase == 0) | ((x < 8) & (phase == 2)))
        return F.when(~hole, value)

    return cube_frames(spark, sf_dir).withColumn("pixels", F.transform("pixels", punched))


def some_holes(spark, sf_dir):
    """The cube with the samples of :func:`holes` missing in one month only, so that some windows are whole."""
    phase = (F.col("y") + F.col("x")) % 3
    hole = (F.col("frame") == 8) & (F.col("y") < 8) & (phase == 2)
    return cube(spark, sf_dir).withColumn("intensity", F.when(~hole, F.col("intensity")))


def wide_frames(spark, sf_dir):
    """Quantity shipped by month, supplier (y) and part (x) on images of 128 x 128 samples."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stack_id"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("channel"),
        (F.month("l_shipdate") - 1).alias("frame"),
        (F.col("l_suppkey") % WIDE).cast("int").alias("y"),
        (F.col("l_partkey") % WIDE).cast("int").alias("x"),
        "l_quantity",
    )
    return dense_frames(rows, "l_quantity", MONTHS, WIDE, WIDE)


def faulty(frames):
    """Faults planted in series of images: damaged and absent arrays, images of another size, images without a key.

    Series that begin with A: image 5 is cut short and image 9 absent; with R: image 0 is smaller than the others;
    with N: some images once more without their channel.
    """
    first = F.substring("stack_id", 1, 1)
    frame = F.col("frame")
    small = (first == "R") & (frame == 0)
    pixels = (
        F.when((first == "A") & (frame == 5), F.slice("pixels", 1, 100))
        .when((first == "A") & (frame == 9), F.lit(None))
        .when(small, F.slice("pixels", 1, 64))
        .otherwise(F.col("pixels"))
    )
    planted = frames.withColumns(
        {
            "pixels": pixels,
            "height": F.when(small, 8).otherwise(F.col("height")),
            "width": F.when(small, 8).otherwise(F.col("width")),
        }
    )
    nameless = frames.where((first == "N") & (frame < 3)).withColumn("channel", F.lit(None).cast("int"))
    return planted.unionByName(nameless)


def part_maps(spark, sf_dir, model="2D", half=16):
    """One correlation map per part, with known parameters and small errors; the lags of a map lie together."""
    span = F.sequence(F.lit(-half), F.lit(half - 1))
    parts = table(spark, sf_dir, "part").select(
        F.concat_ws("_", "p_partkey", F.lit("scan_RICScorr")).alias("stack_id"),
        (F.col("p_partkey") % 2).cast("int").alias("channel"),
        F.col("p_partkey").alias("part"),
        F.pow(F.lit(10.0), (F.col("p_size") % 5) / 2.0 - 1.0).alias("true_d"),
        (0.2 + (F.col("p_partkey") % 7) * 0.1).alias("true_a"),
    )
    # rows go to the partition of their map, in order, before each becomes a map: its lags stay together
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = parts.repartition(tasks, "stack_id", "channel").sortWithinPartitions("stack_id", "channel", "part")
    lags = placed.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    placed = with_lag_geometry(with_acq(lags))
    shape = shape_factor(model, "true_d")
    error = 0.001 * (F.pmod(7 * F.col("dy") + 3 * F.col("dx") + F.col("part"), F.lit(5)) - 2)
    zero = (F.col("dy") == 0) & (F.col("dx") == 0)
    return placed.withColumn("g", F.when(zero, 0.0).otherwise(F.col("true_a") * shape + error)).withColumn(
        "n_frames", F.lit(10).cast("long")
    )


def meta_json(spark, sf_dir):
    """One nested metadata document per supplier; every fifth has none."""
    key = F.col("s_suppkey")
    dwell = (key % 9 + 1) * 1e-6
    listed = F.to_json(
        F.struct(
            F.struct(F.struct(F.array(F.struct(((key % 7 + 10) * 1e-9).alias("Value"))).alias("Distance")).alias("Items")).alias(
                "Scaling"
            ),
            F.struct(
                F.struct(
                    F.struct(
                        F.struct(
                            F.array(
                                F.struct(F.struct(dwell.alias("PixelTime")).alias("LaserScanInfo")),
                                F.struct(F.struct((dwell * 2).alias("PixelTime")).alias("LaserScanInfo")),
                            ).alias("Channel")
                        ).alias("Channels")
                    ).alias("Dimensions")
                ).alias("Image")
            ).alias("Information"),
        )
    )
    single = F.to_json(
        F.struct(
            F.struct(F.struct(F.array(F.struct(((key % 7 + 10) * 1e-9).alias("Value"))).alias("Distance")).alias("Items")).alias(
                "Scaling"
            ),
            F.struct(
                F.struct(
                    F.struct(
                        F.struct(F.struct(F.struct(dwell.alias("PixelTime")).alias("LaserScanInfo")).alias("Channel")).alias(
                            "Channels"
                        )
                    ).alias("Dimensions")
                ).alias("Image")
            ).alias("Information"),
        )
    )
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("stack_id"),
        F.lit(256).alias("width"),
        F.when(key % 5 != 0, F.when(key % 2 == 0, listed).otherwise(single)).alias("metadata"),
    )


def rolled_frames(spark, sf_dir):
    """The total image of each series, rolled by a known shift per month."""
    frames = cube_frames(spark, sf_dir).select("stack_id", "channel", F.posexplode("pixels").alias("pos", "v"))
    base = frames.groupBy("stack_id", "channel", "pos").agg(F.sum("v").alias("v"))
    images = base.groupBy("stack_id", "channel").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("pixels")
    )
    still = images.select(
        "stack_id",
        "channel",
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        "pixels",
    )
    shift = still.select(
        "stack_id", "channel", "frame", (F.col("frame") % 3).alias("dy"), (-((F.col("frame") * 2) % 5)).alias("dx")
    )
    return apply_drift(still, shift)


# --- the same in SQL -------------------------------------------------------


def _dense(name, n_frames, height, width):
    return f"""
{name}_ids AS (SELECT DISTINCT stack_id, channel FROM {name}_cells),
{name} AS (
  SELECT s.stack_id, s.channel, f.range AS frame, a.range AS y, b.range AS x,
         coalesce(c.value, 0.0)::DOUBLE AS intensity
  FROM {name}_ids s CROSS JOIN range({n_frames}) f CROSS JOIN range({height}) a CROSS JOIN range({width}) b
  LEFT JOIN {name}_cells c
    ON c.stack_id = s.stack_id AND c.channel = s.channel AND c.frame = f.range AND c.y = a.range AND c.x = b.range
)"""


CUBE = f"""
cube_cells AS (
  SELECT l_returnflag || '_' || (l_suppkey // {SIDE})::VARCHAR AS stack_id,
         CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END::BIGINT AS channel,
         (month(l_shipdate) - 1)::BIGINT AS frame, l_suppkey % {SIDE} AS y, l_partkey % {SIDE} AS x,
         sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL
),{_dense("cube", MONTHS, SIDE, SIDE)}"""

EVENTS = f"""
ev_cells AS (
  SELECT event_type AS stack_id, (user_id // 64)::BIGINT AS channel, (day(ts) - 1)::BIGINT AS frame,
         user_id % {SIDE} AS y, hour(ts)::BIGINT AS x, count(*)::DOUBLE AS value
  FROM events GROUP BY ALL
),{_dense("ev", DAYS, SIDE, HOURS)}"""

VEC = """
vec AS (
  SELECT label::VARCHAR AS stack_id, (label % 2)::BIGINT AS channel, vec_id::BIGINT AS frame,
         ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, v::DOUBLE + 1.0 AS intensity
  FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings)
)"""

HOLES = (
    CUBE
    + """,
holes AS (
  SELECT stack_id, channel, frame, y, x,
         CASE WHEN y < 8 AND ((y + x + frame) % 3 = 0 OR (x < 8 AND (y + x + frame) % 3 = 2)) THEN NULL
              ELSE intensity END AS intensity
  FROM cube
)"""
)

SOME_HOLES = (
    CUBE
    + """,
holes AS (
  SELECT stack_id, channel, frame, y, x,
         CASE WHEN frame = 8 AND y < 8 AND (y + x) % 3 = 2 THEN NULL ELSE intensity END AS intensity
  FROM cube
)"""
)

WIDE_CUBE = f"""
wd_cells AS (
  SELECT l_returnflag AS stack_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END::BIGINT AS channel,
         (month(l_shipdate) - 1)::BIGINT AS frame, l_suppkey % {WIDE} AS y, l_partkey % {WIDE} AS x, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL
),{_dense("wd", MONTHS, WIDE, WIDE)}"""


def faulty_sql(source, name="faulty"):
    """Sound series of ``source`` with the damaged images as missing samples, and the status rows of the others."""
    return f"""{name} AS (
  SELECT stack_id, channel, frame, y, x, CASE WHEN stack_id LIKE 'A%' AND frame IN (5, 9) THEN NULL ELSE intensity END AS intensity
  FROM {source} WHERE stack_id NOT LIKE 'R%'
),
{name}_status AS (
  SELECT DISTINCT stack_id, channel, 'mixed_sizes' AS status FROM {source} WHERE stack_id LIKE 'R%'
  UNION ALL
  SELECT DISTINCT stack_id, NULL::BIGINT, 'null_key' FROM {source} WHERE stack_id LIKE 'N%'
)"""


ROLLED = (
    CUBE
    + f""",
rolled AS (
  SELECT stack_id, channel, f.range AS frame, (y + f.range % 3) % {SIDE} AS y,
         ((x - (f.range * 2) % 5) + {SIDE}) % {SIDE} AS x, value AS intensity
  FROM (SELECT stack_id, channel, y, x, sum(intensity) AS value FROM cube GROUP BY ALL) b CROSS JOIN range(6) f
)"""
)

# Fixed values of the default acquisition: 20 nm, 50 us, 12.8 ms; focus 0.2 um, aspect 4.985423166.
SPACE = "(20.0e-3 * 20.0e-3 * (dx * dx + dy * dy))"
TIME = "abs(50.0e-6 * dx + 12.8e-3 * dy)"


def shape_sql(model, d, s="s_lag", t="t_lag"):
    spread = f"(4.0 * {d} * {t} + 0.2::DOUBLE * 0.2::DOUBLE)"
    value = f"((0.2::DOUBLE * 0.2::DOUBLE / {spread}) * exp(-{s} / {spread}))"
    if model == "3D":
        value = f"({value} / sqrt(1.0 + 4.0 * {d} * {t} / (0.2::DOUBLE * 0.2::DOUBLE * 4.985423166::DOUBLE * 4.985423166::DOUBLE)))"
    return value


def part_maps_sql(model="2D", half=16):
    return f"""
parts AS (
  SELECT p_partkey::VARCHAR || '_scan_RICScorr' AS stack_id, (p_partkey % 2)::BIGINT AS channel, p_partkey AS part,
         pow(10.0::DOUBLE, (p_size % 5) / 2.0::DOUBLE - 1.0) AS true_d,
         0.2::DOUBLE + (p_partkey % 7) * 0.1::DOUBLE AS true_a,
         a.range AS dy, b.range AS dx
  FROM part CROSS JOIN range(-{half}, {half}) a CROSS JOIN range(-{half}, {half}) b
),
placed AS (SELECT *, {SPACE}::DOUBLE AS s_lag, {TIME}::DOUBLE AS t_lag FROM parts),
maps AS (
  SELECT *, CASE WHEN dy = 0 AND dx = 0 THEN 0.0::DOUBLE ELSE
    true_a * {shape_sql(model, "true_d")}
    + 0.001::DOUBLE * ((((7 * dy + 3 * dx + part) % 5) + 5) % 5 - 2) END AS g, 10::BIGINT AS n_frames
  FROM placed
)"""


META = """
meta AS (
  SELECT s_suppkey::VARCHAR AS stack_id, s_suppkey AS k,
         CASE WHEN s_suppkey % 5 <> 0 THEN ((s_suppkey % 7 + 10) * 1e-9::DOUBLE) * 1e9::DOUBLE END AS pixel_size_nm,
         CASE WHEN s_suppkey % 5 <> 0 THEN ((s_suppkey % 9 + 1) * 1e-6::DOUBLE) * 1e6::DOUBLE END AS first_dwell
  FROM supplier
)"""
