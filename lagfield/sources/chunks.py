"""Image series at rest in the partitioning that the correlation job works on."""

from collections import namedtuple

from pyspark.sql import functions as F

from lagfield.schema import KEYS

#: ``chunks`` with the copies at their borders, ``frames`` without, ``status`` of series that have none, and how they were placed.
Stored = namedtuple("Stored", "chunks frames status window reps chunk")
PLACED = ("window", "reps", "chunk")


def write_chunks(placed, status, table, window, reps, chunk=None, path=None, buckets=None):
    """Store what :func:`lagfield.plans.store.store_chunks` has placed, bucketed by series and group of chunks.

    ``table`` and ``table_status`` are new tables of the catalog, below ``path`` if one is given.  Each bucket is one
    file, written by one task.  ``buckets`` is by default the number of shuffle partitions; with fewer than that Spark
    would shuffle the images again.
    """
    spark = placed.sparkSession
    buckets = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    on = [*KEYS, "group"]
    rows = placed.repartition(buckets, *on)
    writer = rows.write.format("parquet").bucketBy(buckets, *on).sortBy(*on, "chunk", "frame")
    side = status.write.format("parquet")
    if path is not None:
        writer, side = writer.option("path", f"{path}/chunks"), side.option("path", f"{path}/status")
    side.saveAsTable(f"{table}_status")
    writer.saveAsTable(table)
    values = dict(zip(PLACED, (window, reps, chunk)))
    listed = ", ".join(f"'lagfield.{k}' = '{v}'" for k, v in values.items() if v is not None)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({listed})")


def read_chunks(spark, table):
    """The images of :func:`write_chunks`; frames carry their position in the series."""
    listed = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    window, reps, chunk = (int(listed[f"lagfield.{k}"]) if f"lagfield.{k}" in listed else None for k in PLACED)
    if window is None:
        raise ValueError(f"{table} was not written by write_chunks")
    chunks = spark.table(table)
    own = chunks.where(F.expr("frame div _span") == F.col("chunk")).select(*KEYS, "frame", "height", "width", "pixels")
    return Stored(chunks, own, spark.table(f"{table}_status"), window, reps, chunk)
