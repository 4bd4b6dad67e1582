"""Exact duplicates by stateful streaming: a keyed state on disk remembers every digest that has ever arrived.

The state of a digest is the stable identifier of the row that stays, a locator of its content (file and row) and the
number of arrivals.  It never expires.  A digest that arrives again is a hit; hits are settled by their full bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.llm.common import fold_case, materialize, passing_tables, remove, scratch

#: State on disk.  A store's files are not given their space ahead, as there are many small stores; only changes are uploaded.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


def _arrivals(source: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    """What is known of a row on arrival: digest, and the row's identifier with the locator of its content."""
    folded = fold_case(F.col(text))
    return source.select(
        F.struct(
            F.col(doc_id).alias("doc_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("at"),
        folded.alias("folded"),
        digest(folded).alias("digest"),
    )


def remember(
    spark: SparkSession,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    batch_bytes: int = 256 << 20,
    digest=sha256,
    folder: str | None = None,
) -> DataFrame:
    """Stream all files below ``path`` through the state; one row per digest: ``digest, keep, n``.

    ``folder`` holds the stream's checkpoint and its updates.  With the folder of an earlier call only files that
    have come since are read: the state goes on where it was, also after a failure.
    """
    folder = folder or scratch(spark, "dedup-stream")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    place, files = _hadoop_path(spark, path)
    if files.getFileStatus(place).isFile():  # a stream watches folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    source = reader.parquet(path)
    state = (
        _arrivals(source, doc_id, text, digest)
        .groupBy("digest")
        .agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    )

    def put(batch, number):
        # one folder per batch, replaced when a batch is run again: updates are neither lost nor doubled
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(put)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    place, files = _hadoop_path(spark, f"{folder}/updates")
    if not files.exists(place):
        return spark.createDataFrame([], "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint")
    updates = spark.read.option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")
    last = updates.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s"))
    return last.select("digest", "s.keep", "s.n")


def _hadoop_path(spark, path):
    """A path and its file system, whatever the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exact_dedup_files(
    spark: SparkSession,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    batch_bytes: int = 256 << 20,
    digest=sha256,
) -> DataFrame:
    """Every row of the Parquet files with ``keep_id, group_size, kept, text_sha256`` added.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the
    largest ``doc_id`` stays (null is smallest; among repeated rows the one last in its file), so exactly one row of
    each group is kept.  A hit is checked by grouping the full texts under its digest: where a digest has more than
    one text, these groups decide instead of the state.  A group of any size is counted in the tasks that read it
    before rows meet.  An empty table gives no rows; further columns pass through.
    """
    folder = scratch(spark, "dedup-stream")
    known = materialize(remember(spark, path, doc_id, text, batch_bytes, digest, folder), "dedup-known")
    remove(spark, folder)  # the stream has come to its end
    rows = _arrivals(spark.read.parquet(path), doc_id, text, digest)
    hits = rows.join(known.where("n > 1").select("digest"), "digest", "left_semi")
    texts = hits.groupBy("digest", "folded").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    mixed = materialize(texts.groupBy("digest").count().where("count > 1").select("digest"), "dedup-mixed")

    settled = rows.join(known, "digest").select("at", "digest", "keep", "n")
    if not mixed.isEmpty():  # one digest, several texts: the texts themselves are the key
        alone = rows.join(known.join(mixed, "digest", "left_anti"), "digest").select("at", "digest", "keep", "n")
        apart = rows.join(mixed, "digest", "left_semi").join(
            texts.join(mixed, "digest", "left_semi"), ["digest", "folded"]
        )
        settled = alone.unionByName(apart.select("at", "digest", "keep", "n"))
    return settled.select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("at") == F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("at.file").alias("file"),
        F.col("at.row").alias("row"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 256 << 20) -> DataFrame:
    """``docs`` without the rows that are exact copies of another; same columns.

    A stream needs a source that can be read again: a plain scan of Parquet files is streamed from where they lie, rows
    of any other kind are written to the shared folder first.
    """
    spark = docs.sparkSession
    source, path = docs, _scanned_folder(docs)
    if path is None:
        path = scratch(spark, "dedup-source")
        docs.write.parquet(path)
        source = spark.read.schema(docs.schema).parquet(path)
    with passing_tables(spark):
        judged = exact_dedup_files(spark, path, doc_id, text, batch_bytes)
        drop = judged.where("NOT kept").select(F.col("file").alias("__file__"), F.col("row").alias("__row__"))
        drop = materialize(drop, "dedup-drop", keep=True)
    placed = source.select(
        "*", F.col("_metadata.file_path").alias("__file__"), F.col("_metadata.row_index").alias("__row__")
    )
    return placed.join(drop, ["__file__", "__row__"], "left_anti").select(*docs.columns)


def _scanned_folder(docs: DataFrame) -> str | None:
    """The folder, if ``docs`` is nothing but a scan of all Parquet files of one folder."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        return None
    roots = plan.relation().location().rootPaths()
    return roots.head().toString() if roots.size() == 1 and not docs.isStreaming else None
