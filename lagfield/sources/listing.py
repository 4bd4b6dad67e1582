"""Input files of a folder."""

from pyspark.sql import functions as F

from lagfield.functions.paths import extension, folder, stem


def _any_case(text):
    """Glob that matches ``text`` in any case."""
    special = set("*?[]{}\\,")
    parts = []
    for ch in text:
        if ch.lower() != ch.upper():
            parts.append(f"[{ch.lower()}{ch.upper()}]")
        else:
            parts.append(f"\\{ch}" if ch in special else ch)
    return "".join(parts)


def list_inputs(spark, path, ext, suffix=""):
    """Files of one folder with an extension and an ending of their stem.

    Case does not matter; an empty suffix takes all.  Only file facts are read,
    never contents, and the name test already applies to the listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*" + _any_case(suffix + ext))
        .load(path)
        .select("path", "length")
    )
    name = F.col("path")
    wanted = (F.lower(extension(name)) == ext.lower()) & F.lower(stem(name)).endswith(suffix.lower())
    return files.where(wanted).select(
        "path",
        folder(name).alias("folder"),
        stem(name).alias("stem"),
        extension(name).alias("extension"),
        F.col("length").alias("n_bytes"),
    )
