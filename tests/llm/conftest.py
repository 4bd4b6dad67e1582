import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """All tables that operators write go to one folder of the test run."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    spark.conf.set("spark.sql.shuffle.partitions", "3")


@pytest.fixture
def make(spark):
    """A documents table from texts, or from (doc_id, text, lang, source) rows."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)

    return build


@pytest.fixture
def clash(spark):
    """Adds columns with the names that operators use for themselves."""

    def add(df):
        for name in ("n", "size", "hash", "kept", "key", "bucket", "n_words", "clean_text", "digest", "k", "a", "b"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add


def plain_words(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] if now else out


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
