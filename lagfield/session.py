"""Session settings the operators are written for."""

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Run-time settings; all may be overridden by the cluster's own defaults file.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # one numeric thread per task: Spark already runs one task per core
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def build_session(app_name="lagfield", **overrides):
    """A session with the recommended settings (``overrides`` use ``__`` for ``.``)."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where none is named and driver and tasks run in one process (tests), a temporary folder is made and set.
    On a cluster without the setting this is an error: a local folder there would be another one on each machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lagfield-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_folder(spark, purpose):
    """A fresh folder below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
