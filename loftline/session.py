"""Session defaults.  A cluster supplies its own; these fill gaps for local runs and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "loftline", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra) -> SparkSession:
    """A session with UTC days, adaptive plans and skew-join splitting switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs milliseconds per column operation when plans are built
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update({k: str(v) for k, v in extra.items()})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder the cluster names for checkpoints; a fallback is used only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return named
    if fallback:
        spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def work_folder(spark: SparkSession) -> str:
    """A new folder's name where every executor can read and write: under the shared checkpoint folder.

    A local session without one gets a temporary folder; on a cluster that is an error.
    """
    shared = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="loftline-")
    return f"{shared}/{uuid.uuid4().hex}"
