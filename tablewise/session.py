"""Session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Calendar buckets and parsed dates carry no zone; UTC keeps them fixed.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key on one side of a sort-merge join is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Spark joins small shuffle partitions up to this size, compressed; sorts and hash tables of a task hold ten times as much and more.
ADVISORY, ADVISED, SPARKS_OWN = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m", ("67108864b", "64MB", "64m")


def build_session(app: str = "tablewise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(ADVISORY) in SPARKS_OWN:  # what somebody else set stays
        spark.conf.set(ADVISORY, ADVISED)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the shared folder in spark.checkpoint.dir; below one of our own only on a local master, which is one machine."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"{(shared or tempfile.mkdtemp(prefix='tablewise-scratch-')).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir; one of our own only on a local master, which is one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tablewise-checkpoint-"))
    return df.checkpoint(eager=True)
