"""Session settings that every part of the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "meterlark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on.

    On a cluster, leave ``master`` out and let spark-submit set it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench.py."""
    n = cpus or os.cpu_count() or 4
    return build_session(
        master=f"local[{n}]",
        **{"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine stands in, but only if driver and executors are one process.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterlark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")
