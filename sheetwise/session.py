"""Session settings and shared folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "sheetwise") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``, or the program by ``setCheckpointDir``. Only
    a local master, where driver and executors share one machine, gets a temporary folder instead.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and re.match(r"local(\[|$)", context.master):
        folder = tempfile.mkdtemp(prefix="sheetwise-")
    if folder is None:
        raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"
