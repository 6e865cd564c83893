"""Session settings the operators are written for."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; a cluster's own master and settings stay where given."""
    builder = SparkSession.builder.config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one that ``spark.checkpoint.dir`` names. In local mode without
    that setting it is a temporary one, deleted at exit; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def tasks(spark: SparkSession, rows: int, most: int) -> int:
    """Into how many tasks rows of like cost are dealt where their bytes say nothing about it: at most
    ``most`` rows each, and all cores have a share if there are some hundred rows a core."""
    return max(-(-rows // most), min(4 * spark.sparkContext.defaultParallelism, -(-rows // 100)), 1)
