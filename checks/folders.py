"""Where the queries that store something put it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from contentflow import session


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. A local session that names none gets a temporary one; a cluster must name it."""
    context = spark.sparkContext
    unset = spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="contentflow-"))
    return session.work_folder(spark, name)
