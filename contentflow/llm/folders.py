"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`. Only a local session may do without that setting, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="contentflow-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/contentflow-llm/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: later uses read it, and its lineage ends there.

    A table also has sizes of its own. A checkpoint keeps the estimate of the plan behind it, and in a loop of joins those
    estimates multiply without end.

    Tables are left in the shared folder, because the frames that read them are lazy; whoever owns the folder
    clears it, as with checkpoints.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
