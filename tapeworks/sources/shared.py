"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """Where intermediate tables go: what the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is set and everything runs in one process (tests) is a temporary folder made and
    set as the checkpoint folder; a cluster's executors could not see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tapeworks-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/tapeworks/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_shared(spark: SparkSession) -> None:
    """Deletes every table and archive this library left in the shared folder. Results that still read
    from one are lost, so this is for when a session's results have been written elsewhere."""
    delete_path(spark, f"{shared_root(spark)}/tapeworks")
