"""A fresh folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where the session names none, a local one, but only on one machine."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="tidemark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return path.toString()
