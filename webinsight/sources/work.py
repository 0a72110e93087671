"""The folder for tables that a query writes: shared on a cluster, temporary on a single machine."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="webinsight-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/{name}-{uuid.uuid4().hex}"
