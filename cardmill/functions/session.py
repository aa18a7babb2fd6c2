"""Session settings and the shared folder that jobs may write scratch tables to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

KEEP_LAST_KEY = "spark.sql.variant.allowDuplicateKeys"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Keep the last of duplicate JSON keys instead of refusing the whole card; set once a session."""
    if spark.conf.get(KEEP_LAST_KEY, "false") != "true":
        spark.conf.set(KEEP_LAST_KEY, "true")
    return spark


@cache
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="cardmill-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share; removed when the application ends.

    The folder is the one named in spark.checkpoint.dir. Only a session that runs in one local process can
    do without; anywhere else each executor would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = local_folder()
    path = f"{shared.rstrip('/')}/cardmill/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path
