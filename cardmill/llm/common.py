"""What the operators of this package share: reading, cutting lineage, hashing words in bulk."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.session import scratch_path

#: Characters that part words: space, and tab to carriage return. `bytes.split()` parts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a task hands to Python at once.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole(text: str | Column) -> Column:
    """A whole text; NULL is the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, where all executors can read what one has written.

    Only a local session that has none gets one; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, so that a lost executor costs no earlier work."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows as Parquet in the shared folder, for a table of which later steps read some columns each."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_transfers(spark: SparkSession) -> None:
    """From now on texts go to Python and back in batches of at most 1,000 rows; a smaller setting stays.

    Spark's 10,000 texts are held several times at once: in buffers outside the JVM's heap on both ways, and in Python
    as received, as objects and as results.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, merge: bool = False) -> DataFrame:
    """An equality join with a side whose keys are unique and tell in `_count` how many rows on the left have them.

    A key that holds more than a small part of one task's share would land in one task. There are at most 8 such
    keys for each shuffle partition, so their rows are looked up from a copy in each task; the rest is shuffled.
    """
    partitions = shuffle_partitions(left.sparkSession)
    total = right.agg(F.sum("_count")).first()[0] or 0
    bound = total // (8 * partitions) + 1
    heavy, light = right.filter(F.col("_count") > bound), right.filter(F.col("_count") <= bound)
    few = left.join(F.broadcast(heavy.drop("_count")), on)
    light = light.drop("_count")
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge") if merge else light, on, how)
    return few.unionByName(rest)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
