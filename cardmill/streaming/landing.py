"""Land small card files once in a table, so that later jobs read few large files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.functions.session import prepare_session
from cardmill.sources.cards import file_cards
from cardmill.streaming.stream import FOREVER, write_batches

GROUP_BYTES = 128 * 1024 * 1024
# Opening a file counts as so many bytes, so that a task is not given thousands of tiny files.
OPEN_BYTES = 64 * 1024


def land_cards(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    *,
    files_per_batch: int = 100_000,
    group_bytes: int = GROUP_BYTES,
    open_bytes: int = OPEN_BYTES,
    recursive: bool = True,
) -> StreamingQuery:
    """Append the files below `path` that the table does not hold yet, each exactly once; landed_cards reads them.

    The checkpoint is the ledger of landed files. A run takes what has arrived and stops; a batch that was broken off
    is done again in place of what it left. Which files are new goes by their path: files are taken as finished when
    they appear, whatever their age, and one that is rewritten later is not taken again. A file without a byte gives no
    row, as in read_cards.

    Files are packed by size: each task reads files of about `group_bytes` together and writes one Parquet file, without
    a shuffle. A batch smaller than that for each core is dealt out over the cores. The driver holds the list of file
    names, as for any folder that Spark reads; land folders of more than some ten million files one by one.
    """
    # A session of its own, as these settings decide how its files are grouped.
    own = prepare_session(spark.newSession())
    own.conf.set("spark.sql.files.maxPartitionBytes", str(group_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(open_bytes))
    files = (
        own.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", FOREVER)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(path, wholetext=True)
    )
    known = file_cards(
        files,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    return write_batches(known, table, checkpoint, lambda batch: batch, "append")


def landed_cards(spark: SparkSession, table: str) -> DataFrame:
    """file_name, raw, file_path, file_size, modified and batch of all landed files; cards_from_table parses them."""
    return spark.read.parquet(table)
