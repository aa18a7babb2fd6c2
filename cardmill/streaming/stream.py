"""The same card operators on a stream of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.functions.session import prepare_session
from cardmill.operators.registry import check_by_registry
from cardmill.sources.cards import file_cards, with_document

# Else a stream passes over files that are a week older than the newest one it has taken.
FOREVER = "36500d"


def card_stream(
    spark: SparkSession, path: str, *, files_per_batch: int = 10_000, recursive: bool = True
) -> DataFrame:
    """Cards of new files below a folder, as read_cards gives them for present files."""
    prepare_session(spark)
    files = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", FOREVER)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(path, wholetext=True)
    )
    return with_document(file_cards(files))


def write_card_stream(
    cards: DataFrame, path: str, checkpoint: str, file_format: str = "parquet"
) -> StreamingQuery:
    """Append to a table folder, taking what has arrived and then stopping.

    Both folders must be shared by all executors; the file sink's commit log makes
    each input file count once even when the query is restarted.
    """
    return (
        cards.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, made: Callable[[DataFrame], DataFrame], mode: str
) -> StreamingQuery:
    """What `made` gives for each micro-batch, in a folder of its number; a batch that is run again replaces its own."""

    def keep(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def check_stream_by_registry(
    cards: DataFrame,
    registry: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    *,
    columns: tuple[str, ...] = (),
    **options: str | None,
) -> StreamingQuery:
    """Check what has arrived by the schemas of a registry, and append it to a table with a `batch` column.

    The registry is a table at rest that `registry` reads anew for each micro-batch, so a schema that is added between
    two batches counts from the next one on; cards that are in the table stay as they were checked. `columns` are kept,
    all where none are given; `options` are those of check_by_registry.
    """

    def checked(batch: DataFrame) -> DataFrame:
        found = check_by_registry(batch, registry(), **options)
        return found.select(*columns) if columns else found

    return write_batches(cards, path, checkpoint, checked, "append")


def write_summary_stream(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a summary of a stream (violation_summary, intake_summary) up to date; read_summary gives it.

    Counts are state of the stream and survive a restart. A micro-batch writes only the groups that it changed, so what
    is written does not grow with what was counted before.
    """
    return write_batches(summary, path, checkpoint, lambda batch: batch, "update")


def read_summary(spark: SparkSession, path: str, counts: tuple[str, ...]) -> DataFrame:
    """The newest counts of each group that write_summary_stream has written."""
    rows = spark.read.parquet(path)
    keys = [name for name in rows.columns if name not in (*counts, "batch")]
    newest = F.max_by(F.struct(*counts), "batch").alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")
