"""Card sources: whole JSON files, a table column, or a stream of files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.fence import fence
from cardmill.functions.session import prepare_session


# A task gets at most so many bytes of a table that is dealt out, and a table with more than SPREAD_BYTES of long texts
# stays as its files are split.
TASK_BYTES = 1024 * 1024
SPREAD_BYTES = 1024 * 1024 * 1024


def spread(table: DataFrame, most_bytes: int | None = SPREAD_BYTES) -> DataFrame:
    """The same rows over all cores, in tasks of at most TASK_BYTES.

    A row group is read by one task, and parsing and checking cards costs far more than dealing out their rows: left
    as the files are split, a table of narrow rows gives a task millions of cards. Tables of more than most_bytes (None:
    of any size) have splits enough for what a byte costs and are not shuffled, nor are streams.
    """
    if table.isStreaming:
        return table
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if most_bytes is not None and size > most_bytes:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores * max(1, math.ceil(size / (cores * TASK_BYTES))))


def file_cards(files: DataFrame, *more: Column) -> DataFrame:
    """Name and text of whole-file rows, and columns of one's own; the reader reports names percent-encoded."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("file_name"), F.col("value").alias("raw"), *more)


def with_document(cards: DataFrame, raw: str = "raw") -> DataFrame:
    """Add doc (NULL when the text is not exactly one JSON value) and parse_ok.

    The built-in parser stops after the first value and ignores what follows, so
    the text is parsed as the first of two list elements; the second is a hash of
    the text, and only a text that is one complete value leaves it in place.
    """
    text = F.regexp_replace(raw, r"\A\x{FEFF}", "")
    seal = F.concat(F.lit("k"), F.xxhash64(raw).cast("string"))
    sealed = F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))
    whole = F.try_variant_get(F.get("_parsed", 1), "$", "string") == seal
    alone = F.size("_parsed") == 2
    doc = F.when(whole & alone, F.get("_parsed", 0))
    # A column of its own, so that the text is parsed once; elements are read at once, as a path to none costs an exception.
    parsed = (
        cards.withColumn("_parsed", F.try_variant_get(F.try_parse_json(sealed), "$", "array<variant>"))
        .withColumn("doc", doc)
        .drop("_parsed")
        .withColumn("parse_ok", F.col("doc").isNotNull())
    )
    return fence(parsed, "doc", "parse_ok")


def read_cards(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """One row per file: file_name, raw, doc, parse_ok. Files of subfolders too, unless recursive is off.

    Files are read whole and cannot be split, so land a corpus of small files in a
    Parquet table once (land_cards) and go on from there with cards_from_table.
    """
    prepare_session(spark)
    files = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return with_document(file_cards(files.text(path, wholetext=True)))


def cards_from_table(
    table: DataFrame, json_column: str = "raw", name_column: str | None = None
) -> DataFrame:
    """Cards held in a string column; the other columns of the table are kept."""
    prepare_session(table.sparkSession)
    name = F.col(name_column) if name_column else F.lit("").cast("string")
    cards = table.withColumn("file_name", name).withColumn("raw", F.col(json_column))
    return with_document(cards)
