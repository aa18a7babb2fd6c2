"""Range shards of near equal size by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.common import cut, shuffle_partitions, whole

#: Draws of the key sample for each range; the error of a boundary falls with its square root.
DRAWS = 64
#: A range that holds more than this many times its share is subdivided.
OVERFULL = 2


def range_of(key: Column, boundaries: list[int]) -> Column:
    """How many boundaries are at or below a key, by binary search in a literal array."""
    if not boundaries:
        return F.lit(0)
    bounds = F.array(*[F.lit(x).cast("long") for x in boundaries])
    steps = [1 << b for b in range(len(boundaries).bit_length() - 1, -1, -1)]
    count = F.lit(len(boundaries))

    def step(at: Column, add: Column) -> Column:
        fits = (at + add <= count) & (F.get(bounds, F.least(at + add, count) - 1) <= key)
        return F.when(fits, at + add).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def sampled_boundaries(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Key quantiles by size: each row is drawn in proportion to its size, large rows several times.

    The draw depends on the row alone, so a task that runs again draws the same rows. Only the sketch of the
    sample reaches the driver, at most `ranges - 1` numbers.
    """
    chance = F.col("_size") * (DRAWS * ranges / total)
    share = F.pmod(F.xxhash64("_tie", "_key", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select("_key", F.floor(chance + share).cast("int").alias("draws")).filter("draws > 0")
    keys = drawn.select(F.explode(F.array_repeat("_key", F.col("draws"))).alias("_key"))
    marks = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("_key", marks, 20 * ranges).alias("marks")).first()["marks"]
    return sorted(set(found or []))


def range_shards(
    records: DataFrame, key: Column, tie: Column, size: Column, shards: int, *, kept: list[str]
) -> DataFrame:
    """Give each record a shard (0 to `shards` - 1, near equal sums of size) and a slot there (from 0, gapless).

    The columns `kept` come back with `shard` and `slot`; all others are dropped, so no name can clash.

    `key` is a long that orders the records; `tie` a long that orders records of one key. Records are placed by
    size: the key range is cut at sampled size quantiles, a range that holds more than its share (a key that many
    records have) is subdivided by the hash of `tie`, and a record goes to the shard in which the middle of its
    stretch of the overall order lies. A shard is off its share by one record's size at most.

    NULL sizes count 0, NULL keys count as 0. A NULL tie is the row's place in the stored table, so any number of such
    records of one key can be subdivided. Repeated records each get a slot. An empty table gives none.
    """
    spark = records.sparkSession
    rows = cut(
        records.select(
            F.struct(*kept).alias("_kept"),
            F.coalesce(key, F.lit(0)).alias("_key"),
            F.coalesce(tie, F.monotonically_increasing_id()).alias("_tie"),
            F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        )
    )
    totals = rows.agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).first()
    total = max(totals["bytes"] or 0, 1)
    # A range must be a small part of a shard and few enough records to be sorted by one task.
    ranges = max(8 * shards, 2 * shuffle_partitions(spark), totals["rows"] // 1_000_000)
    boundaries = sampled_boundaries(rows, total, ranges)
    ranged = rows.withColumn("_range", range_of(F.col("_key"), boundaries))
    # One number for each range: how many parts it is cut into.
    filled = ranged.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
    fair_bytes, fair_rows = total / ranges, totals["rows"] / ranges
    parts = [1] * (len(boundaries) + 1)
    for x in filled:
        fill = max(x["bytes"] / fair_bytes, x["rows"] / fair_rows)
        parts[x["_range"]] = int(fill) + 1 if fill > OVERFULL else 1
    pieces = F.get(F.array(*[F.lit(p) for p in parts]), F.col("_range"))
    ranged = ranged.withColumn("_part", F.pmod(F.xxhash64("_tie", F.lit(7)), pieces).cast("int"))

    order = Window.partitionBy("_range", "_part").orderBy("_key", "_tie", "_size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # At most twice as many rows as ranges, so one task may sum them up and all may have a copy.
    starts = ranged.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"))
    starts = starts.select(
        "_range",
        "_part",
        F.coalesce(
            F.sum("_bytes").over(Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
    )
    placed = ranged.select(
        "*",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.row_number().over(order).cast("long").alias("_rank"),
    ).join(F.broadcast(starts), ["_range", "_part"])
    middle = 2 * (F.col("_start") + F.col("_before")) + F.col("_size")
    # Divided before it is multiplied: whole shares and the rest apart, so no product passes a long.
    shard = F.floor(middle / F.lit(2 * total / shards)).cast("int")
    placed = placed.withColumn("shard", F.greatest(F.lit(0), F.least(F.lit(shards - 1), shard)))
    runs = placed.groupBy("_range", "_part", "shard").agg(F.count("*").alias("_count"), F.min("_rank").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_range", "_part", "shard", (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return placed.join(F.broadcast(runs), ["_range", "_part", "shard"]).select(
        "_kept.*", "shard", (F.col("_rank") + F.col("_shift")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of near equal bytes; equal texts stand side by side unless they overfill a range.

    Returns doc_id, size (UTF-8 bytes and 8; NULL text: 8), text_crc32, shard and slot. Documents without an id are
    kept. Empty and very long texts are records like any other: a text is never cut.
    """
    told = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole(text)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(whole(text)).alias("text_crc32"),
        F.xxhash64(whole(text)).alias("group"),
    )
    tie = F.col("doc_id").cast("long")
    return range_shards(told, F.col("group"), tie, F.col("size"), shards, kept=["doc_id", "size", "text_crc32"])
