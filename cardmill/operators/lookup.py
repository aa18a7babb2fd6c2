"""Join cards with a lookup table without one hot key ending up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(
    lookup: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Measure the lookup with one small aggregation: row count and JSON bytes."""
    row_bytes = F.octet_length(F.to_json(F.struct("*")))
    measured = lookup.agg(F.count("*").alias("n"), F.sum(row_bytes).alias("bytes")).first()
    return measured["n"] <= rows and (measured["bytes"] or 0) <= size


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", *, shuffle: bool | None = None
) -> DataFrame:
    """Join on keys (left, inner, left_semi or left_anti): broadcast a lookup that was measured as small, else shuffle.

    shuffle says which way to go where the lookup was measured before; False measures nothing and is for a
    lookup whose size is known to be bounded.
    """
    if shuffle is None:
        shuffle = not fits_broadcast(lookup)
    if not shuffle:
        return facts.join(F.broadcast(lookup), keys, how)
    return skewed_join(facts, lookup, keys, how)


def skewed_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A shuffled join in which no key of the facts is too large for a task.

    The most frequent keys, a few for each shuffle partition, are looked up from a copy in every task. Any other
    key holds less than a task's share of the rows. Rows with a NULL key match nothing and are not shuffled.
    Send only the columns that are needed through it: each of them is shuffled.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = F.lit(True)
    for key in keys:
        given = given & F.col(key).isNotNull()
    whole = facts.filter(given)
    counts = whole.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = counts.orderBy(F.desc("_rows"), *keys).limit(4 * partitions).select(*keys)
    few = lookup.join(F.broadcast(hot), keys, "left_semi")
    at_hand = whole.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    rest = whole.join(F.broadcast(hot), keys, "left_anti").join(lookup.hint("merge"), keys, how)
    joined = at_hand.unionByName(rest)
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(facts.filter(~given), allowMissingColumns=True)
