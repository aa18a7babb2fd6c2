"""Summaries over a corpus. Rows are counted inside each card and before the shuffle, so no group is ever
held whole by one task. Keys that cards choose themselves are part of a path, so the number of groups can
grow with the corpus; it is spread over the shuffle like any other key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation_summary(checked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cards affected and violations per path pattern and keyword.

    The pattern is the path with a star for each position in a list; validation gives it beside the path, as
    a key may itself look like a position. Each card gives one row for each different pattern and keyword
    with its count, so the number of cards is a plain count.
    """
    keys = F.transform(
        "violations", lambda v: F.struct(v["pattern"].alias("path"), v["keyword"].alias("keyword"))
    )

    def counted(key: Column) -> Column:
        times = F.size(F.filter("keys", lambda k: k == key)).cast("bigint")
        return F.struct(key["path"].alias("path"), key["keyword"].alias("keyword"), times.alias("times"))

    entries = F.transform(F.array_distinct("keys"), counted)
    return (
        checked.select(*by, keys.alias("keys"))
        .select(*by, F.explode(entries).alias("entry"))
        .groupBy(*by, "entry.path", "entry.keyword")
        .agg(F.count("*").alias("cards"), F.sum("entry.times").alias("violations"))
    )


def intake_summary(classified: DataFrame) -> DataFrame:
    """Cards per format, card type and parse status."""
    return classified.groupBy("format", "card_type", "parse_ok").agg(F.count("*").alias("cards"))
