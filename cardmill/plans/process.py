"""The whole way of a card: classify, load, validate. Map-only, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.contracts.shapes import Shape
from cardmill.functions.fence import fence
from cardmill.operators.classify import classify
from cardmill.operators.convert import load_section
from cardmill.operators.defaults import fill_defaults
from cardmill.operators.validate import validate


def process_cards(
    cards: DataFrame, shapes: dict[str, Shape], root: str = "$", *, fill: bool = False
) -> DataFrame:
    """Classified cards with their section and its violations, refused cards included.

    Refused cards have no section and NULL violations; nothing is dropped. With fill, missing fields of a
    section get the defaults of the shape of its card type before it is checked.
    """
    loaded = load_section(classify(cards)).withColumn(
        "section", F.when(F.col("reject_reason").isNull(), F.col("section"))
    )
    if fill:
        filled = F.col("section")
        for kind, shape in shapes.items():
            filled = F.when(F.col("card_type") == kind, fill_defaults(F.col("section"), shape)).otherwise(filled)
        loaded = fence(loaded.withColumn("section", filled), "section")
    checked = validate(loaded, shapes, doc="section", root=root)
    return checked.withColumns(
        {
            name: F.when(F.col("section").isNotNull(), F.col(name))
            for name in ("violations", "error_count", "is_valid")
        }
    )
