"""Write cards: nested JSON or flat text, partitioned by card type and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions.fence import fence
from cardmill.functions.json_text import indented_json
from cardmill.operators.convert import EXPORT_RELEASE, nested_to_flat, wrap_envelope

# Why a card has no line.
UNKNOWN_TYPE = "unknown_type"
NO_SECTION = "no_section"
NOT_MAPPABLE = "not_mappable"


def preview_json(value: Column) -> Column:
    """Indented JSON text of a VARIANT, for display."""
    return indented_json(value)


def utc_day(moment: Column | None = None) -> Column:
    """UTC calendar day of a timestamp, of now when none is given."""
    moment = F.current_timestamp() if moment is None else moment
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd")


def export_name(card_type: Column, family: str, day: Column, ending: str) -> Column:
    """File name a single exported card goes by."""
    return F.concat(F.lit(f"{family.lower()}-"), card_type, F.lit("-"), day, F.lit(ending))


def with_refusal(cards: DataFrame) -> DataFrame:
    """Add refusal: why a card got no line, NULL where it did."""
    known = F.coalesce(F.col("card_type").isin("model", "dataset"), F.lit(False))
    reason = (
        F.when(F.col("value").isNotNull(), None)
        .when(~known, UNKNOWN_TYPE)
        .when(F.col("section").isNull(), NO_SECTION)
        .otherwise(NOT_MAPPABLE)
    )
    return fence(cards.withColumn("refusal", reason), "value", "refusal")


def nested_lines(cards: DataFrame, family: str, release: str = EXPORT_RELEASE) -> DataFrame:
    """Add value, one line of nested JSON for a card with section and card_type, and refusal."""
    card = wrap_envelope(F.col("section"), F.col("card_type"), family, release)
    return with_refusal(cards.withColumn("value", F.to_json(card)))


def flat_lines(cards: DataFrame) -> DataFrame:
    """Add value, one line of flat JSON for a card with section and card_type, and refusal."""
    flat = nested_to_flat(cards, into="_flat")
    return with_refusal(flat.withColumn("value", F.to_json("_flat")).drop("_flat"))


def write_lines(lines: DataFrame, path: str, day: str | None) -> DataFrame:
    written = lines.filter(F.col("refusal").isNull()).select(
        "card_type", (F.lit(day) if day else utc_day()).alias("export_date"), "value"
    )
    written.write.mode("errorifexists").partitionBy("card_type", "export_date").text(path)
    return lines.filter(F.col("refusal").isNotNull()).drop("value")


def export_nested(
    cards: DataFrame,
    path: str,
    *,
    family: str,
    release: str = EXPORT_RELEASE,
    day: str | None = None,
) -> DataFrame:
    """Write nested cards, one a line, under card_type=…/export_date=…

    Returns the cards that were not written, with the reason in refusal; written and returned
    cards together are all cards. Pass the day to make reruns equal.
    """
    return write_lines(nested_lines(cards, family, release), path, day)


def export_flat(cards: DataFrame, path: str, *, day: str | None = None) -> DataFrame:
    """Write flat cards, one a line, under card_type=…/export_date=…; returns those not written."""
    return write_lines(flat_lines(cards), path, day)
