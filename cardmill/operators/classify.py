"""Decide format and card type, and say why a card is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions.fence import fence
from cardmill.functions.text import utf16_length
from cardmill.functions.json_text import compact_json
from cardmill.functions.values import Field, Fields, Record, as_text, json_path

# Keys that identify a card and the texts shown for it.
SECTION_KEY = {"model": "Model", "dataset": "Dataset"}
NAME_KEY = {"model": "model_name", "dataset": "dataset_name"}
NO_SCHEMA_TEXT = "Detected from content"

INVALID_FILE = "invalid_file"
TOO_LARGE = "too_large"
# Bytes beyond which Spark may refuse a sound JSON text: its parser takes strings up to this size.
LARGEST_TEXT = 20_000_000
NO_DATA = "no_data"
UNKNOWN_TYPE = "unknown_type"


# The few fields that tell what a card is.
HEAD = Fields(
    tuple((key,) for key in (*SECTION_KEY.values(), *NAME_KEY.values())),
    probed=frozenset((key,) for key in SECTION_KEY.values()),
)


def detect_format(file_name: Column, head: Record) -> Column:
    """'txt' for the flat layout, 'json' for the nested one; the file name decides first."""
    name = F.lower(file_name)
    flat = head.at(NAME_KEY["model"]).truthy | head.at(NAME_KEY["dataset"]).truthy
    return (
        F.when(name.endswith(".txt"), "txt")
        .when(name.endswith(".json"), "json")
        .when(flat, "txt")
        .otherwise("json")
    )


def detect_card_type(head: Record) -> Column:
    """'model' wins over 'dataset' when a card holds both."""
    found = F
    for kind in ("model", "dataset"):
        known = head.at(SECTION_KEY[kind]).truthy | head.at(NAME_KEY[kind]).truthy
        found = found.when(known, kind)
    return found.otherwise("unknown")


def reject_reason(doc: Column, card_type: Column, raw: Column) -> Column:
    """Why a card cannot be loaded, NULL when it can.

    A text that gives no value and is longer than the engine takes a single value may be sound JSON, so it is
    not called broken.
    """
    return (
        F.when(doc.isNull() & (F.octet_length(raw) > LARGEST_TEXT), TOO_LARGE)
        .when(doc.isNull() | F.is_variant_null(doc), INVALID_FILE)
        .when(card_type != "unknown", None)
        .when(~Field(doc).truthy, NO_DATA)
        .otherwise(UNKNOWN_TYPE)
    )


def classify(cards: DataFrame) -> DataFrame:
    """Add format, card_type and reject_reason. Map-only, batch or stream."""
    head = HEAD.record("head")
    typed = HEAD.stage(cards, "head", F.col("doc")).withColumns(
        {
            "format": detect_format(F.col("file_name"), head),
            "card_type": detect_card_type(head),
        }
    )
    reason = reject_reason(F.col("doc"), F.col("card_type"), F.col("raw"))
    classified = HEAD.unstage(typed.withColumn("reject_reason", reason), "head")
    return fence(classified, "format", "card_type", "reject_reason")


def card_preview(cards: DataFrame) -> DataFrame:
    """Add what a user sees of a classified card before it is loaded."""
    doc = F.col("doc")
    kind = F.col("card_type")
    title = F.concat(F.upper(F.substring(kind, 1, 1)), F.expr("substring(card_type, 2)"))
    schema = Field(F.try_variant_get(doc, json_path("$schema"), "variant"))
    return cards.withColumns(
        {
            "format_text": F.upper("format"),
            "type_text": F.concat(title, F.lit(" Card")),
            "size_chars": utf16_length(compact_json(doc)),
            "schema_text": F.when(schema.truthy, as_text(schema)).otherwise(NO_SCHEMA_TEXT),
        }
    )


def split_rejects(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted cards, and refused ones with their reject_reason."""
    refused = F.col("reject_reason").isNotNull()
    return cards.filter(~refused), cards.filter(refused)
