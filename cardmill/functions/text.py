"""Text expressions: labelled paragraphs, leading integers, text length."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a card reader trims and skips.
SPACE = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
PARAGRAPH = "\n\n"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def join_present(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither NULL nor empty."""
    return F.concat_ws(separator, *[F.nullif(part, F.lit("")) for part in parts])


def labelled(label: str, text: Column) -> Column:
    """'label: text', or NULL when there is no text."""
    return F.when(text != "", F.concat(F.lit(f"{label}: "), text))


def labelled_text(text: Column, label: str) -> Column:
    """Text after the first 'label:' up to the line end, '' when there is none.

    The label may stand anywhere and in any letter case, and white space after the
    colon may run over line ends, so an empty entry yields the next line.
    """
    pattern = rf"(?i){re.escape(label)}:{SPACE}*([^\n]+)"
    return F.coalesce(trim_space(F.regexp_extract(text, pattern, 1)), F.lit(""))


def first_paragraph(text: Column) -> Column:
    return F.substring_index(text, PARAGRAPH, 1)


def leading_integer(text: Column) -> Column:
    """Integer at the start of a text (decimal, or hexadecimal after 0x) as VARIANT, else NULL.

    Up to 38 digits it is exact; a longer run of digits gives the nearest double, as does one of more
    than 15 hexadecimal digits, and JSON null where no double is large enough.
    """
    hexa = F.regexp_extract(text, rf"\A{SPACE}*[+-]?0[xX]0*([0-9a-fA-F]+)", 1)
    sign = F.when(text.rlike(rf"\A{SPACE}*-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_extract(text, rf"\A{SPACE}*([+-]?[0-9]+)", 1)
    exact_hexa = F.when(F.length(hexa) <= 15, F.conv(hexa, 16, 10).try_cast("bigint") * sign)
    folded = F.aggregate(
        F.split(hexa, ""), F.lit(0.0), lambda sum_, digit: sum_ * 16 + F.conv(digit, 16, 10).try_cast("double")
    )
    return F.when(
        hexa != "", F.coalesce(exact_hexa.cast("variant"), finite(folded * sign))
    ).otherwise(F.coalesce(digits.try_cast("decimal(38,0)").cast("variant"), finite(digits.try_cast("double"))))


def finite(number: Column) -> Column:
    """A double as VARIANT; JSON null where it is infinite or no number."""
    beyond = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(beyond, F.parse_json(F.lit("null"))).otherwise(number.cast("variant"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")
