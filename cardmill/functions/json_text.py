"""JSON text of a VARIANT as a script prints it: numbers, compact and indented."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, a bracket, comma or colon, or any other scalar. The quantifiers give nothing back,
#: so that long strings need no deep stack.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'
#: Numbers that Spark prints in another way than a script: whole doubles, exponents, tiny decimals.
ODD_NUMBER = r"\A-?[0-9]+\.(?:0|[0-9]+E-?[0-9]+|000000[0-9]*)\z"
ODD_INSIDE = r"[0-9]\.(?:0(?![0-9])|[0-9]+E|000000)"
#: Tokens whose depth is summed up at once.
BLOCK = 256


def odd_number(text: Column) -> Column:
    return text.rlike(ODD_NUMBER)


def number_text(text: Column) -> Column:
    """Text of a number: no exponent from 1e-6 up to 1e21, no fraction where it is whole."""
    number = text.try_cast("double")
    size = F.abs(number)
    short = F.regexp_replace(number.cast("string"), r"\.0E", "E")
    exponent = F.regexp_replace(F.replace(short, F.lit("E-"), F.lit("e-")), "E", "e+")
    places = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,18)").cast("string")
    )
    shown = (
        F.when((size >= 1e21) | ((size < 1e-6) & (size > 0)), exponent)
        .when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))
        .otherwise(F.regexp_replace(places, r"\.?0+\z", ""))
    )
    return F.when(odd_number(text), F.coalesce(shown, text)).otherwise(text)


def tokens(text: Column) -> Column:
    """The tokens of a compact JSON text, numbers as a script prints them."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), number_text)


def compact_json(value: Column) -> Column:
    """JSON text of a VARIANT on one line."""
    text = F.to_json(value)
    return F.when(text.rlike(ODD_INSIDE), F.array_join(tokens(text), "")).otherwise(text)


def depths(found: Column) -> Column:
    """How many brackets are open after each token.

    Summed up in blocks: an array grows by copying, so one fold over all tokens would take the square of
    their number.
    """

    def change(token: Column) -> Column:
        return F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)

    def running(start: Column, block: Column) -> Column:
        first = F.array(start)
        sums = F.aggregate(block, first, lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + change(t))))
        return F.slice(sums, 2, F.size(block))

    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: F.slice(found, at, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, t: s + change(t)))
    before = F.aggregate(totals, F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t)))
    return F.flatten(F.transform(blocks, lambda block, number: running(F.get(before, number), block)))


def indented_json(value: Column, step: int = 2) -> Column:
    """JSON text of a VARIANT with a line for each member, as for display."""

    def lay_out(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("token"), depths(found).alias("depth"))

        def shown(pair: Column, number: Column) -> Column:
            token, depth = pair["token"], pair["depth"]
            line = F.concat(F.lit("\n"), F.repeat(F.lit(" " * step), depth))
            before, after = F.get(found, number - 1), F.get(found, number + 1)
            closes = token.isin("}", "]") & ~F.coalesce(before.isin("{", "["), F.lit(False))
            opens = token.isin("{", "[") & ~F.coalesce(after.isin("}", "]"), F.lit(False))
            return F.concat(
                F.when(closes, line).otherwise(""),
                token,
                F.when(opens | (token == ","), line).when(token == ":", " ").otherwise(""),
            )

        return F.array_join(F.transform(pairs, shown), "")

    laid_out = F.transform(F.array(tokens(F.to_json(value))), lay_out)
    return F.when(value.isNotNull(), F.get(laid_out, 0))
