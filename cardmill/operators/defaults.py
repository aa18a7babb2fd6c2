"""Fill missing fields of a section with the defaults of its contract."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.contracts.shapes import Shape
from cardmill.functions.values import Field, literal

# What a missing field starts as, by JSON type.
EMPTY_BY_TYPE = {"string": "", "array": [], "object": {}}


def defaults_of(section: Shape) -> dict[str, Any]:
    """Default per field: its own when that is truthy or a list, else the empty value."""
    found = {}
    for name, shape in section.fields.items():
        kind = shape.types[0] if len(shape.types) == 1 else None
        own = shape.default
        if own or isinstance(own, (list, dict)):
            found[name] = own
        elif kind in EMPTY_BY_TYPE:
            found[name] = EMPTY_BY_TYPE[kind]
    return found


def apply_defaults(section: Column, defaults: dict[str, Any]) -> Column:
    """Section with the missing fields added; present fields stay, null ones too."""
    present = Field(section).read("map<string,variant>")
    pairs = [x for name, value in defaults.items() for x in (F.lit(name), literal(value))]
    missing = F.map_filter(
        F.create_map(*pairs), lambda name, _: ~F.map_contains_key(present, name)
    )
    return F.when(
        present.isNotNull(), F.to_variant_object(F.map_concat(present, missing))
    ).otherwise(section)


def fill_defaults(section: Column, shape: Shape) -> Column:
    """Section with missing fields added at every level that is there.

    Fields of the section, of objects in it and of objects in its lists are filled; a missing object or list
    gets its default as a whole. Present fields stay, null ones and those of another type too.
    """
    if shape.types == ("array",):
        if shape.items is None or not fillable(shape.items):
            return section
        items = Field(section).read("array<variant>")
        done = F.transform(items, lambda item: fill_defaults(item, shape.items)).cast("variant")
        return F.when(items.isNotNull(), done).otherwise(section)
    inner = {name: s for name, s in shape.fields.items() if fillable(s)}

    def field(name: Column, value: Column) -> Column:
        chosen = F
        for wanted, inside in inner.items():
            chosen = chosen.when(name == wanted, fill_defaults(value, inside))
        return chosen.otherwise(value) if inner else value

    present = Field(section).read("map<string,variant>")
    filled = apply_defaults(F.to_variant_object(F.transform_values(present, field)), defaults_of(shape))
    return F.when(present.isNotNull(), filled).otherwise(section)


def fillable(shape: Shape) -> bool:
    """Does a shape have fields, or items with fields, to fill?"""
    if shape.types == ("array",):
        return shape.items is not None and fillable(shape.items)
    return bool(shape.fields)
