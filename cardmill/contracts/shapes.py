"""Shapes: what a value in a card may look like, as plain data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any


class Unset:
    """Stands for a rule that is not given, as null is a value."""

    def __repr__(self) -> str:
        return "UNSET"


UNSET = Unset()


@dataclass(frozen=True)
class Keys:
    """Keys of an object: those that match a pattern, or without one all but some names and those that match others."""

    pattern: str | None = None
    names: tuple[str, ...] = ()
    others: tuple[str, ...] = ()


@dataclass(frozen=True)
class At:
    """One position of a list."""

    number: int


# A step from a value to values in it: a field, all items of a list from a number on, one item, or some keys' values.
Step = str | int | At | Keys
# A way from a value to values of a recursive shape in it.
Route = tuple[tuple[Step, ...], str]


@dataclass(frozen=True)
class Loop:
    """A recursive shape: the rules of each shape that takes part, and where it holds others of them."""

    entry: str
    members: Mapping[str, tuple[Shape, tuple[Route, ...]]]


@dataclass(frozen=True)
class Shape:
    """Rules for one value. Rules that do not apply to its JSON type pass."""

    types: tuple[str, ...] = ()
    values: tuple[Any, ...] = ()
    constant: Any = UNSET
    # objects
    fields: Mapping[str, Shape] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    closed: bool = False
    # rules for the values of some keys, whatever these are
    keyed: tuple[tuple[Keys, Shape], ...] = ()
    min_keys: int | None = None
    max_keys: int | None = None
    # lists
    lead: tuple[Shape, ...] = ()
    items: Shape | None = None
    min_items: int | None = None
    max_items: int | None = None
    unique: bool = False
    # texts
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    format: str | None = None
    # numbers
    minimum: float | None = None
    maximum: float | None = None
    # combinations
    one_of: tuple[Shape, ...] = ()
    condition: Shape | None = None
    then: Shape | None = None
    otherwise: Shape | None = None
    # rules that come back inside the value, down to any depth
    loop: Loop | None = None
    # no value passes
    never: bool = False
    default: Any = None

    def with_(self, **changes: Any) -> Shape:
        return replace(self, **changes)


def text(**rules: Any) -> Shape:
    return Shape(types=("string",), **rules)


def choice(*values: str, **rules: Any) -> Shape:
    return Shape(types=("string",), values=values, **rules)


def integer(**rules: Any) -> Shape:
    return Shape(types=("integer",), **rules)


def number(**rules: Any) -> Shape:
    return Shape(types=("number",), **rules)


def record(fields: Mapping[str, Shape], *, closed: bool = True, **rules: Any) -> Shape:
    return Shape(types=("object",), fields=fields, closed=closed, **rules)


def listing(items: Shape | None = None, **rules: Any) -> Shape:
    return Shape(types=("array",), items=items, **rules)


def self_listing(shape: Shape, field_name: str) -> Shape:
    """A shape whose field lists values of the same shape."""
    return Shape(loop=Loop("", {"": (shape, (((field_name, 0), ""),))}))
