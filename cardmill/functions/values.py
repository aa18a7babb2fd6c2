"""Typed reads and truthiness for values inside a VARIANT card.

A card is untyped JSON, so every read says which JSON type it accepts and gives NULL
for any other. Looking a key up in a VARIANT object walks its keys, so the fields a
job needs are read in one pass into a struct (a record), and all expressions then
work on the fields of that struct, which keeps the generated code small.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions.json_text import number_text, odd_number

Path = tuple[str, ...]


def json_path(*keys: str | int) -> str:
    steps = []
    for key in keys:
        if isinstance(key, int):
            steps.append(f"[{key}]")
        elif '"' not in key:
            steps.append(f'["{key}"]')
        elif "'" not in key:
            steps.append(f"['{key}']")
        else:
            raise ValueError(f"key mixes both quote characters: {key!r}")
    return "$" + "".join(steps)


def tree_of(places: Iterable[tuple[Path, Any]]) -> dict[str, Any]:
    """Nested dictionary of (path, leaf) pairs."""
    tree: dict[str, Any] = {}
    for path, leaf in places:
        inner = reduce(lambda node, key: node.setdefault(key, {}), path[:-1], tree)
        inner[path[-1]] = leaf
    return tree


def leaves(tree: dict[str, Any], path: Path = ()) -> Iterable[tuple[Path, Any]]:
    """The (path, leaf) pairs of a nested dictionary."""
    for name, leaf in tree.items():
        if isinstance(leaf, dict):
            yield from leaves(leaf, (*path, name))
        else:
            yield (*path, name), leaf


def backticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def struct_type(tree: dict[str, Any]) -> str:
    """Type of a record: a struct per inner level, the leaf's type (VARIANT) else."""
    fields = [
        f"{backticked(name)}: {struct_type(leaf) if isinstance(leaf, dict) else leaf}"
        for name, leaf in tree.items()
    ]
    return f"struct<{', '.join(fields)}>"


@dataclass(frozen=True)
class Field:
    """A VARIANT column, with its text form where one was read along with it."""

    value: Column
    string: Column | None = None

    def read(self, spark_type: str) -> Column:
        return F.try_variant_get(self.value, "$", spark_type)

    @cached_property
    def is_list(self) -> Column:
        return self.read("array<struct<>>").isNotNull()

    @cached_property
    def is_object(self) -> Column:
        return self.read("struct<>").isNotNull()

    @cached_property
    def is_string(self) -> Column:
        return F.schema_of_variant(self.value) == "STRING"

    @cached_property
    def text(self) -> Column:
        """The string, or NULL when the value is not a JSON string."""
        return F.when(self.is_string, self.any_text)

    @cached_property
    def any_text(self) -> Column:
        """JSON strings as they are, other values as JSON text."""
        return self.read("string") if self.string is None else self.string

    @cached_property
    def items(self) -> Column:
        return self.read("array<variant>")

    @cached_property
    def truthy(self) -> Column:
        """JavaScript truth: absent, null, '', 0 and false are false, [] and {} true."""
        if self.string is None:
            return self.is_object | self.is_list | F.coalesce(self.scalar_truthy, F.lit(False))
        return F.coalesce(self.scalar_truthy, F.lit(False))

    @property
    def scalar_truthy(self) -> Column:
        return (self.any_text != "") & (~self.any_text.isin(FALSY_TEXTS) | self.is_string)


# Text forms of the numbers and the boolean that are false.
FALSY_TEXTS = ["0", "-0", "0.0", "-0.0", "false"]


@dataclass(frozen=True)
class Record:
    """Two structs read from a card: VARIANT leaves and, for most, their text forms."""

    values: Column
    texts: Column
    probed: frozenset[Path]

    def at(self, *path: str) -> Field:
        def leaf(column: Column) -> Column:
            return reduce(lambda inner, name: inner.getField(name), path, column)

        return Field(leaf(self.values), None if path in self.probed else leaf(self.texts))


@dataclass(frozen=True)
class Fields:
    """Which fields of a card a job reads.

    Each kind of struct is read in one pass over the card. Fields in probed are lists
    or objects as a rule; they get no text form, which would serialise them.
    """

    paths: tuple[Path, ...]
    probed: frozenset[Path] = frozenset()

    def _read(self, doc: Column) -> tuple[Column, Column]:
        texts = [path for path in self.paths if path not in self.probed]
        return (
            F.try_variant_get(doc, "$", struct_type(tree_of((p, "variant") for p in self.paths))),
            F.try_variant_get(doc, "$", struct_type(tree_of((p, "string") for p in texts))),
        )

    def stage(self, cards: DataFrame, name: str, doc: Column) -> DataFrame:
        """Add the record as two columns, so that the card is read once per column."""
        values, texts = self._read(doc)
        return cards.withColumns({f"_{name}_values": values, f"_{name}_texts": texts})

    def record(self, name: str) -> Record:
        return Record(F.col(f"_{name}_values"), F.col(f"_{name}_texts"), self.probed)

    def unstage(self, cards: DataFrame, name: str) -> DataFrame:
        return cards.drop(f"_{name}_values", f"_{name}_texts")

    def rebuild(self, items: Column, build: Callable[[Record], Column]) -> Column:
        """Each object of a VARIANT list put through build."""

        def read(item: Column) -> Column:
            values, texts = self._read(item)
            return F.struct(values.alias("values"), texts.alias("texts"))

        return F.transform(
            F.transform(items, read),
            lambda one: build(Record(one["values"], one["texts"], self.probed)),
        )


def literal(value: Any) -> Column:
    """A constant VARIANT; folded once by the optimizer."""
    return F.parse_json(F.lit(json.dumps(value)))


def first_truthy(*choices: Field, default: Any = None) -> Column:
    """First truthy value as VARIANT, else the default (NULL when there is none)."""
    found = [F.when(choice.truthy, choice.value) for choice in choices]
    if default is not None:
        found.append(literal(default))
    return F.coalesce(*found)


def scalar_text(field: Field) -> Column:
    """Strings as they are, numbers as they print in a text."""
    odd = odd_number(field.any_text) & ~field.is_string
    return F.when(odd, number_text(field.any_text)).otherwise(field.any_text)


def as_text(field: Field) -> Column:
    """Text of any value as it reads inside a larger text; lists are comma-joined."""
    joined = F.array_join(
        F.transform(
            field.items,
            lambda x: F.when(F.is_variant_null(x), F.lit(""))
            .when(Field(x).is_object, F.lit("[object Object]"))
            .otherwise(scalar_text(Field(x))),
        ),
        ",",
    )
    nested = F.substring(field.any_text, 1, 1).isin("[", "{") & ~field.is_string
    return F.when(nested, F.coalesce(joined, F.lit("[object Object]"))).otherwise(
        scalar_text(field)
    )


def truthy_text(field: Field) -> Column:
    return F.when(field.truthy, as_text(field))


def as_object(places: dict[Path, Column], optional: tuple[str, ...] = ()) -> Column:
    """VARIANT object with one level per path step.

    Top-level names in optional are left out of the object where their value is SQL
    NULL; JSON null stays.
    """
    tree = tree_of(places.items())

    def build(node: dict[str, Any]) -> Column:
        return F.struct(
            *[
                (build(child) if isinstance(child, dict) else child).alias(name)
                for name, child in node.items()
            ]
        )

    if not optional:
        return F.to_variant_object(build(tree))

    def entry(name: str) -> list[Column]:
        child = tree[name]
        value = F.to_variant_object(build(child)) if isinstance(child, dict) else child
        return [F.lit(name), value.cast("variant")]

    always = [part for name in tree if name not in optional for part in entry(name)]
    nothing = F.create_map().cast("map<string,variant>")
    extra = [
        F.when(tree[name].isNotNull(), F.create_map(*entry(name))).otherwise(nothing)
        for name in optional
    ]
    return F.to_variant_object(F.map_concat(F.create_map(*always), *extra))
