"""Read a shape from a JSON Schema document (one small document per schema version)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from cardmill.contracts.profiles import FALLBACK_SECTION, LONG_VALUE_LIST, TEXT
from cardmill.contracts.shapes import UNSET, At, Keys, Loop, Route, Shape, Step, record

# Keywords that carry a rule, by the shape attribute that holds a plain value.
PLAIN = {
    "const": "constant",
    "default": "default",
    "format": "format",
    "maxItems": "max_items",
    "maxLength": "max_length",
    "maxProperties": "max_keys",
    "maximum": "maximum",
    "minItems": "min_items",
    "minLength": "min_length",
    "minProperties": "min_keys",
    "minimum": "minimum",
    "pattern": "pattern",
    "uniqueItems": "unique",
}
INNER = {"if": "condition", "then": "then", "else": "otherwise"}
# Keywords that describe and never fail a value.
SILENT = {"$comment", "$defs", "$id", "$schema", "description", "examples", "title"}
SILENT_WHEN_TRUE = {"additionalProperties", "items", "unevaluatedItems"}
CHECKED_FORMATS = {"date", "date-time", "email", "time", "uri", "uuid"}
REFERENCE = "#/$defs/"


def shape_from_document(document: dict[str, Any]) -> Shape:
    """Shape of a whole card. Raises ValueError on a rule that is not supported, so that none is skipped."""
    return Reader(document.get("$defs", {})).shape(document)


def references(node: Any) -> Iterator[str]:
    if isinstance(node, dict):
        if isinstance(node.get("$ref"), str):
            yield node["$ref"].removeprefix(REFERENCE)
        for key, value in node.items():
            if key not in ("const", "default", "enum", "examples"):
                yield from references(value)
    elif isinstance(node, list):
        for value in node:
            yield from references(value)


class Reader:
    """Reads the nodes of one document; a definition that comes back inside itself becomes a loop."""

    def __init__(self, definitions: dict[str, Any]):
        self.definitions = definitions
        self.reach = {name: self.reached(name) for name in definitions}

    def reached(self, name: str) -> set[str]:
        seen: set[str] = set()
        open_ = [name]
        while open_:
            for other in references(self.definitions[open_.pop()]):
                if other in self.definitions and other not in seen:
                    seen.add(other)
                    open_.append(other)
        return seen

    def shape(self, node: Any) -> Shape:
        return Walk(self, frozenset(), []).shape(node, ())

    def loop(self, name: str) -> Shape:
        """The definition with all that take turns with it, each read once."""
        group = frozenset(n for n in self.reach[name] if name in self.reach[n]) | {name}
        members = {}
        for member in sorted(group):
            walk = Walk(self, group, [])
            shape = walk.shape(self.definitions[member], ())
            members[member] = (shape, tuple(walk.routes))
        return Shape(loop=Loop(name, members))


class Walk:
    """One definition's own rules; values of the group's definitions in it are noted as routes."""

    def __init__(self, reader: Reader, group: frozenset[str], routes: list[Route]):
        self.reader, self.group, self.routes = reader, group, routes

    def shape(self, node: Any, steps: tuple[Step, ...] | None) -> Shape:
        """steps is the way from the definition, None where a value can't be singled out by a way."""
        if node is True:
            return Shape()
        if node is False:
            return Shape(never=True)
        own = self.plain({k: v for k, v in node.items() if k != "$ref"}, steps)
        if "$ref" not in node:
            return own
        return merged(self.reference(node["$ref"], steps), own)

    def reference(self, ref: str, steps: tuple[Step, ...] | None) -> Shape:
        name, reader = ref.removeprefix(REFERENCE), self.reader
        if name not in reader.definitions:
            raise ValueError(f"unknown reference: {ref}")
        if name in self.group:
            if not steps:
                raise ValueError(f"{name} comes back where no way leads to it")
            self.routes.append((steps, name))
            return Shape()
        if name in reader.reach[name]:
            return reader.loop(name)
        return self.shape(reader.definitions[name], steps)

    def plain(self, node: dict[str, Any], steps: tuple[Step, ...] | None) -> Shape:
        def inside(*more: Step) -> tuple[Step, ...] | None:
            return None if steps is None else (*steps, *more)

        found: dict[str, Any] = {}
        for keyword, value in node.items():
            if keyword in SILENT or (keyword in SILENT_WHEN_TRUE and value is True):
                continue
            if keyword == "format" and value not in CHECKED_FORMATS:
                raise ValueError(f"format not supported: {value}")
            if keyword in PLAIN:
                found[PLAIN[keyword]] = value
            elif keyword in INNER:
                found[INNER[keyword]] = self.shape(value, None)
            elif keyword == "items":
                found["items"] = self.shape(value, inside(len(node.get("prefixItems", ()))))
            elif keyword == "type":
                found["types"] = (value,) if isinstance(value, str) else tuple(value)
            elif keyword == "enum":
                found["values"] = tuple(value)
            elif keyword == "required":
                found["required"] = tuple(value)
            elif keyword == "properties":
                found["fields"] = {name: self.shape(rule, inside(name)) for name, rule in value.items()}
            elif keyword == "additionalProperties" and value is False:
                found["closed"] = True
            elif keyword == "additionalProperties":
                known, patterns = (tuple(node.get(k, ())) for k in ("properties", "patternProperties"))
                others = Keys(names=known, others=patterns)
                found["keyed"] = (*found.get("keyed", ()), (others, self.shape(value, inside(others))))
            elif keyword == "patternProperties":
                told = [(Keys(pattern), rule) for pattern, rule in value.items()]
                shapes = tuple((keys, self.shape(rule, inside(keys))) for keys, rule in told)
                found["keyed"] = (*found.get("keyed", ()), *shapes)
            elif keyword == "prefixItems":
                found["lead"] = tuple(self.shape(rule, inside(At(i))) for i, rule in enumerate(value))
            elif keyword == "oneOf":
                found["one_of"] = tuple(self.shape(rule, None) for rule in value)
            else:
                raise ValueError(f"rule not supported: {keyword}")
        return Shape(**found)


def merged(base: Shape, beside: Shape) -> Shape:
    """The rules of a reference and those that stand beside it; the same rule twice is refused."""
    plain = Shape()
    given = {n: v for n, v in vars(beside).items() if v is not getattr(plain, n) and v != getattr(plain, n)}
    given |= {"constant": None} if beside.constant is None else {}
    for name in given:
        held = getattr(base, name)
        if held is not UNSET and held != getattr(plain, name) and name != "default":
            raise ValueError(f"rule given beside a reference that has it too: {name}")
    if given.keys() & {"fields", "closed", "keyed"} and base.loop is not None:
        raise ValueError("fields given beside a reference that comes back inside itself")
    return base.with_(**given)


# ---- form rules ----------------------------------------------------------------

# Any of these makes a value a plain text in a form.
COMBINED = ("anyOf", "oneOf", "allOf", "if", "then", "else", "patternProperties")
# What a form keeps of a value; all else is left to the declared rules.
FORM_KEPT = (*PLAIN, "type", "enum", "required")


def form_from_document(document: dict[str, Any], card_type: str) -> Shape:
    """Form rules of a card type's section; only the name is asked for where there is none or it can't be read.

    A value with combined rules, or a definition within itself, becomes a plain text.
    """
    definitions = document.get("$defs", {})
    try:
        section = definitions[card_type]
        fields = {name: form_value(rule, definitions, ()) for name, rule in section["properties"].items()}
        return record(fields, closed=False, required=tuple(section.get("required", ())))
    except (AttributeError, KeyError, TypeError, ValueError):
        return FALLBACK_SECTION


def form_value(node: Any, definitions: dict[str, Any], opened: tuple[str, ...]) -> Shape:
    if isinstance(node, bool):
        return Shape() if node else Shape(never=True)
    if "$ref" in node:
        name = node["$ref"].removeprefix(REFERENCE)
        if name in opened:
            return TEXT
        if name in definitions:
            return form_value(definitions[name], definitions, (*opened, name))
    if any(node.get(k) for k in COMBINED) or isinstance(node.get("additionalProperties"), dict):
        return TEXT
    held = {k: v for k, v in node.items() if k in FORM_KEPT and (k != "format" or v in CHECKED_FORMATS)}
    shape = Walk(Reader({}), frozenset(), []).plain(held, None)
    if node.get("additionalProperties") is False:
        shape = shape.with_(closed=True)
    if "items" in node and node.get("type") == "array":
        items = form_value(node["items"], definitions, opened)
        shape = shape.with_(items=items, unique=shape.unique or len(items.values) > LONG_VALUE_LIST)
    if node.get("prefixItems"):
        shape = shape.with_(lead=tuple(form_value(x, definitions, opened) for x in node["prefixItems"]))
    if node.get("properties") and node.get("type") == "object":
        fields = {name: form_value(rule, definitions, opened) for name, rule in node["properties"].items()}
        shape = shape.with_(fields=fields)
    return shape
