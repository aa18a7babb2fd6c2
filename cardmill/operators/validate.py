"""Turn a shape into one column that lists what is wrong with each card.

The rules become a single SQL expression: no join, no shuffle and no state, so the
same expression works on tables and streams and can be used in a SELECT or a view.
The fields of a document are read into a record in one pass; only lists need a
higher-order function. SQL text is used here, not Column calls, because a contract has hundreds of
rules and each Column call is a round trip to the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.contracts.shapes import UNSET, At, Keys, Loop, Shape
from cardmill.functions.fence import fence
from cardmill.functions.values import backticked, json_path, leaves, struct_type

NO_VIOLATIONS = (
    "cast(array() AS array<struct<path:string,pattern:string,keyword:string,message:string>>)"
)
NO_NODES = (
    "cast(array() AS "
    "array<struct<kind:string,path:string,pattern:string,order:array<int>,value:variant>>)"
)

# Accepted text formats.
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
EMAIL_SHAPE = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
URI_SHAPE = r"\A[A-Za-z][A-Za-z0-9+.-]*:\S+\z"
TIME_SHAPE = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:[zZ]|[+-][0-9]{2}:[0-9]{2})"
UUID_SHAPE = r"\A[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"

# Fixed value: how many violations are shown before "... and N more errors".
SHOWN = 5

# Spark's JSON parser refuses texts that are nested deeper.
DEEPEST = 1000

# Turns in which a recursive value is gathered without a look at how deep it may be.
TURNS = 8

# Spark turns a longer IN into a set (spark.sql.optimizer.inSetConversionThreshold, as it comes).
SHORT_IN = 10

# Arrays joined in one step.
GROUP = 12


def quote(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class Place:
    """A value inside a document and the path it is reported under, as SQL.

    doc is a VARIANT expression, record a struct with its fields (see record_tree) and lists one with the items of those
    that are lists (see list_tree); tree is the record's form and listed names the places found in lists. names_of has
    the key names of some objects.
    base is the known end of the path and start an expression before it (in lists); star_base and stars are the
    same with a star for each position in a list. Both stand in rules only where a violation is made, so a sound
    value costs no text. depth counts enclosing lambdas and keeps their parameter names apart.
    """

    doc: str
    record: str = ""
    tree: Mapping[str, Any] = field(default_factory=dict)
    lists: str = ""
    listed: frozenset[tuple[str | int, ...]] = frozenset()
    names_of: Mapping[tuple[str | int, ...], str] = field(default_factory=dict)
    base: str = ""
    start: str | None = None
    star_base: str = ""
    stars: str | None = None
    keys: tuple[str | int, ...] = ()
    is_record: bool = False
    depth: int = 0
    # Where the kind of the value itself, its text and its number have been read before.
    known_kind: str | None = None
    known_text: str | None = None
    known_number: str | None = None

    @property
    def path(self) -> str:
        if self.start is None:
            return quote(self.base)
        return f"concat({self.start}, {quote(self.base)})" if self.base else self.start

    @property
    def pattern(self) -> str:
        if self.stars is None:
            return quote(self.star_base)
        return f"concat({self.stars}, {quote(self.star_base)})" if self.star_base else self.stars

    def child(self, name: str, shape: Shape | None = None) -> Place:
        return replace(
            self,
            base=f"{self.base}.{name}",
            star_base=f"{self.star_base}.{name}",
            keys=(*self.keys, name),
            is_record=shape is not None and holds_record(shape),
        )

    @property
    def slot(self) -> str:
        """The place's own part of the record."""
        return ".".join([self.record, *(backticked(key) for key in self.keys)])

    def read(self, spark_type: str) -> str:
        """Leaves are read from the record, values that are records from the document."""
        if not self.keys:
            return f"try_variant_get({self.doc}, '$', '{spark_type}')"
        if self.is_record:
            path = quote(json_path(*self.keys))
            return f"try_variant_get({self.doc}, {path}, '{spark_type}')"
        return f"try_variant_get({self.slot}, '$', '{spark_type}')"

    @property
    def value(self) -> str:
        if not self.keys:
            return self.doc
        return self.read("variant") if self.is_record else self.slot

    @property
    def kind(self) -> str:
        if self.known_kind and not self.keys:
            return self.known_kind
        return f"schema_of_variant({self.value})"

    @property
    def present(self) -> str:
        if not self.is_record or not self.keys:
            return f"{self.value} IS NOT NULL"
        # The slot of a record is looked at first, as it is there already; a path that leads nowhere costs an exception.
        *above, name = self.keys
        names = self.names_of.get(tuple(above))
        other = f"coalesce(array_contains({names}, {quote(name)}), false)" if names else f"{self.value} IS NOT NULL"
        return f"({self.slot} IS NOT NULL OR {other})"

    @property
    def absent(self) -> str:
        return f"NOT {self.present}" if self.is_record and self.keys else f"{self.value} IS NULL"

    @property
    def is_string(self) -> str:
        return f"{self.kind} = 'STRING'"

    @property
    def text(self) -> str:
        if self.known_text and not self.keys:
            return self.known_text
        return f"if({self.is_string}, {self.read('string')}, NULL)"

    @property
    def number(self) -> str:
        if self.known_number and not self.keys:
            return self.known_number
        return f"if({self.is_string}, NULL, {self.read('double')})"

    @property
    def items(self) -> str:
        if self.keys in self.listed:
            return ".".join([self.lists, *(backticked(key) for key in self.keys)])
        return self.read("array<variant>")

    @property
    def is_list(self) -> str:
        return f"{self.items if self.keys in self.listed else self.read('array<struct<>>')} IS NOT NULL"

    @property
    def names(self) -> str:
        return self.names_of.get(self.keys) or f"map_keys({self.read('map<string,struct<>>')})"

    def has_slots(self, fields: Mapping[str, Shape]) -> bool:
        """Does the record have all these fields, in this form? Forms of oneOf may name others."""
        node: Any = self.tree
        for key in self.keys:
            node = node.get(key) if isinstance(node, dict) else None
        held = node if isinstance(node, dict) else {}
        return all(name in held and isinstance(held[name], dict) == holds_record(one) for name, one in fields.items())

    @property
    def is_object(self) -> str:
        return f"{self.slot} IS NOT NULL" if self.is_record else f"{self.read('struct<>')} IS NOT NULL"


def holds_record(shape: Shape) -> bool:
    return bool(shape.fields)


def record_tree(shape: Shape) -> dict[str, Any]:
    """The fields of a shape, those of records within it too; lists stay VARIANT."""
    names = dict.fromkeys(shape.required, Shape()) | dict(shape.fields)
    return {
        name: record_tree(inner) if holds_record(inner) else "variant"
        for name, inner in names.items()
    }


def reads_items(shape: Shape) -> bool:
    """Do rules of the value itself look at its items, or whether it is a list?"""
    sized = shape.min_items is not None or shape.max_items is not None
    return "array" in shape.types or sized or shape.unique or bool(shape.lead) or shape.items is not None


def list_tree(shape: Shape) -> dict[str, Any]:
    """The fields of a shape that are lists, those of records within it too."""
    tree: dict[str, Any] = {}
    for name, inner in shape.fields.items():
        if holds_record(inner):
            if below := list_tree(inner):
                tree[name] = below
        elif reads_items(inner):
            tree[name] = "array<variant>"
    return tree


def read_lists(doc: str, shape: Shape) -> str:
    """The items of all lists of a document that a shape has rules for, in one pass over it."""
    return f"try_variant_get({doc}, '$', {quote(struct_type(list_tree(shape)))})"


def listed_keys(shape: Shape) -> frozenset[tuple[str | int, ...]]:
    return frozenset(path for path, _ in leaves(list_tree(shape)))


def name_keys(shape: Shape, keys: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """Where the records of a shape stand whose key names its rules ask for."""
    inner = [(name, one) for name, one in shape.fields.items() if holds_record(one)]
    if inner or shape.closed or shape.min_keys is not None or shape.max_keys is not None:
        yield keys
    for name, one in inner:
        yield from name_keys(one, (*keys, name))


def read_names(doc: str, record: str, shape: Shape) -> str:
    """The key names of all records of a document that a shape has rules for, each read once; NULL where there is none."""
    fields = []
    for number, keys in enumerate(name_keys(shape)):
        names = f"map_keys(try_variant_get({doc}, {quote(json_path(*keys))}, 'map<string,struct<>>'))"
        slot = ".".join([record, *(backticked(key) for key in keys)])
        fields.append(f"'n{number}', if({slot} IS NOT NULL, {names}, NULL)")
    return f"named_struct({', '.join(fields)})"


def read_record(doc: str, shape: Shape) -> str:
    """All fields of a document that a shape has rules for, in one pass over it."""
    return f"try_variant_get({doc}, '$', {quote(struct_type(record_tree(shape)))})"


@dataclass(frozen=True)
class Rule:
    """One possible violation, or (many) an array expression of violations, with a test whether there is one (some)."""

    broken: str = ""
    path: str = ""
    pattern: str = ""
    keyword: str = ""
    message: str = ""
    many: str = ""
    some: str = ""
    # Another rule of the same value is broken whenever this one is.
    implied: bool = False
    # The test (some) costs little beside the array.
    cheap: bool = False

    def under(self, guard: str) -> Rule:
        if self.many:
            some = f"({guard}) AND ({self.some})" if self.some else ""
            return replace(self, many=f"if({guard}, {self.many}, NULL)", some=some)
        return replace(self, broken=f"({guard}) AND ({self.broken})")

    @property
    def any_broken(self) -> str:
        """A test for a place where NULL counts as false."""
        return self.broken or self.some or f"size({self.many}) > 0"


def violation(path: str, pattern: str, keyword: str, message: str) -> str:
    return (
        f"named_struct('path', {path}, 'pattern', {pattern}, "
        f"'keyword', {quote(keyword)}, 'message', {quote(message)})"
    )


def has_type(place: Place, name: str) -> str:
    if name == "string":
        return f"({place.is_string})"
    if name == "object":
        return f"({place.is_object})"
    if name == "array":
        return f"({place.is_list})"
    kind = place.kind
    if name == "integer":
        whole_decimal = quote(r"\ADECIMAL\([0-9]+,0\)\z")
        whole_double = f"({kind} = 'DOUBLE' AND {place.number} = floor({place.number}))"
        return f"({kind} = 'BIGINT' OR {kind} RLIKE {whole_decimal} OR {whole_double})"
    if name == "number":
        return f"({kind} RLIKE {quote(chr(92) + 'A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)')})"
    if name == "boolean":
        return f"({kind} = 'BOOLEAN')"
    if name == "null":
        return f"is_variant_null({place.value})"
    raise ValueError(f"unknown JSON type: {name}")


def equals_any(place: Place, values: tuple[Any, ...]) -> str:
    texts = [quote(value) for value in values if isinstance(value, str)]
    others = [
        quote(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        for value in values
        if not isinstance(value, str)
    ]
    matches = []
    if texts:
        known = place.known_text and not place.keys
        text = place.text if known else place.read("string")
        listed = f"{text} IN ({', '.join(texts)})"
        # Inside a higher-order function a match in a short IN costs an exception; a long one becomes a set.
        if place.depth and len(texts) <= SHORT_IN:
            listed = f"array_contains(array({', '.join(texts)}), {text})"
        matches.append(f"coalesce({listed if known else f'{place.is_string} AND {listed}'}, false)")
    if others:
        matches.append(f"to_json({place.value}) IN ({', '.join(others)})")
    return f"({' OR '.join(matches)})"


def format_broken(text: str, name: str) -> str:
    if name == "date":
        no_day = f"try_to_date({text}, 'yyyy-MM-dd') IS NULL"
        return f"{text} IS NOT NULL AND (NOT {text} RLIKE {quote(DATE_SHAPE)} OR {no_day})"
    if name == "date-time":
        day = format_broken(f"substring({text}, 1, 10)", "date")
        return f"({day} OR NOT {text} RLIKE {quote(rf'{chr(92)}A.{{10}}[tT ]{TIME_SHAPE}{chr(92)}z')})"
    shapes = {"email": EMAIL_SHAPE, "uri": URI_SHAPE, "uuid": UUID_SHAPE}
    shapes["time"] = rf"\A{TIME_SHAPE}\z"
    if name not in shapes:
        raise ValueError(f"unknown format: {name}")
    return f"NOT {text} RLIKE {quote(shapes[name])}"


def rules_of(place: Place, shape: Shape) -> Iterator[Rule]:
    """Rules of a shape in reporting order: the value itself, then what it holds."""

    def rule(broken: str, keyword: str, message: str, implied: bool = False) -> Rule:
        return Rule(broken, place.path, place.pattern, keyword, message, implied=implied)

    if shape.never:
        yield rule(place.present, "false", "is not allowed")
        return
    if shape.loop is not None:
        yield Rule(many=f"if({place.present}, {looped(place, shape.loop)}, NULL)")
    if shape.types:
        fits = " OR ".join(has_type(place, name) for name in shape.types)
        yield rule(
            f"NOT ({fits}) AND {place.present}" if place.is_record else f"{place.present} AND NOT ({fits})",
            "type",
            f"must be of type {' or '.join(shape.types)}",
            implied=shape.types == ("string",) and bool(shape.values) and all(isinstance(v, str) for v in shape.values),
        )
    if shape.constant is not UNSET:
        same = equals_any(place, (shape.constant,))
        shown = "null" if shape.constant is None else shape.constant
        yield rule(f"{place.present} AND NOT {same}", "const", f"must be {shown}")
    if shape.values:
        listed = equals_any(place, shape.values)
        yield rule(
            f"{place.present} AND NOT {listed}", "enum", "must be one of the listed values"
        )
    yield from text_rules(place, shape)
    yield from number_rules(place, shape)
    yield from object_rules(place, shape)
    yield from list_rules(place, shape)
    if shape.one_of:
        passes = " + ".join(f"cast({valid_for(place, s)} AS int)" for s in shape.one_of)
        yield rule(
            f"{place.present} AND ({passes}) != 1",
            "oneOf",
            "must match exactly one of the allowed forms",
        )
    if shape.condition is not None:
        applies = valid_for(place, shape.condition)
        for branch, guard in ((shape.then, applies), (shape.otherwise, f"NOT {applies}")):
            if branch is not None:
                for branch_rule in rules_of(place, branch):
                    yield branch_rule.under(guard)


def text_rules(place: Place, shape: Shape) -> Iterator[Rule]:
    text, path = place.text, (place.path, place.pattern)
    if shape.min_length is not None:
        message = f"must have at least {shape.min_length} characters"
        yield Rule(f"length({text}) < {shape.min_length}", *path, "minLength", message)
    if shape.max_length is not None:
        message = f"must have at most {shape.max_length} characters"
        yield Rule(f"length({text}) > {shape.max_length}", *path, "maxLength", message)
    if shape.pattern is not None:
        message = f"must match {shape.pattern}"
        yield Rule(f"NOT {text} RLIKE {quote(shape.pattern)}", *path, "pattern", message)
    if shape.format is not None:
        message = f"must be a valid {shape.format}"
        yield Rule(format_broken(text, shape.format), *path, "format", message)


def number_rules(place: Place, shape: Shape) -> Iterator[Rule]:
    for bound, keyword, words, sign in (
        (shape.minimum, "minimum", "at least", "<"),
        (shape.maximum, "maximum", "at most", ">"),
    ):
        if bound is not None:
            outside = f"{place.number} {sign} {float(bound)!r}D AND {has_type(place, 'number')}"
            yield Rule(outside, place.path, place.pattern, keyword, f"must be {words} {bound}")


def object_rules(place: Place, shape: Shape) -> Iterator[Rule]:
    for name in shape.required:
        missing = place.child(name, shape.fields.get(name))
        broken = f"{place.is_object} AND {missing.absent}"
        yield Rule(broken, missing.path, missing.pattern, "required", "is required")
    if shape.closed:
        yield extra_keys(place, shape)
    size = f"size({place.names})"
    if shape.min_keys is not None:
        message = f"must have at least {shape.min_keys} fields"
        broken = f"{place.is_object} AND {size} < {shape.min_keys}"
        yield Rule(broken, place.path, place.pattern, "minProperties", message)
    if shape.max_keys is not None:
        message = f"must have at most {shape.max_keys} fields"
        broken = f"{place.is_object} AND {size} > {shape.max_keys}"
        yield Rule(broken, place.path, place.pattern, "maxProperties", message)
    for keys, inner in shape.keyed:
        yield keyed_values(place, keys, inner)
    for name, inner in shape.fields.items():
        yield from rules_of(place.child(name, inner), inner)


def extra_keys(place: Place, shape: Shape) -> Rule:
    """Keys that no rule names. Names are looked at only where there are more keys than fields that the record holds."""
    key = f"key{place.depth}"
    allowed = ", ".join(quote(name) for name in shape.fields)
    extra = f"array_except({place.names}, cast(array({allowed}) AS array<string>))"
    patterns = [keys.pattern for keys, _ in shape.keyed if keys.pattern is not None]
    unfit = key_fits(key, Keys(names=tuple(shape.fields), others=tuple(patterns)))
    tests = [f"exists({place.names}, {key} -> {unfit})"] if patterns or not place.has_slots(shape.fields) else []
    if place.has_slots(shape.fields):
        held = [f"cast({place.child(name, inner).present} AS int)" for name, inner in shape.fields.items()]
        tests.insert(0, f"size({place.names}) > {summed(held)}")
    some = f"coalesce({' AND '.join(tests)}, false)"
    if patterns:
        extra = f"filter({extra}, {key} -> {key_fits(key, Keys(others=tuple(patterns)))})"
    under = [f"concat({start}, '.', {key})" for start in (place.path, place.pattern)]
    found = violation(*under, "additionalProperties", "is not an allowed field")
    return Rule(many=f"if({some}, transform({extra}, {key} -> {found}), NULL)", some=some, cheap=True)


def summed(numbers: list[str]) -> str:
    """The sum of all numbers, added in pairs of halves: a long chain would be a deep expression."""
    if len(numbers) < 2:
        return numbers[0] if numbers else "0"
    middle = len(numbers) // 2
    return f"({summed(numbers[:middle])} + {summed(numbers[middle:])})"


def key_fits(key: str, keys: Keys) -> str:
    if keys.pattern is not None:
        return f"{key} RLIKE {quote(keys.pattern)}"
    tests = [f"NOT {key} IN ({', '.join(quote(name) for name in keys.names)})"] if keys.names else []
    tests += [f"NOT {key} RLIKE {quote(pattern)}" for pattern in keys.others]
    return " AND ".join(tests) or "true"


def keyed_values(place: Place, keys: Keys, shape: Shape) -> Rule:
    pair, one = f"pair{place.depth}", f"spot{place.depth}"
    entries = (
        f"filter(map_entries({place.read('map<string,variant>')}), "
        f"{pair} -> {key_fits(f'{pair}.key', keys)})"
    )
    spots = f"transform({entries}, {pair} -> named_struct('at', {pair}.key, {spot_fields(f'{pair}.value', shape)}))"
    starts = [f"concat({start}, '.', {one}.at)" for start in (place.path, place.pattern)]
    return checked_spots(spots, shape, place.depth, start=starts[0], stars=starts[1])


def list_rules(place: Place, shape: Shape) -> Iterator[Rule]:
    items, path = place.items, (place.path, place.pattern)
    if shape.min_items is not None:
        message = f"must have at least {shape.min_items} items"
        yield Rule(f"size({items}) < {shape.min_items}", *path, "minItems", message)
    if shape.max_items is not None:
        message = f"must have at most {shape.max_items} items"
        yield Rule(f"size({items}) > {shape.max_items}", *path, "maxItems", message)
    if shape.unique:
        item = f"item{place.depth}"
        # A quoted text is equal to no other value's JSON text; it need not be escaped to be told from others.
        text = f"concat('\"', try_variant_get({item}, '$', 'string'), '\"')"
        told = f"if(schema_of_variant({item}) = 'STRING', {text}, to_json({item}))"
        distinct = f"array_distinct(transform({items}, {item} -> {told}))"
        message = "must not repeat items"
        broken = f"size({items}) > 1 AND size({distinct}) < size({items})"
        yield Rule(broken, *path, "uniqueItems", message)
    for position, inner in enumerate(shape.lead):
        yield checked_items(place, f"slice({items}, {position + 1}, 1)", position, inner)
    if shape.items is not None:
        offset = len(shape.lead)
        rest = f"slice({items}, {offset + 1}, greatest(size({items}), 0))" if offset else items
        yield checked_items(place, rest, offset, shape.items)


def checked_items(place: Place, items: str, offset: int, shape: Shape) -> Rule:
    """What is wrong with items of a list, of which the first has the position `offset`."""
    item, index, one = f"item{place.depth}", f"index{place.depth}", f"spot{place.depth}"
    spots = f"transform({items}, ({item}, {index}) -> named_struct('at', {index}, {spot_fields(item, shape)}))"
    at = f"{one}.at + {offset}" if offset else f"{one}.at"
    start = f"concat({place.path}, '[', cast({at} AS string), ']')"
    return checked_spots(
        spots, shape, place.depth, start=start, stars=place.stars, star_base=f"{place.star_base}[*]"
    )


def spot_fields(value: str, shape: Shape) -> str:
    """A value of a list with what its rules read of it, so that it is read once."""
    fields = [f"'value', {value}"]
    if record_tree(shape):
        fields.append(f"'record', {read_record(value, shape)}")
    elif reads_kind(shape):
        is_string = f"schema_of_variant({value}) = 'STRING'"
        fields.append(f"'kind', schema_of_variant({value})")
        if reads_text(shape):
            fields.append(f"'text', if({is_string}, try_variant_get({value}, '$', 'string'), NULL)")
        if shape.minimum is not None or shape.maximum is not None:
            fields.append(f"'number', if({is_string}, NULL, try_variant_get({value}, '$', 'double'))")
    if list_tree(shape):
        fields.append(f"'lists', {read_lists(value, shape)}")
    elif reads_items(shape) and not record_tree(shape):
        fields.append(f"'lists', try_variant_get({value}, '$', 'array<variant>')")
    return ", ".join(fields)


def forms(shape: Shape) -> tuple[Shape, ...]:
    """A shape and those that the value itself is checked by with it."""
    parts = [*shape.one_of, shape.condition, shape.then, shape.otherwise]
    return shape, *(form for part in parts if part is not None for form in forms(part))


def reads_kind(shape: Shape) -> bool:
    """Do rules of a value without known fields ask for its kind?"""
    told = {"string", "integer", "number", "boolean"}
    bounded = shape.minimum is not None or shape.maximum is not None
    asked = bounded or reads_text(shape) or any(told & set(form.types) or form.values for form in forms(shape))
    return bool(asked) and not record_tree(shape)


def reads_text(shape: Shape) -> bool:
    """Do rules of the value itself ask for its text?"""
    lengths = (shape.min_length, shape.max_length)
    own = shape.pattern or shape.format or any(bound is not None for bound in lengths)
    listed = any(isinstance(value, str) for value in shape.values)
    return bool(own or listed) or any(reads_text(form) for form in forms(shape)[1:])


def looped(place: Place, loop: Loop) -> str:
    """Violations of a value of a recursive shape and of all such values within it.

    Most values hold none, as they lack the fields that could, and then the value itself is checked. Else they are
    gathered turn by turn, each turn those that the last ones hold. Some turns are always there; where they leave values
    over, there are as many more as the value has opening brackets, as it can't be nested deeper, nor deeper than the
    parser goes. Turns with nothing left change nothing. Where a turn took several values, all are put into the order of the document; else they stand in
    each other and are in order. They are checked by one copy of the rules of each shape.
    """
    work, turn, one, top = (f"{name}{place.depth}" for name in ("work", "turn", "node", "top"))
    left, right = f"left{place.depth}", f"right{place.depth}"
    first = node(loop.entry, place.path, place.pattern, "array(0)", place.value)
    brackets = f"regexp_count(to_json({top}.value), {quote(chr(92) + '[|' + chr(92) + '{')})"
    alone = len(loop.members) == 1
    held = []
    for kind, (_, routes) in loop.members.items():
        for number, (steps, target) in enumerate(routes):
            order = f"array_append({one}.order, {number})"
            found = along(f"{one}.value", f"{one}.path", f"{one}.pattern", order, steps, target, place.depth)
            held.append(found if alone else f"if({one}.kind = {quote(kind)}, {found}, {NO_NODES})")
    inner = f"{one} -> {held[0] if len(held) == 1 else f'concat({", ".join(held)})'}"
    taken = (
        f"({work}, {turn}) -> if(size({work}.front) = 0, {work}, named_struct("
        f"'front', flatten(transform({work}.front, {inner})), 'done', flatten(array({work}.done, {work}.front)), "
        f"'wide', {work}.wide OR size({work}.front) > 1))"
    )
    before = f"({left}, {right}) -> if({left}.order < {right}.order, -1, 1)"
    in_order = f"if({work}.wide, array_sort({work}.done, {before}), {work}.done)"
    below = f"flatten(transform(array({top}), {inner}))"
    start = f"named_struct('front', {below}, 'done', array({top}), 'wide', false)"
    more = f"aggregate(sequence(1, least({brackets}, {DEEPEST})), {work}, {taken}, {work} -> {in_order})"
    rest = f"{work} -> if(size({work}.front) = 0, {in_order}, {more})"
    gathered = f"aggregate(sequence(1, {TURNS}), {start}, {taken}, {rest})"
    nodes = f"if({may_hold(place.value, loop)}, flatten(transform(array({first}), {top} -> {gathered})), array({first}))"
    spot, checked = f"spot{place.depth + 1}", []
    for kind, (shape, _) in loop.members.items():
        fields = f"'path', {one}.path, 'pattern', {one}.pattern, {spot_fields(f'{one}.value', shape)}"
        spots = f"transform({nodes}, {one} -> named_struct({fields}))" if alone else f"array(named_struct({fields}))"
        rule = checked_spots(spots, shape, place.depth + 1, start=f"{spot}.path", stars=f"{spot}.pattern")
        checked.append(rule.many if alone else f"WHEN {one}.kind = {quote(kind)} THEN {rule.many}")
    return checked[0] if alone else f"flatten(transform({nodes}, {one} -> CASE {' '.join(checked)} END))"


def may_hold(value: str, loop: Loop) -> str:
    """Has a value of the entry a field by which it could hold others? True where a way does not begin with a field."""
    firsts = [steps[0] if steps else None for steps, _ in loop.members[loop.entry][1]]
    if not all(isinstance(step, str) for step in firsts):
        return "true"
    names = list(dict.fromkeys(firsts))
    if not names:
        return "false"
    record = f"try_variant_get({value}, '$', {quote(struct_type(dict.fromkeys(names, 'variant')))})"
    return " OR ".join(f"{record}.{backticked(name)} IS NOT NULL" for name in names)


def node(kind: str, path: str, pattern: str, order: str, value: str) -> str:
    return (
        f"named_struct('kind', {quote(kind)}, 'path', {path}, 'pattern', {pattern}, "
        f"'order', {order}, 'value', {value})"
    )


def along(
    value: str, path: str, pattern: str, order: str, steps: tuple, target: str, depth: int, names: tuple[str, ...] = ()
) -> str:
    """The values at the end of a route, as nodes; none where it ends early. names are steps that lead on from value."""
    at = quote(json_path(*names))
    if not steps:
        value = f"try_variant_get({value}, {at}, 'variant')" if names else value
        return f"if({value} IS NULL, {NO_NODES}, array({node(target, path, pattern, order, value)}))"
    step, *rest = steps
    if isinstance(step, str):
        name = quote(f".{step}")
        return along(
            value,
            f"concat({path}, {name})",
            f"concat({pattern}, {name})",
            order,
            tuple(rest),
            target,
            depth,
            (*names, step),
        )
    item, index = f"held{depth}_{len(rest)}", f"place{depth}_{len(rest)}"
    if isinstance(step, Keys):
        pairs = f"map_entries(try_variant_get({value}, {at}, 'map<string,variant>'))"
        inner = along(
            f"{item}.value",
            f"concat({path}, '.', {item}.key)",
            f"concat({pattern}, '.', {item}.key)",
            f"array_append({order}, {index})",
            tuple(rest),
            target,
            depth,
        )
        chosen = f"filter({pairs}, {item} -> {key_fits(f'{item}.key', step)})"
        return f"coalesce(flatten(transform({chosen}, ({item}, {index}) -> {inner})), {NO_NODES})"
    items = f"try_variant_get({value}, {at}, 'array<variant>')"
    start = step.number if isinstance(step, At) else step
    if isinstance(step, At):
        items = f"slice({items}, {start + 1}, 1)"
    elif start:
        items = f"slice({items}, {start + 1}, greatest(size({items}), 0))"
    inner = along(
        item,
        f"concat({path}, '[', cast({index} + {start} AS string), ']')",
        f"concat({pattern}, '[*]')",
        f"array_append({order}, {index})",
        tuple(rest),
        target,
        depth,
    )
    return f"coalesce(flatten(transform({items}, ({item}, {index}) -> {inner})), {NO_NODES})"


def checked_spots(
    spots: str, shape: Shape, depth: int, *, start: str, stars: str | None, star_base: str = ""
) -> Rule:
    """Violations of every spot of a list, in order; texts are made only for those that are not sound."""
    one = f"spot{depth}"
    has_fields = bool(record_tree(shape))
    bounded = shape.minimum is not None or shape.maximum is not None
    place = Place(
        f"{one}.value",
        record=f"{one}.record" if has_fields else "",
        tree=record_tree(shape),
        lists=f"{one}.lists",
        listed=listed_keys(shape) or (frozenset([()]) if reads_items(shape) and not has_fields else frozenset()),
        start=start,
        stars=stars,
        star_base=star_base,
        is_record=has_fields,
        depth=depth + 1,
        known_kind=f"{one}.kind" if reads_kind(shape) else None,
        known_text=f"{one}.text" if reads_kind(shape) and reads_text(shape) else None,
        known_number=f"{one}.number" if reads_kind(shape) and bounded else None,
    )
    return Rule(
        many=f"flatten(transform({spots}, {one} -> {violations_at(place, shape)}))",
        some=f"exists({spots}, {one} -> {any_rule_broken(place, shape)})",
    )


def any_rule_broken(place: Place, shape: Shape) -> str:
    """Is anything wrong below a place? NULL counts as no."""
    return one_broken(rules_of(place, shape))


def one_broken(rules: Iterable[Rule]) -> str:
    tests = [rule.any_broken for rule in rules if not rule.implied]
    return f"({' OR '.join(f'({test})' for test in tests) or 'false'})"


def valid_for(place: Place, shape: Shape) -> str:
    return f"(NOT coalesce({any_rule_broken(place, shape)}, false))"


def violations_at(place: Place, shape: Shape) -> str:
    """All violations below a place, in order.

    Every rule gives an array, empty or of one violation, and the arrays are joined:
    outside lists this leaves no step that Spark cannot compile. Inside them rules that are quickly tested are tested
    first, and arrays made only where one is broken; what takes as much work to test as to list is listed at once.
    """
    rules = list(rules_of(place, shape))
    if place.start is None:
        return joined([listed_rule(rule) for rule in rules])
    found = []
    for quick, run in groupby(rules, lambda rule: rule.cheap or not rule.many):
        group = list(run)
        arrays = [listed_rule(rule) for rule in group]
        if quick and len(group) > 1:
            found.append(f"if({one_broken(group)}, flatten(array({', '.join(arrays)})), {NO_VIOLATIONS})")
        else:
            found += arrays
    return f"flatten(array({', '.join(found)}))" if len(found) > 1 else (found or [NO_VIOLATIONS])[0]


def listed_rule(rule: Rule) -> str:
    if rule.many:
        return f"coalesce({rule.many}, {NO_VIOLATIONS})"
    one = violation(rule.path, rule.pattern, rule.keyword, rule.message)
    return f"if({rule.broken}, array({one}), {NO_VIOLATIONS})"


def joined(arrays: list[str]) -> str:
    """All arrays in one, joined in groups: the compiler leaves very long methods alone."""
    if not arrays:
        return NO_VIOLATIONS
    if len(arrays) <= GROUP:
        return f"concat({', '.join(arrays)})"
    groups = [arrays[start : start + GROUP] for start in range(0, len(arrays), GROUP)]
    return joined([joined(group) for group in groups])


def violations_sql(
    doc: str, record: str, shape: Shape, root: str = "$", *, lists: str = "", names: str = ""
) -> str:
    """SQL expression for the violations of a VARIANT column.

    record names a column that holds read_record(doc, shape), lists one that holds read_lists(doc, shape) and names
    one that holds read_names(doc, record, shape).
    """
    place = Place(
        doc,
        record=record,
        tree=record_tree(shape),
        lists=lists,
        listed=listed_keys(shape) if lists else frozenset(),
        names_of={keys: f"{names}.n{number}" for number, keys in enumerate(name_keys(shape))} if names else {},
        base=root,
        star_base=root,
        is_record=bool(record_tree(shape)),
    )
    return violations_at(place, shape)


def validate(
    cards: DataFrame,
    shapes: Shape | dict[str, Shape],
    *,
    doc: str = "doc",
    key: str = "card_type",
    root: str = "$",
) -> DataFrame:
    """Add violations, error_count and is_valid.

    With a dictionary, each row is checked by the shape its key column names; rows
    with another key get NULL, so that "not checked" never reads as "valid". The key
    may be the card type, a profile name or the schema version of a registry.
    """
    by_key = {None: shapes} if isinstance(shapes, Shape) else shapes
    records, key_names, found = {}, {}, []
    for number, (wanted, shape) in enumerate(by_key.items()):
        name, lists, names = f"_record_{number}", f"_lists_{number}", f"_names_{number}"
        document = backticked(doc)
        if wanted is not None:
            document = f"if({backticked(key)} = {quote(wanted)}, {document}, NULL)"
        if record_tree(shape):
            records[name] = F.expr(read_record(document, shape))
        if list_tree(shape):
            records[lists] = F.expr(read_lists(document, shape))
        if record_tree(shape) and list(name_keys(shape)):
            key_names[names] = F.expr(read_names(document, name, shape))
        at = {"lists": lists, "names": names if names in key_names else ""}
        checked = F.expr(violations_sql(backticked(doc), name, shape, root, **at))
        chosen = F.col(backticked(key)) == wanted
        found.append(checked if wanted is None else F.when(chosen, checked))
    # The records are columns of their own, so that each document is read once for fields, once for lists and once for key names.
    checked = (
        cards.withColumns(records)
        .withColumns(key_names)
        .withColumn("violations", F.coalesce(*found))
        .withColumn("error_count", F.when(F.col("violations").isNotNull(), F.size("violations")))
        .withColumn("is_valid", F.col("error_count") == 0)
        .drop(*records, *key_names)
    )
    return fence(checked, "violations", "error_count", "is_valid")


def with_report(checked: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Add the first violations, how many more there are, and both as one text."""
    found = F.col("violations")
    first = F.slice(found, 1, shown)
    more = F.greatest(F.size(found) - shown, F.lit(0))
    lines = F.transform(
        first, lambda v: F.concat(F.lit("• "), v["path"], F.lit(": "), v["message"])
    )
    tail = F.concat(F.lit("... and "), more.cast("string"), F.lit(" more errors"))
    return checked.withColumns(
        {
            "shown": first,
            "more_errors": F.when(found.isNotNull(), more),
            "report": F.concat_ws("\n", lines, F.when(more > 0, tail)),
        }
    )
