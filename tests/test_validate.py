import json

import pytest

import cardmill
from cardmill.contracts.profiles import dataset_section, subset
from cardmill.contracts.schema_documents import form_from_document, shape_from_document
from cardmill.contracts.shapes import Shape, choice, integer, listing, record, text
from test_convert import DATASET, MODEL, nested

GROUP = {"Site count": 3, "Age range": [[2, "months"], [11, "years"]], "Sex": "Unsure"}
CARD = {
    "$schema": "FAM-dataset-2031-01.json",
    "Dataset": {
        "Name": "Knees",
        "Indexing code": {"Content": ["MR"]},
        "Author": [{"Name": "Q. Writer", "Email": "q@lab.example"}],
        "Date": {"Created": 1999},
        "Reference": [{"Title": "On knees"}],
        "Imaging": {"File format": ["DICOM"]},
        "Composition": {
            "Data type": ["Image"],
            "Number of instances": 4,
            "Representativeness": {"Sample type": ["Convenience sample"]},
        },
        "Partition": [
            {"Partition name": "Left", "Data": GROUP},
            {"Partition name": "Right", "Data": GROUP | {"Demographic": "left-handed"}},
        ],
    },
}


def faults(cards, shape, **where):
    rows = cardmill.validate(cards, shape, **where).collect()
    return [[(v.path, v.keyword) for v in row.violations] for row in rows]


def check(cards_of, shape, *values):
    return faults(cards_of(*[("c", json.dumps(value)) for value in values]), shape)


def test_declared_dataset_reports_in_order(cards_of):
    cards = cards_of(("c.json", json.dumps(CARD)))
    want = [
        ("$.$schema", "const"),
        ("$.Dataset.Reference[0]", "type"),
        ("$.Dataset.Composition.Data type", "enum"),
        ("$.Dataset.Composition.Representativeness.Sample type", "enum"),
        ("$.Dataset.Partition[0].Data.Sex", "enum"),
        ("$.Dataset.Partition[1].Data.Sex", "enum"),
        ("$.Dataset.Partition[1].Data.Demographic", "enum"),
    ]
    assert faults(cards, cardmill.declared_dataset("FAM")) == [want]
    report = cardmill.with_report(
        cardmill.validate(cards, cardmill.declared_dataset("FAM"))
    ).first()
    assert report.report.endswith("... and 2 more errors")
    assert len(report.shown) == 5 and report.more_errors == 2 and not report.is_valid


def test_overrides_are_explicit(cards_of):
    shape = cardmill.declared_dataset("FAM", values_on_items=True, release="2031-01")
    found = check(cards_of, shape, CARD)[0]
    assert [keyword for _, keyword in found] == ["type", "enum", "enum", "enum"]


def test_converted_dataset_breaks_the_declared_section(cards_of):
    section = dataset_section(subset())
    found = faults(nested(cards_of, DATASET), section, doc="section")[0]
    subsets = [("additionalProperties", 4), ("type", 2), ("enum", 1)]
    for position in (0, 1):
        own = [k for p, k in found if p.startswith(f"$.Subsets[{position}]")]
        assert [(kind, own.count(kind)) for kind, _ in subsets] == subsets
    rest = [(p, k) for p, k in found if "Subsets" not in p]
    assert rest == [
        ("$.Indexing code.Content[0]", "enum"),
        ("$.Indexing code.Content[1]", "enum"),
        ("$.Imaging.Burned-in PHI", "enum"),
        ("$.Composition.Data type", "enum"),
        ("$.Composition.Representativeness.Sample type", "type"),
        ("$.Composition.Representativeness.Sample type", "enum"),
    ]


def test_profiles_differ_on_years_and_coded_objects(cards_of):
    card = {"Name": "x", "Date": {"Created": 2025}, "Extra": 1}
    declared = dataset_section(subset())
    assert check(cards_of, declared, card) == [[("$.Extra", "additionalProperties")]]
    assert check(cards_of, cardmill.form_dataset(), card) == [[("$.Date.Created", "type")]]
    old = card | {"Date": {"Created": 1850}}
    assert ("$.Date.Created", "minimum") in check(cards_of, declared, old)[0]


def test_legacy_model(cards_of):
    found = faults(nested(cards_of, MODEL), cardmill.legacy_model(), doc="section")[0]
    assert found == [
        ("$.Results[0].Metric[0]", "enum"),
        ("$.Results[1].Metric[0]", "enum"),
        ("$.Results[1].Metric[1]", "enum"),
    ]


@pytest.mark.parametrize(
    ("value", "fits"),
    [(1, True), (1.0, True), (100.0, True), (1.5, False), ("1", False), (True, False), (None, False)],
)
def test_integers(cards_of, value, fits):
    assert check(cards_of, record({"n": integer()}), {"n": value})[0] == (
        [] if fits else [("$.n", "type")]
    )


def test_exponent_integer(cards_of):
    assert faults(cards_of(("c", '{"n": 1e2}')), record({"n": integer()})) == [[]]


def test_null_is_present(cards_of):
    shape = record({"a": text()}, required=("a",))
    assert check(cards_of, shape, {}, {"a": None}, {"a": ""}) == [
        [("$.a", "required")],
        [("$.a", "type")],
        [],
    ]


def test_rules_skip_other_types(cards_of):
    shape = Shape(min_length=3, minimum=5, min_items=2, min_keys=1, required=("a",))
    values = ("abc", 7, [1, 2], {"a": 1}, "ab", 4, [1], {}, True)
    found = [[k for _, k in row] for row in check(cards_of, shape, *values)]
    assert found == [[], [], [], [], ["minLength"], ["minimum"], ["minItems"],
                     ["required", "minProperties"], []]


def test_unique_items_compare_as_json(cards_of):
    shape = listing(unique=True)
    values = ([1, 1.0], [1, "1"], [{"a": 1, "b": 2}, {"b": 2, "a": 1}], [[1], [1, 2]])
    assert [bool(row) for row in check(cards_of, shape, *values)] == [True, False, True, False]


def test_subsets_are_checked_at_any_depth(cards_of):
    card = {"Sex": "Female"}
    for depth in range(12):
        card = {"Sex": "Other", "Subset": [{"Sex": "Female"}, card] if depth % 2 else [card]}
    found = check(cards_of, subset(), card)[0]
    paths, path, node = [], "$", card
    while node:
        paths += [(f"{path}.Sex", "enum")] * (node["Sex"] == "Other")
        inner = node.get("Subset", [])
        path, node = f"{path}.Subset[{len(inner) - 1}]", inner[-1] if inner else None
    assert found == paths and len(found) == 12


def test_order_of_nested_values_is_that_of_the_document(cards_of):
    odd = {"Sex": 1}
    card = {"Subset": [{"Sex": 1, "Subset": [odd, odd]}, odd], "Sex": 1}
    places = ["", ".Subset[0]", ".Subset[0].Subset[0]", ".Subset[0].Subset[1]", ".Subset[1]"]
    assert [p for p, k in check(cards_of, subset(), card)[0] if k == "type"] == [f"${p}.Sex" for p in places]


def test_gathering_reads_brackets_and_sorts_only_where_it_must(cards_of):
    """Chains beyond the first turns and wide values among them give all places in order."""

    def places(card, path="$"):
        inner = [p for i, c in enumerate(card.get("Subset", [])) for p in places(c, f"{path}.Subset[{i}]")]
        return [f"{path}.Sex"] * (card.get("Sex") == 1) + inner

    def chain(depth, end):
        return {"Sex": 1, "Subset": [chain(depth - 1, end)]} if depth else end

    wide = {"Sex": 1, "Subset": [chain(3, {"Sex": 1}), {}, {"Sex": 1, "Subset": [{"Sex": 1}, {"Sex": 1}]}]}
    cards = [chain(n, end) for n in (0, 1, 7, 8, 9, 25) for end in ({"Sex": 1}, wide)]
    for card, found in zip(cards, check(cards_of, subset(), *cards), strict=True):
        assert [p for p, k in found if k == "type"] == places(card)
    sql = cardmill.operators.validate.violations_sql("doc", "_record_0", subset())
    # The depth is counted and the places are sorted behind a test, not for each card that holds another value.
    assert ".wide, array_sort(" in sql and "aggregate(sequence(1, least(" not in sql.split(".front) = 0, ")[0]


MUTUAL = {
    "$ref": "#/$defs/tree",
    "$defs": {
        "tree": {
            "type": "object",
            "properties": {"name": {"type": "string"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/leaf"}},
                           "left": {"$ref": "#/$defs/tree"}},
            "additionalProperties": False,
        },
        "leaf": {"properties": {"size": {"minimum": 0}, "tree": {"$ref": "#/$defs/tree"}}},
    },
}


def test_definitions_that_hold_each_other(cards_of):
    card = {"name": "r", "left": {"name": 1, "left": {"odd": 1}}, "kids": [
        {"size": 1}, {"size": -1, "tree": {"kids": [{"size": -2}], "name": 2}}]}
    assert sorted(check(cards_of, shape_from_document(MUTUAL), card)[0]) == [
        ("$.kids[1].size", "minimum"),
        ("$.kids[1].tree.kids[0].size", "minimum"),
        ("$.kids[1].tree.name", "type"),
        ("$.left.left.odd", "additionalProperties"),
        ("$.left.name", "type"),
    ]


def test_no_rule_is_skipped(cards_of):
    document = {
        "properties": {
            "list": {"$ref": "#/$defs/list", "minItems": 1}, "none": {"const": None}, "pair": {
                "prefixItems": [{"type": "string"}], "items": False}, "when": {"format": "date-time"},
            "never": False, "rest": {"type": "array", "unevaluatedItems": True, "items": True},
        },
        "$defs": {"list": {"type": "array"}},
    }
    shape = shape_from_document(document)
    bad = {"list": [], "none": 0, "pair": ["a", 1], "when": "no", "never": None, "rest": [1]}
    assert check(cards_of, shape, bad)[0] == [
        ("$.list", "minItems"), ("$.none", "const"), ("$.pair[1]", "false"), ("$.when", "format"),
        ("$.never", "false"),
    ]
    good = {"list": [1], "none": None, "pair": ["a"], "when": "2020-02-29T10:00:00Z", "rest": []}
    assert check(cards_of, shape, good, {"when": "2021-02-29T10:00:00Z"}) == [[], [("$.when", "format")]]
    for odd in ({"format": "hostname"}, {"$ref": "#/$defs/a", "type": "array", "$defs": {"a": {"type": "object"}}}):
        with pytest.raises(ValueError):
            shape_from_document(odd)


def test_forms_make_combined_rules_a_text(cards_of):
    document = {"$defs": {"model": {"properties": {
        "any": {"anyOf": [{"type": "number"}]}, "all": {"allOf": [{}]}, "map": {"additionalProperties": {"type": "number"}},
        "keys": {"patternProperties": {"a": {}, "b": {}}}, "plain": {"type": "array", "items": False}}}}}
    form = form_from_document(document, "model")
    assert [p for p, _ in check(cards_of, form, dict.fromkeys(("any", "all", "map", "keys"), 1))[0]] == [
        "$.any", "$.all", "$.map", "$.keys"]
    assert form_from_document({"$defs": {"model": "no object"}}, "model").required == ("Name",)


def test_columns_may_have_any_name(cards_of):
    cards = cards_of(("a", '{"k": 1}')).selectExpr("doc AS `the doc`", "'v 1' AS `schema version`")
    rows = cardmill.validate(cards, {"v 1": record({"k": text()})}, doc="the doc", key="schema version").collect()
    assert [v.keyword for v in rows[0].violations] == ["type"]


SCHEMA = {
    "type": "object",
    "properties": {"Model": {"$ref": "#/$defs/model"}},
    "$defs": {
        "model": {
            "type": "object",
            "properties": {
                "Name": {"type": "string"},
                "Codes": {"type": "array", "items": {"type": "string", "enum": list("abcdef")}},
                "When": {"type": ["string", "number"], "if": {"type": "string"},
                         "then": {"format": "date"}, "else": {"minimum": 1900}},
                "Inner": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/model"}},
            },
            "required": ["Name"],
            "additionalProperties": False,
        }
    },
}


def test_schema_documents(cards_of):
    inner = {"Name": 1, "Inner": [{"Name": "x", "Other": 1}]}
    card = {"Model": {"Name": "m", "Codes": ["a", "a", "z"], "When": 1850, "Inner": [inner]}}
    assert check(cards_of, shape_from_document(SCHEMA), card)[0] == [
        ("$.Model.Codes[2]", "enum"),
        ("$.Model.When", "minimum"),
        ("$.Model.Inner[0].Name", "type"),
        ("$.Model.Inner[0].Inner[0].Other", "additionalProperties"),
    ]
    form = form_from_document(SCHEMA, "model")
    assert check(cards_of, form, card["Model"] | {"Other": 1})[0] == [
        ("$.Codes", "uniqueItems"),
        ("$.Codes[2]", "enum"),
        ("$.When", "type"),
        ("$.Inner[0].Name", "type"),
        ("$.Inner[0].Inner[0]", "type"),
    ]
    assert form_from_document(SCHEMA, "dataset").required == ("Name",)


def test_unsupported_rules_are_refused():
    with pytest.raises(ValueError, match="not supported: anyOf"):
        shape_from_document({"anyOf": [{"type": "string"}]})


def test_unchecked_is_not_valid(cards_of):
    cards = cardmill.classify(cards_of(("a.json", '{"Dataset": {"Name": "x"}}'), ("b", "no json")))
    rows = cardmill.validate(cards, {"dataset": Shape(types=("object",))}).collect()
    assert [(r.error_count, r.is_valid) for r in rows] == [(0, True), (None, None)]


def test_summary_counts_cards_and_violations(cards_of):
    shape = listing(text())
    cards = cards_of(*[("c", json.dumps(v)) for v in ([1, 2, "x"], [3], ["y"], 4)])
    rows = cardmill.violation_summary(cardmill.validate(cards, shape)).collect()
    found = {(r.path, r.keyword): (r.cards, r.violations) for r in rows}
    assert found == {("$[*]", "type"): (2, 3), ("$", "type"): (1, 1)}


def test_summary_keeps_odd_keys_apart(cards_of):
    shape = record({})
    cards = cards_of(*[("c", json.dumps({k: 1})) for k in ("x\u0001y", "k[1]", "k[2]", "k[2]")])
    rows = cardmill.violation_summary(cardmill.validate(cards, shape)).collect()
    assert {(r.path, r.keyword, r.cards) for r in rows} == {
        ("$.x\u0001y", "additionalProperties", 1), ("$.k[1]", "additionalProperties", 1),
        ("$.k[2]", "additionalProperties", 2)}


def test_deep_and_wide_values_of_a_recursive_rule(cards_of):
    """As deep as the parser goes, and with far more brackets than levels."""
    deep = {"Sex": "Other"}
    for _ in range(300):
        deep = {"Subset": [deep]}
    wide = {"Sex": "Other", "Extra": [[] for _ in range(50_000)], "Subset": [{"Sex": "Other"}]}
    tall, broad = check(cards_of, subset(), deep, wide)
    assert [(p.count("Subset"), k) for p, k in tall if k == "enum"] == [(300, "enum")]
    assert [p for p, k in broad if k == "enum"] == ["$.Sex", "$.Subset[0].Sex"]


def test_key_patterns_and_all_other_keys(cards_of):
    document = {
        "properties": {"n": {"type": "integer"}},
        "patternProperties": {"^a": {"type": "string"}, "z$": {"minLength": 2}},
        "additionalProperties": {"type": "array", "items": {"maximum": 3}},
    }
    shape = shape_from_document(document)
    assert check(cards_of, shape, {"n": 1, "a": "x", "az": "x", "o": [1, 5], "p": "t", "z": 1})[0] == [
        ("$.az", "minLength"), ("$.o[1]", "maximum"), ("$.p", "type"),
    ]
    closed = shape_from_document({**document, "additionalProperties": False})
    assert check(cards_of, closed, {"n": 1, "a": "x", "bz": "xx", "o": 1})[0] == [("$.o", "additionalProperties")]


def test_lists_and_key_names_are_read_once(cards_of):
    """Every rule of a list looks at the same items, also inside lists, and key names are read once an object."""
    inner = listing(choice("a", "b"), lead=(integer(minimum=0, maximum=9),), min_items=2, max_items=3)
    shape = record({"tags": listing(text(), min_items=1, max_items=3, unique=True), "pairs": listing(inner, max_items=2)},
                   min_keys=1, max_keys=2)
    plan = cardmill.validate(cards_of({}), shape)._jdf.queryExecution().analyzed().toString()
    # Parsing, both lists of the card, and the lists within a list; the keys of the card; the number of a pair.
    assert [plan.count(part) for part in ("ArrayType(VariantType", "MapType(StringType", "DoubleType")] == [4, 1, 1]
    cards = [
        {"tags": ["x", "y"], "pairs": [[1, "a"], [9, "b", "a"]]},
        {"tags": ["x", "x", 1, "1"], "pairs": [[10, "c"], [1], "no", None], "odd": 0},
        {"tags": None, "pairs": {}},
        {"tags": ["5", 5, None, "null"][:3]},
        {"tags": [], "odd": None},
        {},
    ]
    found = check(cards_of, shape, *cards)
    assert found[0] == [] and found[5] == [("$", "minProperties")]
    assert sorted(found[1]) == sorted([
        ("$.odd", "additionalProperties"), ("$", "maxProperties"), ("$.tags", "maxItems"), ("$.tags", "uniqueItems"),
        ("$.tags[2]", "type"), ("$.pairs", "maxItems"), ("$.pairs[0][0]", "maximum"), ("$.pairs[0][1]", "enum"),
        ("$.pairs[1]", "minItems"), ("$.pairs[2]", "type"), ("$.pairs[3]", "type")])
    assert found[2] == [("$.tags", "type"), ("$.pairs", "type")]
    assert found[3] == [("$.tags[1]", "type"), ("$.tags[2]", "type")]
    assert found[4] == [("$.odd", "additionalProperties"), ("$.tags", "minItems")]


def test_closed_forms_of_a_combined_rule_know_their_own_fields(cards_of):
    """A form that forbids other fields names fields that the shape around it may not."""
    forms = (record({"a": Shape()}), record({"b": Shape(), "c": Shape()}))
    shape = record({"one": Shape(one_of=forms), "many": listing(Shape(one_of=forms))}, closed=False)
    cards = [{"one": {"a": 1}, "many": [{"b": 1}, {"c": None}]}, {"one": {"a": 1, "b": 2}, "many": [{"d": 1}, {}, 7]}]
    found = check(cards_of, shape, *cards)
    assert found[0] == []
    assert found[1] == [("$.one", "oneOf"), ("$.many[0]", "oneOf"), ("$.many[1]", "oneOf"), ("$.many[2]", "oneOf")]


def test_records_that_are_missing_null_or_no_objects(cards_of):
    shape = record({"in": record({"deep": record({"n": integer()}, required=("n",))}, required=("deep",))},
                   required=("in",))
    cards = [{}, {"in": None}, {"in": []}, {"in": {}}, {"in": {"deep": None, "x": 1}}, {"in": {"deep": {"n": None}}},
             {"in": {"deep": {}}}, {"in": {"deep": {"n": 1}}, "in2": {}}]
    assert check(cards_of, shape, *cards) == [
        [("$.in", "required")],
        [("$.in", "type")],
        [("$.in", "type")],
        [("$.in.deep", "required")],
        [("$.in.x", "additionalProperties"), ("$.in.deep", "type")],
        [("$.in.deep.n", "type")],
        [("$.in.deep.n", "required")],
        [("$.in2", "additionalProperties")],
    ]
