import pytest

import cardmill
from cardmill.operators.classify import card_preview

CASES = [
    # name, text, parsed, format, card type, refused for
    ("a.txt", '{"model_name": "m"}', True, "txt", "model", None),
    ("A.TXT", '{"Model": {"Name": "m"}}', True, "txt", "model", None),
    ("a.json", '{"dataset_name": "d"}', True, "json", "dataset", None),
    ("a", '{"dataset_name": "d"}', True, "txt", "dataset", None),
    ("a", '{"Dataset": {}}', True, "json", "dataset", None),
    ("a", '{"Model": "", "Dataset": {}}', True, "json", "dataset", None),
    ("a", '{"Model": {}, "Dataset": {}}', True, "json", "model", None),
    ("a", '{"model_name": "", "x": 1}', True, "json", "unknown", "unknown_type"),
    ("a", "[]", True, "json", "unknown", "unknown_type"),
    ("a", "7", True, "json", "unknown", "unknown_type"),
    ("a", "0", True, "json", "unknown", "no_data"),
    ("a", '""', True, "json", "unknown", "no_data"),
    ("a", "null", True, "json", "unknown", "invalid_file"),
    ("a", "", False, "json", "unknown", "invalid_file"),
    ("a", '{"Model": {}} x', False, "json", "unknown", "invalid_file"),
    ("a", '{"Model": {}}{}', False, "json", "unknown", "invalid_file"),
    ("a", '{"Model": {}},1', False, "json", "unknown", "invalid_file"),
    ("a", '[1] ]', False, "json", "unknown", "invalid_file"),
    ("a", '1] junk', False, "json", "unknown", "invalid_file"),
    ("a", "Name: m", False, "json", "unknown", "invalid_file"),
    ("a", ' {"Model": {"Name": 1, "Name": 2}} \n', True, "json", "model", None),
    ("a", '﻿{"Model": {}}', True, "json", "model", None),
]


def test_classification(cards_of):
    cards = cards_of(*[(f"{i}/{case[0]}", case[1]) for i, case in enumerate(CASES)])
    found = {
        int(r.file_name.split("/")[0]): (r.parse_ok, r.format, r.card_type, r.reject_reason)
        for r in cardmill.classify(cards).collect()
    }
    assert found == {i: case[2:] for i, case in enumerate(CASES)}


def test_last_of_duplicate_keys_wins(cards_of):
    row = cards_of(("a", '{"k": 1, "k": 2}')).selectExpr("variant_get(doc, '$.k', 'int') AS k")
    assert row.first().k == 2


def test_split_keeps_every_row(cards_of):
    cards = cardmill.classify(cards_of(*[(case[0], case[1]) for case in CASES]))
    good, bad = cardmill.split_rejects(cards)
    assert good.count() == 9 and good.count() + bad.count() == len(CASES)


def test_whole_files_and_names(spark, tmp_path):
    (tmp_path / "a b+c%20é.json").write_text('{"Model":\n {"Name": "x"}}\n')
    (tmp_path / "notes.txt").write_text("Name (name): x\n\nText: y\n")
    rows = {
        r.file_name: (r.parse_ok, r.card_type)
        for r in cardmill.classify(cardmill.read_cards(spark, str(tmp_path))).collect()
    }
    assert rows == {"a b+c%20é.json": (True, "model"), "notes.txt": (False, "unknown")}


@pytest.mark.parametrize(
    ("raw", "size", "schema"),
    [
        ('{ "Model" : { "v" : 1.0 } }', 17, "Detected from content"),
        ('{"Model": "😀", "$schema": "s"}', 28, "s"),
        ('{"Model": 1, "$schema": ""}', 24, "Detected from content"),
        ('{"Model": [1e10, 1e3, "1.0E10"], "n": 0.5}', 45, "Detected from content"),
    ],
)
def test_preview(cards_of, raw, size, schema):
    row = card_preview(cardmill.classify(cards_of(("a.json", raw)))).first()
    assert (row.size_chars, row.schema_text) == (size, schema)
    assert (row.format_text, row.type_text) == ("JSON", "Model Card")


def test_filters_do_not_repeat_the_parsing(cards_of):
    good, _ = cardmill.split_rejects(cardmill.classify(cards_of(("a.json", '{"Model": {}}'))))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_a_text_beyond_the_parser_has_a_reason_of_its_own(spark):
    cards = spark.sql("SELECT concat('{\"Model\":\"', repeat('x', 20500000), '\"}') AS raw UNION ALL SELECT '{' AS raw")
    rows = cardmill.classify(cardmill.cards_from_table(cards)).select("reject_reason").collect()
    assert sorted(r[0] for r in rows) == ["invalid_file", "too_large"]
