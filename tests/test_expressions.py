import json

import pytest
from pyspark.sql import functions as F

from cardmill.functions.text import (
    first_paragraph,
    join_present,
    labelled_text,
    leading_integer,
    utf16_length,
)
from cardmill.functions.values import Field, as_text, first_truthy

VALUES = [
    ('{"v": null}', False),
    ('{"v": ""}', False),
    ('{"v": 0}', False),
    ('{"v": 0.0}', False),
    ('{"v": -0.0}', False),
    ('{"v": 0e3}', False),
    ('{"v": false}', False),
    ("{}", False),
    ('{"v": "0"}', True),
    ('{"v": "false"}', True),
    ('{"v": "NA"}', True),
    ('{"v": " "}', True),
    ('{"v": 0.5}', True),
    ('{"v": true}', True),
    ('{"v": []}', True),
    ('{"v": {}}', True),
    ('{"v": [0]}', True),
]


def test_truthiness_with_and_without_text_form(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(VALUES)], "i int, raw string")
    doc = rows.select(
        "i",
        F.expr("variant_get(parse_json(raw), '$.v', 'variant')").alias("v"),
        F.expr("variant_get(parse_json(raw), '$.v', 'string')").alias("s"),
    )
    probed, paired = Field(F.col("v")), Field(F.col("v"), F.col("s"))
    found = doc.select("i", probed.truthy.alias("a"), paired.truthy.alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in found] == [(want, want) for _, want in VALUES]


def test_first_truthy_keeps_the_json_type(spark):
    doc = spark.sql("SELECT parse_json('0') AS a, parse_json('[]') AS b, parse_json('\"x\"') AS c")
    a, b, c = (Field(F.col(name)) for name in "abc")
    row = doc.select(
        F.to_json(first_truthy(a, b, c)).alias("list"),
        F.to_json(first_truthy(a, c)).alias("text"),
        F.to_json(first_truthy(a, default="d")).alias("default"),
        first_truthy(a).isNull().alias("none"),
    ).first()
    assert (row["list"], row["text"], row["default"], row["none"]) == ("[]", '"x"', '"d"', True)


def test_text_of_values(spark):
    cases = {'"x"': "x", "1.50": "1.5", "true": "true", '["a",null,2]': "a,,2", '{"a":1}': "[object Object]", '"[x]"': "[x]"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select(
        "raw", F.parse_json("raw").alias("v")
    )
    found = {r.raw: r.t for r in rows.select("raw", as_text(Field(F.col("v"))).alias("t")).collect()}
    assert found == cases


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1,250", 1), ("12.7", 12), ("abc", None), ("", None), ("  -8x", -8), ("+5", 5),
        ("0x1F", 31), ("-0x10", -16), (" 7", 7), ("x7", None),
        ("12345678901234567890", 12345678901234567890), ("0x000F", 15), ("9" * 40, 1e40), ("0x" + "F" * 22, 16.0**22),
        ("-0x" + "F" * 22, -(16.0**22)), ("1" + "0" * 400, "null"), ("0x" + "1" * 400, "null"),
    ],
)
def test_leading_integer(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(F.to_json(leading_integer(F.col("t")))).first()
    if want is None or want == "null":
        assert row[0] == want
    else:
        assert float(row[0]) == want if isinstance(want, float) else int(row[0]) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1e3", "1000"), ("1e10", "10000000000"), ("1e21", "1e+21"), ("1.5e-7", "1.5e-7"), ("1e-7", "1e-7"),
     ("1.5e-5", "0.000015"), ("0.00000012", "1.2e-7"), ("-2.50e1", "-25"), ("1.25e1", "12.5"), ("1.50", "1.5"),
     ("12345678.9e0", "12345678.9"), ("7", "7"), ('"1000.0"', "1000.0"), ("[1e3, 2]", "1000,2")],
)
def test_numbers_read_as_a_script_prints_them(spark, raw, want):
    value = spark.createDataFrame([(raw,)], "raw string").select(F.parse_json("raw").alias("v"))
    assert value.select(as_text(Field(F.col("v")))).first()[0] == want


def test_an_empty_list_has_a_label(spark, cards_of):
    from test_convert import nested

    rows = nested(cards_of, {"model_name": "m", "sustainability": [], "time_to_train": 1e3, "medical_task": ""})
    comments = rows.select(F.variant_get("section", "$.Comments", "string")).first()[0]
    assert comments == "Sustainability: \n\nTraining Time: 1000"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n\nNoise Issues: some\nmore", "some"),
        ("NOISE ISSUES:   x  ", "x"),
        ("Noise Issues:\nnext line", "next line"),
        ("Noise Issues:  y﻿", "y"),
        ("Noise Issues: one\nNoise Issues: two", "one"),
        ("My Noise Issues: in the middle", "in the middle"),
        ("Noise Issues:", ""),
        ("nothing", ""),
        (None, ""),
    ],
)
def test_labelled_text(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(
        labelled_text(F.col("t"), "Noise Issues")
    ).first()
    assert row[0] == want


def test_paragraphs_and_lengths(spark):
    row = spark.createDataFrame([("a\nb\n\nc\n\nd", "x😀é", "")], "p string, u string, e string").select(
        first_paragraph(F.col("p")).alias("first"),
        utf16_length(F.col("u")).alias("units"),
        join_present("|", F.col("e"), F.col("u"), F.lit(None).cast("string")).alias("joined"),
    ).first()
    assert (row["first"], row["units"], row["joined"]) == ("a\nb", 4, "x😀é")


def test_preview_matches_two_space_json(spark):
    from cardmill import preview_json

    value = {"b": [], "a": {"x": ["é", 1], "y": {}}}
    shown = spark.createDataFrame([(json.dumps(value),)], "raw string").select(
        preview_json(F.parse_json("raw"))
    ).first()[0]
    assert shown == json.dumps(dict(sorted(value.items())), indent=2, ensure_ascii=False)
