"""Queries for the rules, one or a few keywords each, and for the contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.contracts.profiles import (
    DAY_OR_YEAR,
    INDEXING,
    declared_dataset,
    form_dataset,
    legacy_dataset,
    legacy_model,
    subset,
)
from cardmill.contracts.schema_documents import form_from_document, shape_from_document
from cardmill.contracts.shapes import Keys, Shape, choice, integer, listing, number, record, text
from cardmill.operators.convert import flat_to_nested
from cardmill.operators.reports import violation_summary as summarise_violations
from cardmill.operators.validate import validate, with_report
from cardmill.plans.catalog import query
from cardmill.plans.conversion import sections
from cardmill.plans.corpus import (
    FAMILY,
    flat_dataset_cards,
    flat_model_cards,
    nested_dataset_cards,
    table,
)
from cardmill.sources.cards import cards_from_table


def documents(spark: SparkSession, sf_dir: str, name: str, key: str, raw: str) -> DataFrame:
    """Rows of a table as JSON documents with their key."""
    rows = table(spark, sf_dir, name).selectExpr(f"{key} AS id", f"{raw} AS raw")
    return cards_from_table(rows).select("id", "doc")


def listed(checked: DataFrame) -> DataFrame:
    """One row per violation."""
    return checked.select("id", F.explode("violations").alias("v")).select(
        "id", "v.path", "v.keyword"
    )


def union_sql(source: str, *rules: tuple[str, str, str]) -> str:
    """SQL with a SELECT per (path, keyword, condition)."""
    return " UNION ALL ".join(
        f"SELECT id, {path} AS path, '{keyword}' AS keyword FROM ({source}) WHERE {condition}"
        for path, keyword, condition in rules
    )


# ---- single keywords -----------------------------------------------------------

ORDER_SHAPE = record(
    {
        "status": choice("O", "F"),
        "price": number(minimum=1000, maximum=400000),
        "day": text(format="date"),
        "priority": text(pattern="^[1-4]-", min_length=6, max_length=10),
    }
)
ORDER_DAY = """
CASE o_orderkey % 4 WHEN 0 THEN '2025-02-30' WHEN 1 THEN '2025-2-3'
                    WHEN 2 THEN '2025-02-28' ELSE '' END"""
ORDERS_RAW = f"""to_json(struct(o_orderstatus AS status, o_totalprice AS price,
                                {ORDER_DAY} AS day, o_orderpriority AS priority))"""
ORDER_FAULTS = f"""
SELECT o_orderkey AS id,
  list_filter([
    CASE WHEN o_orderstatus = 'P' THEN '$.status: must be one of the listed values' END,
    CASE WHEN o_totalprice < 1000 THEN '$.price: must be at least 1000' END,
    CASE WHEN o_totalprice > 400000 THEN '$.price: must be at most 400000' END,
    CASE WHEN {ORDER_DAY} <> '2025-02-28' THEN '$.day: must be a valid date' END,
    CASE WHEN length(o_orderpriority) < 6 THEN '$.priority: must have at least 6 characters' END,
    CASE WHEN length(o_orderpriority) > 10 THEN '$.priority: must have at most 10 characters' END,
    CASE WHEN o_orderpriority LIKE '5%' THEN '$.priority: must match ^[1-4]-' END
  ], lambda x: x IS NOT NULL) AS faults
FROM orders
"""


@query(f"""
SELECT id, len(faults)::INTEGER AS error_count, len(faults) = 0 AS is_valid,
       greatest(len(faults) - 2, 0)::INTEGER AS more_errors,
       concat_ws(chr(10), array_to_string(list_transform(faults[1:2], lambda x: '• ' || x), chr(10)),
         CASE WHEN len(faults) > 2 THEN '... and ' || (len(faults) - 2) || ' more errors' END)
         AS report
FROM ({ORDER_FAULTS})
""")
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value lists, ranges, lengths and dates, with the first two faults shown."""
    docs = documents(spark, sf_dir, "orders", "o_orderkey", ORDERS_RAW)
    report = with_report(validate(docs, ORDER_SHAPE), shown=2)
    return report.select("id", "error_count", "is_valid", "more_errors", "report")


@query(
    union_sql(
        "SELECT c_custkey AS id, * FROM customer",
        ("'$.name'", "required", "c_custkey % 5 = 0"),
        ("'$.name'", "type", "c_custkey % 5 = 1"),
        ("'$.name'", "pattern", "c_custkey % 5 > 1 AND NOT contains(c_name, '7')"),
        ("'$.segment'", "maxLength", "length(c_mktsegment) > 8"),
        ("'$.nation'", "type", "c_custkey % 3 = 0"),
        ("'$.balance'", "type", "c_custkey % 7 = 0"),
    )
)
def validate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = record(
        {
            "name": text(pattern="7"),
            "segment": text(max_length=8),
            "nation": integer(),
            "balance": number(),
        },
        required=("name",),
    )
    raw = """to_json(struct(
        CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN parse_json('null')
             ELSE cast(c_name AS variant) END AS name,
        c_mktsegment AS segment,
        CASE c_custkey % 3 WHEN 0 THEN cast(c_nationkey + 0.5 AS variant)
             WHEN 1 THEN cast(cast(c_nationkey AS double) AS variant)
             ELSE cast(c_nationkey AS variant) END AS nation,
        if(c_custkey % 7 = 0, cast(c_name AS variant), cast(c_acctbal AS variant)) AS balance))"""
    return listed(validate(documents(spark, sf_dir, "customer", "c_custkey", raw), shape))


@query("""
SELECT path, keyword, count(*) AS lines FROM (
  SELECT unnest(list_filter([
    CASE WHEN l_linenumber < 2 THEN '$.tags|minItems' END,
    CASE WHEN l_linenumber > 6 THEN '$.tags|maxItems' END,
    CASE WHEN l_linenumber > 2 OR (l_linenumber = 2 AND l_returnflag = l_linestatus)
         THEN '$.tags|uniqueItems' END,
    CASE WHEN l_returnflag = 'N' THEN '$.tags[0]|enum' END,
    CASE WHEN l_linestatus = 'N' AND l_linenumber > 1 THEN '$.tags[1]|enum' END,
    CASE WHEN l_returnflag = 'N' AND l_linenumber > 2 THEN '$.tags[2]|enum' END,
    CASE WHEN l_quantity > 40 THEN '$.range[0]|maximum' END,
    CASE WHEN l_returnflag = 'R' THEN '$.range[1]|enum' END,
    CASE WHEN l_linenumber = 3 THEN '$.range[2]|type' END,
    CASE WHEN l_linenumber = 3 THEN '$.range[2]|enum' END
  ], lambda x: x IS NOT NULL)) AS fault,
  split_part(fault, '|', 1) AS path, split_part(fault, '|', 2) AS keyword
  FROM lineitem) GROUP BY ALL
""")
def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List rules: sizes, repeats, items, and a tuple with a first item of its own."""
    shape = record(
        {
            "tags": listing(
                choice("A", "R", "F", "O"), min_items=2, max_items=6, unique=True
            ),
            "range": listing(choice("days", "years"), lead=(integer(minimum=0, maximum=40),)),
        }
    )
    tags = """transform(sequence(1, l_linenumber),
                        i -> if(i = 2, l_linestatus, if(i > 3, 'A', l_returnflag)))"""
    pair = """array(cast(cast(l_quantity AS int) AS variant),
                    cast(if(l_returnflag = 'R', 'weeks', 'days') AS variant))"""
    raw = f"""to_json(struct({tags} AS tags,
                 if(l_linenumber = 3, concat({pair}, array(cast(7 AS variant))), {pair}) AS range))"""
    checked = validate(documents(spark, sf_dir, "lineitem", "l_orderkey", raw), shape)
    return listed(checked).groupBy("path", "keyword").agg(F.count("*").alias("lines"))


@query("""
SELECT page_id AS id, NOT regexp_matches(address, '\\A[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+\\z') AS broken
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, ':', '')
                      WHEN 2 THEN url || ' ' ELSE substring(url, 6) END AS address FROM pages)
""")
def validate_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """to_json(struct(CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, ':', '')
                            WHEN 2 THEN url || ' ' ELSE substring(url, 6) END AS url))"""
    docs = documents(spark, sf_dir, "pages", "page_id", raw)
    checked = validate(docs, record({"url": text(format="uri")}))
    return checked.select("id", (F.col("error_count") == 1).alias("broken"))


@query("""
SELECT c_custkey AS id, c_custkey % 4 = 0 AS is_valid FROM customer
""")
def validate_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """to_json(struct(CASE c_custkey % 4
        WHEN 0 THEN replace(c_name, '#', '') || '@' || c_mktsegment || '.org'
        WHEN 1 THEN c_name || '@' || c_mktsegment
        WHEN 2 THEN c_name || ' x@' || c_mktsegment || '.org'
        ELSE c_name || '@@' || c_mktsegment || '.org' END AS mail))"""
    docs = documents(spark, sf_dir, "customer", "c_custkey", raw)
    return validate(docs, record({"mail": text(format="email")})).select("id", "is_valid")


@query(
    union_sql(
        "SELECT event_id AS id, * FROM events",
        ("'$.extra'", "additionalProperties", "event_id % 3 = 0"),
        ("'$.x' || user_id", "additionalProperties", "user_id % 2 = 0"),
        ("'$.n' || user_id", "type", "user_id % 2 = 1 AND event_id % 3 = 1"),
        ("'$'", "maxProperties", "event_id % 3 = 0"),
        ("'$'", "minProperties", "event_id % 3 = 2 AND event_type = 'view'"),
    )
)
def validate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed objects, key patterns, and how many keys an object may have."""
    shape = record(
        {"k": integer()}, keyed=((Keys("^n[0-9]+$"), text()),), min_keys=2, max_keys=2
    )
    key = "concat(if(user_id % 2 = 0, 'x', 'n'), user_id)"
    value = "if(event_id % 3 = 1, '1', '\"1\"')"
    extra = "if(event_id % 3 = 0, ', \"extra\": 1', '')"
    raw = f"""concat(
        if(event_id % 3 = 2 AND event_type = 'view', '{{', rtrim('}}', props) || ', '),
        '"', {key}, '": ', {value}, {extra}, '}}')"""
    return listed(validate(documents(spark, sf_dir, "events", "event_id", raw), shape))


@query(
    union_sql(
        "SELECT o_orderkey AS id, year(o_orderdate) AS y, * FROM orders",
        ("'$.made'", "format", "o_orderkey % 5 = 1"),
        ("'$.made'", "minimum", "o_orderkey % 5 = 2 AND y - 98 < 1900"),
        ("'$.made'", "maximum", "o_orderkey % 5 = 3 AND y + 104 > 2100"),
        ("'$.made'", "type", "o_orderkey % 5 = 4"),
    )
)
def validate_day_or_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text must be a day, a number a year: one rule set per JSON type."""
    raw = """to_json(struct(CASE o_orderkey % 5
        WHEN 0 THEN cast(date_format(o_orderdate, 'yyyy-MM-dd') AS variant)
        WHEN 1 THEN cast(date_format(o_orderdate, 'dd.MM.yyyy') AS variant)
        WHEN 2 THEN cast(year(o_orderdate) - 98 AS variant)
        WHEN 3 THEN cast(year(o_orderdate) + 104 AS variant)
        ELSE cast(array(o_orderstatus) AS variant) END AS made))"""
    docs = documents(spark, sf_dir, "orders", "o_orderkey", raw)
    return listed(validate(docs, record({"made": DAY_OR_YEAR})))


@query(
    union_sql(
        "SELECT s_suppkey AS id, * FROM supplier",
        ("'$.version'", "const", "s_nationkey % 3 <> 0"),
        ("'$.kinds'", "type", "s_nationkey % 4 = 1"),
        ("'$.kinds'", "enum", "s_nationkey % 4 IN (1, 2)"),
        ("'$.level'", "enum", "s_nationkey % 5 IN (2, 3, 4)"),
    )
)
def validate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant, a value list on a list (never met by a list), a list of numbers."""
    shape = record(
        {
            "version": Shape(constant="v0"),
            "kinds": listing(values=("A", "B")),
            "level": Shape(values=(0, 1)),
        }
    )
    raw = """to_json(struct(
        concat('v', s_nationkey % 3) AS version,
        CASE s_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN cast('C' AS variant)
             WHEN 2 THEN cast(array('A') AS variant) ELSE NULL END AS kinds,
        s_nationkey % 5 AS level))"""
    return listed(validate(documents(spark, sf_dir, "supplier", "s_suppkey", raw), shape))


@query(
    union_sql(
        "SELECT p_partkey AS id, * FROM part",
        ("'$.Content[0]'", "enum", "p_size % 2 = 1"),
        ("'$.RadLex[0]'", "oneOf", "p_size % 3 = 0"),
        ("'$.RadLex[1]'", "oneOf", "p_size % 5 = 0"),
        ("'$.RadLex[2]'", "oneOf", "p_size % 35 = 0"),
        ("'$.RadLex'", "uniqueItems", "p_size % 7 = 0"),
        ("'$.SNOMED[0]'", "type", "p_size % 4 = 0"),
    )
)
def validate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded terms: a value list, and items that are a text or a coded object."""
    raw = """to_json(struct(
        array(if(p_size % 2 = 1, p_type, 'CT')) AS Content,
        concat(array(if(p_size % 3 = 0, cast(p_name AS variant),
                        cast(concat('RID', p_size) AS variant)),
                     to_variant_object(map(if(p_size % 5 = 0, 'ID', 'RID7'), p_type))),
               if(p_size % 7 = 0, array(to_variant_object(map(
                  if(p_size % 5 = 0, 'ID', 'RID7'), p_type))), array())) AS RadLex,
        array(if(p_size % 4 = 0, cast(p_size AS variant), cast(p_type AS variant))) AS SNOMED))"""
    return listed(validate(documents(spark, sf_dir, "part", "p_partkey", raw), INDEXING))


DEPTH = 7


def nested_subsets(inner: str, level: int = 1) -> str:
    """JSON text of subsets within subsets, as deep as the line number says."""
    deeper = nested_subsets(inner, level + 1) if level < DEPTH else "''"
    return (
        f"concat('{{\"Patient count\": ', {inner}, if(l_linenumber > {level}, "
        f"concat(', \"Subset\": [', {deeper}, ']'), ''), '}}')"
    )


@query("""
SELECT path, keyword, count(*) AS lines FROM (
  SELECT unnest(range(1, l_linenumber + 1)) AS level, l_linenumber, l_returnflag
  FROM lineitem),
  LATERAL (SELECT '$' || repeat('.Subset[0]', (level - 1)::INTEGER) AS spot)
  , LATERAL (SELECT CASE WHEN l_returnflag = 'R' THEN spot || '.Patient count' END AS path,
                    'type' AS keyword)
WHERE path IS NOT NULL GROUP BY ALL
""")
def validate_nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets one to seven levels deep, each checked like the first."""
    count = "if(l_returnflag = 'R', '\"7\"', '7')"
    docs = documents(spark, sf_dir, "lineitem", "l_orderkey", nested_subsets(count))
    checked = validate(docs, subset())
    return listed(checked).groupBy("path", "keyword").agg(F.count("*").alias("lines"))


# ---- contracts -----------------------------------------------------------------

# The faults built into the nested dataset cards, in the order they are reported.
DATASET_FAULTS = f"""
SELECT o_orderkey AS id, list_filter([
    CASE WHEN o_orderkey % 2 = 1 THEN '$.$schema|const' END,
    CASE WHEN o_orderkey % 11 = 0 THEN '$.Dataset.Name|required' END,
    CASE WHEN o_orderkey % 13 = 0 THEN '$.Dataset.Motive|additionalProperties' END,
    CASE WHEN o_orderkey % 3 = 0 THEN '$.Dataset.Indexing code.Content|uniqueItems' END,
    CASE WHEN o_orderkey % 3 <> 0 THEN '$.Dataset.Indexing code.Content[1]|enum' END,
    CASE WHEN o_orderkey % 2 = 1 THEN '$.Dataset.Indexing code.RadLex[0]|oneOf' END,
    CASE WHEN o_orderkey % 2 = 1 THEN '$.Dataset.Indexing code.RadLex[1]|oneOf' END,
    CASE WHEN o_orderkey % 4 = 0 THEN '$.Dataset.Author[0].Email|format' END,
    CASE WHEN o_orderkey % 4 = 2 THEN '$.Dataset.Date.Created|format' END,
    CASE WHEN o_orderkey % 4 = 1 THEN '$.Dataset.Date.Created|minimum' END,
    CASE WHEN o_orderkey % 6 = 0 THEN '$.Dataset.Reference[0]|type' END,
    CASE WHEN o_orderkey % 10 = 0 THEN '$.Dataset.License.URL|format' END,
    '$.Dataset.Imaging.File format[1]|enum',
    CASE WHEN o_orderkey % 2 = 1 THEN '$.Dataset.Imaging.Burned-in PHI|enum' END,
    CASE WHEN o_orderkey % 9 = 0 THEN '$.Dataset.Composition.Data type|enum' END
  ], lambda x: x IS NOT NULL)
  || flatten(list_transform(range(1, o_orderkey % 4 + 1), lambda i: list_filter([
    CASE WHEN i = 2 THEN '.Patient count|type' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '.Age range[1][0]|maximum' END,
    CASE WHEN o_orderkey % 7 = 0 THEN '.Age range[1][1]|enum' END,
    CASE WHEN o_orderstatus = 'P' THEN '.Sex|enum' END
  ], lambda x: x IS NOT NULL).list_transform(
    lambda x: '$.Dataset.Partition[' || (i - 1) || '].Data' || x))) AS faults
FROM orders
"""


def checked_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_from_table(nested_dataset_cards(spark, sf_dir))
    return validate(cards, declared_dataset(FAMILY))


@query(f"""
SELECT id, len(faults)::INTEGER AS error_count, array_to_string(faults, ' ') AS faults
FROM ({DATASET_FAULTS})
""")
def declared_dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole declared contract, faults in reporting order."""
    faults = F.transform("violations", lambda v: F.concat(v["path"], F.lit("|"), v["keyword"]))
    return checked_datasets(spark, sf_dir).select(
        "id", "error_count", F.array_join(faults, " ").alias("faults")
    )


@query(f"""
SELECT regexp_replace(split_part(fault, '|', 1), '\\[[0-9]+\\]', '[*]', 'g') AS path,
       split_part(fault, '|', 2) AS keyword,
       count(DISTINCT id) AS cards, count(*) AS violations
FROM (SELECT id, unnest(faults) AS fault FROM ({DATASET_FAULTS})) GROUP BY 1, 2
""")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a corpus: cards affected per place and rule."""
    return summarise_violations(checked_datasets(spark, sf_dir))


@query(
    union_sql(
        "SELECT o_orderkey AS id, * FROM orders",
        ("'$.Name'", "required", "o_orderkey % 11 = 0"),
        ("'$.Indexing code.Content'", "uniqueItems", "o_orderkey % 3 = 0"),
        ("'$.Indexing code.Content[1]'", "enum", "o_orderkey % 3 <> 0"),
        ("'$.Indexing code.RadLex[1]'", "type", "TRUE"),
        ("'$.Author[0].Email'", "format", "o_orderkey % 4 = 0"),
        ("'$.Date.Created'", "type", "o_orderkey % 4 IN (0, 1)"),
        ("'$.Reference[0]'", "type", "o_orderkey % 6 = 0"),
        ("'$.License.URL'", "format", "o_orderkey % 10 = 0"),
        ("'$.Imaging.File format[1]'", "enum", "TRUE"),
        ("'$.Imaging.Burned-in PHI'", "enum", "o_orderkey % 2 = 1"),
        ("'$.Composition.Data type'", "enum", "o_orderkey % 9 = 0"),
        ("'$.Partition[1].Data.Patient count'", "type", "o_orderkey % 4 > 1"),
        *(
            (f"'$.Partition[{i}].Data.{path}'", rule, f"{fault} AND o_orderkey % 4 > {i}")
            for i in range(3)
            for path, rule, fault in (
                ("Age range[1][0]", "maximum", "o_orderkey % 5 = 0"),
                ("Age range[1][1]", "enum", "o_orderkey % 7 = 0"),
                ("Sex", "enum", "o_orderstatus = 'P'"),
            )
        ),
    )
)
def form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form contract: years and coded objects are faults, unknown fields are not."""
    cards = sections(nested_dataset_cards(spark, sf_dir), "Dataset")
    return listed(validate(cards, form_dataset(), doc="section"))


@query(
    union_sql(
        "SELECT p_partkey AS id, * FROM part",
        ("'$.Indexing code.Content'", "minItems", "p_size % 5 = 0"),
        ("'$.Indexing code.Content[0]'", "enum", "p_size % 5 <> 0"),
        ("'$.Indexing code.Content[1]'", "enum", "p_size % 5 <> 0"),
        ("'$.Date.Created'", "format", "TRUE"),
        ("'$.Results[0].Metric[0]'", "enum", "p_size % 4 > 0"),
        ("'$.Results[2].Metric[0]'", "enum", "p_size % 4 > 2"),
        ("'$.Results[0].Value'", "type", "p_size % 4 > 0"),
        ("'$.Results[1].Value'", "type", "p_size % 4 > 1"),
        ("'$.Results[2].Value'", "type", "p_size % 4 > 2"),
    )
)
def legacy_model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted model cards against the older model contract."""
    cards = cards_from_table(flat_model_cards(spark, sf_dir)).withColumn(
        "card_type", F.lit("model")
    )
    return listed(validate(flat_to_nested(cards), legacy_model(), doc="section"))


@query(
    union_sql(
        "SELECT o_orderkey AS id, * FROM orders",
        ("'$.Indexing code.Content[0]'", "enum", "o_orderstatus NOT IN ('O', 'F')"),
        ("'$.Composition.Number of instances'", "type", "o_orderkey % 5 = 2"),
    )
)
def legacy_dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted dataset cards against the older dataset contract."""
    cards = cards_from_table(flat_dataset_cards(spark, sf_dir)).withColumn(
        "card_type", F.lit("dataset")
    )
    return listed(validate(flat_to_nested(cards), legacy_dataset(), doc="section"))


# A schema as a user may supply it: one definition that lists itself, one reference.
NATION_SCHEMA = {
    "$id": "nations.json",
    "type": "object",
    "properties": {
        "Dataset": {"$ref": "#/$defs/dataset"},
        "Code": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 10}]},
    },
    "required": ["Dataset"],
    "additionalProperties": False,
    "$defs": {
        "dataset": {
            "type": "object",
            "properties": {
                "Name": {"type": "string", "minLength": 10},
                "Parts": {"type": "array", "items": {"$ref": "#/$defs/dataset"}},
            },
            "required": ["Name"],
        }
    },
}
SUPPLIER_RAW = """to_json(struct(
    struct(if(s_suppkey % 4 = 0, NULL, substring(s_name, 1, 5 + s_nationkey)) AS Name,
           array(struct(s_suppkey AS Name)) AS Parts) AS Dataset,
    s_nationkey AS Code))"""


@query(
    union_sql(
        "SELECT s_suppkey AS id, * FROM supplier",
        ("'$.Dataset.Name'", "required", "s_suppkey % 4 = 0"),
        (
            "'$.Dataset.Name'",
            "minLength",
            "s_suppkey % 4 <> 0 AND length(substring(s_name, 1, 5 + s_nationkey)) < 10",
        ),
        ("'$.Dataset.Parts[0].Name'", "type", "TRUE"),
        ("'$.Code'", "oneOf", "s_nationkey < 10"),
    )
)
def schema_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a schema document."""
    docs = documents(spark, sf_dir, "supplier", "s_suppkey", SUPPLIER_RAW)
    return listed(validate(docs, shape_from_document(NATION_SCHEMA)))


@query("""
SELECT s_suppkey AS id,
       CASE s_nationkey % 3
         WHEN 0 THEN (s_suppkey % 4 = 0)::INTEGER
           + (s_suppkey % 4 <> 0 AND length(substring(s_name, 1, 5 + s_nationkey)) < 10)::INTEGER
           + 1 + (s_nationkey < 10)::INTEGER
         WHEN 1 THEN (s_suppkey % 4 = 0)::INTEGER
           + (s_suppkey % 4 <> 0 AND length(substring(s_name, 1, 5 + s_nationkey)) < 10)::INTEGER
           + 1
       END AS error_count
FROM supplier
""")
def rules_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card by the schema version it names; an unknown version is not checked."""
    docs = documents(
        spark,
        sf_dir,
        "supplier",
        "struct(s_suppkey AS s, concat('v', s_nationkey % 3) AS version)",
        SUPPLIER_RAW,
    ).select("id.*", "doc")
    form = record({"Dataset": form_from_document(NATION_SCHEMA, "dataset")}, closed=False)
    shapes = {"v0": shape_from_document(NATION_SCHEMA), "v1": form}
    return validate(docs, shapes, key="version").select(F.col("s").alias("id"), "error_count")


STRICT_SCHEMA = {
    "properties": {
        "list": {"$ref": "#/$defs/list", "minItems": 1},
        "none": {"const": None},
        "pair": {"prefixItems": [{"type": "string"}], "items": False},
        "when": {"type": "string", "format": "date-time"},
    },
    "$defs": {"list": {"type": "array", "uniqueItems": True}},
}


@query(
    union_sql(
        "SELECT o_orderkey AS id, * FROM orders",
        ("'$.list'", "minItems", "o_orderkey % 2 = 0"),
        ("'$.none'", "const", "o_orderkey % 3 = 0"),
        ("'$.pair[1]'", "false", "o_orderkey % 5 = 0"),
        ("'$.when'", "format", "o_orderkey % 7 = 0"),
    )
)
def strict_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules beside a reference, a constant null, forbidden items and a moment: none is passed over."""
    raw = """concat('{"list":[', if(o_orderkey % 2 = 0, '', cast(o_orderkey AS string)), '],"none":', if(o_orderkey % 3 = 0, '0', 'null'),
        ',"pair":["a"', if(o_orderkey % 5 = 0, ',1', ''), '],"when":"', date_format(o_orderdate, 'yyyy-MM-dd'),
        if(o_orderkey % 7 = 0, '', 'T10:00:00Z'), '"}')"""
    docs = documents(spark, sf_dir, "orders", "o_orderkey", raw)
    return listed(validate(docs, shape_from_document(STRICT_SCHEMA)))


KEYED_SCHEMA = {
    "$ref": "#/$defs/node",
    "$defs": {
        "node": {
            "type": "object",
            "properties": {"n": {"type": "integer", "maximum": 9}},
            "patternProperties": {"^a": {"$ref": "#/$defs/node"}, "^t": {"type": "string"}},
            "additionalProperties": {"type": "array", "prefixItems": [{"$ref": "#/$defs/node"}]},
        }
    },
}


@query(
    union_sql(
        "SELECT s_suppkey AS id, * FROM supplier",
        ("'$.n'", "maximum", "s_nationkey > 9"),
        ("'$.bad'", "type", "s_suppkey % 3 = 0"),
        ("'$.a' || s_nationkey || '.n'", "maximum", "s_nationkey > 4"),
        ("'$.a' || s_nationkey || '.tx'", "type", "s_suppkey % 2 = 0"),
        ("'$.other[0].n'", "maximum", "s_suppkey % 20 > 9"),
        ("'$.other[0].a2.n'", "type", "TRUE"),
        ("'$.other[0].a2.more[0].t'", "type", "s_suppkey % 5 = 0"),
    )
)
def keyed_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several key patterns and a schema for all other keys, by which a definition comes back inside itself."""
    raw = """concat('{"n":', s_nationkey, ',"a', s_nationkey, '":{"n":', s_nationkey + 5, ',"tx":', if(s_suppkey % 2 = 0, '5', '"x"'),
        '},"other":[{"n":', s_suppkey % 20, ',"a2":{"n":"x","more":[{"t":', if(s_suppkey % 5 = 0, '1', '"t"'), '}, 1]}}],"bad":',
        if(s_suppkey % 3 = 0, '1', '[]'), '}')"""
    docs = documents(spark, sf_dir, "supplier", "s_suppkey", raw)
    return listed(validate(docs, shape_from_document(KEYED_SCHEMA)))


FORM_SCHEMA = {
    "$defs": {
        "model": {
            "properties": {
                "any": {"anyOf": [{"type": "integer"}]},
                "map": {"additionalProperties": {"type": "integer"}},
                "keys": {"patternProperties": {"^a": {}, "^b": {}}},
                "own": {"$ref": "#/$defs/part"},
            },
            "required": ["any"],
        },
        "part": {"type": "object", "properties": {"inner": {"$ref": "#/$defs/part"}, "n": {"type": "integer"}}},
    }
}


@query(
    union_sql(
        "SELECT s_suppkey AS id, * FROM supplier",
        ("'$.any'", "type", "s_suppkey % 2 = 0"),
        ("'$.any'", "required", "s_suppkey % 2 = 1"),
        ("'$.map'", "type", "s_suppkey % 3 = 0"),
        ("'$.keys'", "type", "s_suppkey % 5 = 0"),
        ("'$.own.inner'", "type", "TRUE"),
        ("'$.own.n'", "type", "s_nationkey < 10"),
    )
)
def form_of_combined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined rules, and a definition within itself, are plain texts in a form."""
    raw = """concat('{', if(s_suppkey % 2 = 0, '"any":1,', ''), '"map":', if(s_suppkey % 3 = 0, '{}', '"t"'),
        ',"keys":', if(s_suppkey % 5 = 0, '[]', '"t"'), ',"own":{"inner":{},"n":', if(s_nationkey < 10, '"1"', '1'), '}}')"""
    docs = documents(spark, sf_dir, "supplier", "s_suppkey", raw)
    return listed(validate(docs, form_from_document(FORM_SCHEMA, "model")))


@query("""
SELECT '$.' || CASE c_custkey % 4 WHEN 0 THEN 'x' || chr(1) || 'y' WHEN 1 THEN 'k[1]' WHEN 2 THEN 'k[2]'
            ELSE 'list[*]' END AS path,
       CASE c_custkey % 4 WHEN 3 THEN 'type' ELSE 'additionalProperties' END AS keyword,
       count(*)::BIGINT AS cards, sum(CASE c_custkey % 4 WHEN 3 THEN 2 ELSE 1 END)::BIGINT AS violations
FROM customer GROUP BY ALL
""")
def summary_of_odd_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold brackets or control characters are not mixed up with positions or each other."""
    raw = """to_json(CASE c_custkey % 4 WHEN 0 THEN map('x\\u0001y', cast(1 AS variant))
        WHEN 1 THEN map('k[1]', cast(1 AS variant)) WHEN 2 THEN map('k[2]', cast(1 AS variant))
        ELSE map('list', cast(array(1, 2) AS variant)) END)"""
    docs = documents(spark, sf_dir, "customer", "c_custkey", raw)
    return summarise_violations(validate(docs, record({"list": listing(text())})))
