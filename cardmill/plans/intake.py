"""Queries for sources, classification and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.session import scratch_path
from cardmill.operators.classify import card_preview, classify, split_rejects
from cardmill.operators.convert import load_section
from cardmill.operators.reports import intake_summary as summarise_intake
from cardmill.plans.catalog import query
from cardmill.plans.corpus import (
    flat_dataset_cards,
    flat_model_cards,
    nation_card_files,
    nested_dataset_cards,
    nested_model_cards,
    table,
)
from cardmill.sources.cards import cards_from_table, read_cards


@query("""
SELECT event_id, json_valid(props) AS parse_ok,
       try_cast(json_extract(props, '$.k') AS BIGINT) AS k
FROM events
""")
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_from_table(table(spark, sf_dir, "events"), "props")
    k = F.try_variant_get("doc", "$.k", "bigint")
    return cards.select("event_id", "parse_ok", k.alias("k"))


# Whole, damaged and padded JSON texts made from one column.
DAMAGED = """
CASE event_id % 8
  WHEN 0 THEN props
  WHEN 1 THEN concat(props, ' x')
  WHEN 2 THEN substring(props, 1, length(props) - 1)
  WHEN 3 THEN concat(props, props)
  WHEN 4 THEN ''
  WHEN 5 THEN concat(' ', props, ' ')
  WHEN 6 THEN concat('[', props, '] ]')
  ELSE 'null' END
"""


@query(f"""
SELECT event_id,
       json_valid(raw) AS parse_ok,
       CASE WHEN NOT json_valid(raw) OR raw = 'null' THEN 'invalid_file'
            ELSE 'unknown_type' END AS reject_reason
FROM (SELECT event_id, {DAMAGED} AS raw FROM events)
""")
def source_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = table(spark, sf_dir, "events").selectExpr("event_id", f"{DAMAGED} AS raw")
    return classify(cards_from_table(damaged)).select("event_id", "parse_ok", "reject_reason")


@query("""
SELECT 'document' AS kind, doc_id AS id,
       CASE WHEN NOT json_valid(text) THEN 'invalid_file' ELSE 'unknown_type' END AS reject_reason
FROM documents
UNION ALL
SELECT 'event', event_id,
       CASE WHEN NOT json_valid(props) THEN 'invalid_file' ELSE 'unknown_type' END
FROM events
""")
def source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").selectExpr(
        "'document' AS kind", "doc_id AS id", "text AS raw"
    )
    events = table(spark, sf_dir, "events").selectExpr(
        "'event' AS kind", "event_id AS id", "props AS raw"
    )
    models = flat_model_cards(spark, sf_dir).selectExpr("'model' AS kind", "id", "raw")
    cards = classify(cards_from_table(documents.unionByName(events).unionByName(models)))
    _, refused = split_rejects(cards)
    return refused.select("kind", "id", "reject_reason")


@query("""
SELECT s_nationkey::BIGINT AS nation, count(*)::BIGINT AS suppliers, 'dataset' AS card_type,
       'txt' AS format, TRUE AS ends_in_txt
FROM supplier GROUP BY s_nationkey
""")
def source_card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a card file for each nation that sums up its suppliers, then read the files whole."""
    path = scratch_path(spark, "card-files")
    nation_card_files(spark, sf_dir, path)
    return classify(read_cards(spark, path, recursive=True)).select(
        F.variant_get("doc", "$.dataset_name", "string").cast("bigint").alias("nation"),
        F.variant_get("doc", "$.number_of_instances", "bigint").alias("suppliers"),
        "card_type",
        "format",
        F.col("file_name").endswith(".txt").alias("ends_in_txt"),
    )


@query("""
SELECT page_id,
       CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'json'
            ELSE CASE page_id % 3 WHEN 0 THEN 'txt' ELSE 'json' END END AS format
FROM pages
""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names end as a page address does, with four endings put behind it."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """concat(url, CASE page_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.json'
                                       WHEN 2 THEN '.txt.bak' ELSE '' END) AS name""",
        """CASE page_id % 3
             WHEN 0 THEN to_json(struct(url AS model_name, html AS caveats))
             WHEN 1 THEN to_json(struct(struct(url AS Name, html AS Comments) AS Dataset))
             ELSE to_json(struct('' AS model_name, html AS other)) END AS raw""",
    )
    return classify(cards_from_table(pages, "raw", "name")).select("page_id", "format")


@query("""
SELECT c_custkey,
       CASE c_custkey % 8
         WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' WHEN 2 THEN 'dataset' WHEN 3 THEN 'model'
         WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' WHEN 6 THEN 'dataset' ELSE 'model'
       END AS card_type
FROM customer
""")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys count as given: empty objects do, empty texts, null, 0 and false do not."""
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 8
             WHEN 0 THEN to_json(struct(c_name AS model_name, c_name AS dataset_name))
             WHEN 1 THEN '{"Model": "", "Dataset": {}}'
             WHEN 2 THEN '{"Model": 0, "dataset_name": "0"}'
             WHEN 3 THEN '{"Model": [], "Dataset": {"Name": 1}}'
             WHEN 4 THEN concat('[', to_json(struct(c_name AS model_name)), ']')
             WHEN 5 THEN '{"Model": null, "Dataset": false, "model_name": ""}'
             WHEN 6 THEN to_json(struct(c_name AS dataset_name))
             ELSE to_json(struct(struct(c_name AS Name) AS Model)) END AS raw""",
    )
    return classify(cards_from_table(cards)).select("c_custkey", "card_type")


@query("""
SELECT doc_id, 'TXT' AS format_text, 'Dataset Card' AS type_text,
       CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Detected from content' END AS schema_text,
       CASE WHEN doc_id % 2 = 0 THEN 13 + length(source) ELSE 0 END
         + 31 + length(CAST(to_json(source) AS VARCHAR))
         + length(CAST(to_json(text) AS VARCHAR)) AS size_chars
FROM documents
""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """to_json(struct(if(doc_id % 2 = 0, source, NULL) AS `$schema`,
                          source AS dataset_name, text AS labeling_x)) AS raw""",
        "concat(source, '.txt') AS name",
    )
    shown = card_preview(classify(cards_from_table(cards, "raw", "name")))
    return shown.select("doc_id", "format_text", "type_text", "schema_text", "size_chars")


@query("""
SELECT p_partkey AS id,
       CASE p_size % 3 WHEN 0 THEN 'json' ELSE 'txt' END AS format,
       p_size % 3 = 0 AS format_mismatch,
       TRUE AS convert_ok,
       CASE p_size % 3 WHEN 0 THEN NULL ELSE p_name END AS name
FROM part
UNION ALL
SELECT -1 - p_partkey, 'txt', TRUE, TRUE, ''
FROM part
""")
def section_and_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat cards under a .json name load as {}, nested ones under .txt as empty fields."""
    flat = flat_model_cards(spark, sf_dir, "p_size").selectExpr(
        "id", "if(p_size % 3 = 0, 'a.json', 'a.txt') AS name", "raw"
    )
    nested = nested_model_cards(spark, sf_dir).selectExpr(
        "-1 - id AS id", "'a.txt' AS name", "raw"
    )
    cards = classify(cards_from_table(flat.unionByName(nested), "raw", "name"))
    name = F.try_variant_get("section", "$.Name", "string")
    return load_section(cards).select(
        "id", "format", "format_mismatch", "convert_ok", name.alias("name")
    )


@query("""
SELECT format, card_type, parse_ok, sum(n)::BIGINT AS cards FROM (
  SELECT 'txt' AS format, 'model' AS card_type, TRUE AS parse_ok, count(*) AS n FROM part
  UNION ALL SELECT 'json', 'model', TRUE, count(*) FROM part
  UNION ALL SELECT 'txt', 'dataset', TRUE, count(*) FROM orders
  UNION ALL SELECT 'json', 'dataset', TRUE, count(*) FROM orders
  UNION ALL SELECT 'json', 'unknown', json_valid(text), count(*) FROM documents GROUP BY ALL
) GROUP BY ALL
""")
def intake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("file_name", "raw")
    cards = flat_model_cards(spark, sf_dir).select(*columns)
    for more in (nested_model_cards, flat_dataset_cards, nested_dataset_cards):
        cards = cards.unionByName(more(spark, sf_dir).select(*columns))
    documents = table(spark, sf_dir, "documents").selectExpr("'' AS file_name", "text AS raw")
    cards = cards.unionByName(documents)
    return summarise_intake(classify(cards_from_table(cards, "raw", "file_name")))
