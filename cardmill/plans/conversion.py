"""Queries for the mappings between the layouts and the expressions they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.contracts.profiles import legacy_dataset
from cardmill.contracts.shapes import integer, listing, record, text
from cardmill.functions.text import (
    first_paragraph,
    join_present,
    labelled,
    labelled_text,
    leading_integer,
    utf16_length,
)
from cardmill.functions.values import Field, first_truthy, literal
from cardmill.operators.classify import classify
from cardmill.operators.convert import (
    flat_to_nested,
    infer_codes,
    load_section,
    nested_to_flat,
    wrap_envelope,
)
from cardmill.operators.defaults import apply_defaults, defaults_of, fill_defaults
from cardmill.plans.catalog import query
from cardmill.plans.corpus import (
    FAMILY,
    flat_dataset_cards,
    flat_model_cards,
    nested_dataset_cards,
    nested_model_cards,
    table,
)
from cardmill.sources.cards import cards_from_table


def text_of(doc: str, path: str) -> str:
    return f"variant_get({doc}, '{path}', 'string')"


def sections(cards: DataFrame, key: str) -> DataFrame:
    """Nested cards of one type with their section taken out."""
    parsed = cards_from_table(cards)
    return parsed.withColumn("card_type", F.lit(key.lower())).withColumn(
        "section", F.variant_get("doc", f"$.{key}", "variant")
    )


# ---- text expressions ----------------------------------------------------------

# DuckDB's regular expressions know white space as the expressions here spell it out.
SQL_SPACE = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def sql_labelled(text: str, label: str) -> str:
    found = f"regexp_extract({text}, '(?i){label}:{SQL_SPACE}*([^\\n]+)', 1)"
    return rf"regexp_replace({found}, '\A{SQL_SPACE}+|{SQL_SPACE}+\z', '', 'g')"


PACKED_SQL = r"""
SELECT doc_id, text, source, lang,
       concat_ws(chr(10) || chr(10), text,
                 CASE WHEN doc_id % 3 <> 0 THEN 'Noise Issues: ' || source END,
                 'Missing Information: ' || lang) AS packed
FROM documents
"""


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts with two labelled paragraphs behind them."""
    noise = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        join_present(
            "\n\n",
            F.col("text"),
            labelled("Noise Issues", noise),
            labelled("Missing Information", F.col("lang")),
        ).alias("packed"),
    )


@query(f"SELECT doc_id, packed FROM ({PACKED_SQL})")
def join_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir).select("doc_id", "packed")


@query(f"""
SELECT doc_id, {sql_labelled('packed', 'Noise Issues')} AS noise,
       {sql_labelled('packed', 'missing information')} AS missing,
       {sql_labelled("packed || chr(10) || 'PURPOSE:  ' || chr(10) || ' ' || text", 'Purpose')}
         AS next_line,
       {sql_labelled('packed', 'Availability')} AS absent
FROM ({PACKED_SQL})
""")
def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.col("packed")
    with_label = F.concat(packed, F.lit("\nPURPOSE:  \n "), F.col("text"))
    return packed_documents(spark, sf_dir).select(
        "doc_id",
        labelled_text(packed, "Noise Issues").alias("noise"),
        labelled_text(packed, "missing information").alias("missing"),
        labelled_text(with_label, "Purpose").alias("next_line"),
        labelled_text(packed, "Availability").alias("absent"),
    )


@query(f"""
SELECT doc_id, split_part(packed, chr(10) || chr(10), 1) AS paragraph
FROM ({PACKED_SQL})
""")
def first_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir).select(
        "doc_id", first_paragraph(F.col("packed")).alias("paragraph")
    )


@query(r"""
SELECT doc_id,
       (length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::BIGINT
         AS units
FROM documents
""")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", utf16_length(F.col("text")).alias("units")
    )


@query("""
SELECT doc_id,
       CASE WHEN contains(text, 'the') OR contains(text, 'sch') THEN 'A,' ELSE '' END
       || CASE WHEN contains(text, 'que') THEN 'B,' ELSE '' END
       || CASE WHEN NOT contains(text, 'the') AND NOT contains(text, 'sch')
                AND NOT contains(text, 'que') THEN 'none,' ELSE '' END AS codes
FROM documents
""")
def inferred_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ((("the", "sch"), "A"), (("que",), "B"))
    codes = infer_codes(F.col("text"), words, "none")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.array_join(codes, ","), F.lit(",")).alias("codes")
    )


INTEGER_TEXTS = """
CASE p_size % 7
  WHEN 0 THEN concat(p_size, ',250')
  WHEN 1 THEN concat('  ', p_size, '.7 mm')
  WHEN 2 THEN p_brand
  WHEN 3 THEN concat('-', p_size)
  WHEN 4 THEN ''
  WHEN 5 THEN concat('+', p_partkey, 'x')
  ELSE concat(p_type, p_size) END
"""


@query(rf"""
SELECT p_partkey, try_cast(regexp_extract(t, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS n
FROM (SELECT p_partkey, {INTEGER_TEXTS} AS t FROM part)
""")
def leading_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{INTEGER_TEXTS} AS t")
    return texts.select(
        "p_partkey", F.try_variant_get(leading_integer(F.col("t")), "$", "bigint").alias("n")
    )


@query("""
SELECT c_custkey,
       CASE c_custkey % 4
         WHEN 0 THEN power(16::DOUBLE, 14 + c_custkey % 9) WHEN 1 THEN power(10::DOUBLE, 38 + c_custkey % 3)
         WHEN 2 THEN -255 END AS n
FROM customer
""")
def long_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits that no decimal holds become doubles; one that no double holds becomes null."""
    texts = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 4
             WHEN 0 THEN concat('0x0001', repeat('0', cast(14 + c_custkey % 9 AS int)), ' bytes')
             WHEN 1 THEN concat('1', repeat('0', cast(38 + c_custkey % 3 AS int)))
             WHEN 2 THEN '-0x000000000000000000000000fF'
             ELSE repeat('9', 400) END AS t""",
    )
    return texts.select(
        "c_custkey", F.try_variant_get(leading_integer(F.col("t")), "$", "double").alias("n")
    )


# ---- defaults and truthiness ---------------------------------------------------


@query("""
SELECT doc_id,
       CASE WHEN quality <> 0 THEN quality::VARCHAR WHEN toxic <> 0 THEN concat('t', toxic)
            ELSE '[]' END AS chosen
FROM labels
""")
def first_truthy_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 and '' are passed over, the default [] is not."""
    labels = table(spark, sf_dir, "labels")
    quality = Field(F.col("quality").cast("variant"))
    toxic = Field(
        F.when(F.col("toxic") != 0, F.concat(F.lit("t"), "toxic")).otherwise("").cast("variant")
    )
    chosen = first_truthy(quality, Field(literal("")), toxic, default=[])
    return labels.select("doc_id", chosen.cast("string").alias("chosen"))


@query("""
SELECT documents.doc_id,
       16::BIGINT AS n_fields,
       CASE WHEN quality IS NULL THEN '' ELSE quality::VARCHAR END AS version,
       CASE WHEN toxic = 1 THEN NULL ELSE '' END AS funding,
       '[{"Email":"","Name":""}]' AS author
FROM documents LEFT JOIN labels USING (doc_id)
""")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields of a section are filled; fields that are null stay null."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels")
    section = F.expr(
        """parse_json(concat('{', concat_ws(',',
             '"Name":' || to_json(cast(source AS variant)),
             '"Labeling":' || to_json(cast(text AS variant)),
             if(toxic = 1, '"Funding":null', NULL),
             '"Version":"' || quality || '"'), '}'))"""
    )
    filled = apply_defaults(F.col("section"), defaults_of(legacy_dataset()))
    return (
        documents.join(labels, "doc_id", "left")
        .withColumn("section", section)
        .withColumn("section", filled)
        .select(
            "doc_id",
            F.expr("cast(size(variant_get(section, '$', 'map<string,variant>')) AS bigint)").alias(
                "n_fields"
            ),
            F.variant_get("section", "$.Version", "string").alias("version"),
            F.variant_get("section", "$.Funding", "string").alias("funding"),
            F.to_json(F.variant_get("section", "$.Author", "variant")).alias("author"),
        )
    )


@query("""
SELECT c_custkey,
       CASE c_custkey % 3 WHEN 0 THEN '{"Name":"","Org":{},"Parts":[]}'
            WHEN 1 THEN '{"Name":"n","Org":{"City":"' || c_mktsegment || '","Name":""},"Parts":[{"Label":"","Size":1},7]}'
            ELSE '{"Name":null,"Org":null,"Parts":"none"}' END AS filled
FROM customer
""")
def nested_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields are filled in objects and in objects of lists; null and other types stay."""
    shape = record(
        {
            "Name": text(),
            "Org": record({"Name": text(), "City": text()}),
            "Parts": listing(record({"Label": text(), "Size": integer()})),
        }
    )
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """parse_json(CASE c_custkey % 3 WHEN 0 THEN '{}'
             WHEN 1 THEN concat('{"Name":"n","Org":{"City":"', c_mktsegment, '"},"Parts":[{"Size":1},7]}')
             ELSE '{"Name":null,"Org":null,"Parts":"none"}' END) AS section""",
    )
    return cards.select("c_custkey", F.to_json(fill_defaults(F.col("section"), shape)).alias("filled"))


# ---- mappings ------------------------------------------------------------------


@query("""
SELECT c_custkey,
       'Sustainability: ' || chr(10) || chr(10) || 'Training Time: '
         || CASE c_custkey % 5 WHEN 0 THEN c_custkey + 1 || '000' WHEN 1 THEN c_custkey + 1 || '.5'
                 WHEN 2 THEN (c_custkey + 1)::VARCHAR WHEN 3 THEN '1.5e-7' ELSE '1e+21' END AS comments
FROM customer
""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside a text, and a label with nothing behind it for an empty list."""
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """concat('{"model_name":"m","sustainability":[],"time_to_train":', CASE c_custkey % 5
             WHEN 0 THEN concat(c_custkey + 1, 'e3') WHEN 1 THEN concat(c_custkey + 1, '.50')
             WHEN 2 THEN concat(c_custkey + 1, '.0') WHEN 3 THEN '15e-8' ELSE '1e21' END, '}') AS raw""",
        "'m.txt' AS name",
    )
    loaded = load_section(classify(cards_from_table(cards, "raw", "name")))
    return loaded.select("c_custkey", F.try_variant_get("section", "$.Comments", "string").alias("comments"))


@query("""
SELECT s_suppkey,
       CASE s_suppkey % 4 WHEN 2 THEN '' ELSE s_nationkey + 1 || '' END AS patient_count,
       CASE s_suppkey % 4 WHEN 2 THEN '' WHEN 3 THEN s_nationkey + 2 || ''
            ELSE s_nationkey + 1 || '' END AS number_instances,
       CASE WHEN s_nationkey % 2 = 0 THEN '5' ELSE '1' END AS site_count,
       'Not specified' AS age, s_name AS subset_name
FROM supplier
""")
def subsets_to_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a subset stand in for each other; what is missing gets its default."""
    cards = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "'dataset' AS card_type",
        """parse_json(concat('{"Name":"d","Subsets":[{"Subset name":"', s_name, '"',
             CASE s_suppkey % 4 WHEN 0 THEN concat(',"Patient count":', s_nationkey + 1)
                  WHEN 1 THEN concat(',"Number of instances":', s_nationkey + 1) WHEN 2 THEN ''
                  ELSE concat(',"Patient count":', s_nationkey + 1, ',"Number of instances":', s_nationkey + 2) END,
             if(s_nationkey % 2 = 0, ',"Site count":5', ''), '}]}')) AS section""",
    )
    names = ("patient_count", "number_instances", "site_count", "age", "subset_name")
    fields = [f"variant_get(flat, '$.partitions[0].{n}', 'string') AS {n}" for n in names]
    return nested_to_flat(cards).selectExpr("s_suppkey", *fields)


@query("""
SELECT p_partkey AS id, p_name AS name,
       CASE WHEN p_size % 5 = 0 THEN '[]' ELSE '["' || p_brand || '","' || p_type || '"]' END
         AS content,
       concat_ws(chr(10) || chr(10),
                 CASE WHEN p_size % 4 <> 0 THEN 'Rate ' || p_type END,
                 CASE WHEN p_size % 3 <> 0 THEN 'Net of ' || p_name END,
                 'Code Availability: ' || CASE WHEN p_size % 6 = 0 THEN p_brand ELSE 'NA' END,
                 'Training Time: ' || CASE WHEN p_size % 2 = 0 THEN p_size || ' h' ELSE 'NA' END
       ) AS comments,
       CASE WHEN p_size % 3 <> 0 THEN 'Net of ' || p_name ELSE '' END AS input,
       (p_size % 4)::BIGINT AS n_results,
       CASE WHEN p_size % 4 > 0 THEN '{"Decision Threshold":"","Metric":["AUC"],"Result Information":"run 1","Subset":"","Value":'
            || (p_size + 1) || '}' END AS result_1,
       CASE WHEN p_size % 4 > 2 THEN '{"Decision Threshold":"","Metric":["AUC"],"Result Information":"'
            || p_type || ' 3","Subset":"' || p_brand || '","Value":' || (p_size + 3) || '}' END
         AS result_3,
       CASE WHEN p_size % 4 > 1 THEN '["Accuracy","Recall"]' END AS metric_2,
       CASE WHEN p_size % 2 = 0 THEN
         '{"Code Availability":"' || CASE WHEN p_size % 6 = 0 THEN p_brand ELSE 'NA' END
         || '","Hardware Requirements":"NA","Inference Time":"NA","Sustainability":"NA","Training Time":"'
         || p_size || ' h"}' END AS technical
FROM part
""")
def flat_to_nested_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_from_table(flat_model_cards(spark, sf_dir)).withColumn(
        "card_type", F.lit("model")
    )
    return flat_to_nested(cards).selectExpr(
        "id",
        f"{text_of('section', '$.Name')} AS name",
        "to_json(variant_get(section, '$[\"Indexing code\"].Content')) AS content",
        f"{text_of('section', '$.Comments')} AS comments",
        f"{text_of('section', '$.Input')} AS input",
        "cast(size(variant_get(section, '$.Results', 'array<variant>')) AS bigint) AS n_results",
        "to_json(variant_get(section, '$.Results[0]')) AS result_1",
        "to_json(variant_get(section, '$.Results[2]')) AS result_3",
        "to_json(variant_get(section, '$.Results[1].Metric')) AS metric_2",
        "to_json(variant_get(section, '$[\"Technical Details\"]')) AS technical",
    )


@query(rf"""
SELECT p_partkey AS id, p_name AS model_name, 'Rate ' || p_type AS medical_task,
       CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS model_architecture,
       CASE WHEN p_size % 20 <> 0 AND p_size % 4 = 0 AND p_size % 5 <> 0 THEN '3 days'
            WHEN p_size % 2 = 0 THEN '5 h' ELSE 'Hardware: CPU' END AS time_to_train,
       CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE 'CPU' END AS hardware,
       p_brand AS sustainability, 'NA' AS inference,
       CASE WHEN p_size % 4 > 0 THEN p_type || ' 1' END AS name_1,
       CASE WHEN p_size % 4 > 0 THEN p_brand END AS metric_1,
       CASE WHEN p_size % 4 > 1 THEN FALSE END AS has_metric_2,
       CASE WHEN p_size % 4 > 2 THEN p_brand END AS metric_3
FROM part
""")
def nested_to_flat_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested_to_flat(sections(nested_model_cards(spark, sf_dir), "Model"))
    return flat.selectExpr(
        "id",
        f"{text_of('flat', '$.model_name')} AS model_name",
        f"{text_of('flat', '$.medical_task')} AS medical_task",
        f"{text_of('flat', '$.model_architecture')} AS model_architecture",
        f"{text_of('flat', '$.time_to_train')} AS time_to_train",
        f"{text_of('flat', '$.hardware_requirements')} AS hardware",
        f"{text_of('flat', '$.sustainability')} AS sustainability",
        f"{text_of('flat', '$.time_to_inference')} AS inference",
        f"{text_of('flat', '$.results[0].result_name')} AS name_1",
        f"{text_of('flat', '$.results[0].result_metric')} AS metric_1",
        """map_contains_key(variant_get(flat, '$.results[1]', 'map<string,variant>'),
                            'result_metric') AS has_metric_2""",
        f"{text_of('flat', '$.results[2].result_metric')} AS metric_3",
    )


@query("""
SELECT o_orderkey AS id,
       CASE o_orderstatus WHEN 'O' THEN '["CT - Computed Tomography"]'
            WHEN 'F' THEN '["CT - Computed Tomography","MR - Magnetic Resonance"]'
            ELSE '["OT - Other"]' END AS content,
       CASE o_orderkey % 5 WHEN 2 THEN 'null' WHEN 4 THEN '0' ELSE o_custkey::VARCHAR END
         AS instances,
       CASE o_orderstatus WHEN 'O' THEN 'CT scan; ' || o_orderpriority
            WHEN 'F' THEN 'MRI and CT of ' || o_orderkey ELSE 'ct scan' END AS details,
       CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE '["DICOM"]' END AS file_format,
       CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE 'Unknown' END AS burned_in,
       concat_ws(chr(10) || chr(10),
                 CASE WHEN o_orderkey % 3 <> 0 THEN 'Labels of ' || o_orderkey END,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'Missing Information: see ' || o_custkey END,
                 'Noise Issues: ' || o_orderpriority) AS labeling,
       concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey % 7 <> 0 THEN 'kept secret' END,
                 'Re-identification: ' || o_orderstatus) AS confidentiality,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'kept secret' ELSE '' END AS ethical,
       strftime(o_orderdate, '%Y-%m-%d') || chr(10) || chr(10) || 'Partitioning: '
         || o_orderpriority AS collection,
       'Purpose: why ' || o_orderkey AS comments,
       CASE WHEN o_orderkey % 2 = 1 THEN 'Random sample' ELSE '' END AS sample,
       CASE WHEN o_orderkey % 4 > 0 THEN
         '{"Age":"Not specified","Criterion":"","Demographic":"","Number of instances":"'
         || o_custkey || '","Patient count":"' || o_custkey
         || '","Sex":"Not specified","Site count":"","Subset description":"","Subset name":"'
         || o_orderstatus || '1"}' END AS subset_1,
       CASE WHEN o_orderkey % 4 > 1 THEN '' END AS patients_2,
       CASE WHEN o_orderkey % 4 > 2 THEN 'Female' END AS sex_3,
       o_orderkey % 4 > 0 AS has_subsets
FROM orders
""")
def flat_to_nested_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_from_table(flat_dataset_cards(spark, sf_dir)).withColumn(
        "card_type", F.lit("dataset")
    )
    sample = "$.Composition.Representativeness[\"Sample type\"]"
    return flat_to_nested(cards).selectExpr(
        "id",
        "to_json(variant_get(section, '$[\"Indexing code\"].Content')) AS content",
        "to_json(variant_get(section, '$.Composition[\"Number of instances\"]')) AS instances",
        f"{text_of('section', '$.Imaging["Pre-processing"]')} AS details",
        "to_json(variant_get(section, '$.Imaging[\"File format\"]')) AS file_format",
        f"{text_of('section', '$.Imaging["Burned-in PHI"]')} AS burned_in",
        f"{text_of('section', '$.Labeling')} AS labeling",
        f"{text_of('section', '$.Confidentiality')} AS confidentiality",
        f"{text_of('section', '$["Ethical review"]')} AS ethical",
        f"{text_of('section', '$["Collection process"]')} AS collection",
        f"{text_of('section', '$.Comments')} AS comments",
        f"{text_of('section', sample)} AS sample",
        "to_json(variant_get(section, '$.Subsets[0]')) AS subset_1",
        f"{text_of('section', '$.Subsets[1]["Patient count"]')} AS patients_2",
        f"{text_of('section', '$.Subsets[2].Sex')} AS sex_3",
        "map_contains_key(variant_get(section, '$', 'map<string,variant>'), 'Subsets')"
        " AS has_subsets",
    )


@query("""
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS dataset_name,
       '["Image data"]' AS imaging_details,
       '["DICOM","' || o_orderpriority || '"]' AS file_format,
       CASE WHEN o_orderkey % 2 = 1 THEN 'Maybe' ELSE 'No' END AS burned_in_phi,
       'labels ' || o_orderpriority AS labeling, '' AS noise,
       o_custkey AS number_of_instances, 'CC' AS dataset_license, '[]' AS partitions
FROM orders
""")
def nested_to_flat_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested_to_flat(sections(nested_dataset_cards(spark, sf_dir), "Dataset"))
    return flat.selectExpr(
        "id",
        f"{text_of('flat', '$.dataset_name')} AS dataset_name",
        "to_json(variant_get(flat, '$.imaging_details')) AS imaging_details",
        "to_json(variant_get(flat, '$.file_format')) AS file_format",
        f"{text_of('flat', '$.burned_in_phi')} AS burned_in_phi",
        f"{text_of('flat', '$.labeling')} AS labeling",
        f"{text_of('flat', '$.noise')} AS noise",
        "variant_get(flat, '$.number_of_instances', 'bigint') AS number_of_instances",
        f"{text_of('flat', '$.dataset_license')} AS dataset_license",
        "to_json(variant_get(flat, '$.partitions')) AS partitions",
    )


@query("""
SELECT p_partkey AS id, p_name AS model_name,
       CASE WHEN p_size % 4 <> 0 THEN 'Rate ' || p_type
            WHEN p_size % 3 <> 0 THEN 'Net of ' || p_name
            ELSE 'Code Availability: ' || CASE WHEN p_size % 6 = 0 THEN p_brand ELSE 'NA' END
       END AS medical_task,
       CASE WHEN p_size % 3 <> 0 THEN 'Net of ' || p_name ELSE '' END AS model_architecture,
       CASE WHEN p_size % 2 = 0 THEN p_size || ' h' ELSE 'NA' END AS time_to_train,
       CASE WHEN p_size % 4 > 1 THEN p_type || ' 2' END AS result_name_2,
       CASE WHEN p_size % 4 > 1 THEN 'Accuracy' END AS result_metric_2
FROM part
""")
def round_trip_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat to nested and back: result names become descriptions, one metric is kept."""
    cards = cards_from_table(flat_model_cards(spark, sf_dir)).withColumn(
        "card_type", F.lit("model")
    )
    return nested_to_flat(flat_to_nested(cards)).selectExpr(
        "id",
        f"{text_of('flat', '$.model_name')} AS model_name",
        f"{text_of('flat', '$.medical_task')} AS medical_task",
        f"{text_of('flat', '$.model_architecture')} AS model_architecture",
        f"{text_of('flat', '$.time_to_train')} AS time_to_train",
        f"{text_of('flat', '$.results[1].result_name')} AS result_name_2",
        f"{text_of('flat', '$.results[1].result_metric')} AS result_metric_2",
    )


@query(rf"""
SELECT doc_id, CASE WHEN text = '' THEN 'Noise Issues: ' || source ELSE text END AS labeling,
       source AS noise, lang AS purpose,
       {sql_labelled("'Motivation: ' || text", 'Motivation')} AS motivation, '1' AS site_count
FROM documents
""")
def round_trip_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts packed into a nested card and read back.

    A text of several lines returns whole as the leading paragraph, but only its first
    line returns from a labelled entry.
    """
    raw = """to_json(struct(source AS dataset_name, text AS labeling, source AS noise,
                            text AS motivation, lang AS purpose,
                            array(struct(lang AS subset_name)) AS partitions)) AS raw"""
    documents = table(spark, sf_dir, "documents")
    cards = cards_from_table(documents.selectExpr("doc_id", raw)).withColumn(
        "card_type", F.lit("dataset")
    )
    return nested_to_flat(flat_to_nested(cards)).selectExpr(
        "doc_id",
        f"{text_of('flat', '$.labeling')} AS labeling",
        f"{text_of('flat', '$.noise')} AS noise",
        f"{text_of('flat', '$.purpose')} AS purpose",
        f"{text_of('flat', '$.motivation')} AS motivation",
        f"{text_of('flat', '$.partitions[0].site_count')} AS site_count",
    )


@query(f"""
SELECT s_suppkey,
       CASE s_nationkey % 3
         WHEN 0 THEN '{{"$schema":"{FAMILY}-model-2025-05.json","Model":{{"Name":"' || s_name || '"}}}}'
         WHEN 1 THEN '{{"$schema":"{FAMILY}-dataset-2025-05.json","Dataset":{{"Name":"' || s_name || '"}}}}'
       END AS card
FROM supplier
""")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards are wrapped by type; a type without an envelope gives NULL.

    Keys of a VARIANT are sorted, and "$" and "D" come before "M".
    """
    kind = F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'other' END")
    section = F.expr("to_variant_object(struct(s_name AS Name))")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.to_json(wrap_envelope(section, kind, FAMILY)).alias("card")
    )
