"""Queries for the registry, exports, streams and the whole way of a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.contracts.profiles import legacy_dataset, legacy_model
from cardmill.contracts.shapes import integer, listing, record, text
from cardmill.functions.session import prepare_session, scratch_path
from cardmill.operators.classify import classify
from cardmill.operators.registry import (
    check_by_registry,
    check_registry,
    resolve_schema,
    unknown_codes,
)
from cardmill.operators.reports import violation_summary
from cardmill.operators.validate import validate
from cardmill.plans.catalog import query
from cardmill.plans.conversion import sections
from cardmill.plans.corpus import (
    FAMILY,
    flat_dataset_cards,
    flat_model_cards,
    nation_card_files,
    nested_model_cards,
    table,
)
from cardmill.plans.process import process_cards
from cardmill.sinks.exports import export_flat, export_name, export_nested, preview_json
from cardmill.sources.cards import cards_from_table
from cardmill.streaming.landing import land_cards, landed_cards
from cardmill.streaming.stream import (
    card_stream,
    check_stream_by_registry,
    read_summary,
    write_card_stream,
    write_summary_stream,
)

# ---- registry ------------------------------------------------------------------


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base schema per region, one without structure, and a custom one per nation, some unusable."""
    base = table(spark, sf_dir, "region").selectExpr(
        "CASE r_regionkey WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'other' END AS card_type",
        "'base' AS source",
        """parse_json(concat('{"$id":"', r_name, '"', if(r_regionkey = 0, '', concat(
                             ',"properties":{"Model":{},"Dataset":{}},',
                             '"$defs":{"model":{},"dataset":{}}')), '}')) AS document""",
    )
    custom = table(spark, sf_dir, "nation").selectExpr(
        "if(n_nationkey % 2 = 0, 'model', 'dataset') AS card_type",
        "concat('custom/', n_nationkey) AS source",
        """try_parse_json(CASE n_regionkey
             WHEN 0 THEN '{not json'
             WHEN 1 THEN concat('{"$id":"', n_name, '","properties":{"Model":{},"Dataset":{}}}')
             WHEN 2 THEN '{"properties":{"Model":{},"Dataset":{}},"$defs":{"model":{},"dataset":{}}}'
             ELSE concat('{"$id":"', n_name, '","description":"for ', n_regionkey,
                         '","properties":{"Model":{},"Dataset":{}},',
                         '"$defs":{"model":{},"dataset":{}}}') END) AS document""",
    )
    return base.unionByName(custom)


@query("""
SELECT CASE r_regionkey WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'other' END AS card_type,
       'base' AS source, r_regionkey = 1 AS usable, r_name AS version, '' AS description
FROM region
UNION ALL
SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'model' ELSE 'dataset' END,
       'custom/' || n_nationkey, n_regionkey > 1,
       CASE WHEN n_regionkey IN (0, 2) THEN 'Unknown' ELSE n_name END,
       CASE WHEN n_regionkey > 2 THEN 'for ' || n_regionkey ELSE '' END
FROM nation
""")
def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_registry(registry_rows(spark, sf_dir)).select(
        "card_type", "source", "usable", "version", "description"
    )


RESOLVED_SQL = """
WITH cards AS (
  SELECT c_custkey, c_nationkey,
         CASE c_custkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'unknown' END
           AS card_type,
         c_custkey % 5 <> 0 AS asks
  FROM customer),
matched AS (
  SELECT cards.*, n_name, n_regionkey,
         asks AND n_regionkey > 1
         AND card_type = CASE WHEN n_nationkey % 2 = 0 THEN 'model' ELSE 'dataset' END AS is_custom
  FROM cards JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey,
       CASE WHEN is_custom THEN 'custom/' || c_nationkey ELSE 'Base Schema' END AS schema_text,
       CASE WHEN is_custom THEN CASE WHEN n_regionkey = 2 THEN 'Unknown' ELSE n_name END
            ELSE coalesce((SELECT r_name FROM region
                           WHERE r_regionkey = CASE card_type WHEN 'model' THEN 0
                                               WHEN 'dataset' THEN 1 END), 'Unknown') END
         AS schema_version,
       CASE WHEN is_custom AND n_regionkey > 2 THEN 'for ' || n_regionkey ELSE '' END
         AS schema_description,
       is_custom, card_type <> 'unknown' AS schema_found
FROM matched
"""


def resolved(spark: SparkSession, sf_dir: str, shuffle: bool | None) -> DataFrame:
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'unknown' END
           AS card_type""",
        "if(c_custkey % 5 <> 0, concat('custom/', c_nationkey), NULL) AS schema_source",
    )
    found = resolve_schema(cards, registry_rows(spark, sf_dir), shuffle=shuffle)
    return found.select(
        "c_custkey",
        "schema_text",
        "schema_version",
        "schema_description",
        "is_custom",
        "schema_found",
    )


@query(RESOLVED_SQL)
def resolved_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir, None)


@query(RESOLVED_SQL)
def resolved_schemas_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when the registry is too large to broadcast."""
    return resolved(spark, sf_dir, True)


BY_REGISTRY_SQL = """
WITH cards AS (
  SELECT s_suppkey, s_acctbal, s_suppkey % 10 = 0 AS nameless, n_regionkey,
         n_regionkey < 4 AS is_custom, n_regionkey < 4 AND n_nationkey % 7 = 0 AS odd
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, is_custom, NOT odd AS contract_read,
       CASE WHEN NOT odd THEN list_filter([
         CASE WHEN nameless THEN '$.Dataset.Name|required' END,
         CASE WHEN s_acctbal > CASE WHEN is_custom THEN 1000 * n_regionkey ELSE 5000 END
              THEN '$.Dataset.Balance|maximum' END], lambda x: x IS NOT NULL) END AS found
FROM cards
"""


def nation_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each nation, some of which don't load or hold a rule that is not supported, and a base schema."""
    document = """try_parse_json(concat('{"$id":"', version, '","type":"object","properties":',
        '{"Model":{},"Dataset":{"$ref":"#/$defs/dataset"}},"$defs":{"model":{},"dataset":{',
        '"type":"object","required":["Name"],', extra,
        '"properties":{"Balance":{"type":"number","maximum":', top, '}}}}}')) AS document"""
    base = table(spark, sf_dir, "region").filter("r_regionkey = 0").selectExpr(
        "'base' AS source", "r_name AS version", "'' AS extra", "'5000' AS top"
    )
    custom = table(spark, sf_dir, "nation").selectExpr(
        "concat('custom/', n_nationkey) AS source",
        "n_name AS version",
        """CASE WHEN n_regionkey = 4 THEN '{' WHEN n_nationkey % 7 = 0 THEN '"anyOf":[true],'
                ELSE '' END AS extra""",
        "cast(1000 * n_regionkey AS string) AS top",
    )
    return base.unionByName(custom).selectExpr("'dataset' AS card_type", "source", document)


SUPPLIER_CARDS = (
    "s_suppkey",
    "'dataset' AS card_type",
    "concat('custom/', s_nationkey) AS schema_source",
    """parse_json(to_json(struct(struct(
         s_acctbal AS Balance, if(s_suppkey % 10 = 0, NULL, s_name) AS Name) AS Dataset))) AS doc""",
)
FAULTS = "transform(violations, v -> concat(v.path, '|', v.keyword)) AS found"


@query(BY_REGISTRY_SQL)
def checked_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards checked by the schema of their nation, or the base schema where that one doesn't load."""
    cards = table(spark, sf_dir, "supplier").selectExpr(*SUPPLIER_CARDS)
    checked = check_by_registry(cards, nation_registry(spark, sf_dir))
    return checked.selectExpr("s_suppkey", "is_custom", "contract_read", FAULTS)


@query("""
SELECT c_custkey, c_custkey % 450 % 9 <> 0 AS is_custom,
       CASE WHEN c_custkey % 450 % 9 = 0 THEN CASE WHEN c_acctbal > 0 THEN ['$.Model.Balance|maximum'] ELSE [] END
            WHEN c_acctbal > 10 * (c_custkey % 450) THEN ['$.Model.Balance|maximum'] ELSE [] END AS found
FROM customer
""")
def checked_by_many_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of 450 schemas, more than the rules of one run; a source in nine has no schema that can be used."""
    document = """try_parse_json(concat('{"$id":"v', n, '","properties":{"Dataset":{},"Model":{"$ref":"#/$defs/model"}},',
        '"$defs":{"dataset":{},"model":{"properties":{"Balance":{"type":"number","maximum":', top, '}}}}}')) AS document"""
    sources = spark.range(450).selectExpr(
        "concat('custom/', id) AS source", "id AS n", "if(id % 9 = 0, '}', cast(10 * id AS string)) AS top"
    )
    base = spark.range(1).selectExpr("'base' AS source", "id AS n", "'0' AS top")
    registry = base.unionByName(sources).selectExpr("'model' AS card_type", "source", document)
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "'model' AS card_type",
        "concat('custom/', c_custkey % 450) AS schema_source",
        "parse_json(to_json(struct(struct(c_acctbal AS Balance) AS Model))) AS doc",
    )
    checked = check_by_registry(cards, registry)
    found = F.transform("violations", lambda v: F.concat(v["path"], F.lit("|"), v["keyword"]))
    return checked.select("c_custkey", "is_custom", found.alias("found"))


UNKNOWN_CODES_SQL = """
SELECT doc_id, code FROM (
  SELECT doc_id, lang AS code FROM documents UNION ALL SELECT doc_id, source FROM documents)
WHERE code NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey < 3)
  AND code <> 'en'
"""


def codes_outside(spark: SparkSession, sf_dir: str, shuffle: bool | None) -> DataFrame:
    cards = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "array(lang, source) AS codes"
    )
    known = table(spark, sf_dir, "nation").selectExpr(
        "if(n_regionkey < 3, concat('src', n_nationkey), 'en') AS code"
    )
    return unknown_codes(cards, known, codes="codes", id_column="doc_id", shuffle=shuffle)


@query(UNKNOWN_CODES_SQL)
def codes_outside_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes_outside(spark, sf_dir, None)


@query(UNKNOWN_CODES_SQL)
def codes_outside_vocabulary_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes_outside(spark, sf_dir, True)


# ---- exports -------------------------------------------------------------------

EXPORT_DAY = "2025-05-31"


def supplier_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "if(s_nationkey % 2 = 0, 'model', 'dataset') AS card_type",
        """to_variant_object(struct(s_name AS Name, s_suppkey AS Key, s_acctbal AS Balance))
           AS section""",
    )


def exported(spark: SparkSession, path: str) -> DataFrame:
    """Exported lines read back; card_type and export_date come from the folders."""
    return cards_from_table(prepare_session(spark).read.text(path), "value")


@query(f"""
SELECT s_suppkey, s_name, s_acctbal,
       CASE WHEN s_nationkey % 2 = 0 THEN 'model' ELSE 'dataset' END AS card_type,
       '{FAMILY}-' || CASE WHEN s_nationkey % 2 = 0 THEN 'model' ELSE 'dataset' END
         || '-2025-05.json' AS schema_name,
       lower('{FAMILY}') || '-' || CASE WHEN s_nationkey % 2 = 0 THEN 'model' ELSE 'dataset' END
         || '-{EXPORT_DAY}.json' AS file_name
FROM supplier
""")
def exported_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nested")
    export_nested(supplier_sections(spark, sf_dir), path, family=FAMILY, day=EXPORT_DAY)
    section = "coalesce(variant_get(doc, '$.Model', 'variant'), variant_get(doc, '$.Dataset'))"
    day = F.col("export_date").cast("string")
    cards = exported(spark, path).withColumn("section", F.expr(section))
    return cards.select(
        F.variant_get("section", "$.Key", "bigint").alias("s_suppkey"),
        F.variant_get("section", "$.Name", "string").alias("s_name"),
        F.variant_get("section", "$.Balance", "double").alias("s_acctbal"),
        "card_type",
        F.variant_get("doc", '$["$schema"]', "string").alias("schema_name"),
        export_name(F.col("card_type"), FAMILY, day, ".json").alias("file_name"),
    )


@query("""
SELECT p_name AS model_name, 'Rate ' || p_type AS medical_task,
       (p_size % 4)::INTEGER AS n_results, count(*) AS cards
FROM part GROUP BY ALL
""")
def exported_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flat")
    export_flat(sections(nested_model_cards(spark, sf_dir), "Model"), path, day=EXPORT_DAY)
    cards = exported(spark, path).selectExpr(
        "variant_get(doc, '$.model_name', 'string') AS model_name",
        "variant_get(doc, '$.medical_task', 'string') AS medical_task",
        "size(variant_get(doc, '$.results', 'array<variant>')) AS n_results",
    )
    return cards.groupBy("model_name", "medical_task", "n_results").agg(
        F.count("*").alias("cards")
    )


@query("""
SELECT c_custkey,
       CASE c_custkey % 4 WHEN 0 THEN 'unknown_type' WHEN 1 THEN 'no_section'
            WHEN 2 THEN 'not_mappable' END AS flat_fate,
       CASE c_custkey % 4 WHEN 0 THEN 'unknown_type' WHEN 1 THEN 'no_section' END AS nested_fate
FROM customer
""")
def export_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of which some have an unknown type, no section or one that can't be mapped: none is lost."""
    cards = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "if(c_custkey % 4 = 0, 'other', if(c_custkey % 8 < 4, 'model', 'dataset')) AS card_type",
        """parse_json(CASE c_custkey % 4 WHEN 1 THEN NULL WHEN 2 THEN concat(
             '{"Name":"', c_custkey, '","Results":"text","Subsets":"text"}')
             ELSE concat('{"Name":"', c_custkey, '"}') END) AS section""",
    )
    flat, nested = scratch_path(spark, "flat"), scratch_path(spark, "nested")
    not_flat = export_flat(cards, flat, day=EXPORT_DAY)
    not_nested = export_nested(cards, nested, family=FAMILY, day=EXPORT_DAY)
    name = """coalesce(variant_get(doc, '$.model_name', 'string'), variant_get(doc, '$.dataset_name', 'string'),
                       variant_get(doc, '$.Model.Name', 'string'), variant_get(doc, '$.Dataset.Name', 'string'))"""

    def fates(path: str, refused: DataFrame, fate: str) -> DataFrame:
        written = exported(spark, path).selectExpr(f"cast({name} AS bigint) AS c_custkey", f"NULL AS {fate}")
        return written.unionByName(refused.selectExpr("c_custkey", f"refusal AS {fate}"))

    return fates(flat, not_flat, "flat_fate").join(fates(nested, not_nested, "nested_fate"), "c_custkey")


@query("""
SELECT s_suppkey,
       concat_ws(chr(10), '{', '  "Keys": [', '    ' || s_suppkey, '  ],',
                 '  "Name": "' || s_name || '",', '  "None": []', '}') AS shown
FROM supplier
""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(
        """to_variant_object(struct(s_name AS Name, array(s_suppkey) AS Keys,
                                    cast(array() AS array<string>) AS None))"""
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", preview_json(value).alias("shown"))


# ---- the whole way -------------------------------------------------------------


@query("""
SELECT 'part-' || p_partkey || '.txt' AS file_name, 'model' AS card_type,
       1 + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END
         + CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS error_count,
       NULL AS reject_reason
FROM part
UNION ALL
SELECT 'order-' || o_orderkey || '.txt', 'dataset',
       (o_orderstatus NOT IN ('O', 'F'))::INTEGER + (o_orderkey % 5 = 2)::INTEGER, NULL
FROM orders
UNION ALL
SELECT 'document-' || doc_id, 'unknown', NULL, 'invalid_file' FROM documents
""")
def processed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, convert and validate a mixed corpus; refused cards stay in it."""
    columns = ("file_name", "raw")
    documents = table(spark, sf_dir, "documents").selectExpr(
        "concat('document-', doc_id) AS file_name", "text AS raw"
    )
    corpus = (
        flat_model_cards(spark, sf_dir)
        .select(*columns)
        .unionByName(flat_dataset_cards(spark, sf_dir).select(*columns))
        .unionByName(documents)
    )
    cards = cards_from_table(corpus, "raw", "file_name")
    shapes = {"model": legacy_model(), "dataset": legacy_dataset()}
    return process_cards(cards, shapes).select(
        "file_name", "card_type", "error_count", "reject_reason"
    )


@query("""
WITH versions AS (
  SELECT n_nationkey AS nation, n_regionkey, since, n
  FROM (SELECT *, unnest([0, 1]) AS n FROM nation), LATERAL (SELECT make_date(1996 + 2 * n + n_nationkey % 2, 1, 1) AS since)
  WHERE n_regionkey < 4 OR n = 0)
SELECT o_orderkey, n IS NOT NULL AS is_custom,
       coalesce('v' || n, CASE WHEN o_orderdate >= DATE '1995-07-01' THEN 'base' ELSE 'Unknown' END) AS schema_version,
       o_totalprice > CASE n WHEN 0 THEN 200000 WHEN 1 THEN 300000
                      ELSE CASE WHEN o_orderdate >= DATE '1995-07-01' THEN 100000 END END AS broken
FROM orders ASOF LEFT JOIN versions ON o_custkey % 30 = nation AND o_orderdate >= since
""")
def checked_by_schema_of_the_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards checked by the schema that was valid on their date: two versions of each source, of which some don't load."""
    document = """try_parse_json(concat('{"$id":"', version, '","properties":{"Dataset":{},"Model":{"$ref":"#/$defs/model"}},',
        '"$defs":{"dataset":{},"model":{"properties":{"Price":{"maximum":', top, '}}}}}')) AS document"""
    versions = table(spark, sf_dir, "nation").selectExpr("*", "explode(array(0, 1)) AS n").selectExpr(
        "concat('custom/', n_nationkey) AS source",
        "make_date(1996 + 2 * n + n_nationkey % 2, 1, 1) AS since",
        "concat('v', n) AS version",
        "if(n_regionkey = 4 AND n = 1, '}', cast(200000 + 100000 * n AS string)) AS top",
    )
    base = spark.range(1).selectExpr(
        "'base' AS source", "DATE '1995-07-01' AS since", "'base' AS version", "'100000' AS top"
    )
    registry = base.unionByName(versions).selectExpr("'model' AS card_type", "source", "since", document)
    cards = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "'model' AS card_type",
        "concat('custom/', o_custkey % 30) AS schema_source",
        "cast(o_orderdate AS date) AS card_date",
        "parse_json(to_json(struct(struct(o_totalprice AS Price) AS Model))) AS doc",
    )
    checked = check_by_registry(cards, registry, order="since", at="card_date")
    return checked.selectExpr("o_orderkey", "is_custom", "schema_version", "NOT is_valid AS broken")


# ---- streams -------------------------------------------------------------------


@query("""
SELECT event_id,
       (try_cast(json_extract(props, '$.k') AS BIGINT) > 50)::INTEGER AS error_count
FROM events
""")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same checks on a stream of table files."""
    events = (
        prepare_session(spark)
        .readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    shape = record({"k": integer(maximum=50)}, required=("k",))
    checked = validate(cards_from_table(events, "props"), shape)
    path = scratch_path(spark, "streamed")
    stream = write_card_stream(
        checked.select("event_id", "error_count"), path, scratch_path(spark, "commits")
    )
    stream.awaitTermination()
    return spark.read.parquet(path)


@query(BY_REGISTRY_SQL)
def streamed_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving cards checked by the schema of their nation, as checked_by_registry does with cards at rest."""
    arriving = (
        prepare_session(spark)
        .readStream.schema(table(spark, sf_dir, "supplier").schema)
        .option("pathGlobFilter", "supplier.parquet")
        .parquet(sf_dir)
    )
    path = scratch_path(spark, "streamed")
    stream = check_stream_by_registry(
        arriving.selectExpr(*SUPPLIER_CARDS),
        lambda: nation_registry(spark, sf_dir),
        path,
        scratch_path(spark, "commits"),
        columns=("s_suppkey", "is_custom", "contract_read", "violations"),
    )
    stream.awaitTermination()
    return spark.read.parquet(path).selectExpr("s_suppkey", "is_custom", "contract_read", FAULTS)


@query("""
SELECT path, keyword, count(DISTINCT id) AS cards, count(*) AS violations FROM (
  SELECT c_custkey AS id, unnest(list_filter([
    CASE WHEN c_custkey % 5 = 0 THEN '$.name|required' END,
    CASE WHEN length(c_mktsegment) > 8 THEN '$.tags[*]|maxLength' END,
    CASE WHEN c_custkey % 3 = 0 THEN '$.tags[*]|type' END], lambda x: x IS NOT NULL)) AS fault,
    split_part(fault, '|', 1) AS path, split_part(fault, '|', 2) AS keyword FROM customer) GROUP BY ALL
""")
def streamed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with cards that arrive in two lots, summed up by a stream that was stopped in between."""
    raw = """to_json(struct(if(c_custkey % 5 = 0, NULL, c_name) AS name,
        array(cast(c_mktsegment AS variant), if(c_custkey % 3 = 0, cast(1 AS variant), cast('a' AS variant))) AS tags)) AS raw"""
    cards = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", raw)
    shape = record({"name": text(), "tags": listing(text(max_length=8))}, required=("name",))
    folder, path, commits = (scratch_path(spark, name) for name in ("arriving", "summary", "commits"))
    for lot in (0, 1):
        cards.filter(F.col("id") % 2 == lot).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(cards.schema).parquet(folder)
        checked = validate(cards_from_table(arriving), shape)
        write_summary_stream(violation_summary(checked), path, commits).awaitTermination()
    return read_summary(spark, path, ("cards", "violations"))


@query("""
SELECT s_nationkey::BIGINT AS nation, 'dataset' AS card_type, count(*)::BIGINT AS suppliers,
       (count(*) > 3)::INTEGER AS error_count
FROM supplier GROUP BY s_nationkey
""")
def streamed_card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card file for each nation that sums up its suppliers, taken in as a stream of files."""
    folder = scratch_path(spark, "arriving")
    nation_card_files(spark, sf_dir, folder)
    shape = record(
        {"Composition": record({"Number of instances": integer(maximum=3)}, closed=False)}, closed=False
    )
    processed = process_cards(card_stream(spark, folder), {"dataset": shape})
    path = scratch_path(spark, "streamed")
    stream = write_card_stream(
        processed.selectExpr(
            "cast(variant_get(section, '$.Name', 'string') AS bigint) AS nation",
            "card_type",
            "variant_get(section, '$.Composition[\"Number of instances\"]', 'bigint') AS suppliers",
            "error_count",
        ),
        path,
        scratch_path(spark, "commits"),
    )
    stream.awaitTermination()
    return spark.read.parquet(path)


@query("""
SELECT p_brand AS brand, count(*)::BIGINT AS parts, 'model' AS card_type,
       (substr(p_brand, 7)::INTEGER % 2)::BIGINT AS batch, 1::BIGINT AS files
FROM part GROUP BY p_brand
""")
def landed_card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card file for each brand, landed in two lots, the second by a run that meets the files of the first again."""
    folder, landed, commits = (scratch_path(spark, name) for name in ("arriving", "landed", "commits"))
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    cards = brands.selectExpr(
        "p_brand AS card",
        "cast(substring(p_brand, 7) AS int) % 2 AS lot",
        """to_json(struct(struct(p_brand AS Name, n AS Parts) AS Model)) AS value""",
    )
    for lot in (0, 1):
        cards.filter(F.col("lot") == lot).drop("lot").write.mode("append").partitionBy("card").text(folder)
        for _ in range(2):
            land_cards(spark, folder, landed, commits).awaitTermination()
    found = classify(cards_from_table(landed_cards(spark, landed), "raw", "file_name"))
    return found.groupBy(
        F.variant_get("doc", "$.Model.Name", "string").alias("brand"),
        F.variant_get("doc", "$.Model.Parts", "bigint").alias("parts"),
        "card_type",
        F.col("batch").cast("bigint").alias("batch"),
    ).agg(F.count("*").alias("files"))


@query("""
SELECT card_type, format, reject_reason, count(*) AS cards FROM (
  SELECT CASE event_type WHEN 'click' THEN 'model' WHEN 'view' THEN 'dataset'
              ELSE 'unknown' END AS card_type,
         CASE WHEN event_type = 'click' THEN 'txt' ELSE 'json' END AS format,
         CASE WHEN event_type IN ('click', 'view') THEN NULL
              WHEN event_type = 'error' THEN 'invalid_file' WHEN event_type = 'signup' THEN 'no_data'
              ELSE 'unknown_type' END AS reject_reason
  FROM events) GROUP BY ALL
""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason for which a card is refused."""
    cards = table(spark, sf_dir, "events").selectExpr(
        """CASE event_type
             WHEN 'click' THEN to_json(struct(concat('m', event_id) AS model_name))
             WHEN 'view' THEN concat('{"Dataset": ', props, '}')
             WHEN 'error' THEN concat(props, '}')
             WHEN 'signup' THEN if(event_id % 2 = 0, '0', '""')
             ELSE if(event_id % 2 = 0, '[]', props) END AS raw"""
    )
    classified = classify(cards_from_table(cards))
    return classified.groupBy("card_type", "format", "reject_reason").agg(
        F.count("*").alias("cards")
    )
