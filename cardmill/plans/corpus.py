"""Cards derived from the driver tables: one card per row; rows are shuffled once, unless large texts stand in them, so that no task gets too many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.session import prepare_session
from cardmill.sources.cards import spread

# Stands for the first part of the schema names in the derived cards.
FAMILY = "SAMPLE"


# Tables whose rows hold long texts; of these, large ones are not shuffled.
LONG_TEXTS = ("documents", "pages", "conversations", "benchmark", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in LONG_TEXTS else spread(rows, None)


def as_json(*expressions: str) -> str:
    """SQL for the JSON text of an object; NULL members are left out."""
    return f"to_json(struct({', '.join(expressions)}))"


def flat_model_cards(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A flat model card per part: id, file_name, raw, and more columns of the part."""
    result = """named_struct(
        'result_name', concat('run ', i),
        'result_description', if(i = 1, '', concat(p_type, ' ', i)),
        'result_metric', if(i % 2 = 1, cast('AUC' AS variant),
                            cast(array('Accuracy', 'Recall') AS variant)),
        'result_value', cast(p_size + i AS variant),
        'result_subset_data', if(i = 3, p_brand, NULL))"""
    raw = as_json(
        "p_name AS model_name",
        "if(p_size % 5 = 0, NULL, array(p_brand, p_type)) AS content_code",
        "if(p_size % 4 = 0, '', concat('Rate ', p_type)) AS medical_task",
        "if(p_size % 3 = 0, NULL, concat('Net of ', p_name)) AS model_architecture",
        "if(p_size % 2 = 0, concat(p_size, ' h'), 'NA') AS time_to_train",
        "if(p_size % 6 = 0, p_brand, 'NA') AS model_code_availability",
        "p_brand AS license",
        "array('Detection') AS use_case",
        f"transform(slice(array(1, 2, 3), 1, p_size % 4), i -> {result}) AS results",
    )
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "concat('part-', p_partkey, '.txt') AS file_name",
        f"{raw} AS raw",
        *more,
    )


def nested_model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested model card per part."""
    result = """named_struct(
        'Result Information', concat(p_type, ' ', i),
        'Metric', CASE i WHEN 1 THEN cast(array(p_brand, 'x') AS variant)
                         WHEN 2 THEN cast(cast(array() AS array<string>) AS variant)
                         ELSE cast(p_brand AS variant) END,
        'Value', cast(p_size AS string))"""
    technical = "named_struct('Training Time', if(p_size % 4 = 0, '3 days', ''))"
    section = f"""struct(
        p_name AS Name,
        struct(array(p_type) AS Content) AS `Indexing code`,
        concat('Rate ', p_type, '\\n\\nsustainability:  ', p_brand, ' \\n\\nTraining Time:',
               if(p_size % 2 = 0, ' 5 h', '\\nHardware: CPU')) AS Comments,
        if(p_size % 3 = 0, NULL, p_name) AS Input,
        p_type AS Output,
        if(p_size % 5 = 0, NULL, {technical}) AS `Technical Details`,
        transform(slice(array(1, 2, 3), 1, p_size % 4), i -> {result}) AS Results)"""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "concat('part-', p_partkey, '.json') AS file_name",
        f"to_json(struct('{FAMILY}-model-2025-05.json' AS `$schema`, {section} AS Model)) AS raw",
    )


def flat_dataset_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat dataset card per order."""
    partition = """named_struct(
        'subset_name', concat(o_orderstatus, i),
        'patient_count', if(i = 2, NULL, cast(o_custkey AS string)),
        'number_instances', if(i = 1, NULL, cast(o_custkey + i AS string)),
        'sex', if(i = 3, 'Female', NULL))"""
    raw = as_json(
        "concat('Order ', o_orderkey) AS dataset_name",
        """CASE o_orderstatus
             WHEN 'O' THEN cast(array('CT scan', o_orderpriority) AS variant)
             WHEN 'F' THEN cast(concat('MRI and CT of ', o_orderkey) AS variant)
             ELSE cast('ct scan' AS variant) END AS imaging_details""",
        """CASE o_orderkey % 5
             WHEN 0 THEN cast(concat(o_custkey, ',5') AS variant)
             WHEN 1 THEN cast(concat(' ', o_custkey, '.7 rows') AS variant)
             WHEN 2 THEN cast('abc' AS variant)
             WHEN 3 THEN cast(o_custkey AS variant) END AS number_of_instances""",
        "if(o_orderkey % 3 = 0, '', concat('Labels of ', o_orderkey)) AS labeling",
        "o_orderpriority AS noise",
        "if(o_orderkey % 2 = 0, concat('see ', o_custkey), NULL) AS missing_information",
        "if(o_orderkey % 7 = 0, '', 'kept secret') AS confidentiality",
        "o_orderstatus AS re_identification",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS collection_process",
        "o_orderpriority AS partioning_scheme",
        "concat('why ', o_orderkey) AS purpose",
        "if(o_orderkey % 4 = 0, array(), NULL) AS file_format",
        "if(o_orderkey % 4 = 1, o_orderpriority, NULL) AS burned_in_phi",
        "if(o_orderkey % 2 = 1, 'Random sample', NULL) AS representativeness",
        "transform(slice(array(1, 2, 3), 1, cast(o_orderkey % 4 AS int)), "
        f"i -> {partition}) AS partitions",
    )
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('order-', o_orderkey, '.txt') AS file_name", f"{raw} AS raw"
    )


def nested_dataset_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested dataset card per order, with a known set of faults."""
    data = """named_struct(
        'Patient count', if(i = 2, cast('7' AS variant), cast(o_custkey AS variant)),
        'Age range', array(array(cast(18 AS variant), cast('years' AS variant)),
                           array(cast(if(o_orderkey % 5 = 0, 300, 90) AS variant),
                                 cast(if(o_orderkey % 7 = 0, 'weeks', 'years') AS variant))),
        'Sex', if(o_orderstatus = 'P', 'Mixed', 'Female'))"""
    reference = "named_struct('Title', concat('T ', o_orderkey), 'Year', 2024)"
    section = f"""struct(
        if(o_orderkey % 11 = 0, NULL, concat('Order ', o_orderkey)) AS Name,
        struct(if(o_orderkey % 3 = 0, array('CT', 'CT'), array('CT', o_orderstatus)) AS Content,
               if(o_orderkey % 2 = 0,
                  array(cast('RID58' AS variant), to_variant_object(map('RID1', 'liver'))),
                  array(cast('58' AS variant), to_variant_object(map('x', 'liver')))) AS RadLex
              ) AS `Indexing code`,
        array(struct('A. Author' AS Name,
                     if(o_orderkey % 4 = 0, 'nobody', 'a@b.org') AS Email)) AS Author,
        struct(CASE o_orderkey % 4 WHEN 0 THEN cast(2020 AS variant)
                                   WHEN 1 THEN cast(1850 AS variant)
                                   WHEN 2 THEN cast('2020-02-30' AS variant)
                                   ELSE cast(date_format(o_orderdate, 'yyyy-MM-dd') AS variant)
               END AS Created) AS Date,
        array(if(o_orderkey % 6 = 0, to_variant_object({reference}),
                 to_variant_object(array({reference})))) AS Reference,
        struct('CC' AS Text, if(o_orderkey % 10 = 0, 'no uri', 'https://a.b/c') AS URL) AS License,
        struct(array('DICOM', o_orderpriority) AS `File format`,
               if(o_orderkey % 2 = 1, 'Maybe', 'No') AS `Burned-in PHI`) AS Imaging,
        concat('labels ', o_orderpriority) AS Labeling,
        struct(if(o_orderkey % 9 = 0, array('Image'), NULL) AS `Data type`,
               o_custkey AS `Number of instances`) AS Composition,
        if(o_orderkey % 13 = 0, 'why', NULL) AS Motive,
        transform(slice(array(1, 2, 3), 1, cast(o_orderkey % 4 AS int)),
                  i -> named_struct('Partition name', concat('part ', i), 'Data', {data})
                 ) AS Partition)"""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "concat('order-', o_orderkey, '.json') AS file_name",
        f"""to_json(struct(if(o_orderkey % 2 = 0, '{FAMILY}-dataset-2025-03.json',
                                                 '{FAMILY}-dataset-2025-05.json') AS `$schema`,
                          {section} AS Dataset)) AS raw""",
    )


def nation_card_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A flat card file for each nation (25 at any size) with the number of its suppliers, below card=…/ folders."""
    cards = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    lines = cards.selectExpr(
        "s_nationkey AS card",
        "to_json(struct(cast(s_nationkey AS string) AS dataset_name, n AS number_of_instances)) AS value",
    )
    lines.write.partitionBy("card").text(folder)
