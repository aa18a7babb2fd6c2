"""Look up the schema version that applies to each card."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.contracts.schema_documents import shape_from_document
from cardmill.contracts.shapes import Shape
from cardmill.functions.fence import fence
from cardmill.functions.session import scratch_path
from cardmill.functions.values import Fields, Record, as_text, backticked
from cardmill.operators.classify import SECTION_KEY
from cardmill.operators.lookup import lookup_join
from cardmill.operators.validate import validate

# What is shown for a schema.
BASE_SOURCE = "base"
BASE_TEXT = "Base Schema"
NO_VERSION = "Unknown"


SCHEMA_PARTS = tuple(("properties", key) for key in SECTION_KEY.values()) + tuple(
    ("$defs", kind) for kind in SECTION_KEY
)
SCHEMA = Fields((("$id",), ("description",), *SCHEMA_PARTS), probed=frozenset(SCHEMA_PARTS))


def usable_schema(schema: Record, card_type: Column) -> Column:
    """True when a schema document has the section and definition of its card type."""
    usable = [
        schema.at("properties", key).truthy
        & schema.at("$defs", kind).truthy
        & (card_type == kind)
        for kind, key in SECTION_KEY.items()
    ]
    return usable[0] | usable[1]


def check_registry(registry: DataFrame) -> DataFrame:
    """Add usable, version and description to registry rows.

    A registry row is (card_type, source, document): source is 'base' or the address
    of a custom schema, document the parsed schema or NULL when it did not load.
    """
    schema = SCHEMA.record("schema")
    version, about = schema.at("$id"), schema.at("description")
    checked = SCHEMA.stage(registry, "schema", F.col("document")).withColumns(
        {
            "usable": F.coalesce(usable_schema(schema, F.col("card_type")), F.lit(False)),
            "version": F.when(version.truthy, as_text(version)).otherwise(NO_VERSION),
            "description": F.when(about.truthy, as_text(about)).otherwise(""),
        }
    )
    return fence(SCHEMA.unstage(checked, "schema"), "usable", "version", "description")


def fit_schemas(checked: DataFrame) -> DataFrame:
    loaded = F.col("document").isNotNull()
    return checked.filter(loaded & (F.col("usable") | (F.col("source") == BASE_SOURCE)))


def one_per_source(checked: DataFrame, order: str | None = None) -> DataFrame:
    """One schema per card type and source, so that a join repeats no card.

    Of several rows the one with the largest value in the column `order` counts. Without such a column nothing
    tells which is newer, so a source with different rows is left out like one that can't be used. Base schemas
    count as they are, custom ones only with the structure that a schema must have.
    """
    fit = fit_schemas(checked)
    entry = F.struct("version", "description", F.to_json("document").alias("document"))
    if order is not None:
        chosen = fit.groupBy("card_type", "source").agg(F.max_by(entry, F.col(order)).alias("one"))
    else:
        low, high = F.min(entry).alias("one"), F.max(entry).alias("other")
        chosen = fit.groupBy("card_type", "source").agg(low, high).filter("one = other")
    return chosen.select("card_type", "source", "one.*")


def all_versions(checked: DataFrame, order: str) -> DataFrame:
    """All schemas of each source that can be used, with the value of `order` from which on each is valid."""
    return fit_schemas(checked).select(
        "card_type", "source", F.col(order).alias("_since"), "version", "description", F.to_json("document").alias("document")
    )


def stored(frame: DataFrame, name: str) -> DataFrame:
    """A small table written once, so that what it was made from is not read again for each use."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def resolve_schema(
    cards: DataFrame,
    registry: DataFrame,
    *,
    source_column: str = "schema_source",
    order: str | None = None,
    at: str | None = None,
    shuffle: bool | None = None,
) -> DataFrame:
    """Add the schema a card is checked with: its own if usable, else the base schema.

    Adds schema_text, schema_version, schema_description, is_custom and schema_found. schema_found is false
    where not even a base schema exists, so that a missing schema is visible. The registry is checked once;
    only names and versions are joined, in one join. Base schemas, one for each card type, become constants.

    With `at`, a column of the cards, the schema counts that was valid then: of each source the row with the largest
    `order` that is not after it (the largest version and document of equal ones). A source that has none yet is as if
    it were not there. A row without a value of `order` was always valid, a card without one of `at` takes the newest.
    """
    sources = stored(usable_sources(registry, order, at), "registry").drop("document")
    return with_schema(cards, sources, source_column, shuffle, at)


def usable_sources(registry: DataFrame, order: str | None, at: str | None) -> DataFrame:
    checked = check_registry(registry)
    if at is None:
        return one_per_source(checked, order)
    if order is None:
        raise ValueError("at needs order: the column that tells from when on a schema is valid")
    return all_versions(checked, order)


def with_schema(
    cards: DataFrame, sources: DataFrame, source_column: str, shuffle: bool | None, at: str | None = None
) -> DataFrame:
    """Columns of resolve_schema; also _contract, which tells different documents apart, where sources have it."""
    if "_contract" not in sources.columns:
        named = with_schema(cards, sources.withColumn("_contract", F.lit("")), source_column, shuffle, at)
        return named.drop("_contract")
    if at is not None:
        return with_schema_at(cards, sources, source_column, shuffle, at)
    custom = sources.filter(F.col("source") != BASE_SOURCE).select(
        "card_type",
        F.col("source").alias(source_column),
        F.col("version").alias("_custom_version"),
        F.col("description").alias("_custom_description"),
        F.col("_contract").alias("_custom_contract"),
    )
    base_version = base_description = base_contract = F.lit(None).cast("string")
    for row in sources.filter(F.col("source") == BASE_SOURCE).filter(F.col("card_type").isin(*SECTION_KEY)).collect():
        own = F.col("card_type") == row["card_type"]
        base_version = F.when(own, row["version"]).otherwise(base_version)
        base_description = F.when(own, row["description"]).otherwise(base_description)
        base_contract = F.when(own, row["_contract"]).otherwise(base_contract)
    joined = lookup_join(cards, custom, ["card_type", source_column], shuffle=shuffle)
    told = with_names(joined, source_column, base_version, base_description, base_contract)
    return told.drop("_custom_version", "_custom_description", "_custom_contract")


def with_names(
    joined: DataFrame, source_column: str, base_version: Column, base_description: Column, base_contract: Column
) -> DataFrame:
    is_custom = F.col("_custom_version").isNotNull()
    return joined.withColumns(
        {
            "schema_text": F.when(is_custom, F.col(source_column)).otherwise(BASE_TEXT),
            "schema_version": F.coalesce("_custom_version", base_version, F.lit(NO_VERSION)),
            "schema_description": F.coalesce("_custom_description", base_description, F.lit("")),
            "is_custom": is_custom,
            "schema_found": is_custom | base_version.isNotNull(),
            "_contract": F.coalesce("_custom_contract", base_contract),
        }
    )


def with_schema_at(
    cards: DataFrame, sources: DataFrame, source_column: str, shuffle: bool | None, at: str
) -> DataFrame:
    """with_schema by time. A source's versions are joined as one sorted array, so no card is repeated or sorted."""
    entry = F.struct("_since", "version", "description", "_contract")
    history = F.sort_array(F.collect_set(entry))
    histories = sources.groupBy("card_type", "source").agg(history.alias("_history"))
    is_base = F.col("source") == BASE_SOURCE
    base = histories.filter(is_base & F.col("card_type").isin(*SECTION_KEY)).select(
        "card_type", F.col("_history").alias("_base")
    )
    custom = histories.filter(~is_base).select(
        "card_type", F.col("source").alias(source_column), F.col("_history").alias("_custom")
    )
    joined = lookup_join(cards, custom, ["card_type", source_column], shuffle=shuffle)
    joined = lookup_join(joined, base, ["card_type"])

    def valid(versions: str) -> Column:
        when = F.col(backticked(at))
        known = F.filter(versions, lambda v: v["_since"].isNull() | when.isNull() | (v["_since"] <= when))
        return F.try_element_at(known, F.lit(-1))

    chosen = fence(joined.withColumns({"_custom": valid("_custom"), "_base": valid("_base")}), "_custom", "_base")
    parts = {f"_custom_{name}": F.col(f"_custom.{field}") for name, field in VERSION_PARTS.items()}
    told = with_names(
        chosen.withColumns(parts), source_column, *(F.col(f"_base.{field}") for field in VERSION_PARTS.values())
    )
    return told.drop("_custom", "_base", *parts)


VERSION_PARTS = {"version": "version", "description": "description", "contract": "_contract"}


# Each different schema adds its rules to the plan; more are checked in groups, each with its part of the cards.
MOST_SCHEMAS = 200


def registry_shapes(documents: DataFrame) -> dict[str, Shape]:
    """The shapes of all documents that can be read, by contract; none reads as a shape that no card is checked by."""
    shapes = {}
    for row in documents.collect():
        try:
            shapes[row["_contract"]] = shape_from_document(json.loads(row["document"]))
        except (AttributeError, KeyError, TypeError, ValueError):
            continue
    return shapes or {"": Shape()}


def check_by_registry(
    cards: DataFrame,
    registry: DataFrame,
    *,
    doc: str = "doc",
    source_column: str = "schema_source",
    order: str | None = None,
    at: str | None = None,
) -> DataFrame:
    """Check each card (card_type, source_column, doc) by the schema it resolves to.

    Adds the columns of resolve_schema, contract_read and those of validate. contract_read is false, and the
    violations are NULL, where no schema was found or the schema holds a rule that is not supported.

    Sources with equal documents share a contract, and of a large registry only contracts that cards resolve to are
    read. Where these are still more than MOST_SCHEMAS, cards are stored by groups of contracts, and each group is
    checked by its own rules, so that neither plan nor driver holds all of them.
    """
    sources = stored(usable_sources(registry, order, at), "registry")
    sources = sources.withColumn("_contract", F.sha2("document", 256))
    documents = sources.select("_contract", "document").distinct()
    named = with_schema(cards, sources.drop("document"), source_column, None, at)
    if documents.limit(MOST_SCHEMAS + 1).count() > MOST_SCHEMAS:
        used = named.select("_contract").distinct()
        documents = stored(documents.join(used, "_contract", "left_semi"), "contracts")
    count = documents.count()
    if count <= MOST_SCHEMAS:
        parts = [(named, documents)]
    else:
        # About half of what a run can take, as groups by hash differ in size.
        groups = 2 * count // MOST_SCHEMAS + 1
        group = F.pmod(F.xxhash64("_contract"), F.lit(groups)).cast("int")
        path = scratch_path(cards.sparkSession, "cards-by-contract")
        named.withColumn("_group", group).write.partitionBy("_group").parquet(path)
        kept = cards.sparkSession.read.schema(named.withColumn("_group", group).schema).parquet(path)
        parts = [
            (kept.filter(F.col("_group") == g).drop("_group"), documents.filter(group == g)) for g in range(groups)
        ]
    checked = [validate(own, registry_shapes(rules), doc=doc, key="_contract") for own, rules in parts]
    told = reduce(DataFrame.unionByName, checked)
    return told.withColumn("contract_read", F.col("violations").isNotNull()).drop("_contract")


def unknown_codes(
    cards: DataFrame, vocabulary: DataFrame, *, codes: str, id_column: str, shuffle: bool | None = None
) -> DataFrame:
    """One row per card and code that the vocabulary (column code) does not hold."""
    each = cards.select(id_column, F.explode(codes).alias("code"))
    known = vocabulary.select("code").distinct()
    return lookup_join(each, known, ["code"], "left_anti", shuffle=shuffle).select(id_column, "code")
