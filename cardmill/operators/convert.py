"""Map sections between the flat and the nested layout.

A conversion is a map-only projection that works the same on tables and streams: the
fields are read into a record once, and the other layout is built from that record.
A result is NULL where the card cannot be mapped (a list field that is no list, a list
with null in it, a text field that is no text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions.fence import fence
from cardmill.functions.text import (
    PARAGRAPH,
    first_paragraph,
    labelled_text,
    leading_integer,
)
from cardmill.functions.values import (
    Field,
    Fields,
    Path,
    Record,
    as_object,
    as_text,
    backticked,
    first_truthy,
    leaves,
    literal,
    tree_of,
    truthy_text,
)
from cardmill.operators.classify import HEAD, NAME_KEY, SECTION_KEY
from cardmill.operators.layouts import (
    CODE_WORDS,
    DATA_TYPES,
    DATASET_FIELDS,
    DATASET_PACKED,
    DETAIL_SEPARATOR,
    MODEL_COMMENTS,
    MODEL_FIELDS,
    NO_DETAILS,
    NOT_AVAILABLE,
    OTHER_CODE,
    RESULT_FIELDS,
    SUBSET_FIELDS,
    TECHNICAL_FIELDS,
    TECHNICAL_KEY,
    Packed,
)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def bad_list(field: Field) -> Column:
    """A list field that holds something else, or a list with null elements."""
    has_null = F.exists(field.items, F.is_variant_null)
    return F.when(field.is_list, has_null).otherwise(field.truthy)


def bad_text(field: Field) -> Column:
    return field.truthy & field.text.isNull()


def pack(card: Record, packed: Packed) -> Column:
    parts = [truthy_text(card.at(name)) for name in packed.lead]
    # A truthy value gets its label even where its text is empty, as that of [] is.
    parts += [
        F.concat(F.lit(f"{label}: "), truthy_text(card.at(name))) for label, name in packed.labelled
    ]
    return F.concat_ws(PARAGRAPH, *parts)


def infer_codes(
    details: Column,
    code_words: tuple[tuple[tuple[str, ...], str], ...] = CODE_WORDS,
    other: str = OTHER_CODE,
) -> Column:
    """Content codes named in a text; words are matched in the letter case given."""
    nothing = F.array().cast("array<string>")
    found = F.concat(
        *[
            F.when(any_of(details.contains(word) for word in words), F.array(F.lit(code)))
            .otherwise(nothing)
            for words, code in code_words
        ]
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def all_na(fields: list[Field]) -> Column:
    """True when every value is 'NA' or falsy."""
    nothing = [~f.truthy | F.coalesce(f.text == NOT_AVAILABLE, F.lit(False)) for f in fields]
    return reduce(lambda left, right: left & right, nothing)


def scalar_or_list(field: Field, default: str = "") -> Column:
    """A list as it is, any other value as a list of one."""
    return F.coalesce(field.items, F.array(first_truthy(field, default=default)))


def mapped_list(field: Field, fields: Fields, build: Callable[[Record], Column]) -> Column:
    """Objects of a list, each rebuilt from its fields; VARIANT list, [] if absent."""
    built = fields.rebuild(field.items, build)
    return F.coalesce(built, F.array().cast("array<variant>")).cast("variant")


def named(*names: str, probed: tuple[str, ...] = ()) -> Fields:
    return Fields(tuple((n,) for n in names), frozenset((n,) for n in probed))


@dataclass(frozen=True)
class Mapped:
    """A mapped card: value per place, whether it can be mapped, names left out if NULL."""

    places: dict[Path, Column]
    mappable: Column
    optional: tuple[str, ...] = ()


def assemble(cards: DataFrame, into: str, mapped: dict[str, Mapped], kind: Column) -> DataFrame:
    """Add the object of each card's kind, NULL where it cannot be mapped.

    The parts of an object are columns of their own before they are put together: one
    expression for a whole card would be compiled into methods too long to be fast.
    """
    checks, parts, objects = {}, {}, F
    for name, card in mapped.items():
        check = f"_{name}_mappable"
        checks[check] = (kind == name) & card.mappable
        tree = tree_of(card.places.items())
        columns = {key: f"_{name}_{number}" for number, key in enumerate(tree)}
        for key, part in tree.items():
            whole = as_object(dict(leaves(part))) if isinstance(part, dict) else part
            parts[columns[key]] = F.when(F.col(check), whole.cast("variant"))
        places = {(key,): F.col(column) for key, column in columns.items()}
        objects = objects.when(F.col(check), as_object(places, card.optional))
    staged = fence(cards.withColumns(checks).withColumns(parts), *checks, *parts)
    return staged.withColumn(into, objects).drop(*checks, *parts)


# ---- flat to nested ------------------------------------------------------------

PACKED_NAMES = {
    name
    for packed in (MODEL_COMMENTS, *DATASET_PACKED)
    for name in (*packed.lead, *(name for _, name in packed.labelled))
}
FLAT_LISTS = ("results", "partitions", "imaging_details")
# All flat fields of either card type.
FLAT = named(
    *sorted({name for name, _, _ in (*MODEL_FIELDS, *DATASET_FIELDS)} | PACKED_NAMES),
    *FLAT_LISTS,
    "number_of_instances",
    "representativeness",
    probed=FLAT_LISTS,
)
FLAT_RESULT = named(
    "result_name",
    "result_description",
    "result_metric",
    *(name for name, _ in RESULT_FIELDS),
    probed=("result_metric",),
)
FLAT_PARTITION = named(
    "patient_count", "number_instances", *(name for name, *_ in SUBSET_FIELDS)
)


def nested_model(card: Record) -> Mapped:
    """Nested model section of a flat record; the results must be a list."""

    def result(one: Record) -> Column:
        information = first_truthy(
            one.at("result_description"), one.at("result_name"), default=""
        )
        places = {
            ("Result Information",): information,
            ("Metric",): scalar_or_list(one.at("result_metric")),
        }
        for name, key in RESULT_FIELDS:
            places[(key,)] = first_truthy(one.at(name), default="")
        return as_object(places)

    places = {path: first_truthy(card.at(name), default=d) for name, path, d in MODEL_FIELDS}
    places[MODEL_COMMENTS.path] = pack(card, MODEL_COMMENTS)
    architecture = first_truthy(card.at("model_architecture"), default="")
    places[("Input",)] = architecture
    places[("Output",)] = architecture
    places[("Results",)] = mapped_list(card.at("results"), FLAT_RESULT, result)
    technical = {
        (key,): first_truthy(card.at(name), default=NOT_AVAILABLE)
        for name, key in TECHNICAL_FIELDS
    }
    nothing = all_na([card.at(name) for name, _ in TECHNICAL_FIELDS])
    places[(TECHNICAL_KEY,)] = F.when(~nothing, as_object(technical))
    return Mapped(places, ~bad_list(card.at("results")), (TECHNICAL_KEY,))


def nested_dataset(card: Record) -> Mapped:
    """Nested dataset section of a flat record."""
    details = card.at("imaging_details")

    def joined(separator: str) -> Column:
        texts = F.transform(details.items, lambda x: F.coalesce(as_text(Field(x)), F.lit("")))
        return F.coalesce(F.array_join(texts, separator), details.text, F.lit(""))

    def subset(one: Record) -> Column:
        places = {
            (key,): first_truthy(one.at(name), default=going_in)
            for name, key, going_in, _ in SUBSET_FIELDS
        }
        patients = one.at("patient_count")
        places[("Patient count",)] = first_truthy(patients, default="")
        places[("Number of instances",)] = first_truthy(
            one.at("number_instances"), patients, default=""
        )
        return as_object(places)

    places = {path: first_truthy(card.at(name), default=d) for name, path, d in DATASET_FIELDS}
    for packed in DATASET_PACKED:
        places[packed.path] = pack(card, packed)
    places[("Indexing code", "Content")] = infer_codes(joined(" "))
    places[("Imaging", "Pre-processing")] = joined(DETAIL_SEPARATOR)
    places[("Ethical review",)] = first_truthy(card.at("confidentiality"), default="")
    sample = first_truthy(card.at("representativeness"), default="")
    places[("Composition", "Sample Size Calculation")] = sample
    places[("Composition", "Representativeness", "Sample type")] = sample
    places[("Composition", "Data type")] = literal(DATA_TYPES)
    count = card.at("number_of_instances")
    places[("Composition", "Number of instances")] = F.when(
        count.truthy, leading_integer(as_text(count))
    ).otherwise(literal(0))
    partitions = card.at("partitions")
    places[("Subsets",)] = F.when(
        F.size(partitions.items) > 0, mapped_list(partitions, FLAT_PARTITION, subset)
    )
    no_details = details.truthy & ~details.is_list & details.text.isNull()
    return Mapped(places, ~(bad_list(partitions) | no_details), ("Subsets",))


# ---- nested to flat ------------------------------------------------------------

# The fields of a nested section, of either card type, that have a flat place.
NESTED = Fields(
    tuple(
        sorted(
            {path for _, path, _ in (*MODEL_FIELDS, *DATASET_FIELDS)}
            | {packed.path for packed in (MODEL_COMMENTS, *DATASET_PACKED)}
            | {(TECHNICAL_KEY, key) for _, key in TECHNICAL_FIELDS}
        )
    )
    + (
        ("Composition", "Number of instances"),
        ("Composition", "Representativeness", "Sample type"),
        ("Composition", "Sample Size Calculation"),
        ("Imaging", "Pre-processing"),
        ("Input",),
        ("Output",),
        ("Results",),
        ("Subsets",),
    ),
    probed=frozenset({("Results",), ("Subsets",)}),
)
NESTED_RESULT = named(
    "Result Information", "Metric", *(key for _, key in RESULT_FIELDS), probed=("Metric",)
)
NESTED_SUBSET = named(
    "Patient count", "Number of instances", *(key for _, key, *_ in SUBSET_FIELDS)
)


def flat_model(card: Record) -> Mapped:
    """Flat model card of a nested record."""
    comments = card.at(*MODEL_COMMENTS.path)
    text = F.coalesce(comments.text, F.lit(""))

    def result(one: Record) -> Column:
        metric = one.at("Metric")
        information = first_truthy(one.at("Result Information"), default="")
        places = {("result_name",): information, ("result_description",): information}
        for name, key in RESULT_FIELDS:
            places[(name,)] = first_truthy(one.at(key), default="")
        places[("result_metric",)] = F.when(metric.is_list, F.get(metric.items, 0)).otherwise(
            first_truthy(metric, default="")
        )
        return as_object(places, optional=("result_metric",))

    places = {(name,): first_truthy(card.at(*path), default=d) for name, path, d in MODEL_FIELDS}
    task = first_paragraph(text)
    places[("medical_task",)] = F.when(task != "", task.cast("variant")).otherwise(
        first_truthy(card.at("Input"), default="")
    )
    places[("model_architecture",)] = first_truthy(
        card.at("Input"), card.at("Output"), default=""
    )
    places[("results",)] = mapped_list(card.at("Results"), NESTED_RESULT, result)
    labels = {name: label for label, name in MODEL_COMMENTS.labelled}
    for name, key in TECHNICAL_FIELDS:
        found = F.nullif(labelled_text(text, labels[name]), F.lit(""))
        places[(name,)] = F.coalesce(
            first_truthy(card.at(TECHNICAL_KEY, key)),
            F.coalesce(found, F.lit(NOT_AVAILABLE)).cast("variant"),
        )
    no_text = comments.value.isNotNull() & ~F.is_variant_null(comments.value)
    no_text = no_text & comments.text.isNull()
    return Mapped(places, ~(bad_list(card.at("Results")) | no_text))


def flat_dataset(card: Record) -> Mapped:
    """Flat dataset card of a nested record."""
    details = card.at("Imaging", "Pre-processing")

    def partition(one: Record) -> Column:
        places = {
            (name,): first_truthy(one.at(key), default=coming_back)
            for name, key, _, coming_back in SUBSET_FIELDS
        }
        patients, instances = one.at("Patient count"), one.at("Number of instances")
        places[("patient_count",)] = first_truthy(patients, instances, default="")
        places[("number_instances",)] = first_truthy(instances, patients, default="")
        return as_object(places)

    places = {
        (name,): first_truthy(card.at(*path), default=d) for name, path, d in DATASET_FIELDS
    }
    for packed in DATASET_PACKED:
        text = F.coalesce(card.at(*packed.path).text, F.lit(""))
        for name in packed.lead:
            places[(name,)] = first_paragraph(text)
        for label, name in packed.labelled:
            places[(name,)] = labelled_text(text, label)
    split = F.split(details.text, DETAIL_SEPARATOR).cast("variant")
    places[("imaging_details",)] = F.when(details.truthy, split).otherwise(literal(NO_DETAILS))
    places[("number_of_instances",)] = first_truthy(
        card.at("Composition", "Number of instances"), default=0
    )
    places[("representativeness",)] = first_truthy(
        card.at("Composition", "Representativeness", "Sample type"),
        card.at("Composition", "Sample Size Calculation"),
        default="",
    )
    places[("partitions",)] = mapped_list(card.at("Subsets"), NESTED_SUBSET, partition)
    no_text = any_of(
        bad_text(field)
        for field in [details] + [card.at(*packed.path) for packed in DATASET_PACKED]
    )
    return Mapped(places, ~(bad_list(card.at("Subsets")) | no_text))


# ---- whole tables --------------------------------------------------------------


def flat_to_nested(
    cards: DataFrame, doc: str = "doc", into: str = "section", card_type: str = "card_type"
) -> DataFrame:
    """Add the nested section of flat cards; other card types keep their document."""
    kind, record = F.col(card_type), FLAT.record("flat")
    mapped = {"model": nested_model(record), "dataset": nested_dataset(record)}
    staged = FLAT.stage(cards, "flat", F.col(doc))
    built = FLAT.unstage(assemble(staged, into, mapped, kind), "flat")
    kept = F.when(kind.isin(*mapped), F.col(into)).otherwise(F.col(doc))
    return fence(built.withColumn(into, kept), into)


def nested_to_flat(
    cards: DataFrame, section: str = "section", into: str = "flat", card_type: str = "card_type"
) -> DataFrame:
    """Add the flat card of nested sections; NULL for other card types and where there is no section."""
    kind = F.when(F.col(backticked(section)).isNotNull(), F.col(card_type))
    record = NESTED.record("nested")
    mapped = {"model": flat_model(record), "dataset": flat_dataset(record)}
    staged = NESTED.stage(cards, "nested", F.col(section))
    return fence(NESTED.unstage(assemble(staged, into, mapped, kind), "nested"), into)


def pick_section(head: Record, card_type: Column) -> Column:
    """The section of a nested card, {} when its key is missing or falsy."""
    chosen = F
    for kind, key in SECTION_KEY.items():
        chosen = chosen.when((card_type == kind) & head.at(key).truthy, head.at(key).value)
    return chosen.otherwise(literal({}))


def mismatched(head: Record, card_type: Column, layout: Column) -> Column:
    """True where the format taken from the file name is not the layout of the content."""
    flat = any_of((card_type == k) & head.at(NAME_KEY[k]).truthy for k in NAME_KEY)
    nested = any_of((card_type == k) & head.at(SECTION_KEY[k]).truthy for k in SECTION_KEY)
    return F.when(layout == "txt", ~flat).otherwise(~nested)


def load_section(cards: DataFrame) -> DataFrame:
    """Add section, format_mismatch and convert_ok to classified, accepted cards."""
    kind, layout = F.col("card_type"), F.col("format")
    head, record = HEAD.record("head"), FLAT.record("flat")
    is_flat = layout == "txt"
    mapped = {"model": nested_model(record), "dataset": nested_dataset(record)}
    staged = FLAT.stage(cards, "flat", F.when(is_flat, F.col("doc")))
    converted = assemble(staged, "_converted", mapped, F.when(is_flat, kind))
    typed = HEAD.stage(FLAT.unstage(converted, "flat"), "head", F.col("doc"))
    section = (
        F.when(is_flat & kind.isin(*mapped), F.col("_converted"))
        .when(is_flat, F.col("doc"))
        .otherwise(pick_section(head, kind))
    )
    loaded = (
        typed.withColumn("format_mismatch", mismatched(head, kind, layout))
        .withColumn("section", section)
        .withColumn("convert_ok", F.col("section").isNotNull())
        .drop("_converted")
    )
    return fence(HEAD.unstage(loaded, "head"), "section", "format_mismatch", "convert_ok")


# Fixed value: release part of the schema name written into exported cards.
EXPORT_RELEASE = "2025-05"


def wrap_envelope(
    section: Column, card_type: Column, family: str, release: str = EXPORT_RELEASE
) -> Column:
    """Whole nested card around a section, NULL around none; family is the first part of the schema name."""

    def envelope(kind: str) -> Column:
        return as_object(
            {
                ("$schema",): F.lit(f"{family}-{kind}-{release}.json"),
                (SECTION_KEY[kind],): section,
            }
        )

    given = section.isNotNull()
    return F.when(given & (card_type == "model"), envelope("model")).when(
        given & (card_type == "dataset"), envelope("dataset")
    )
