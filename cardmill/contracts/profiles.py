"""The contracts cards are checked against.

declared_dataset   the published rules for a whole nested dataset card
form_dataset       the looser rules an entry form derives from them, for a section
legacy_model       the older rules for a model section
legacy_dataset     the older rules for a dataset section
"""

from __future__ import annotations

from cardmill.contracts import vocabularies as v
from cardmill.contracts.shapes import (
    Keys,
    Shape,
    choice,
    integer,
    listing,
    record,
    self_listing,
    text,
)

# Fixed value: release part of the schema name the declared contract asks for. It is
# older than the release written on export, so exported dataset cards break this rule.
DECLARED_RELEASE = "2025-03"

TEXT = text()
EMAIL = text(format="email")
URI = text(format="uri")
DAY = text(format="date")
COUNT = integer()

DAY_OR_YEAR = Shape(
    types=("string", "number"),
    condition=TEXT,
    then=Shape(format="date"),
    otherwise=Shape(minimum=1900, maximum=2100),
)


def texts(*names: str) -> dict[str, Shape]:
    return dict.fromkeys(names, TEXT)


PERSON = record(
    texts("Name")
    | {"Email": EMAIL}
    | texts("Address")
    | {"ORCID": text(pattern="https://orcid.org/.+", format="uri"), "URL": URI},
    required=("Name",),
)

ORGANIZATION = record(
    texts("Name", "Contact name") | {"Email": EMAIL} | texts("Address") | {"URL": URI},
    required=("Name",),
)

# No type of its own: anything but an object passes.
LICENSE = Shape(fields=texts("Text") | {"URL": URI}, closed=True, min_keys=1)

DATES = record(dict.fromkeys(("Created", "Published", "Updated"), DAY_OR_YEAR), min_keys=1)

REFERENCE = record(
    texts("Authors", "Title", "Source")
    | {"Year": integer(), "Date": DAY_OR_YEAR, "DOI": text(pattern=r"[0-9]+\.[0-9]+/.+")}
    | {"URL": URI, "PMID": integer()}
    | texts("PMCID", "Notes"),
    required=("Title",),
)

INDEXING = record(
    {
        "Content": listing(choice(*v.CONTENT_CODES), min_items=1, unique=True),
        "RadLex": listing(
            Shape(
                one_of=(
                    text(pattern="RID[0-9]+"),
                    record({}, keyed=((Keys("RID[0-9]+"), TEXT),)),
                )
            ),
            unique=True,
        ),
        "SNOMED": listing(TEXT, unique=True),
    }
)

IMAGING = record(
    {
        "Modality": listing(choice(*v.MODALITIES)),
        "Procedure": listing(
            record(
                texts("LOINC")
                | {"RadLex": text(min_length=5, max_length=10, pattern="RPID[0-9]+")}
                | texts("Name"),
                min_keys=1,
                max_keys=3,
            )
        ),
        "File format": listing(choice(*v.FILE_FORMATS)),
    }
    | texts("Resolution", "Pre-processing")
    | {"Burned-in PHI": choice(*v.BURNED_IN)},
    closed=False,
)

SIGNATURE = record(
    texts("ID", "Name") | {"Email": EMAIL} | texts("Authority") | {"Date": DAY},
    min_keys=3,
    required=("Authority", "Date"),
)

CARD = record(
    {"ID": integer(minimum=1), "URL": URI, "Submitted": SIGNATURE, "Approved": SIGNATURE}
)

AGE_BOUND = listing(
    choice(*v.AGE_UNITS), lead=(integer(minimum=0, maximum=240),), min_items=2, max_items=2
)


def subset() -> Shape:
    """A group of patients; its field Subset lists groups within it, down to any depth."""
    counts = ("Site count", "Patient count", "Exam count", "Series count", "Image count")
    group = record(
        dict.fromkeys(counts, COUNT)
        | {
            "Age range": listing(AGE_BOUND, min_items=2, max_items=2),
            "Sex": choice(*v.SEXES),
            "Demographic": choice(*v.DEMOGRAPHICS),
        }
        | texts("Criterion", "Comments")
        | {"Subset": listing()},
    )
    return self_listing(group, "Subset")


def dataset_section(one_subset: Shape, *, values_on_items: bool = False) -> Shape:
    """The declared dataset section.

    Two lists carry their allowed values on the list itself, which no list can ever
    meet. values_on_items moves them to the list items; it is off by default.
    """

    def value_list(values: tuple[str, ...]) -> Shape:
        return listing(choice(*values)) if values_on_items else listing(values=values)

    return record(
        texts("Name")
        | {
            "Indexing code": INDEXING,
            "Author": listing(PERSON, min_items=1),
            "Organization": listing(ORGANIZATION, min_items=1),
            "Date": DATES,
            "Repository": listing(URI, unique=True),
        }
        | texts("Version")
        # Each reference is declared as a list of references.
        | {"Reference": listing(listing(REFERENCE)), "License": LICENSE}
        | texts("Contact", "Funding", "Ethical review", "Comments")
        | {"Imaging": IMAGING}
        | texts(
            "Labeling",
            "Missing information",
            "Relationships between instances",
            "Noise",
            "External data",
            "Confidentiality",
            "Subpopulations",
            "Re-identification",
            "Sensitive data",
            "Collection process",
        )
        | {
            "Composition": record(
                texts("Confidentiality")
                | {"Data type": value_list(v.DATA_TYPES), "Number of instances": COUNT}
                | texts("Sample Size Calculation")
                | {
                    "Representativeness": record(
                        {"Sample type": value_list(v.SAMPLE_TYPES)}
                        | texts("Population", "Verification")
                    )
                },
                closed=False,
            ),
            "Motivation": record(texts("Purpose", "Team", "Funding", "Comments")),
        }
        | texts("Partioning scheme")
        | {
            "Partition": listing(
                record(
                    texts("Partition name") | {"Data": one_subset},
                    required=("Partition name", "Data"),
                )
            ),
            "Subsets": listing(one_subset),
        },
        required=("Name",),
    )


def declared_dataset(
    family: str,
    *,
    values_on_items: bool = False,
    release: str = DECLARED_RELEASE,
) -> Shape:
    """Rules for a whole nested dataset card; family starts the schema name."""
    return record(
        {
            "$schema": Shape(constant=f"{family}-dataset-{release}.json"),
            "Card": CARD,
            "Dataset": dataset_section(subset(), values_on_items=values_on_items),
        },
        required=("$schema", "Dataset"),
    )


# Fixed value: longer value lists may not repeat an item in the form rules.
LONG_VALUE_LIST = 5


def form_shape(shape: Shape) -> Shape:
    """Rules an entry form keeps of a shape: combined rules become plain text."""
    if shape.one_of or shape.condition is not None or shape.keyed:
        return TEXT
    if shape.loop is not None:
        inner, routes = shape.loop.members[shape.loop.entry]
        again = {steps[0]: listing(TEXT) if len(steps) > 1 else TEXT for steps, _ in routes}
        return form_shape(inner.with_(fields=inner.fields | again))
    if shape.types == ("array",) and shape.items is not None:
        long_list = len(shape.items.values) > LONG_VALUE_LIST
        return shape.with_(items=form_shape(shape.items), unique=shape.unique or long_list)
    if shape.types == ("object",):
        return shape.with_(fields={name: form_shape(s) for name, s in shape.fields.items()})
    return shape


def form_section(section: Shape) -> Shape:
    """Form rules of a section: its fields and required names only, open to others."""
    fields = {name: form_shape(shape) for name, shape in section.fields.items()}
    return record(fields, closed=False, required=section.required)


def form_dataset() -> Shape:
    """Form rules of the declared dataset section; a subset within a subset is a text."""
    return form_section(dataset_section(subset()))


# The rules a form falls back to when a schema cannot be used.
FALLBACK_SECTION = record({"Name": text(default="")}, closed=False, required=("Name",))


# ---- older contracts -----------------------------------------------------------

BLANK = text(default="")
BLANK_EMAIL = text(format="email", default="")
BLANK_URI = text(format="uri", default="")


def blanks(*names: str) -> dict[str, Shape]:
    return dict.fromkeys(names, BLANK)


def part(fields: dict[str, Shape], **rules: object) -> Shape:
    return record(fields, closed=False, **rules)


LEGACY_INDEXING = part({"Content": listing(choice(*v.LEGACY_CODES), min_items=1, unique=True)})
LEGACY_DATES = part(dict.fromkeys(("Created", "Published", "Updated"), DAY))
LEGACY_LICENSE = part(blanks("Text") | {"URL": BLANK_URI})


def legacy_authors(*more: str) -> Shape:
    person = part(blanks("Name") | {"Email": BLANK_EMAIL} | blanks("ORCID", *more))
    return listing(person, default=[{"Name": "", "Email": ""}])


def legacy_organizations(more: dict[str, Shape]) -> Shape:
    one = part(blanks("Name", "Contact name") | {"Email": BLANK_EMAIL} | more)
    return listing(one, default=[{"Name": ""}])


def legacy_model() -> Shape:
    return part(
        blanks("Name")
        | {
            "Indexing code": LEGACY_INDEXING,
            "Author": legacy_authors("Address"),
            "Organization": legacy_organizations(blanks("Address") | {"URL": BLANK_URI}),
            "Date": LEGACY_DATES,
        }
        | blanks("Version")
        | {
            "Repository": listing(URI),
            "Reference": listing(
                part(
                    blanks("Authors", "Title", "Source")
                    | {"Year": integer()}
                    | blanks("DOI")
                    | {"URL": BLANK_URI}
                )
            ),
            "License": LEGACY_LICENSE,
            "Contact": BLANK_EMAIL,
        }
        | blanks("Funding", "Comments", "Input", "Output")
        | {
            "Use": part(
                {
                    "Intended": listing(choice(*v.LEGACY_USES), unique=True),
                    "Out-of-scope": listing(TEXT),
                    "Excluded": listing(TEXT),
                }
            ),
            "User": part({"Intended": listing(choice(*v.LEGACY_USERS), unique=True)}),
            "Results": listing(
                part(
                    blanks("Result Information")
                    | {"Metric": listing(choice(*v.LEGACY_METRICS))}
                    | blanks("Value", "Decision Threshold", "Subset")
                )
            ),
        }
        | blanks("Limitations", "Ethical review"),
        required=("Name",),
    )


def legacy_dataset() -> Shape:
    return part(
        blanks("Name")
        | {
            "Indexing code": LEGACY_INDEXING,
            "Author": legacy_authors(),
            "Organization": legacy_organizations({}),
            "Date": LEGACY_DATES,
        }
        | blanks("Version")
        | {"License": LEGACY_LICENSE, "Contact": BLANK_EMAIL}
        | blanks("Funding", "Comments")
        | {
            "Composition": part(
                {
                    "Number of instances": COUNT,
                    "Data type": listing(choice(*v.LEGACY_DATA_TYPES), unique=True),
                }
            ),
            "Imaging": part(
                {
                    "Modality": listing(choice(*v.LEGACY_MODALITIES), unique=True),
                    "File format": listing(choice(*v.FILE_FORMATS)),
                }
                | blanks("Resolution")
            ),
        }
        | blanks("Collection process", "Labeling", "Ethical review", "Confidentiality"),
        required=("Name",),
    )
