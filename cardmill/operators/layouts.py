"""Field tables of the flat and the nested layout, used in both directions."""

from __future__ import annotations

from dataclasses import dataclass

Path = tuple[str, ...]


@dataclass(frozen=True)
class Packed:
    """A nested text that carries several flat fields as paragraphs.

    Unlabelled fields come first; of these only the first can be read back.
    """

    path: Path
    lead: tuple[str, ...]
    labelled: tuple[tuple[str, str], ...]


# Field names, labels and defaults of the two layouts.

# (flat field, nested place, default)
MODEL_FIELDS = (
    ("model_name", ("Name",), ""),
    ("content_code", ("Indexing code", "Content"), []),
    ("date_created", ("Date", "Created"), ""),
    ("license", ("License", "Text"), ""),
    ("funding", ("Funding",), ""),
    ("use_case", ("Use", "Intended"), []),
    ("users", ("User", "Intended"), []),
    ("caveats", ("Limitations",), ""),
)

MODEL_COMMENTS = Packed(
    ("Comments",),
    ("medical_task", "model_architecture"),
    (
        ("Code Availability", "model_code_availability"),
        ("Sustainability", "sustainability"),
        ("Training Time", "time_to_train"),
        ("Inference Time", "time_to_inference"),
        ("Hardware", "hardware_requirements"),
    ),
)

TECHNICAL_KEY = "Technical Details"
# (flat field, key below TECHNICAL_KEY)
TECHNICAL_FIELDS = (
    ("model_code_availability", "Code Availability"),
    ("sustainability", "Sustainability"),
    ("time_to_train", "Training Time"),
    ("time_to_inference", "Inference Time"),
    ("hardware_requirements", "Hardware Requirements"),
)
NOT_AVAILABLE = "NA"

# (flat field, nested key) of one result
RESULT_FIELDS = (
    ("result_value", "Value"),
    ("result_decision_threshold", "Decision Threshold"),
    ("result_subset_data", "Subset"),
)

DATASET_FIELDS = (
    ("dataset_name", ("Name",), ""),
    ("file_format", ("Imaging", "File format"), ["DICOM"]),
    ("resolution", ("Imaging", "Resolution"), ""),
    ("burned_in_phi", ("Imaging", "Burned-in PHI"), "Unknown"),
    ("subpopulations", ("Composition", "Representativeness", "Population"), ""),
    ("verification", ("Composition", "Representativeness", "Verification"), ""),
    ("dataset_license", ("License", "Text"), "Not specified"),
)

DATASET_PACKED = (
    Packed(
        ("Collection process",),
        ("collection_process",),
        (("Composition", "composition"), ("Partitioning", "partioning_scheme")),
    ),
    Packed(
        ("Labeling",),
        ("labeling",),
        (
            ("Missing Information", "missing_information"),
            ("Noise Issues", "noise"),
            ("Instance Relationships", "relationships_between_instances"),
        ),
    ),
    Packed(
        ("Confidentiality",),
        ("confidentiality",),
        (("Re-identification", "re_identification"),),
    ),
    Packed(
        ("Comments",),
        (),
        (
            ("Motivation", "motivation"),
            ("Purpose", "purpose"),
            ("External Data", "external_data"),
            ("Availability", "dataset_availability"),
        ),
    ),
)

DATA_TYPES = ["Image"]
DETAIL_SEPARATOR = "; "
NO_DETAILS = ["Image data"]

# (flat field, nested key, default going in, default coming back)
SUBSET_FIELDS = (
    ("subset_name", "Subset name", "", ""),
    ("subset_description", "Subset description", "", ""),
    ("site_count", "Site count", "", "1"),
    ("age", "Age", "Not specified", "Not specified"),
    ("sex", "Sex", "Not specified", "Not specified"),
    ("demographic", "Demographic", "", ""),
    ("criterion", "Criterion", "", ""),
)

# (words looked for in letter case as given, content code)
CODE_WORDS = (
    (("CT", "computed tomography"), "CT - Computed Tomography"),
    (("MRI", "magnetic resonance"), "MR - Magnetic Resonance"),
)
OTHER_CODE = "OT - Other"
