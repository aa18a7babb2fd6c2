import json

import cardmill

MODEL = {
    "model_name": "Reader",
    "content_code": ["CT - Computed Tomography"],
    "medical_task": "Find things",
    "date_created": "2020-01-02",
    "license": "Own",
    "funding": "None",
    "use_case": ["Detection"],
    "users": ["Researcher"],
    "results": [
        {"result_name": "first", "result_metric": "AUC", "result_value": "0.8",
         "result_decision_threshold": "NA", "result_description": "described",
         "result_subset_data": "all"},
        {"result_name": "second", "result_metric": ["AUC", "F1"], "result_value": "0.9"},
    ],
    "caveats": "few cases",
    "model_code_availability": "NA", "sustainability": "NA", "time_to_train": "NA",
    "time_to_inference": "NA", "hardware_requirements": "NA",
    "model_architecture": "A net",
}

DATASET = {
    "dataset_name": "Knees", "imaging_details": ["CT slices", "then MRI"], "file_format": ["DICOM"],
    "resolution": "half a mm", "burned_in_phi": "a stamp", "labeling": "twice", "missing_information": "weights",
    "relationships_between_instances": "left and right", "noise": "motion", "external_data": "a map",
    "confidentiality": "names cut", "subpopulations": "runners", "re_identification": "by gait",
    "collection_process": "walk-in", "composition": "joints", "number_of_instances": "17",
    "representativeness": "one town", "verification": "by a second", "motivation": "pain",
    "purpose": "counting", "partioning_scheme": "by side",
    "partitions": [
        {"subset_name": "L", "subset_description": "left ones", "site_count": "3",
         "patient_count": "8", "number_instances": "9", "age": "adult", "sex": "Male",
         "demographic": "mixed", "criterion": "walks"},
        {"subset_name": "R", "patient_count": "4"},
    ],
    "dataset_availability": "by post", "dataset_license": "house rules",
}


def values(cards, column):
    return [json.loads(r[0]) for r in cards.selectExpr(f"to_json({column})").collect()]


def nested(cards_of, *cards):
    rows = [("c.txt", json.dumps(card)) for card in cards]
    return cardmill.load_section(cardmill.classify(cards_of(*rows)))


def test_model_to_nested(cards_of):
    (section,) = values(nested(cards_of, MODEL), "section")
    assert section["Comments"].split("\n\n") == [
        "Find things", "A net", "Code Availability: NA", "Sustainability: NA",
        "Training Time: NA", "Inference Time: NA", "Hardware: NA",
    ]
    assert "Technical Details" not in section
    assert section["Input"] == section["Output"] == "A net"
    assert [r["Result Information"] for r in section["Results"]] == ["described", "second"]
    assert [r["Metric"] for r in section["Results"]] == [["AUC"], ["AUC", "F1"]]
    assert section["Results"][1]["Subset"] == ""


def test_model_technical_details(cards_of):
    cards = nested(
        cards_of, MODEL | {"time_to_train": "3 h", "sustainability": ""}, {"model_name": "bare"}
    )
    full, bare = values(cards, "section")
    assert full["Technical Details"] == {
        "Code Availability": "NA", "Sustainability": "NA", "Training Time": "3 h",
        "Inference Time": "NA", "Hardware Requirements": "NA",
    }
    assert bare == {
        "Name": "bare", "Indexing code": {"Content": []}, "Date": {"Created": ""},
        "License": {"Text": ""}, "Funding": "", "Comments": "", "Input": "", "Output": "",
        "Use": {"Intended": []}, "User": {"Intended": []}, "Results": [], "Limitations": "",
    }


def test_model_round_trip(cards_of):
    (flat,) = values(cardmill.nested_to_flat(nested(cards_of, MODEL)), "flat")
    want = json.loads(json.dumps(MODEL))
    want["results"][0]["result_name"] = "described"
    want["results"][1] |= {
        "result_description": "second", "result_metric": "AUC",
        "result_decision_threshold": "", "result_subset_data": "",
    }
    assert flat == want


def test_dataset_to_nested(cards_of):
    (section,) = values(nested(cards_of, DATASET), "section")
    assert section["Indexing code"]["Content"] == [
        "CT - Computed Tomography",
        "MR - Magnetic Resonance",
    ]
    assert section["Imaging"]["Pre-processing"] == "CT slices; then MRI"
    assert section["Composition"]["Number of instances"] == 17
    assert section["Collection process"] == "walk-in\n\nComposition: joints\n\nPartitioning: by side"
    assert section["Ethical review"] == "names cut"
    assert section["Subsets"][1] == {
        "Subset name": "R", "Subset description": "", "Number of instances": "4",
        "Site count": "", "Patient count": "4", "Age": "Not specified",
        "Sex": "Not specified", "Demographic": "", "Criterion": "",
    }


def test_dataset_round_trip(cards_of):
    (flat,) = values(cardmill.nested_to_flat(nested(cards_of, DATASET)), "flat")
    want = json.loads(json.dumps(DATASET)) | {"number_of_instances": 17}
    want["partitions"][1] |= {
        "subset_description": "", "site_count": "1", "number_instances": "4",
        "age": "Not specified", "sex": "Not specified", "demographic": "", "criterion": "",
    }
    assert flat == want


def test_dataset_edges(cards_of):
    cards = [
        {"dataset_name": "d", "file_format": [], "number_of_instances": "abc"},
        {"dataset_name": "d", "imaging_details": "ct scan", "number_of_instances": "1,250"},
        {"dataset_name": "d", "imaging_details": "MRI and CT", "number_of_instances": 12.7},
        {"dataset_name": "d", "noise": "hum", "partitions": []},
    ]
    found = values(nested(cards_of, *cards), "section")
    assert [s["Imaging"]["File format"] for s in found[:2]] == [[], ["DICOM"]]
    assert [s["Composition"]["Number of instances"] for s in found] == [None, 1, 12, 0]
    assert [s["Indexing code"]["Content"] for s in found[1:3]] == [
        ["OT - Other"],
        ["CT - Computed Tomography", "MR - Magnetic Resonance"],
    ]
    assert "Subsets" not in found[3]
    flat = values(cardmill.nested_to_flat(nested(cards_of, cards[3])), "flat")[0]
    assert (flat["labeling"], flat["noise"]) == ("Noise Issues: hum", "hum")


def test_empty_metric_list_is_left_out(cards_of):
    raw = {"Model": {"Results": [{"Metric": []}, {"Metric": [None]}, {"Metric": "AUC"}, 5]}}
    cards = cardmill.load_section(cardmill.classify(cards_of(("c.json", json.dumps(raw)))))
    (flat,) = values(cardmill.nested_to_flat(cards), "flat")
    assert "result_metric" not in flat["results"][0]
    assert [r["result_metric"] for r in flat["results"][1:]] == [None, "AUC", ""]


def test_cards_that_cannot_be_mapped(cards_of):
    cards = nested(
        cards_of,
        {"model_name": "m", "results": "none"},
        {"model_name": "m", "results": [None]},
        {"dataset_name": "d", "imaging_details": 5},
        {"model_name": "m", "results": 0},
    )
    assert [r.convert_ok for r in cards.collect()] == [False, False, False, True]


def test_mismatched_layouts_are_flagged(cards_of):
    cards = cards_of(
        ("a.txt", '{"Model": {"Name": "m"}}'),
        ("a.json", '{"model_name": "m"}'),
        ("a.json", '{"Model": {"Name": "m"}}'),
    )
    loaded = cardmill.load_section(cardmill.classify(cards))
    assert [r.format_mismatch for r in loaded.collect()] == [True, True, False]
    names = [section.get("Name") for section in values(loaded, "section")]
    assert names == ["", None, "m"]
