"""Classify, convert, validate and export corpora of documentation cards with Spark."""

from cardmill.contracts.profiles import (
    declared_dataset,
    form_dataset,
    legacy_dataset,
    legacy_model,
)
from cardmill.contracts.schema_documents import shape_from_document
from cardmill.operators.classify import classify, split_rejects
from cardmill.operators.convert import (
    flat_to_nested,
    load_section,
    nested_to_flat,
    wrap_envelope,
)
from cardmill.operators.registry import check_registry, resolve_schema
from cardmill.operators.reports import intake_summary, violation_summary
from cardmill.operators.validate import validate, with_report
from cardmill.sinks.exports import export_flat, export_nested, preview_json
from cardmill.sources.cards import cards_from_table, read_cards
from cardmill.streaming.landing import land_cards, landed_cards
from cardmill.streaming.stream import (
    card_stream,
    check_stream_by_registry,
    read_summary,
    write_card_stream,
    write_summary_stream,
)

__all__ = [
    "card_stream",
    "cards_from_table",
    "check_registry",
    "check_stream_by_registry",
    "classify",
    "declared_dataset",
    "export_flat",
    "export_nested",
    "flat_to_nested",
    "form_dataset",
    "intake_summary",
    "land_cards",
    "landed_cards",
    "legacy_dataset",
    "legacy_model",
    "load_section",
    "nested_to_flat",
    "preview_json",
    "read_cards",
    "read_summary",
    "resolve_schema",
    "shape_from_document",
    "split_rejects",
    "validate",
    "violation_summary",
    "with_report",
    "wrap_envelope",
    "write_card_stream",
    "write_summary_stream",
]
