"""Terms of many texts at once: cut and numbered by Arrow, counted in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def term_table(digits: bool) -> bytes:
    """For each byte what stands for it: A-Z become small, what is no letter, wanted digit or part of a longer
    character becomes a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for small in range(0x61, 0x7B):
        table[small] = table[small - 32] = small
    if digits:
        table[0x30:0x3A] = b"0123456789"
    return bytes(table)


WORDS_AND_NUMBERS, LETTERS = term_table(True), term_table(False)


@dataclass
class Counted:
    """How often each term occurs in each text: one entry for each text and term in it, by text."""

    vocabulary: pa.Array
    text: np.ndarray
    term: np.ndarray
    count: np.ndarray
    #: For each text the number of its terms, with repeats.
    total: np.ndarray


def count_terms(texts: pa.Array, table: bytes) -> Counted:
    """Terms are the longest runs of bytes that `table` keeps; a NULL text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    data = (data.to_pybytes() if data else b"").translate(table)
    plain = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data)) if len(texts) else texts
    cut = pc.ascii_split_whitespace(plain)
    encoded = cut.flatten().dictionary_encode()
    size = max(1, len(encoded.dictionary))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    term = encoded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(encoded.dictionary, pa.scalar("")).as_py()
    if blank >= 0:  # before a text's first and behind its last term
        text, term = text[term != blank], term[term != blank]
    keys, count = np.unique(text * size + term, return_counts=True)
    return Counted(encoded.dictionary, keys // size, keys % size, count, np.bincount(text, minlength=len(texts)))


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `size` bytes of text at most, at least one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
