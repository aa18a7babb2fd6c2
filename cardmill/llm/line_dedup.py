"""Repeated runs of lines, found by winnowing over line hashes; later ones are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import cut, join_heavy, mix, small_batches, small_transfers, stored, whole
from cardmill.llm.words import FACTORS, OTHER_FACTORS

WINDOWS = "doc_id long, copy long, at int, lines int, mark long, mark_at int, low long, high long"
WINDOWS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("lines", pa.int32()), ("mark", pa.int64())]
    + [("mark_at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]
)


def lines_of(text: bytes) -> list[bytes]:
    """The lines that have a word, without white space at their ends."""
    return [line for part in text.split(b"\n") if (line := part.strip())]


def line_windows(text: bytes, width: int) -> tuple[np.ndarray, ...] | None:
    """For each run of `width` lines: its selected line hash and that line's number, and 128 bits of the run itself.

    The selected hash is the least of the window, the last one of equal ones, so every run of `width` lines that two
    texts share selects the same fingerprint in both.
    """
    lines = lines_of(text)
    count = len(lines) - width + 1
    if count < 1:
        return None
    hashes = mix(np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)))
    low, high = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    for j in range(width):
        low += hashes[j : j + count] * FACTORS[j % 64]
        high += hashes[j : j + count] * OTHER_FACTORS[j % 64] + np.uint64(j)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    place = np.arange(count) + width - 1 - views.argmin(axis=1)
    return hashes[place].view(np.int64), place, mix(low).view(np.int64), mix(high).view(np.int64)


def runs_of(text: bytes, width: int, least_words: int | None) -> tuple[np.ndarray, ...] | None:
    """All runs that count: number of the first line, number of lines, and what `line_windows` tells.

    These are the runs of `width` lines, and shorter ones that hold at least `least_words` words, if that is given.
    Runs of another length select other fingerprints, so they only meet their like.
    """
    made: list[tuple[np.ndarray, ...]] = []
    if least_words is not None:
        words = np.cumsum([0, *(len(line.split()) for line in lines_of(text))])
    for lines in range(width if least_words is None else 1, width + 1):
        told = line_windows(text, lines)
        if told is None:
            continue
        mark, place, low, high = told
        at = np.arange(len(mark))
        if lines < width:
            at = np.flatnonzero(words[lines:] - words[:-lines] >= least_words)
            mark = mix(mark.view(np.uint64) + np.uint64(lines)).view(np.int64)
        made.append((at, np.full(len(at), lines), mark[at], place[at], low[at], high[at]))
    return tuple(np.concatenate(c) for c in zip(*made, strict=True)) if made else None


def winnowed(docs: DataFrame, width: int, least_words: int | None) -> DataFrame:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            parts: list[list[np.ndarray]] = []
            ids: list = []
            for number, copy, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                made = runs_of(text.encode(), width, least_words)
                if made is not None:
                    parts.append([np.full(len(made[0]), copy), *made])
                    ids += [number] * len(made[0])
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([ids, *columns], WINDOWS_ARROW.types, strict=True)],
                    schema=WINDOWS_ARROW,
                )

    return docs.mapInArrow(windows, WINDOWS)


def without_lines(texts: pa.Array, runs: pa.Array) -> list[str | None]:
    out = []
    for text, own in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
        if not own:
            out.append(text)
            continue
        gone = {line for run in own for line in range(run["at"], run["at"] + run["lines"])}
        kept, number = [], 0
        for line in text.split("\n"):
            if line.encode().strip():
                if number not in gone:
                    kept.append(line)
                number += 1
            else:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def repeated_runs(
    docs: DataFrame, width: int = 3, least_words: int | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, copy, runs): the runs of `width` lines of each text that occur earlier, as the number of their first
    line and of their lines; also shorter ones of at least `least_words` words, if that is given.

    Earlier is a smaller doc_id, or further up in the same text without overlap. `copy` is a hash of the text, so
    that rows with one id but different texts are told apart; among them the smaller hash comes first. Lines are
    compared without white space at their ends, and lines without a word are passed over.
    """
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole(text), F.lit(2)).alias("copy"), whole(text).alias("text")
    )
    # Repeated rows stay here and fall together at the end, which saves a shuffle of all windows.
    found = stored(winnowed(keyed, width, least_words), "line-windows")
    # A fingerprint that stands at one place only, even if in repeated rows, is no copy of anything.
    ends = [end(c).alias(f"{name}_{c}") for c in ("doc_id", "copy", "mark_at") for name, end in (("least", F.min), ("most", F.max))]
    marks = found.groupBy("mark").agg(F.count("*").alias("_count"), F.count("doc_id").alias("named"), *ends)
    marks = marks.filter(
        "least_doc_id <> most_doc_id or least_copy <> most_copy or least_mark_at <> most_mark_at or named between 1 and _count - 1"
    )
    alive = join_heavy(found, cut(marks.select("mark", "_count")), ["mark"])
    alive = cut(alive.select("doc_id", "copy", "at", "lines", "low", "high"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy", "at")
    firsts = alive.groupBy("lines", "low", "high").agg(F.count("*").alias("_count"), F.min(place).alias("first")).filter("_count > 1")
    later = join_heavy(alive, cut(firsts), ["lines", "low", "high"])
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    later = later.filter(~same_text | (F.col("at") >= F.col("first.at") + F.col("lines")))
    return later.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set(F.struct("at", "lines"))).alias("runs"))


def remove_repeated_runs(
    docs: DataFrame, width: int = 3, least_words: int | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with all its columns, its text without lines in a run of `width` or more lines that occurs earlier.

    Where `least_words` is given, a run of fewer lines counts too if it holds at least so many words.

    Runs are judged on the input, not on what is left. A text of which nothing repeats is returned unchanged, NULL as
    NULL; other texts keep their other lines, blank ones too, and may end up empty. Repeated rows keep each other's
    text (they are one document). A line that stands many times in a text keeps its first `width`.

    Fingerprints (window minima) that occur once end there. The others' windows are compared in full; overlapping
    repeated windows make up the maximal runs. Frequent lines cost one row a place and are never listed in pairs.
    """
    small_transfers(docs.sparkSession)
    runs = repeated_runs(docs, width, least_words, doc_id=doc_id, text=text)
    columns = docs.columns
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(doc_id).cast("long").alias("_id"),
        F.xxhash64(whole(text), F.lit(2)).alias("_copy"),
    )
    runs = runs.select(F.col("doc_id").alias("_run_id"), F.col("copy").alias("_run_copy"), "runs")
    # The runs are looked up by hash, so that no text is sorted.
    same = F.col("_id").eqNullSafe(F.col("_run_id")) & (F.col("_copy") == F.col("_run_copy"))
    matched = row.join(runs.hint("shuffle_hash"), same, "left")

    @F.arrow_udf(T.StringType())
    def kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array(without_lines(texts, runs), pa.string())

    # Only a text that loses lines goes to Python.
    before, repeats = F.col("_row")[text], F.col("runs").isNotNull()
    changed = F.when(repeats, kept(F.when(repeats, before), F.col("runs"))).otherwise(before)
    return matched.select(*[(changed if c == text else F.col("_row")[c]).alias(c) for c in columns])
