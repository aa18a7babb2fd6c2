"""Quality rules: counts inside each text, and lines that too many documents of a host share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import cut, join_heavy, whole
from cardmill.llm.words import covered, windows, within_text, words_of

SEPARATORS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
DIGITS = re.compile(rb"[0-9]")

STATS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [
        T.StructField(
            "lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())]))
        )
    ]
)
ARROW_STATS = pa.struct(
    [pa.field(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [pa.field("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
)


def normalised(line: bytes) -> bytes:
    """A line as it is counted across documents: lower-case A-Z, single spaces, every digit as 0."""
    return DIGITS.sub(b"0", b" ".join(line.translate(LOWER).split()))


def repeated_words(texts: list[bytes], width: int) -> np.ndarray:
    """For each text, how many of its words lie in windows of `width` words that it holds twice or more."""
    words = words_of(texts)
    begins = np.flatnonzero(within_text(words, width))
    keys, owner = windows(words, width)[begins], words.text[begins]
    order = np.lexsort((keys, owner))
    same = (np.diff(keys[order]) == 0) & (np.diff(owner[order]) == 0)
    twice = np.zeros(len(order), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    marks = np.concatenate([[0], np.cumsum(covered(begins[twice], width, len(words.hashes)))])
    return marks[words.first[1:]] - marks[words.first[:-1]]


def text_stats(text: bytes) -> dict:
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        count = len(line.split())
        if not count:
            continue
        if line in seen:
            repeated += 1
        seen.add(line)
        number = xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)
        lines[number] = lines.get(number, 0) + count
    letters = text.translate(None, SEPARATORS)
    return {
        "n_words": sum(lines.values()),
        "word_chars": len(letters.decode()),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": repeated,
        "lines": [{"line": line, "words": words} for line, words in lines.items()],
    }


@F.arrow_udf(STATS)
def line_and_word_counts(texts: pa.Array) -> pa.Array:
    """The counts of each text, and each different normalised line with the words it has there in all."""
    rows: list[dict] = []
    for at in range(0, len(texts), 512):
        part = [(t.as_py() or "").encode() for t in texts[at : at + 512]]
        repeats = repeated_words(part, 8)
        rows += [text_stats(t) | {"n_repeat_words": int(n)} for t, n in zip(part, repeats, strict=True)]
    return pa.array(rows, ARROW_STATS)


def quality_rules(
    docs: DataFrame,
    limit: int = 50,
    min_words: int = 20,
    min_kept: float = 0.5,
    *,
    count_copies: bool = True,
    first_keeps: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Base counts and base_failed of each row, and a verdict by lines that are frequent at the row's host.

    A line (normalised) that more than `limit` distinct documents of a host have is removed from all of them. A
    document is depleted if fewer than `min_words` words, or less than `min_kept` of its words, are left. kept is
    false if base_failed or depleted. A document is an id with a text, so a repeated row counts once and exact copies
    under several ids count each; rows without an id are documents of their own. With `count_copies=False` the copies
    of a text at a host count as one document, with `first_keeps=True` the document with the least id (and its
    copies) keeps the line.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_frequent_words.
    A NULL text is empty (no words, so base_failed); a NULL host is a host of its own; rows without an id come after
    all others; repeated rows stay. Extra columns are dropped.

    Copies are grouped first, counts are summed before they are shuffled, and only lines above the limit go back to
    the documents; those that very many documents have are looked up from a copy in each task.
    """
    told = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(host), F.col(host).isNull()).alias("host"),
        F.struct(F.xxhash64(F.lit(1), whole(text)), F.xxhash64(F.lit(2), whole(text))).alias("copy"),
        line_and_word_counts(whole(text)).alias("stats"),
    )
    rows = cut(told)
    texts = rows.groupBy("host", "copy").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("stats.lines").alias("lines")
    )
    if count_copies:
        known_ids = rows.filter(F.col("doc_id").isNotNull()).select("host", "copy", "doc_id").distinct()
        ids = known_ids.groupBy("host", "copy").agg(F.count("*").alias("ids"))
        no_id = rows.filter(F.col("doc_id").isNull()).groupBy("host", "copy").agg(F.count("*").alias("ids"))
        weights = ids.unionByName(no_id).groupBy("host", "copy").agg(F.sum("ids").alias("documents"))
        texts = texts.join(weights, ["host", "copy"])
    else:
        texts = texts.withColumn("documents", F.lit(1))
    texts = cut(texts)
    lines = texts.select("host", "copy", "least", "documents", F.explode("lines").alias("l")).select(
        "host", "copy", "documents", "l.line", "l.words", F.struct(F.col("least").isNull(), "least", "copy").alias("order")
    )
    counted = lines.groupBy("host", "line").agg(
        F.count("*").alias("_count"), F.sum("documents").alias("documents"), F.min("order").alias("first")
    )
    frequent = cut(counted.filter(F.col("documents") > limit).drop("documents"))
    gone = join_heavy(lines, frequent, ["host", "line"])
    if first_keeps:
        gone = gone.filter(F.col("copy") != F.col("first.copy"))
    gone = gone.groupBy("host", "copy").agg(F.sum("words").alias("removed"))
    removed = texts.join(gone, ["host", "copy"], "left").select(
        "host", "copy", F.coalesce("removed", F.lit(0)).alias("n_frequent_words"), F.col("rows").alias("_count")
    )
    known = join_heavy(rows.select("doc_id", "host", "copy", "stats"), cut(removed), ["host", "copy"])
    n_words, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (n_words < min_words) | (100 * repeated > 30 * n_words)
    left = n_words - F.col("n_frequent_words")
    depleted = (left < min_words) | (left < F.lit(min_kept) * n_words)
    return known.select(
        "doc_id",
        *[F.col(f"stats.{name}").alias(name) for name in STATS.names[:5]],
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        "n_frequent_words",
    )
