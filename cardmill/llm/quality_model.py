"""A quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text's features are its words, pairs of words, the shapes of its words (runs of small letters, capitals and digits
shortened to one sign each, other bytes as they are), threes of shapes, and that three words stood earlier in the text.
Each is hashed to a place; a family's features share its weight, so a long text counts as much as a short one. Words
as they stand catch wording, shapes catch what never stood in a labelled text in the same form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import whole
from cardmill.llm.words import FACTORS, Words, mix, windows, within_text, words_of
from cardmill.operators.lookup import fits_broadcast

PLACES = 1 << 20
#: What the features of a family sum up to; the updates' rate fits it.
FAMILY_WEIGHT = 8.0
#: Bytes of text that are scored at once; a longer text is scored alone.
STRETCH = 1 << 20

#: The training sample: at most so many rows of each label, with texts of at most so many bytes.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 1 << 14
EPOCHS = 3
#: Follow the regularised leader: rate, its smoothing, and the weights of the two penalties.
RATE, SMOOTHING, SPARSE, RIDGE = 0.3, 1.0, 0.02, 0.05
#: The cut that parts the labels best is moved to this score.
CUT = 0.7
#: The cut is set on at least so many rows of each label.
LEAST_ROWS = 10
#: Scores are counted by their logit, from minus to plus so much, in so many bins for each unit.
BIN_REACH, BINS_A_UNIT = 12, 100


def shape_table() -> np.ndarray:
    """For each byte the sign of its kind: small letters and parts of longer characters, capitals, digits, itself."""
    table = np.arange(256, dtype=np.uint8)
    table[0x61:0x7B] = table[0x80:] = ord("a")
    table[0x41:0x5B] = ord("A")
    table[0x30:0x3A] = ord("0")
    return table


SHAPES = shape_table()


def shape_of(text: bytes) -> bytes:
    signs = SHAPES[np.frombuffer(text, dtype=np.uint8)]
    return signs[np.diff(signs, prepend=0 if not len(signs) else signs[0] ^ 1) != 0].tobytes()


@dataclass
class Model:
    weights: np.ndarray
    offset: float


def repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each three words in a text: does the same stand earlier in it; and the number of the text."""
    inside = within_text(words, 3)
    text = words.text[: len(inside)][inside]
    keys = mix(windows(words, 3)[inside] + text.astype(np.uint64) * FACTORS[5])
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again, text


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, number of the text and value of each occurrence of a feature."""
    words, shapes = words_of(texts), words_of([shape_of(t) for t in texts])
    places, owners, values = [], [], []
    for number, (of, width) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 3))):
        inside = within_text(of, width)
        keys = windows(of, width)[inside] + np.uint64(number)
        text = of.text[: len(inside)][inside]
        places.append(mix(keys) % np.uint64(PLACES - 2))
        owners.append(text)
        values.append(FAMILY_WEIGHT / np.bincount(text, minlength=len(texts))[text])
    again, text = repeats(words)
    places.append(PLACES - 2 + again.astype(np.uint64))
    owners.append(text)
    values.append(FAMILY_WEIGHT / np.bincount(text, minlength=len(texts))[text])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners), np.concatenate(values)


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """For each text the sparse dot product of its features with the weights."""
    out = np.zeros(len(texts))
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < STRETCH):
            size += len(texts[high])
            high += 1
        places, owner, value = features(texts[low:high])
        out[low:high] = np.bincount(owner, weights=model.weights[places] * value, minlength=high - low)
        low = high
    return out + model.offset


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 13) -> Model:
    """One update for each text: weights follow from the sums of gradients, and small ones are exactly 0."""
    if not len(texts) or labels.min() == labels.max():  # nothing to tell apart: one score for all
        return Model(np.zeros(PLACES), 4.0 if len(texts) and labels.max() else -4.0)
    rows = []
    for text in texts:
        places, _, value = features([text])
        distinct, at = np.unique(places, return_inverse=True)
        rows.append((np.append(distinct, PLACES), np.append(np.bincount(at, weights=value), 1.0)))
    leader, squares = np.zeros(PLACES + 1), np.zeros(PLACES + 1)  # the last place is the offset

    def weights(places) -> np.ndarray:
        z = leader[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - SPARSE, 0)
        return -shrunk / ((SMOOTHING + np.sqrt(squares[places])) / RATE + RIDGE)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            places, value = rows[i]
            now = weights(places)
            gradient = (1 / (1 + np.exp(-np.clip(now @ value, -30, 30))) - labels[i]) * value
            own = squares[places]
            leader[places] += gradient - (np.sqrt(own + gradient**2) - np.sqrt(own)) / RATE * now
            squares[places] = own + gradient**2
    final = weights(np.arange(PLACES + 1))
    return Model(final[:-1].astype(np.float32), float(final[-1]))


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def usable_labels(labels: DataFrame) -> DataFrame:
    """(_id, quality, _order): labelled rows that may be learned from; _order is their place in the sample."""
    told = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    told = told.filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id"))
    return told.distinct().withColumn("_order", F.xxhash64("_id", F.lit(13)))


def training_rows(docs: DataFrame, usable: DataFrame, rows: int) -> list:
    """At most `rows` rows of each label by _order, with texts of at most SAMPLE_BYTES; all that the driver sees."""
    counts = {x["quality"]: x["count"] for x in usable.groupBy("quality").count().collect()}
    drawn = []
    for y in (0, 1):
        # Twice the wanted rows, as long texts go. A bound on the hash keeps the sort from growing with the table.
        share = min(1.0, 4 * rows / max(1, counts.get(y, 0)))
        early = F.col("_order") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
        drawn.append(usable.filter((F.col("quality") == y) & early).orderBy("_order", "_id").limit(2 * rows))
    short = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(drawn[0].union(drawn[1])), "_id")
    parts = [short.filter(F.col("quality") == y).orderBy("_order", "_id").limit(rows) for y in (0, 1)]
    return sorted(parts[0].union(parts[1]).select("_id", "_order", "text", "quality").collect(), key=lambda r: (r["_order"], r["_id"]))


def score_counts(docs: DataFrame, usable: DataFrame, model: Model, learned: list) -> pa.Table:
    """(quality, bin, n): how many labelled rows, whose texts were not learned from, have which logit; whole tables."""
    seen = docs.sparkSession.createDataFrame([(i,) for i in learned], T.StructType([T.StructField("_id", docs.schema["_id"].dataType)]))
    fresh = usable.join(F.broadcast(seen), "_id", "left_anti").select("_id", "quality")
    place = F.floor((F.col("_logit") + BIN_REACH) * BINS_A_UNIT)
    own = F.least(F.greatest(place, F.lit(0)), F.lit(2 * BIN_REACH * BINS_A_UNIT - 1)).cast("int")
    if fits_broadcast(fresh):  # only labelled texts are scored
        told = with_logits(docs.join(F.broadcast(fresh), "_id"), model, "text")
    else:  # scored before the join, so that no text is shuffled
        told = with_logits(docs, model, "text").select("_id", "_logit").join(fresh, "_id")
    return told.groupBy("quality", own.alias("bin")).agg(F.count("*").alias("n")).toArrow()


def best_cut(counts: pa.Table) -> float:
    """The logit at which the shares of rows on the right side, of both labels, add up to most; 0 with too few rows."""
    sums = np.zeros((2, 2 * BIN_REACH * BINS_A_UNIT))
    for label, place, n in zip(*(counts[name].to_numpy() for name in ("quality", "bin", "n")), strict=True):
        sums[label, place] += n
    if sums.sum(axis=1).min() < LEAST_ROWS:
        return 0.0
    below = np.cumsum(sums, axis=1) / sums.sum(axis=1, keepdims=True)
    right = np.concatenate([[0], below[0] - below[1]])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS_A_UNIT - BIN_REACH)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on a bounded sample of labelled rows; move the cut that parts all other labelled rows best to CUT.

    Rows whose id is held out, is NULL or has no label of 0 or 1 are never learned from. An id with both labels counts
    as one row of each.
    """
    own = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("text"))
    usable = usable_labels(labels)
    rows = training_rows(own, usable, SAMPLE_ROWS)
    model = train([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], dtype=np.int64))
    cut_at = best_cut(score_counts(own, usable, model, sorted({r["_id"] for r in rows})))
    model.offset += float(np.log(CUT / (1 - CUT))) - cut_at
    return model


def with_logits(docs: DataFrame, model: Model, text: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the data

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [logits(held.value, [(t.as_py() or "").encode() for t in texts[a : a + 256]]) for a in range(0, len(texts), 256)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.withColumn("_logit", score(whole(text)))


def score_quality(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with _quality (0 to 1, higher: better) behind its own columns.

    The score comes from the whole text alone; equal texts have equal scores. A NULL or empty text has no features and
    gets the score of no evidence. Rows with equal ids, or none, are scored each on their own.
    """
    scored = with_logits(docs, model, text)
    return scored.withColumn("_quality", 1 / (1 + F.exp(-F.col("_logit")))).drop("_logit")
