"""A small convolutional text classifier, trained in numpy on a bounded sample and applied to every whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import small_transfers, whole
from cardmill.llm.words import words_of

#: Every byte but letters, digits and those of longer characters parts words here, so punctuation doesn't stick.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A word's embedding is the sum of three hashed rows: the whole word, its first four and its first five bytes.
PREFIXES = (4, 5)
BUCKETS = 1 << 18
DIMENSION = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Words that are convolved at once; a longer text is read in overlapping stretches and the largest response counts.
STRETCH = 1 << 16

#: The training sample: at most so many rows of each label, with texts of at most so many bytes.
SAMPLE_ROWS = 1600
SAMPLE_BYTES = 1 << 15
EPOCHS = 8
UNTOUCHED = np.float32(1e-2)
BATCH = 32
DROPPED = 0.3
#: A threshold is set on at least so many rows of each label.
LEAST_ROWS = 10
#: Scores are counted by their logit, from minus to plus so much, in so many bins for each unit.
BIN_REACH = 10
BINS_A_UNIT = 100


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dimension; the last row is padding and stays zero
    filters: list[np.ndarray]  # for each width: width x dimension x filters
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all words (three each) and where each text begins; each text ends in padding words."""
    words = words_of(texts, lower=True, gap=GAP, prefixes=PREFIXES)
    pad = max(WIDTHS)
    counts = np.diff(words.first) + pad
    starts = np.cumsum([0, *counts])
    out = np.full((starts[-1], 1 + len(PREFIXES)), BUCKETS, dtype=np.int32)
    at = np.arange(len(words.hashes)) + pad * words.text
    for i, hashes in enumerate((words.hashes, *words.prefixes)):
        out[at, i] = hashes % np.uint64(BUCKETS)
    return out, starts


def responses(model: Model, rows: np.ndarray) -> list[np.ndarray]:
    """What each filter gives at each word; the input ends in padding, so the last windows are cut off."""
    inputs = model.embedding[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        inputs = inputs + model.embedding[rows[:, i]]
    count = len(rows) - max(WIDTHS) + 1
    return [
        sum(inputs[j : j + count] @ kernel[j] for j in range(width)) + bias
        for width, kernel, bias in zip(WIDTHS, model.filters, model.bias, strict=True)
    ]


def pooled(model: Model, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text, at least zero.

    Windows on the last padding words of a text reach into the next one, so they don't count, as in training.
    """
    found = responses(model, rows)
    for r in found:
        for back in range(1, max(WIDTHS)):
            r[starts[1:-1] - back] = 0
    return np.maximum(np.concatenate([np.maximum.reduceat(r, starts[:-1]) for r in found], axis=1), 0)


def long_pooled(model: Model, rows: np.ndarray) -> np.ndarray:
    """The same for one long text, a stretch at a time."""
    pad = max(WIDTHS)
    best = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
    for at in range(0, max(1, len(rows) - pad + 1), STRETCH):
        part = rows[at : at + STRETCH + pad - 1]
        best = np.maximum(best, pooled(model, part, np.array([0, len(part)]))[0])
    return best


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """A probability for each text."""
    out = np.zeros(len(texts))
    low = 0
    while low < len(texts):  # as many texts as make up a stretch, at least one
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < 4 * STRETCH):
            size += len(texts[high])
            high += 1
        rows, starts = features(texts[low:high])
        hidden = long_pooled(model, rows)[None] if high == low + 1 else pooled(model, rows, starts)
        out[low:high] = 1 / (1 + np.exp(-np.clip(hidden @ model.weight + model.offset, -30, 30)))
        low = high
    return out


def fresh_model(seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (BUCKETS + 1, DIMENSION)).astype(np.float32)
    embedding[BUCKETS] = 0
    filters = [rng.normal(0, 1 / np.sqrt(w * DIMENSION), (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weight = np.abs(rng.normal(0, 0.5, FILTERS * len(WIDTHS))).astype(np.float32)
    return Model(embedding, filters, bias, weight, -1.0, {})


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> Model:
    """Fit by gradient steps with per-parameter rates; only the windows that win the pooling pass a gradient back."""
    model = fresh_model(seed)
    if not len(texts) or labels.min() == labels.max():  # nothing to tell apart: one score for all
        model.weight[:] = 0
        model.offset = 4.0 if len(texts) and labels.max() else -4.0
        return model
    rng = np.random.default_rng(seed)
    prepared = [features([t])[0] for t in texts]
    dense = [*model.filters, *model.bias, model.weight]
    squares = [np.full_like(p, 1e-2) for p in dense]
    embedding_squares = np.full((BUCKETS + 1, 1), UNTOUCHED, dtype=np.float32)
    offset_square = 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            rows = np.concatenate([prepared[i] for i in chosen])
            # Words are left out at random, so that one which only stands beside stronger ones is learned too.
            rows = np.where(rng.random((len(rows), 1)) < DROPPED, np.int32(BUCKETS), rows)
            starts = np.cumsum([0, *(len(prepared[i]) for i in chosen)])
            found = responses(model, rows)
            best = np.stack(
                [
                    np.concatenate([low + r[low : high - max(WIDTHS) + 1].argmax(axis=0) for r in found])
                    for low, high in zip(starts[:-1], starts[1:], strict=True)
                ]
            )
            raw = np.stack(
                [r[best[:, k * FILTERS : (k + 1) * FILTERS], np.arange(FILTERS)] for k, r in enumerate(found)], axis=1
            ).reshape(len(chosen), -1)
            hidden = np.maximum(raw, 0)
            probability = 1 / (1 + np.exp(-np.clip(hidden @ model.weight + model.offset, -30, 30)))
            error = ((probability - labels[chosen]) / len(chosen)).astype(np.float32)
            gradients = [np.zeros_like(p) for p in dense]
            gradients[-1] = hidden.T @ error
            # A silent filter passes a little, so that it can come back.
            back = error[:, None] * model.weight * np.where(raw > 0, 1, 0.1).astype(np.float32)
            touched, changes = [], []
            for k, width in enumerate(WIDTHS):
                part, place = back[:, k * FILTERS : (k + 1) * FILTERS], best[:, k * FILTERS : (k + 1) * FILTERS]
                gradients[len(WIDTHS) + k] = part.sum(axis=0)
                for j in range(width):
                    ids = rows[place + j]  # texts x filters x 3
                    inputs = model.embedding[ids].sum(axis=2)
                    gradients[k][j] = np.einsum("bf,bfd->df", part, inputs)
                    touched.append(ids.reshape(-1, ids.shape[2]))
                    changes.append((part[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIMENSION))
            for p, g, s in zip(dense, gradients, squares, strict=True):
                s += g * g
                p -= 0.05 * g / np.sqrt(s)
            offset_square += float(error.sum()) ** 2
            model.offset -= 0.05 * float(error.sum()) / np.sqrt(offset_square)
            ids = np.concatenate(touched)
            change = np.concatenate(changes)
            unique, place = np.unique(ids, return_inverse=True)
            total = np.zeros((len(unique), DIMENSION), dtype=np.float32)
            np.add.at(total, place.reshape(-1), np.repeat(change, ids.shape[1], axis=0))
            embedding_squares[unique] += (total * total).mean(axis=1, keepdims=True)
            model.embedding[unique] -= 0.1 * total / np.sqrt(embedding_squares[unique])
            model.embedding[BUCKETS] = 0
    # Rows that never won a window were never learned; their first random values say nothing about a text.
    model.embedding[embedding_squares[:, 0] == UNTOUCHED] = 0
    return model


def threshold_of(values: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cut between scores with the best balance of precision and recall; 0.5 where a label has too few rows to tell.

    Each value stands for as many rows as `counts` says, one if it isn't given.
    """
    counts = np.ones(len(values)) if counts is None else counts
    total = counts[labels == 1].sum()
    if min(total, counts.sum() - total) < LEAST_ROWS:
        return 0.5
    order = np.argsort(-values, kind="stable")
    right, taken, ranked = np.cumsum((labels * counts)[order]), np.cumsum(counts[order]), values[order]
    ends = np.flatnonzero(np.diff(ranked, append=-1.0))  # equal scores stay on one side
    quality = 2 * right[ends] / (taken[ends] + total)
    top = ends[quality.argmax()]
    below = ranked[top + 1] if top + 1 < len(ranked) else 0.0
    return float(np.clip((ranked[top] + below) / 2, 0.05, 0.95))


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def usable_labels(labels: DataFrame) -> DataFrame:
    """(_id, toxic, _order): all labelled rows that may be learned from."""
    told = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.filter(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("_id"))
    return told.withColumn("_order", F.xxhash64("_id", F.lit(2)))


def training_rows(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, *, doc_id: str = "doc_id", text: str = "text"
) -> list:
    """At most `rows` rows of label 1 and twice as many of label 0 (by hash of their id), with texts of at most
    SAMPLE_BYTES: all that the driver gets to see, whatever the size of the tables."""
    usable = usable_labels(labels)
    # Twice what is wanted, as long texts go; then the first of those that stay. A bound on the hash, from the number
    # of rows, leaves about twice as many to sort, so that the sort doesn't grow with the table.
    counts = {x["toxic"]: x["count"] for x in usable.groupBy("toxic").count().collect()}
    drawn = []
    for y in (0, 1):
        wanted = 2 * rows * (2 - y)
        share = min(1.0, 2 * wanted / max(1, counts.get(y, 0)))
        early = F.col("_order") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
        drawn.append(usable.filter((F.col("toxic") == y) & early).orderBy("_order", "_id").limit(wanted))
    sample = drawn[0].union(drawn[1])
    told = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("text"), F.col("lang"))
    told = told.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(sample), "_id")
    per_label = [told.filter(F.col("toxic") == y).orderBy("_order", "_id").limit(rows * (2 - y)) for y in (0, 1)]
    return per_label[0].union(per_label[1]).select("_id", "text", "lang", "toxic", "_order").collect()


def score_counts(
    docs: DataFrame, labels: DataFrame, model: Model, learned: list, *, doc_id: str = "doc_id", text: str = "text"
) -> pa.Table:
    """How many labelled rows have which score: (lang, toxic, long, bin, fresh, seen), over whole tables.

    `fresh` counts the rows that the model did not learn from, `seen` those it did (their ids are `learned`), which
    score too well to set a cut. `long` tells texts too long for training. A language with too few fresh rows of a label
    goes under NULL, so the result is bounded by the bins and the languages that get a threshold.
    """
    spark = docs.sparkSession
    own = docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id))
    value = F.least(F.greatest(F.col("_score"), F.lit(1e-9)), F.lit(1 - 1e-9))
    place = F.floor((F.log(value / (1 - value)) + BIN_REACH) * BINS_A_UNIT)
    # Scores are made before the join, so that no text is shuffled.
    scored = score_documents(own, model, text=text).select(
        F.col(doc_id).alias("_id"),
        "lang",
        (F.octet_length(whole(text)) > SAMPLE_BYTES).alias("long"),
        F.least(F.greatest(place, F.lit(0)), F.lit(2 * BIN_REACH * BINS_A_UNIT - 1)).cast("int").alias("bin"),
    )
    id_type = docs.schema[doc_id].dataType.simpleString()
    trained = spark.createDataFrame([(i,) for i in sorted(set(learned))], f"_id {id_type}").withColumn("_seen", F.lit(1))
    told = scored.join(usable_labels(labels).drop("_order"), "_id").join(F.broadcast(trained), "_id", "left")
    seen = F.coalesce(F.col("_seen"), F.lit(0)).cast("long")
    keys = ["lang", "toxic", "long", "bin"]
    counts = told.groupBy(*keys).agg(F.sum(1 - seen).alias("fresh"), F.sum(seen).alias("seen"))
    of_language = Window.partitionBy("lang")
    enough = [F.sum(F.when(F.col("toxic") == y, F.col("fresh")).otherwise(0)).over(of_language) >= LEAST_ROWS for y in (0, 1)]
    merged = counts.withColumn("_enough", enough[0] & enough[1]).withColumn("lang", F.when(F.col("_enough"), F.col("lang")))
    return merged.groupBy(*keys).agg(F.sum("fresh").alias("fresh"), F.sum("seen").alias("seen")).toArrow()


def set_thresholds(model: Model, counts: pa.Table) -> None:
    """The cut for all languages together is moved to 0.5; then each language with enough rows gets its own.

    Rows learned from are left out of the cuts; the others with the same language, label and length stand for them, so
    that the share of each label is that of the whole table.
    """
    languages = np.array([x if x is None else str(x) for x in counts["lang"].to_pylist()], dtype=object)
    truth, far, place, fresh, seen = (
        counts[name].to_numpy().astype(np.int64) for name in ("toxic", "long", "bin", "fresh", "seen")
    )
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(languages, truth, far, strict=True)):
        groups.setdefault(key, []).append(i)
    weight = fresh.astype(float)
    for rows in groups.values():
        if known := fresh[rows].sum():
            weight[rows] *= 1 + seen[rows].sum() / known
    logits = (place + 0.5) / BINS_A_UNIT - BIN_REACH

    def cut_of(chosen: np.ndarray) -> float:
        if min((fresh[chosen] * (truth[chosen] == y)).sum() for y in (0, 1)) < LEAST_ROWS:
            return 0.5
        return threshold_of(1 / (1 + np.exp(-logits[chosen])), truth[chosen], weight[chosen])

    cut_at = cut_of(np.ones(len(languages), dtype=bool))
    shift = float(np.log(cut_at / (1 - cut_at)))
    model.offset -= shift
    logits = logits - shift
    for language in sorted({x for x in languages if x is not None}):
        model.thresholds[language] = cut_of(languages == language)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on three quarters of the sample; set the thresholds on all labelled rows that were not learned from."""
    rows = sorted(training_rows(docs, labels, doc_id=doc_id, text=text), key=lambda r: (r["_order"], r["_id"]))
    seen = [r for r in rows if r["_order"] % 4]
    model = train([r["text"].encode() for r in seen], np.array([r["toxic"] for r in seen], dtype=np.int64))
    set_thresholds(model, score_counts(docs, labels, model, [r["_id"] for r in seen], doc_id=doc_id, text=text))
    return model


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with _score and _threshold behind its own columns.

    The score comes from the text alone; a NULL or empty text gets the score of no evidence. The threshold is that of
    the row's language, 0.5 for languages with too few labelled rows and for NULL. Texts are read whole.
    """
    small_transfers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        values = [scores(held.value, [(t.as_py() or "").encode() for t in texts[a : a + 256]]) for a in range(0, len(texts), 256)]
        return pa.array(np.concatenate([np.zeros(0), *values]), pa.float64())

    known = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]) if model.thresholds else None
    threshold = F.coalesce(F.try_element_at(known, F.col(lang)), F.lit(0.5)) if known is not None else F.lit(0.5)
    return docs.withColumns({"_score": score(whole(text)), "_threshold": threshold})
