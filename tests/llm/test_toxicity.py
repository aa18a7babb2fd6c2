import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from cardmill.llm.toxicity import (
    fit,
    fresh_model,
    held_out,
    score_counts,
    score_documents,
    scores,
    set_thresholds,
    threshold_of,
    train,
    training_rows,
)

from odd_documents import ODD

BAD = ["badword", "nastything", "vexxa", "vexxo", "vexxit"]


def corpus(count, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_training_in_numpy():
    rows = corpus(900)
    model = train([t.encode() for _, t, _ in rows[:600]], np.array([y for *_, y in rows[:600]]))
    values = scores(model, [t.encode() for _, t, _ in rows[600:]])
    truth = np.array([y for *_, y in rows[600:]])
    assert ((values >= 0.5) == truth).mean() > 0.95
    order = values.argsort().argsort()
    assert (order[truth == 1].mean() - order[truth == 0].mean()) > 0.45 * len(truth)
    # Endings that were never seen share the beginning of a word; case and signs don't matter.
    unseen = scores(model, [b"one two vexxurgh three four", b"(BADWORD!) one two three", b"one two three four"])
    assert unseen[0] > unseen[2] and unseen[1] > unseen[2]


def test_long_texts_are_read_whole():
    rows = corpus(400)
    model = train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    plain = ("one two three " * 60000).encode()
    low, high, alone = scores(model, [plain, plain + b"badword", b"badword"])
    assert high > low and abs(high - alone) < 0.3
    assert scores(model, [b""])[0] < 0.5


def test_thresholds():
    labels = np.array([0] * 10 + [1] * 10)
    values = np.concatenate([np.linspace(0.1, 0.3, 10), np.linspace(0.7, 0.9, 10)])
    assert abs(threshold_of(values, labels) - 0.5) < 1e-9
    assert threshold_of(values[:12], labels[:12]) == 0.5 and threshold_of(values[:0], labels[:0]) == 0.5


def test_columns(spark, docs_of, odd, empty):
    rows = corpus(500, 3)
    docs = docs_of(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    made = score_documents(docs, model).withColumn("aside", held_out("doc_id")).collect()
    assert all(r.aside == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in made)
    truth = {i: y for i, _, y in rows}
    assert sum((r._score >= 0.5) == truth[r.doc_id] for r in made if r.aside) > 0.9 * sum(r.aside for r in made)
    learned = training_rows(docs, labels, 50)
    assert sum(r.toxic for r in learned) == 50 and all(zlib.crc32(str(r._id).encode()) % 5 for r in learned)
    found = score_documents(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r._score <= 1 and 0 < r._threshold < 1 for r in found)
    assert score_documents(empty, model).count() == 0
    unknown = score_documents(odd, fit(docs, labels.limit(0))).collect()
    assert len({r._score for r in unknown}) == 1 and unknown[0]._score < 0.5


def test_a_score_does_not_depend_on_the_next_text():
    rows = corpus(400)
    model = train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    clean = [b"one two three four", b"", b"five"]
    toxic = [f"{bad} {bad} {bad} one two".encode() for bad in BAD]
    apart = np.concatenate([scores(model, clean), scores(model, toxic)])
    assert np.allclose(scores(model, clean + toxic), apart, rtol=0, atol=1e-5)
    mixed = [t for bad in toxic for t in (clean[0], bad, clean[1], bad, clean[2], bad)]
    alone = np.array([scores(model, [t])[0] for t in mixed])
    assert np.allclose(scores(model, mixed), alone, rtol=0, atol=1e-5)


def test_thresholds_count_all_labelled_rows(spark):
    # A language with few of the toxic labels, beyond what the sample for training holds, and texts too long for it.
    rows = [(i, t, "en", y) for i, t, y in corpus(12000, 7)]
    rare = [(20000 + i, t, "xx", y) for i, t, y in corpus(200, 8)]
    far = [(30000 + i, t + " one two" * 5000, "zz", y) for i, t, y in corpus(120, 9)]
    held = spark.createDataFrame(rows + rare + far, "doc_id long, text string, lang string, toxic int")
    model = fit(held.drop("toxic"), held.select("doc_id", "toxic"))
    assert {"en", "xx", "zz"} <= set(model.thresholds)
    sample = training_rows(held.drop("toxic"), held.select("doc_id", "toxic"))
    learned = [r._id for r in sample if r._order % 4]
    counts = score_counts(held.drop("toxic"), held.select("doc_id", "toxic"), model, learned).to_pylist()
    want = Counter((lang, y) for i, _, lang, y in rows + rare + far if zlib.crc32(str(i).encode()) % 5)
    found = Counter()
    for r in counts:
        found[r["lang"], r["toxic"]] += r["fresh"] + r["seen"]
    assert found == want and sum(r["seen"] for r in counts) == len(learned)


def test_the_cut_is_that_of_the_whole_table():
    # The model learned from most toxic rows and few others: the shares are those of fresh and seen rows together.
    def table(toxic_seen, toxic_fresh):
        rows = [("a", 1, False, 1100, toxic_fresh, toxic_seen), ("a", 1, False, 900, toxic_fresh, toxic_seen)]
        rows += [("a", 0, False, 900, 300, 0), ("a", 0, False, 700, 1000, 0)]
        names = ["lang", "toxic", "long", "bin", "fresh", "seen"]
        return pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    made = []
    for seen, fresh in ((0, 400), (380, 20), (0, 20)):
        model = fresh_model()
        set_thresholds(model, table(seen, fresh))
        made.append((model.offset, model.thresholds["a"]))
    assert np.allclose(made[0], made[1]) and made[0][0] > made[2][0]
    values, truth = np.array([0.9, 0.5, 0.2]), np.array([1, 0, 0])
    counts = np.array([30, 20, 50])
    assert threshold_of(values, truth, counts) == threshold_of(np.repeat(values, counts), np.repeat(truth, counts))
