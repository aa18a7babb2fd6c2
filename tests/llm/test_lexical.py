import math
import random
import re
from collections import Counter

import cardmill.llm.lexical as lexical
import numpy as np
import pyarrow as pa
import pytest
from cardmill.llm.lexical import bounds, build_index, levels_of, search, sets_in, term_hashes
from cardmill.llm.terms import LETTERS, WORDS_AND_NUMBERS, count_terms
from pyspark.sql import functions as F

from odd_documents import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, wanted=20):
    counts = [(i, Counter(slow_terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    df = Counter(t for _, c in counts for t in c)
    total = sum(sum(c.values()) for _, c in counts)
    weight = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * len(counts)) // total
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in slow_terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:wanted], 1)]
    return sorted(out, key=repr)


def items_of(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def found(docs, items, wanted=20):
    return sorted(map(tuple, search(docs, items, wanted).collect()), key=repr)


def invented(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "Été", "漢字", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice((1, 5, 40, 400)))) for _ in range(count)]


@pytest.fixture(scope="module")
def some(docs_of):
    return [(i // 2, t) for i, t in enumerate(invented(1, 300))]  # every id twice


def test_against_brute_force(spark, docs_of, some, monkeypatch):
    monkeypatch.setattr(lexical, "PROBES", 1)
    items = [(i, t) for i, t in enumerate(invented(2, 12))] + [(3, "W1 w2"), (3, "W1 w2"), (20, None), (21, "! -"), (None, "w5"), (22, "none")]
    wanted = brute(some, items, 5)
    assert found(docs_of(*some).repartition(5), items_of(spark, *items), 5) == wanted
    assert len(wanted) > 50
    # Candidates that are too many to be copied to each task give the same, and so do groups of items.
    monkeypatch.setattr(lexical, "COPIED_ROWS", 3)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 1000)
    assert found(docs_of(*some), items_of(spark, *items), 5) == wanted


def test_odd_documents(spark, odd, empty, docs_of):
    items = [(1, "same text y"), (2, "word LONG"), (3, "é 漢字 x 9"), (4, "no id"), (5, "y" * 70000)]
    assert found(odd, items_of(spark, *items)) == brute(ODD, items)
    assert found(empty, items_of(spark, *items)) == []
    assert found(docs_of((1, "..."), (2, None)), items_of(spark, *items)) == []
    assert found(odd, items_of(spark, *items).limit(0)) == []
    alike = [(i, "hot copy of one text") for i in range(60)] + [(None, "hot copy")] * 40
    assert found(docs_of(*alike), items_of(spark, (1, "hot"))) == brute(alike, [(1, "hot")])


def test_bounds_hold_and_slices_lose_nothing(docs_of, some):
    index = build_index(docs_of(*some))
    items = invented(3, 9)
    totals = index.groupBy().sum("n_docs", "n_terms").toDF("n_docs", "n_terms").first()
    assert tuple(totals) == (len(some), sum(len(slow_terms(t)) for _, t in some))
    query = lexical.weighed(index, items, totals)
    spread = levels_of(term_hashes(query.terms))
    table = index.select("keys", "lengths", "width", "slices").toArrow()
    above = {}
    for keys, lengths, width, slices in sets_in(table.to_batches()):
        for key, column in zip(keys, bounds(query, spread, width, slices, lengths).T, strict=True):
            above[int(key)] = column
    keyed = docs_of(*some).select("doc_id", "text", lexical.document_key(F.col("doc_id"), F.col("text")).alias("key"))
    real = {(i, d): s for i, _, d, s in brute([(r.key, r.text) for r in keyed.collect()], list(enumerate(items)), 10**9)}
    assert all(above[d][i] >= s for (i, d), s in real.items())
    slack = sum(int(above[d][i]) for i, d in real) / sum(real.values())
    assert slack < 1.15


def test_terms():
    texts = pa.array(["Ab ab-1é É\x0b\x85 z", None, "", "  ", "q_q"])
    counted = count_terms(texts, WORDS_AND_NUMBERS)
    told = [(int(a), counted.vocabulary[int(b)].as_py(), int(n)) for a, b, n in zip(counted.text, counted.term, counted.count, strict=True)]
    assert sorted(told) == [(0, "1é", 1), (0, "ab", 2), (0, "z", 1), (0, "\x85", 1), (0, "É", 1), (4, "q", 2)]
    assert counted.total.tolist() == [6, 0, 0, 0, 2]
    letters = count_terms(texts.slice(0, 1), LETTERS)
    assert sorted(letters.vocabulary.to_pylist()) == ["ab", "z", "\x85", "É", "é"]
    assert np.array_equal(count_terms(texts.slice(4), LETTERS).total, [2])
    assert len(count_terms(pa.array([], pa.string()), LETTERS).total) == 0
