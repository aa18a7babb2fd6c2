import random
import zlib

import numpy as np
import pytest
from cardmill.llm import quality_model
from cardmill.llm.quality_model import Model, best_cut, features, fit, logits, score_quality, shape_of, train
from cardmill.llm.queries import op13_quality_classifier

from odd_documents import ODD


def prose(rng, count):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(count))


def junk(rng, count):
    kind = rng.randint(0, 2)
    words = prose(rng, count).split()
    return " ".join([w + "&&&" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:3] * count)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    return [(i, junk(rng, 30) if i % 4 == 0 else prose(rng, 30), int(i % 4 != 0)) for i in range(600)]


def labelled(spark, rows):
    return spark.createDataFrame([(i, y, 0, "x") for i, _, y in rows], "doc_id long, quality int, toxic int, text string")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark, docs_of, rows):
    docs = docs_of(*[(i, t) for i, t, _ in rows])
    model = fit(docs, labelled(spark, rows))
    scored = {r.doc_id: r._quality for r in score_quality(docs, model).collect()}
    right = [(scored[i] >= quality_model.CUT) == (y == 1) for i, _, y in rows if held(i)]
    assert len(right) > 100 and np.mean(right) > 0.97
    # Labels of held-out rows change nothing.
    turned = [(i, t, 1 - y if held(i) else y) for i, t, y in rows]
    assert np.array_equal(fit(docs, labelled(spark, turned)).weights, model.weights)


def test_scores_are_those_of_a_slow_sum(rows):
    texts = [t.encode() for _, t, _ in rows[:40]] + [b"", b"One", b"a b c a b c", "Ünï 12 cod".encode()]
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=quality_model.PLACES), 0.25)
    alone = [float(sum(model.weights[p] * v for p, v in zip(f[0], f[2]))) + 0.25 for f in (features([t]) for t in texts)]
    assert np.allclose(logits(model, texts), alone)
    assert logits(model, [b""])[0] == 0.25
    doubled = features([b"a b c x a b c"])
    assert (doubled[0] == quality_model.PLACES - 1).sum() == 1 and (doubled[0] == quality_model.PLACES - 2).sum() == 4
    assert shape_of("Été 2024!!".encode()) == b"a 0!" and shape_of(b"") == b"" and shape_of(b"aB") == b"aA"


def test_training_is_follow_the_regularised_leader(rows):
    """One text at a time by the plain formulas gives the same weights."""
    texts, labels = [t.encode() for _, t, _ in rows[:30]], np.array([y for _, _, y in rows[:30]])
    z, n = {}, {}
    q = quality_model

    def weight(p):
        s = z.get(p, 0.0)
        return 0.0 if abs(s) <= q.SPARSE else -(s - np.sign(s) * q.SPARSE) / ((q.SMOOTHING + n.get(p, 0.0) ** 0.5) / q.RATE + q.RIDGE)

    for i in np.random.default_rng(13).permutation(30):
        x = {}
        for p, v in zip(*(features([texts[i]])[k] for k in (0, 2))):
            x[p] = x.get(p, 0.0) + v
        x[q.PLACES] = 1.0
        now = {p: weight(p) for p in x}
        error = 1 / (1 + np.exp(-sum(now[p] * v for p, v in x.items()))) - labels[i]
        for p, v in x.items():
            g = error * v
            z[p] = z.get(p, 0.0) + g - ((n.get(p, 0.0) + g * g) ** 0.5 - n.get(p, 0.0) ** 0.5) / q.RATE * now[p]
            n[p] = n.get(p, 0.0) + g * g
    model = train(texts, labels, epochs=1)
    assert np.isclose(model.offset, weight(q.PLACES))
    assert all(np.isclose(model.weights[p], weight(p), atol=1e-6) for p in z if p != q.PLACES)
    assert (model.weights != 0).sum() <= len(z)


def test_odd_documents(spark, odd, empty, docs_of, rows, monkeypatch):
    docs = docs_of(*[(i, t) for i, t, _ in rows])
    model = fit(docs, labelled(spark, rows))
    scored = score_quality(odd, model)
    assert scored.columns == [*odd.columns, "_quality"]
    found = scored.collect()
    assert len(found) == len(ODD) and all(0 <= r._quality <= 1 for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.text or "", r._quality) == r._quality
    assert score_quality(empty, model).collect() == []
    none = fit(docs, labelled(spark, rows).limit(0))
    assert {round(r._quality, 6) for r in score_quality(docs, none).collect()} == {round(1 / (1 + np.exp(4.0 - np.log(7 / 3))), 6)}
    assert fit(empty, labelled(spark, rows)).offset == none.offset
    # Labels that are too many to be copied are joined with scores; the cut is the same.
    monkeypatch.setattr(quality_model, "fits_broadcast", lambda _: False)
    assert fit(docs, labelled(spark, rows)).offset == model.offset


def test_the_query(spark, tmp_path, docs_of, rows):
    docs_of(*[(i, t) for i, t, _ in rows], (None, "no id"), (9999, None)).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    got = op13_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    assert all(r.held_out == held(r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_cut():
    import pyarrow as pa

    at = quality_model.BIN_REACH * quality_model.BINS_A_UNIT
    table = pa.table({"quality": [0, 0, 1, 1], "bin": [at - 200, at - 100, at + 100, at + 300], "n": [50, 50, 70, 30]})
    assert -1 < best_cut(table) < 1
    assert best_cut(table.slice(0, 3).slice(1)) != 0 and best_cut(table.slice(0, 2)) == 0
