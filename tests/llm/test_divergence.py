import random
import re
from collections import Counter, defaultdict

import cardmill.llm.divergence as divergence
import numpy as np
from cardmill.llm.divergence import pair_sums, probabilities, runs_of, source_divergence

from odd_documents import ODD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, term string, rank int"


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, most=200):
    """Rows of (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = slow_terms(text)
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p_of(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "mine", 1) for i, (t, lang, s) in enumerate(rows)], COLUMNS)


def found(docs, **options):
    return sorted(map(tuple, source_divergence(docs, **options).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgÉ漢" for b in "xyzÄ"] + ["The", "THE"] * 3
    rows = []
    for _ in range(400):
        lang = rng.choice(("en", "de", None))
        source = "hot" if rng.random() < 0.4 else rng.choice(("s1", "s2", None, "é"))
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 30))) if rng.random() < 0.9 else None, lang, source))
    rows += [("only once here", "en", "alone"), (None, "en", "silent"), ("single", "fr", "one"), ("other", "fr", "two")]
    want = brute(rows, 3, 7)
    assert found(frame(spark, rows).repartition(6), most_terms=7) == want
    assert {("en", "silent"), ("fr", "one")} <= {r[:2] for r in want}
    monkeypatch.setattr(divergence, "RANGE_ENTRIES", 1)
    assert found(frame(spark, rows), most_terms=7) == want


def test_odd_documents(spark, odd, empty):
    assert found(odd) == brute([(t, "en", "s") for _, t in ODD])
    assert found(empty) == []
    alike = [("same words here", "en", "a")] * 50 + [("same words", "en", "b")] * 2
    assert found(frame(spark, alike)) == brute(alike)
    assert found(frame(spark, [(None, None, None), ("x", None, "b")])) == brute([(None, None, None), ("x", None, "b")])


def test_runs_and_wide_numbers():
    rng = random.Random(5)
    for _ in range(200):
        column = [rng.choice((0, 0, 0, 1, 1, 2)) for _ in range(rng.randint(1, 12))]
        places = np.flatnonzero(column)
        starts, values = runs_of(places, np.array(column)[places], len(column))
        assert np.repeat(values, np.diff(starts, append=len(column))).tolist() == column
        assert starts[0] == 0 and (np.diff(values) != 0).all()
    counts = [0, 1, 8_999_999_999_999, 10**12]
    assert probabilities(np.array(counts), 9 * 10**14).tolist() == [1 + 10**9 * (c + 1) // (9 * 10**14) for c in counts]
    a, b = [5, 5, 1, 1, 7], [2, 2, 2, 9, 9]
    columns = {"a": (np.array([0, 2, 4]), np.array([5, 1, 7])), "b": (np.array([0, 3]), np.array([2, 9]))}
    want = {("a", "b"): sum((x - y) ** 2 // y for x, y in zip(a, b)), ("b", "a"): sum((x - y) ** 2 // x for x, y in zip(a, b))}
    assert {(x, y): v for x, y, v in pair_sums(columns, 5)} == want
