import random

import numpy as np
import xxhash
from cardmill.llm import simhash as module
from cardmill.llm.common import join_heavy
from cardmill.llm.simhash import components, fingerprint_of, hexadecimal, keep_first_of_each, links, near_duplicates
from pyspark.sql import functions as F

from odd_documents import ODD


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(spark):
    texts = ["", " \n", "One", "one TWO", "a b c", "A B C a b c", "É é x y z " * 50, "\x85a\xa0b c d"]
    assert [fingerprint_of(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]
    # The hash is the one that Spark has by this name.
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] == fingerprint_of(b"a b c")
    shown = spark.createDataFrame([(-1,), (26,)], "f long").select(hexadecimal(F.col("f"))).collect()
    assert [r[0] for r in shown] == ["f" * 16, "000000000000001a"]


def pairs(values):
    data = np.array(sorted(set(values)), dtype=np.int64)
    found = set()
    for i, value in enumerate(data):
        distance = np.bitwise_count((data[i + 1 :] ^ value).view(np.uint64))
        found |= {(int(value), int(data[i + 1 + j])) for j in np.flatnonzero(distance <= 2)}
    return found


def cluster(rng, center, count, flips):
    return [center ^ sum(1 << b for b in set(rng.sample(range(64), rng.randint(0, flips)))) for _ in range(count)]


def signed(values):
    return [v - (1 << 64) if v >> 63 else v for v in values]


def test_links_are_complete(spark, monkeypatch):
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(200)]
    for size in (3, 30, 150):
        values += cluster(rng, rng.getrandbits(64), size, 3)
    values += [0, 1, 3, 1 << 63, (1 << 63) | 1, (1 << 64) - 1, (1 << 32) | (1 << 31)]
    values = sorted(set(signed(values)))
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for crowd in (128, 4):  # small groups compared, then nearly all looked up by flipped bits
        monkeypatch.setattr(module, "CROWD", crowd)
        rows = links(frame).collect()
        assert len(rows) == len(set(rows)) and {(r.a, r.b) for r in rows} == pairs(values)


def test_signatures_are_dealt_out_alike_at_any_size(spark, monkeypatch):
    """However few signatures are shared, their join is a shuffle, so its disk grows in proportion to the input."""
    plans = []

    def watched(*args, **more):
        joined = join_heavy(*args, **more)
        joined.collect()
        plans.append(joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return joined

    monkeypatch.setattr(module, "join_heavy", watched)
    rows = links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fingerprint long")).collect()
    assert {(r.a, r.b) for r in rows} == pairs([1, 3, 1 << 40])
    assert len(plans) == 1 and "SortMergeJoin" in plans[0]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    parent = {n: n for e in edges for n in e}

    def root(n):
        return n if parent[n] == n else root(parent[n])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_and_odd_documents(docs_of, odd, empty):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(3000)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 40, 4)]
    rows = near_duplicates(docs_of(*near, "something else here", *[near[0]] * 5)).collect()
    assert [r.component_id for r in sorted(rows)] == [0] * 10 + [10] + [0] * 5
    found = near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    blank = [r for r in found if r.fingerprint == 0]
    assert len(blank) == 4 and {r.component_id for r in blank} == {3}
    assert sum(r.component_id is None for r in found) == 1
    assert near_duplicates(empty).count() == 0


def test_the_plan_left_over_is_small(docs_of, capsys):
    """Each step is stored before a lookup reads it several times, so plans don't nest: the last one is one lookup."""
    made = near_duplicates(docs_of("a b c d", "a b c d", "x y z", None))
    made.explain()
    assert capsys.readouterr().out.count("Exchange") <= 6


def test_one_of_each_group_stays(docs_of, odd):
    docs = docs_of("a b c d", "a b c d", "x y z", None, "")
    kept = keep_first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert sorted(map(str, (r.doc_id for r in keep_first_of_each(odd).collect()))) == sorted(
        ["3", "6", "6", "6", "7", "8", "9", "None", "None"]
    )
