import random
import zlib

from cardmill.llm.sharding import range_of, shard_documents
from pyspark.sql import functions as F

from odd_documents import ODD


def laws_hold(rows, shards, largest):
    total = sum(r["size"] for r in rows)
    for shard in range(shards):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest
    assert {r["shard"] for r in rows} <= set(range(shards))


def test_shards_are_near_equal(docs_of):
    rng = random.Random(4)
    texts = ["ab" * rng.randint(0, 200) for _ in range(400)] + ["hot text"] * 300 + ["é" * 3000]
    rows = shard_documents(docs_of(*texts), 24).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    laws_hold(rows, 24, max(r["size"] for r in rows))
    # Copies stand side by side: a text that fits into few shards is in few.
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "hot text"}) <= 4


def test_one_text_in_all_rows(docs_of):
    rows = shard_documents(docs_of(*["same"] * 500), 6).collect()
    laws_hold(rows, 6, 12)


def test_one_text_without_ids(docs_of):
    docs = docs_of(*[(None, "same")] * 500, *[(i, f"own {i}") for i in range(40)])
    rows = shard_documents(docs, 6).collect()
    laws_hold(rows, 6, 16)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 6


def test_odd_documents(odd, empty):
    rows = shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD)
    laws_hold(rows, 3, max(r["size"] for r in rows))
    assert sorted(r["size"] for r in rows)[:3] == [8, 8, 8]
    assert shard_documents(empty, 3).count() == 0


def test_no_python_runs(docs_of):
    plan = shard_documents(docs_of("a", "b"), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ranges_by_binary_search(spark):
    bounds = [-5, 0, 0, 7, 9]
    keys = spark.createDataFrame([(k,) for k in range(-8, 12)], "k long")
    for count in range(6):
        own = bounds[:count]
        rows = keys.select("k", range_of(F.col("k"), own).alias("r")).collect()
        assert all(r.r == sum(b <= r.k for b in own) for r in rows)
