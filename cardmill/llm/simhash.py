"""Near duplicates by SimHash: deletion-variant signatures find fingerprints that differ in at most two bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import cut, join_heavy, small_transfers, whole
from cardmill.llm.words import LOWER

SEED = 42
#: A variant that more fingerprints than this share is searched by flipping bits instead of comparing its members.
CROWD = 128
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
LOWER_TABLE = LOWER.tobytes()


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """Majority of the bits of all word shingles' hashes, as a signed 64-bit number; no word: zero."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    if count == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: count - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    values, ones = np.array(hashes, dtype="<u8"), np.zeros(64, dtype=np.int64)
    for at in range(0, count, BLOCK):
        part = values[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text; NULL counts as the empty text."""
    return pa.array([fingerprint_of((t.as_py() or "").encode()) for t in texts], pa.int64())


def segment(value: Column, place: int) -> Column:
    """One of the two 32-bit segments of a fingerprint."""
    return F.shiftrightunsigned(value, 32) if place else value.bitwiseAND(F.lit(0xFFFFFFFF))


def variants(fingerprints: DataFrame) -> DataFrame:
    """64 signatures for each fingerprint: a segment, and which of its bits is left out, and the other bits."""
    value = F.col("fingerprint")
    keys = [
        (segment(value, place).bitwiseAND(F.lit(~(1 << bit) & 0xFFFFFFFF)) + F.lit((place * 32 + bit) << 32))
        for place in (0, 1)
        for bit in range(32)
    ]
    return fingerprints.select("fingerprint", F.explode(F.array(*keys)).alias("variant"))


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs a < b of different fingerprints that differ in one or two bits, each pair once.

    Of two differing bits at most one lies in one of the two segments. Leaving that bit out gives both fingerprints
    the same signature, so an equality join on signatures finds every pair; the bits are then counted. Signatures
    that stand alone, nearly all of them, end at the count. Where very many fingerprints share a signature (copies
    of one text with small changes), each of them is linked by looking up all 2,080 values within two bits, which
    grows with their number and not with its square. So no pair is missed, however large a group is. The shared ones
    are some signatures of any input, so they are always joined by a shuffle, never by a copy in each task.
    """
    values = fingerprints.select("fingerprint")
    signed = variants(values)
    counted = signed.groupBy("variant").agg(F.count("*").alias("_count")).filter("_count > 1")
    shared = cut(join_heavy(signed, cut(counted.withColumn("members", F.col("_count"))), ["variant"], merge=True))
    few = shared.filter(F.col("members") <= CROWD)
    other = few.select("variant", F.col("fingerprint").alias("other"))
    differs = F.col("fingerprint").bitwiseXOR(F.col("other"))
    place, left_out = F.col("variant") >= F.lit(32 << 32), F.pmod(F.shiftright("variant", 32), F.lit(32)).cast("int")
    here = F.when(place, segment(differs, 1)).otherwise(segment(differs, 0))
    # A pair is counted at one of its signatures: in the first segment that can hold it, at the bit it differs in.
    first = ~place | (F.bit_count(segment(differs, 0)) > 1)
    at_bit = ((here == 0) & (left_out == 0)) | (here == F.expr("shiftleft(1L, pmod(shiftright(variant, 32), 32))"))
    pairs = few.join(other, "variant").filter(
        (F.col("fingerprint") < F.col("other")) & (F.bit_count(differs) <= 2) & first & at_bit
    )
    pairs = pairs.select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))

    crowded = shared.filter(F.col("members") > CROWD).select("fingerprint").distinct()
    signed_masks = [1 << i for i in range(63)] + [-(1 << 63)]
    one = F.array(*[F.lit(m) for m in [0, *signed_masks]])
    two = F.array(*[F.lit(m) for m in signed_masks])
    flipped = crowded.select("fingerprint", F.explode(one).alias("m1")).select("fingerprint", "m1", F.explode(two).alias("m2"))
    # Bits in ascending order, so each set of bits is tried once; a zero stands for no second bit.
    order = (F.col("m1") == 0) | ((F.col("m2") != F.col("m1")) & ((F.col("m1") > F.col("m2")) | (F.col("m1") < 0)) & (F.col("m2") > 0))
    near = F.col("fingerprint").bitwiseXOR(F.col("m1")).bitwiseXOR(F.col("m2"))
    tried = flipped.filter(order).select(F.col("fingerprint").alias("from"), near.alias("fingerprint"))
    met = tried.join(values, "fingerprint").select(
        F.least("from", "fingerprint").alias("a"), F.greatest("from", "fingerprint").alias("b")
    )
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of a graph of pairs (a, b); the component is its least node.

    Each round takes the least label among the neighbours and then the label of that label, so the rounds grow with
    the logarithm of the longest path. A component may hold a large part of all nodes: its label is looked up from a
    copy in each task. Nothing but counts reaches the driver.
    """
    edges = cut(edges.select("a", "b"))
    both = edges.union(edges.select("b", "a"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("component")))
    while True:
        seen = labels.select(F.col("node").alias("b"), "component")
        hopped = both.join(seen, "b").groupBy("a").agg(F.min("component").alias("least"))
        moved = cut(
            labels.join(hopped.withColumnRenamed("a", "node"), "node").select(
                "node", F.col("component").alias("before"), F.least("component", "least").alias("component")
            )
        )
        # Each label is a node, so every row finds the label that its label has now.
        sizes = moved.groupBy("component").agg(F.count("*").alias("_count"))
        jumps = moved.select(F.col("node").alias("component"), F.col("component").alias("further")).join(sizes, "component")
        labels = cut(
            join_heavy(moved, cut(jumps), ["component"]).select(
                "node", "before", F.least("component", "further").alias("component")
            )
        )
        if labels.filter("before <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (a signed 64-bit number) and component_id for each row of `docs`.

    Rows link if their fingerprints differ in at most two bits; component_id is the least doc_id that links reach.
    Texts without a word (NULL too) have the fingerprint zero and link like any others. Rows without an id get the
    component of the rows they link to, NULL if those have no id either. Repeated rows stay. Extra columns are dropped.

    Copies share a fingerprint and are linked through it, never in pairs. What a lookup of frequent keys reads several
    times is stored first, so that the driver never holds the plans and tasks of all steps at once.
    """
    small_transfers(docs.sparkSession)
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), simhash(whole(text)).alias("fingerprint")))
    known = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("_count")))
    found = components(links(known)).withColumnRenamed("node", "fingerprint")
    classed = known.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    classed = cut(classed.withColumnRenamed("_count", "rows"))
    named = classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_count"))
    classed = join_heavy(classed, cut(named), ["component"])
    classed = cut(classed.select("fingerprint", "component_id", F.col("rows").alias("_count")))
    return join_heavy(rows, classed, ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def keep_first_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id names their component: one document of each group stays, with all its columns.

    Rows without an id stay, as nothing tells which of them is first.
    """
    kept = near_duplicates(docs, doc_id=doc_id, text=text).filter(F.col("doc_id") == F.col("component_id"))
    names = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    first = docs.join(names, docs[doc_id] == names["_kept_id"], "left_semi")
    return first.unionByName(docs.filter(F.col(doc_id).isNull()))
