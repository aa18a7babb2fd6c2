"""Passages that repeat from document to document, found by fixed-block anchors and removed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.common import shuffle_partitions, whole
from cardmill.llm.words import (
    Words,
    covered,
    from_planes,
    planes,
    windows,
    within_text,
    words_of,
)

#: Bytes of text that one Python call holds (a longer document is held alone), and of one bucket of anchors.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

SENT = "bucket int, chunk long, step int, count int, keys binary, flags binary, extra binary"
REPLY = "chunk long, step int, bucket int, count int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"
LATEST = np.iinfo(np.int64).max


def packed(*columns: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


SENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("step", pa.int32()), ("count", pa.int32())]
    + [(name, pa.binary()) for name in ("keys", "flags", "extra")]
)
REPLY_ARROW = pa.schema(
    [("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("count", pa.int32()), ("bits", pa.binary())]
)
RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    + [("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())]
)


class Anchors:
    """The windows of one chunk: block-long ones as probes, those at multiples of the block's length as index.

    A chunk sends each key once, with two marks: is it an index block of some document here, do several documents
    here have it. The reply is one bit for each key sent, in the same order, so no key travels back.
    """

    def __init__(self, texts: list[bytes], window: int, bits: int):
        self.window, self.block = window, (window + 1) // 2
        self.words: Words = words_of(texts, others=True)
        inside = within_text(self.words, self.block)
        self.at = np.flatnonzero(inside)
        keys = windows(self.words, self.block)[self.at] >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        opens = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]) != 0)
        self.keys = ranked[opens]
        self.key_of = np.empty(len(keys), dtype=np.int64)  # for each probe the number of its key
        self.key_of[order] = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(keys)))
        self.indexed = self.several = np.zeros(0, bool)
        if len(opens):
            texts_of = self.words.text[self.at[order]]
            place = self.at - self.words.first[self.words.text[self.at]]
            self.indexed = np.logical_or.reduceat((place % self.block == 0)[order], opens)
            self.several = np.minimum.reduceat(texts_of, opens) != np.maximum.reduceat(texts_of, opens)

    def candidates(self, live: np.ndarray) -> np.ndarray:
        """Where whole windows begin that hold a live anchor."""
        hit = np.zeros(len(self.words.hashes) + 1, dtype=np.int64)
        hit[self.at + 1] = live[self.key_of]
        hit = np.cumsum(hit)
        begins = np.flatnonzero(within_text(self.words, self.window))
        span = self.window - self.block + 1
        return begins[hit[begins + span] > hit[begins]]


class Windows:
    """The candidate windows of one chunk by a key of 96 bits, and the smallest document here that has each."""

    def __init__(self, words: Words, begins: np.ndarray, window: int, ids: np.ndarray):
        first, second = windows(words, window)[begins], windows(words, window, other=True)[begins]
        second = second >> np.uint64(32)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        opens = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
        self.first, self.second = a[opens], b[opens]
        self.key_of = np.empty(len(a), dtype=np.int64)
        self.key_of[order] = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(a)))
        self.owner = np.zeros(0, np.int64)
        if len(opens):
            self.owner = np.minimum.reduceat(ids[words.text[begins[order]]], opens)


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def sums(deltas_: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas_, dtype=np.uint64)


def edges(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket of ascending keys begins; keys are dealt by their leading 32 bits."""
    lead = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return np.searchsorted((lead * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def width_of(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1


class Job:
    """The three steps of the removal, with the sizes they were planned for."""

    def __init__(self, window: int, bits: int, buckets: int):
        self.window, self.bits, self.buckets = window, bits, buckets

    @staticmethod
    def opened(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        ids = [LATEST if i is None else i for i in table.column("doc_id").to_pylist()]
        return np.array(ids, dtype=np.int64), [t.encode() for t in table.column("text").to_pylist()]

    def send_anchors(self, key: tuple, table: pa.Table) -> pa.Table:
        _, texts = self.opened(table)
        made = Anchors(texts, self.window, self.bits)
        rows: list[list] = [[] for _ in SENT_ARROW]
        marks = edges(made.keys, self.bits, self.buckets)
        for bucket in np.flatnonzero(np.diff(marks)):
            low, high = marks[bucket], marks[bucket + 1]
            step = deltas(made.keys[low:high])
            width = width_of(step)
            flags = np.packbits(np.concatenate([made.indexed[low:high], made.several[low:high]]))
            values = (bucket, key[0].as_py(), width, high - low, planes(step, width), flags.tobytes(), None)
            for row, value in zip(rows, values, strict=True):
                row.append(value)
        return packed(*rows, schema=SENT_ARROW)

    def match_anchors(self, table: pa.Table) -> pa.Table:
        """A key is live if it is an index block of a document and several documents have it."""
        sent = table.to_pylist()
        keys = [sums(from_planes(x["keys"], x["count"], x["step"])) for x in sent]
        flags = [np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=2 * x["count"]).reshape(2, -1) for x in sent]
        joined, marks = np.concatenate(keys), np.concatenate(flags, axis=1).astype(bool)
        order = np.argsort(joined, kind="stable")
        ranked = joined[order]
        opens = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]) != 0)
        counts = np.diff(opens, append=len(ranked))
        indexed = np.logical_or.reduceat(marks[0][order], opens)
        several = np.logical_or.reduceat(marks[1][order], opens) | (counts > 1)
        live = np.empty(len(joined), dtype=bool)
        live[order] = np.repeat(indexed & several, counts)
        return self.answered(sent, live, 1)

    @staticmethod
    def answered(sent: list[dict], bits: np.ndarray, step: int) -> pa.Table:
        ends = np.cumsum([x["count"] for x in sent])
        parts = [np.packbits(part).tobytes() for part in np.split(bits, ends[:-1])]
        return packed(
            [x["chunk"] for x in sent],
            [step] * len(sent),
            [x["bucket"] for x in sent],
            [x["count"] for x in sent],
            parts,
            schema=REPLY_ARROW,
        )

    @staticmethod
    def replied(table: pa.Table, step: int, count: int) -> np.ndarray:
        rows = sorted((x for x in table.to_pylist() if x["step"] == step), key=lambda x: x["bucket"])
        bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["count"]).astype(bool) for x in rows]
        found = np.concatenate(bits) if bits else np.zeros(0, bool)
        if len(found) != count:
            raise RuntimeError(f"{len(found)} replies for {count} keys")
        return found

    def extended(self, table: pa.Table, reply: pa.Table) -> tuple[np.ndarray, list[bytes], Words, np.ndarray, Windows]:
        ids, texts = self.opened(table)
        made = Anchors(texts, self.window, self.bits)
        begins = made.candidates(self.replied(reply, 1, len(made.keys)))
        return ids, texts, made.words, begins, Windows(made.words, begins, self.window, ids)

    def send_windows(self, key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in SENT_ARROW]
        if table.num_rows:
            *_, found = self.extended(table, reply)
            marks = edges(found.first, 64, self.buckets)
            for bucket in np.flatnonzero(np.diff(marks)):
                low, high = marks[bucket], marks[bucket + 1]
                owner = found.owner[low:high]
                values = (
                    *(bucket, key[0].as_py(), 8, high - low, planes(deltas(found.first[low:high]), 8)),
                    planes(found.second[low:high], 4),
                    planes(owner.view(np.uint64), 8),
                )
                for row, value in zip(rows, values, strict=True):
                    row.append(value)
        return packed(*rows, schema=SENT_ARROW)

    def match_windows(self, table: pa.Table) -> pa.Table:
        """Does a document smaller than all of the sender's have this window?"""
        sent = table.to_pylist()
        a = np.concatenate([sums(from_planes(x["keys"], x["count"], 8)) for x in sent])
        b = np.concatenate([from_planes(x["flags"], x["count"], 4) for x in sent])
        owner = np.concatenate([from_planes(x["extra"], x["count"], 8) for x in sent]).view(np.int64)
        order = np.lexsort((b, a))
        ra, rb = a[order], b[order]
        opens = np.flatnonzero((np.diff(ra, prepend=~ra[:1]) != 0) | (np.diff(rb, prepend=~rb[:1]) != 0))
        least = np.empty(len(a), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owner[order], opens), np.diff(opens, append=len(a)))
        return self.answered(sent, least < owner, 2)

    def removed(self, table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT_ARROW.empty_table()
        ids, texts, words, begins, found = self.extended(table, reply)
        earlier = self.replied(reply, 2, len(found.first))
        if len(begins):
            here = ids[words.text[begins]]
            begins = begins[earlier[found.key_of] | (found.owner[found.key_of] < here)]
        gone = covered(begins, self.window, len(words.hashes))
        out: list[list] = [[] for _ in RESULT_ARROW]
        for i, (number, text) in enumerate(zip(table.column("doc_id").to_pylist(), texts, strict=True)):
            low, high = words.first[i], words.first[i + 1]
            own, parts, runs = gone[low:high], text.split(), []
            count = int(own.sum())
            if count:
                turns = np.flatnonzero(np.diff(own, prepend=False, append=False))
                runs = [{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)]
                parts = [parts[j] for j in np.flatnonzero(~own)]
            values = (number, int(high - low), count, runs, b" ".join(parts).decode())
            for row, value in zip(out, values, strict=True):
                row.append(value)
        return packed(*out, schema=RESULT_ARROW)


def remove_repeated_passages(
    docs: DataFrame, window: int = 13, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Remove each word in a window of `window` words that also begins in a document with a smaller id.

    A window of 2b - 1 words holds a whole block of any division of a text into blocks of b words. So the blocks of
    each document (its non-overlapping stretches of b words) are the index, every stretch of b words is a probe, and
    equal ones of two documents are anchors. Windows around anchors are then compared in full; runs of windows that
    an earlier document has are the maximal exact repeats.

    Returns for each row doc_id, n_words, n_removed, repeats (word ranges, end exclusive) and kept (the other words,
    joined by a space). A NULL or empty text has no words; documents without an id come after all others; rows
    with the same id take nothing from each other. Extra columns are dropped.

    Texts are dealt into chunks by id and text. A chunk sends each of its keys once to the bucket of the key, so a passage in a
    third of all documents costs a bucket one entry for each chunk, and gets one bit back. Nothing is listed in pairs.
    """
    spark = docs.sparkSession
    told = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = shuffle_partitions(spark)
    chunks = max(partitions, math.ceil(size / CHUNK_BYTES))
    buckets = max(partitions, math.ceil(size / BUCKET_BYTES))
    # Anchors are a filter: with 12 bits more than blocks need, few other windows pass it. What passes is compared.
    bits = min(64, max(32, math.ceil(math.log2(size + 2)) + 10))
    job = Job(window, bits, buckets)
    chunked = told.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).groupBy("chunk")

    anchors = chunked.applyInArrow(lambda key, rows: job.send_anchors(key, rows), SENT)
    live = anchors.groupBy("bucket").applyInArrow(lambda rows: job.match_anchors(rows), REPLY)
    beside = chunked.cogroup(live.groupBy("chunk"))
    found = beside.applyInArrow(lambda key, rows, reply: job.send_windows(key, rows, reply), SENT)
    earlier = found.groupBy("bucket").applyInArrow(lambda rows: job.match_windows(rows), REPLY)
    beside = chunked.cogroup(live.unionByName(earlier).groupBy("chunk"))
    return beside.applyInArrow(lambda key, rows, reply: job.removed(rows, reply), RESULT)
