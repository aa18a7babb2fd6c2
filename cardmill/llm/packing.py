"""Token sequences of a fixed length, filled by dominance reduction and best fit."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.common import cut, shuffle_partitions, small_batches, whole

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: How byte-level vocabularies part a text before merging (fixed value of that kind of file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabulary files write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """A byte-level vocabulary file in the merge engine that is quickest; its ids are those of the file.

    Special tokens of the file are recognised in a text, as the file's own library does by default. That library
    encodes the whole of a text which the quick engine refuses (a run of white space too long for its pattern).
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {x["content"]: x["id"] for x in held["added_tokens"] if x["special"]}
    to_byte = printable_bytes()
    ranks = {
        bytes(to_byte[c] for c in token): number
        for token, number in held["model"]["vocab"].items()
        if token not in special
    }
    made = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    own: list[Tokenizer] = []  # read for the first text that needs it

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special="all")
        except ValueError:
            if not own:
                own.append(Tokenizer.from_file(path))
            return own[0].encode(text, add_special_tokens=False).ids

    return encode


def bounds_of(count: int, capacity: int) -> list[tuple[int, int]]:
    """Where the pieces of a document begin and end: full ones from the end, the first takes what is over."""
    head = count % capacity or capacity
    marks = [0, *range(head, count + 1, capacity)]
    return list(zip(marks[:-1], marks[1:], strict=True))


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 2,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every document as pieces of at most `capacity` token ids, its last id being `end_id`.

    One row a piece: doc_id, piece (from 0), start, length, ids_crc32, and the ids themselves where `with_ids`.
    A NULL or empty text is one piece with the end id alone. Only documents longer than `capacity` are cut.
    Repeated rows give repeated pieces.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in small_batches(batches):
            rows: dict[str, list] = defaultdict(list)
            for number, whole_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(whole_text), end_id], dtype="<u4")
                for piece, (start, end) in enumerate(bounds_of(len(ids), capacity)):
                    rows["doc_id"].append(number)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(end - start)
                    rows["ids_crc32"].append(zlib.crc32(ids[start:end].tobytes()))
                    if with_ids:
                        rows["ids"].append(ids[start:end].tolist())
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), types, strict=False)], names=list(rows)
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(pieces, schema)


# --- the plan: made over counts of each length, so its size depends on the capacity alone -----------------------


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets that provably dominate every other set an item could be in (Martello and Toth).

    For an item of size w with room r = capacity - w, by the sizes still unpacked:
    nothing fits: the item alone; an item of size r exists: that pair; at most one more fits: the largest that fits;
    at most two fit: the largest single one if no pair is larger than it, or it and the largest that fits beside it
    if no feasible pair has a larger smaller member. Equal items are fixed together. Repeats until nothing changes.
    """
    left = {s: c for s, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*items: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in items:
            need[s] += 1
        times = min(left[s] // n for s, n in need.items())
        fixed.append((items, times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]

    def dominating(w: int) -> tuple[int, ...] | None:
        room = capacity - w
        if left.get(room, 0) > (room == w):
            return (w, room)
        others = sorted(s for s, c in left.items() if s <= room and c > (s == w))
        if not others:
            return (w,)
        have = {s: left[s] - (s == w) for s in others}
        least: list[int] = []
        for s in others[:3]:
            least += [s] * min(3 - len(least), have[s])
        largest = others[-1]
        if len(least) < 2 or sum(least[:2]) > room:
            return (w, largest)
        if len(least) == 3 and sum(least) <= room:
            return None
        best_sum = most_second = 0
        for x in others:
            fits = [y for y in others if y <= x and x + y <= room and (y != x or have[x] > 1)]
            if fits:
                best_sum, most_second = max(best_sum, x + fits[-1]), max(most_second, fits[-1])
        if best_sum <= largest:
            return (w, largest)
        beside = [y for y in others if y + largest <= room and (y != largest or have[y] > 1)]
        if beside and most_second <= beside[-1]:
            return (w, largest, beside[-1])
        return None

    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while left.get(w) and (found := dominating(w)):
                take(*found)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest items first; bins with the same content are held as one entry with a count."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left

    def put(items: tuple[int, ...], room: int, times: int) -> None:
        bins[room][items] = bins[room].get(items, 0) + times

    for size in sorted(counts, reverse=True):
        count = counts[size]
        while count:
            fitting = min((r for r in bins if r >= size), default=None)
            if fitting is None:
                each = min(capacity // size, count)
                times = count // each
                put((size,) * each, capacity - each * size, times)
                count -= each * times
                continue
            items, times = bins[fitting].popitem()
            each = min(fitting // size, count)
            used = min(times, count // each)
            put(items + (size,) * each, fitting - each * size, used)
            if times > used:
                put(items, fitting, times - used)
            if not bins[fitting]:
                del bins[fitting]
            count -= each * used
    return [(items, times) for group in bins.values() for items, times in group.items()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each length go: (length, first rank, count, first sequence, offset)."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for items, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in items:
            slots.append((size, used[size], times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return slots


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece (columns of `token_pieces`) a sequence_id and an offset there.

    Only the counts of each length (at most `capacity` numbers) reach the driver. A length that many pieces have is
    ranked in several parts. Every piece goes to exactly one place; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}
    share = max(1, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    parts = F.array(*[F.lit(1 + counts.get(size, 0) // share) for size in range(capacity + 1)])
    dealt = pieces.withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(10)), F.get(parts, F.col("length").cast("int"))).cast("int")
    )
    ranked = dealt.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - F.lit(1)
    )
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4 parts for each shuffle partition and one for each length.
    shifts = dealt.groupBy("length", "_part").count().select(
        "length", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift")
    )
    slots = spark.createDataFrame(
        plan(counts, capacity), "length long, _from long, _count long, _sequence long, _offset long"
    )
    placed = ranked.join(F.broadcast(shifts), ["length", "_part"]).withColumn("_at", F.col("_rank") + F.col("_shift"))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_count"))
    return (
        placed.alias("p")
        .join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & inside)
        .select(
            *[f"p.{c}" for c in pieces.columns],
            (F.col("_sequence") + F.col("_at") - F.col("_from")).alias("sequence_id"),
            F.col("_offset").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise whole documents and pack them; the pieces are stored once, as they are counted and then placed."""
    return pack_pieces(cut(token_pieces(docs, vocabulary, capacity, end_id)), capacity)
