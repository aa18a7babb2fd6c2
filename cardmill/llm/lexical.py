"""Ranked search over bit-sliced Bloom signatures, with bounds that let most documents be left unread.

The index holds, for sets of documents of similar length, a bitmap over the documents for each bit of their signatures
(a slice), and how many documents of a block hold each term. A term is present where all its slices have a bit, or by
chance; so what a document may score is never less than what it does score. Signatures also hold that a term occurs at
least twice, three times and so on. A search bounds all documents, reads those with the best bounds to learn which score the last
place of a ranking has at least, and reads all others that may reach it. Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.common import cut, join_heavy, mix, stored, whole
from cardmill.llm.terms import WORDS_AND_NUMBERS, Counted, blocks, count_terms
from cardmill.operators.lookup import fits_broadcast

#: Text that is cut into terms at once; its documents share a list of terms in the index.
BLOCK_BYTES = 8 << 20
#: A signature has so many bits for each entry, and an entry sets so many of them.
BITS, SLICES = 14, 4
#: Documents that share slices; the largest has at most twice the entries of the smallest.
SET_ROWS = 512
#: A term is entered once for each of these numbers of occurrences that it reaches.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 24)
#: Queries are asked in groups of about so many bytes of text.
GROUP_BYTES = 128 << 10
#: So many times the wanted documents are read first, those with the best bounds, to learn what the last place takes.
PROBES = 4
#: Candidates that are looked up from a copy in each task: at most so many, and so many bytes. More are shuffled.
COPIED_ROWS, COPIED_BYTES = 100_000, 4 << 20

INDEX = "keys binary, lengths binary, width int, slices binary, terms array<string>, holders array<int>, n_docs long, n_terms long"


def document_key(doc_id: Column, text: Column) -> Column:
    """Finds the rows of a candidate again. Rows that share it are all read, so none is lost or wrong by chance."""
    return F.xxhash64(doc_id, text)


def term_hashes(terms: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms.to_pylist()], dtype=np.uint64)


def bit_places(spread: np.ndarray, width: int) -> np.ndarray:
    """Which bits of a signature each entry sets, one row for each of the SLICES. `spread` is its hash."""
    low, step = spread & np.uint64(0xFFFFFFFF), (spread >> np.uint64(32)) | np.uint64(1)
    turned = (low + step * np.arange(SLICES, dtype=np.uint64)[:, None]) & np.uint64(0xFFFFFFFF)
    return ((turned * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def levels_of(hashes: np.ndarray) -> list[np.ndarray]:
    return [mix(hashes + np.uint64(level)) for level in range(len(LEVELS))]


def sets_of(entries: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of documents with entries, by size, in sets of similar size."""
    order = np.argsort(entries, kind="stable")
    order = order[entries[order] > 0]
    at = 0
    while at < len(order):
        end = at + int(np.searchsorted(entries[order[at:]], 2 * entries[order[at]], side="right"))
        end = min(end, at + SET_ROWS)
        yield order[at:end]
        at = end


def sliced(counted: Counted, spread: list[np.ndarray], members: np.ndarray, entries: np.ndarray) -> tuple[int, bytes]:
    """The width of the signatures of some documents, and their bitmaps, one after the other by bit."""
    width = BITS * int(entries[members].max())
    bits = np.zeros((width, 8 * math.ceil(len(members) / 8)), dtype=bool)
    low = np.searchsorted(counted.text, members)
    sizes = np.searchsorted(counted.text, members, side="right") - low
    column = np.repeat(np.arange(len(members)), sizes)
    own = np.arange(len(column)) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
    term, count = counted.term[own], counted.count[own]
    for least, hashes in zip(LEVELS, spread, strict=True):
        reached = count >= least
        term, count, column = term[reached], count[reached], column[reached]
        for places in bit_places(hashes[term], width):
            bits[places, column] = True
    return width, np.packbits(bits, axis=1).tobytes()


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        counted = count_terms(block.column("text"), WORDS_AND_NUMBERS)
        if not counted.total.any():
            continue
        keys = block.column("key").to_numpy(zero_copy_only=False)
        spread = levels_of(term_hashes(counted.vocabulary))
        entries = np.zeros(len(keys), dtype=np.int64)
        for least in LEVELS:
            entries += np.bincount(counted.text[counted.count >= least], minlength=len(keys))
        holders = np.bincount(counted.term, minlength=len(counted.vocabulary)).astype(np.int32)
        terms = counted.vocabulary.filter(pa.array(holders > 0))
        told = [terms], [pa.array(holders[holders > 0])], [int((counted.total > 0).sum())], [int(counted.total.sum())]
        for members in sets_of(entries):
            width, slices = sliced(counted, spread, members, entries)
            rows = [[keys[members].tobytes()], [counted.total[members].astype(np.int64).tobytes()], [width], [slices]]
            words, numbers, documents, length = told
            yield pa.record_batch(
                [
                    pa.array(rows[0], pa.binary()),
                    pa.array(rows[1], pa.binary()),
                    pa.array(rows[2], pa.int32()),
                    pa.array(rows[3], pa.binary()),
                    pa.ListArray.from_arrays([0, len(words[0])], words[0]),
                    pa.ListArray.from_arrays([0, len(numbers[0])], numbers[0]),
                    pa.array(documents, pa.int64()),
                    pa.array(length, pa.int64()),
                ],
                names=["keys", "lengths", "width", "slices", "terms", "holders", "n_docs", "n_terms"],
            )
            # The block's terms and totals stand in its first row only.
            told = [terms[:0]], [pa.array([], pa.int32())], [0], [0]


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Slices, lengths and terms of all documents that have a term, stored in the shared folder."""
    keyed = docs.select(document_key(F.col(doc_id), F.col(text)).alias("key"), whole(text).alias("text"))
    return stored(keyed.mapInArrow(index_rows, INDEX), "lexical-index")


@dataclass
class Query:
    """A group of items, with the weight of each term in each item, and what the scores of all documents rest on."""

    terms: pa.Array
    #: For each item its terms and, for each of them, its weight times its occurrences in the item.
    places: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int
    #: What a document must reach to be read, for each item.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def lengths(self, totals: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * totals * self.n_docs) // self.n_terms


def term_share(occurrences: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * occurrences) // (1000 * occurrences + 12 * length)


def bounds(query: Query, spread: list[np.ndarray], width: int, slices: bytes, totals: np.ndarray) -> np.ndarray:
    """What each document of a set may score at most for each item: items x documents."""
    bits = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
    length = query.lengths(totals)
    present, steps, before = [], [], np.zeros(len(totals), dtype=np.int64)
    for level, hashes in enumerate(spread):
        present.append(reduce(np.bitwise_and, (bits[places] for places in bit_places(hashes, width))))
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else totals
        share = term_share(np.minimum(most, totals), length)
        steps.append(share - before)
        before = share
    rows = np.concatenate(present, axis=1)
    out = np.empty((len(query.places), len(totals)), dtype=np.int64)
    for item, (places, weights) in enumerate(zip(query.places, query.weights, strict=True)):
        sums = np.zeros(8 * rows.shape[1])
        for at in range(0, len(places), 4096):
            sums += weights[at : at + 4096] @ np.unpackbits(rows[places[at : at + 4096]], axis=1)
        sums = sums.reshape(len(LEVELS), -1)[:, : len(totals)].astype(np.int64)
        out[item] = sum(step * own for step, own in zip(steps, sums, strict=True))
    return out


def sets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    for batch in batches:
        for row in range(batch.num_rows):
            keys, lengths, width, slices = (batch.column(i)[row].as_py() for i in range(4))
            yield np.frombuffer(keys, np.int64), np.frombuffer(lengths, np.int64), width, slices


def best_bounds(query: Query, wanted: int):
    """Of each task the `wanted` documents with the best bounds for each item: item, key, bound."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = levels_of(term_hashes(query.terms))
        top = np.zeros((len(query.places), wanted), dtype=np.int64)
        held = np.zeros((len(query.places), wanted), dtype=np.int64)
        for keys, totals, width, slices in sets_in(batches):
            found = bounds(query, spread, width, slices, totals)
            for item in np.flatnonzero(found.max(axis=1) > top.min(axis=1)):
                values = np.concatenate([top[item], found[item]])
                best = np.argpartition(-values, wanted - 1)[:wanted]
                top[item], held[item] = values[best], np.concatenate([held[item], keys])[best]
        items, places = np.nonzero(top)
        yield candidates_batch(items, held[items, places], top[items, places])

    return work


def all_that_reach(query: Query):
    """All documents whose bound reaches what is asked for the item: item, key, bound."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = levels_of(term_hashes(query.terms))
        for keys, totals, width, slices in sets_in(batches):
            found = bounds(query, spread, width, slices, totals)
            items, places = np.nonzero(found >= query.least[:, None])
            yield candidates_batch(items, keys[places], found[items, places])

    return work


def candidates_batch(items: np.ndarray, keys: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(items.astype(np.int32)), pa.array(keys.astype(np.int64)), pa.array(found.astype(np.int64))]
    return pa.record_batch(columns, names=["item", "key", "bound"])


def exact_scores(query: Query):
    """Scores of candidates read whole: item, doc_id, score; none of 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            counted = count_terms(block.column("text"), WORDS_AND_NUMBERS)
            asked = pc.fill_null(pc.index_in(counted.vocabulary, value_set=query.terms), -1).to_numpy(zero_copy_only=False)
            length = query.lengths(counted.total)
            wanted = block.column("items")
            rows, items, values = [], [], []
            for row in range(block.num_rows):
                low, high = np.searchsorted(counted.text, [row, row + 1])
                place = asked[counted.term[low:high]]
                occurrences = np.zeros(len(query.terms), dtype=np.int64)
                occurrences[place[place >= 0]] = counted.count[low:high][place >= 0]
                share = term_share(occurrences, length[row])
                for item in wanted[row].as_py():
                    score = int((query.weights[item].astype(np.int64) * share[query.places[item]]).sum())
                    if score > 0:
                        rows.append(row), items.append(item), values.append(score)
            ids = block.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [pa.array(items, pa.int32()), ids, pa.array(values, pa.int64())], names=["item", "doc_id", "score"]
            )

    return work


def read_candidates(docs: DataFrame, candidates: DataFrame, query: Query) -> DataFrame:
    """Exact scores of (item, key): each document is read once, for all items that ask for it."""
    asked = cut(candidates.groupBy("key").agg(F.collect_set("item").alias("items")))
    if fits_broadcast(asked, COPIED_ROWS, COPIED_BYTES):
        found = docs.join(F.broadcast(asked), "key")
    else:  # identical rows share a key; one with many rows is not sent to one task
        counts = docs.select("key").join(asked.select("key"), "key").groupBy("key").agg(F.count("*").alias("_count"))
        found = join_heavy(docs, asked.join(counts, "key"), ["key"])
    kind = dict(docs.dtypes)["doc_id"]
    return found.select("doc_id", "text", "items").mapInArrow(exact_scores(query), f"item int, doc_id {kind}, score long")


def first_of(scores: DataFrame, keys: list[str], wanted: int, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= wanted)


def weighed(index: DataFrame, items: list[str | None], totals) -> Query:
    """The terms of some items with their weights, from how many documents hold them."""
    counted = count_terms(pa.array([t or "" for t in items], pa.string()), WORDS_AND_NUMBERS)
    spark = index.sparkSession
    asked = spark.createDataFrame(
        pa.table({"term": counted.vocabulary, "place": pa.array(np.arange(len(counted.vocabulary)), pa.int64())})
    )
    told = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).select("x.terms", "x.holders")
    df = told.join(F.broadcast(asked), told["terms"] == asked["term"]).groupBy("place").agg(F.sum("holders").alias("df"))
    ratio = F.lit(2 * totals["n_docs"] + 2).cast("double") / (2 * F.col("df") + 1)
    known = df.select("place", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")).toArrow()
    weight = np.zeros(len(counted.vocabulary), dtype=np.int64)
    weight[known["place"].to_numpy()] = known["weight"].to_numpy()
    places, weights = [], []
    for item in range(len(items)):
        own = slice(*np.searchsorted(counted.text, [item, item + 1]))
        useful = weight[counted.term[own]] > 0
        places.append(counted.term[own][useful])
        weights.append((weight[counted.term[own]] * counted.count[own])[useful].astype(np.float64))
    return Query(counted.vocabulary, places, weights, totals["n_docs"], totals["n_terms"])


def search(
    docs: DataFrame, items: DataFrame, wanted: int = 20, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `wanted` best documents of each row of `items`, exactly.

    A NULL or empty text has no terms: such an item has no rows and such a document is never found. Repeated rows of
    either table are ranked each on their own. Equal scores go by doc_id, rows without one last. Columns beyond id and
    text are not looked at. Items are asked in groups of bounded size; all documents are looked at for each group.
    """
    spark = docs.sparkSession
    index = build_index(docs, doc_id=doc_id, text=text)
    totals = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), document_key(F.col(doc_id), F.col(text)).alias("key")
    )
    kinds = f"item_id {dict(items.dtypes)[item_id]}, rank int, doc_id {dict(docs.dtypes)[doc_id]}, score long"
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64).alias("size")).first()["size"] or 0
    groups = size // GROUP_BYTES + 1
    found = spark.createDataFrame([], kinds)
    if not totals["n_docs"]:
        return found
    for group in range(groups):
        of_group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group
        rows = asked.filter(of_group).collect()  # about GROUP_BYTES
        query = weighed(index, [r["text"] for r in rows], totals)
        if any(len(p) for p in query.places):
            found = found.unionByName(ranked(keyed, index, query, rows, wanted, kinds))
    return found


def ranked(docs: DataFrame, index: DataFrame, query: Query, rows: list, wanted: int, kinds: str) -> DataFrame:
    spark = docs.sparkSession
    slices, schema = index.select("keys", "lengths", "width", "slices"), "item int, key long, bound long"
    own = slices.mapInArrow(best_bounds(query, PROBES * wanted), schema)
    # The tasks' best go to a few tasks for each item before they come together in one.
    some = first_of(own.withColumn("part", F.pmod("key", F.lit(64))), ["item", "part"], PROBES * wanted, F.desc("bound"), F.col("key"))
    probes = first_of(some.drop("rank"), ["item"], PROBES * wanted, F.desc("bound"), F.col("key"))
    known = read_candidates(docs, probes.select("item", "key"), query)
    last = first_of(known, ["item"], wanted, F.desc("score")).groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    query.least = np.ones(len(rows), dtype=np.int64)
    for r in last.filter(F.col("n") == wanted).collect():  # one row for each item of the group
        query.least[r["item"]] = r["score"]
    reach = slices.mapInArrow(all_that_reach(query), schema)
    scores = read_candidates(docs, reach.select("item", "key"), query)
    best = first_of(scores, ["item"], wanted, F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, {kinds.split(',')[0]}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
