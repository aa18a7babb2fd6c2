"""How far the sources of a language part in their words: run-length columns whose runs are intersected pair by pair.

The kept vocabulary of each language is put in an order that brings equal counts together: terms with the same number
of occurrences, and among them those with the same counts in the same sources. Along it each source is a column of
counts, stored as runs, most of them of zeros. For two sources the ends of their runs part the order into stretches on
which both counts stand still, so a value is computed once for a stretch and multiplied by its length.

The vocabulary is cut into ranges along this order; what a range adds to each pair is summed up afterwards, so no task
holds a column whole. A range holds at most as many columns as there are sources, and the result has a row for each two.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.common import stored, whole
from cardmill.llm.terms import LETTERS, blocks, count_terms

#: Text that is counted at once; counts of one source within it leave as one row for each term.
BLOCK_BYTES = 16 << 20
SCALE = 1_000_000_000
#: Counts of sources (not zeros) that a range of the vocabulary has when its runs are intersected; more make a new range.
RANGE_ENTRIES = 1 << 20

KEYS = ["lang", "source"]
#: The order of the vocabulary; terms with the same counts everywhere may lie in several ranges.
ORDER = ["lang", "total", "entries", "term"]


def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and documents with it, by lang and source."""
    for block in blocks(batches, "text", BLOCK_BYTES):
        found = count_terms(block.column("text"), LETTERS)
        both = [block.column(name).dictionary_encode() for name in KEYS]
        lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in both)
        group = (lang * len(both[1].dictionary) + source)[found.text]
        key = group * max(1, len(found.vocabulary)) + found.term
        distinct, place = np.unique(key, return_inverse=True)
        group, term = np.divmod(distinct, max(1, len(found.vocabulary)))
        lang, source = np.divmod(group, max(1, len(both[1].dictionary)))
        count = np.bincount(place, weights=found.count, minlength=len(distinct)).astype(np.int64)
        columns = [
            both[0].dictionary.take(pa.array(lang)),
            both[1].dictionary.take(pa.array(source)),
            found.vocabulary.take(pa.array(term)),
            pa.array(count),
            pa.array(np.bincount(place, minlength=len(distinct)).astype(np.int64)),
        ]
        yield pa.record_batch(columns, names=[*KEYS, "term", "count", "docs"])


def term_columns(docs: DataFrame, least_docs: int, *, lang: str, source: str, text: str) -> DataFrame:
    """(lang, term, total, entries): kept terms with their count in each source that has them, stored."""
    given = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("text"))
    rows = given.mapInArrow(counted_rows, "lang string, source string, term string, count long, docs long")
    counts = rows.groupBy(*KEYS, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # At most one entry for each source of the language, whatever the number of documents.
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"),
        F.sum("count").alias("total"),
        F.array_sort(F.collect_list(F.struct("source", "count"))).alias("entries"),
    )
    return stored(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "entries"), "divergence-terms")


def group_totals(docs: DataFrame, terms: DataFrame, *, lang: str, source: str) -> DataFrame:
    """(lang, source, n, v): every group that occurs, and each language under source NULL; n occurrences, v kept terms."""
    groups = docs.select(whole(lang).alias("lang"), whole(source).alias("source")).distinct()
    by_source = (
        terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.count").alias("n"))
    )
    by_lang = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    known = groups.join(by_source, KEYS, "left").join(by_lang, "lang", "left")
    filled = known.select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_lang", "v")])
    return stored(filled, "divergence-groups")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)); decimals hold the product at any size."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, (total + kept).cast("decimal(19,0)"))


def probabilities(counts: np.ndarray, total: int) -> np.ndarray:
    """The same for many counts: nine digits, three at a time, so that 64 bits suffice up to 9e15 occurrences."""
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), dtype=np.int64)
    whole_part, rest = np.divmod(rest, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return 1 + whole_part * SCALE + out


def runs_of(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of a column that is 0 but at `places`, which ascend."""
    if not len(places):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    joined = (np.diff(places) == 1) & (np.diff(counts) == 0)
    first, last = places[np.concatenate([[True], ~joined])], places[np.concatenate([~joined, [True]])] + 1
    values = counts[np.concatenate([[True], ~joined])]
    gap = np.concatenate([last[:-1] < first[1:], [last[-1] < length]])
    starts = np.concatenate([[0] if first[0] else [], first, last[gap]]).astype(np.int64)
    order = np.argsort(starts, kind="stable")
    held = np.concatenate([[0] if first[0] else [], values, np.zeros(gap.sum())]).astype(np.int64)
    return starts[order], held[order]


def parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(columns: dict[str, tuple[np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[str, str, int]]:
    """For both orders of each two columns (starts of runs, probabilities) the values summed over the range."""
    names = sorted(columns)
    for at, one in enumerate(names):
        starts, p = columns[one]
        for other in names[at + 1 :]:
            others, q = columns[other]
            cuts = np.union1d(starts, others)
            sizes = np.diff(cuts, append=length)
            own = p[np.searchsorted(starts, cuts, side="right") - 1]
            their = q[np.searchsorted(others, cuts, side="right") - 1]
            yield one, other, int((parted(own, their) * sizes).sum())
            yield other, one, int((parted(their, own) * sizes).sum())


class Range:
    """Terms of one language that follow each other in the order."""

    def __init__(self, lang: str, sources: dict[str, tuple[int, int]]):
        self.lang, self.sources = lang, sources
        self.length, self.size = 0, 0
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def add(self, entries: pa.ListArray) -> None:
        place = np.repeat(np.arange(len(entries)), np.diff(entries.offsets.to_numpy())) + self.length
        flat = entries.flatten()
        source = flat.field("source").dictionary_encode()
        code, count = source.indices.to_numpy(), flat.field("count").to_numpy()
        for number, name in enumerate(source.dictionary.to_pylist()):
            self.parts[name].append((place[code == number], count[code == number]))
        self.length, self.size = self.length + len(entries), self.size + len(flat)

    def sums(self) -> pa.RecordBatch:
        columns = {}
        for name, (n, v) in self.sources.items():
            parts = self.parts.get(name, [])
            places, counts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
            starts, values = runs_of(places, counts, self.length)
            columns[name] = starts, probabilities(values, n + v)
        found = list(pair_sums(columns, self.length))
        one, other, value = zip(*found, strict=True) if found else ((), (), ())
        arrays = [pa.array([self.lang] * len(found), pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string())]
        return pa.record_batch([*arrays, pa.array(value, pa.int64())], names=[*KEYS, "item", "value"])


def intersected(groups: dict[str, dict[str, tuple[int, int]]]):
    """Sums by pair of each range; the rows of a task come in the order of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Range | None = None
        for batch in batches:
            langs = batch.column("lang")
            at = 0
            while at < batch.num_rows:
                lang = langs[at].as_py()
                end = at + 1
                while end < batch.num_rows and langs[end].as_py() == lang:
                    end += 1
                if current and (current.lang != lang or current.size >= RANGE_ENTRIES):
                    yield current.sums()
                    current = None
                current = current or Range(lang, groups[lang])
                current.add(pa.concat_arrays([batch.column("entries").slice(at, end - at)]))
                at = end
        if current:
            yield current.sums()

    return work


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    # One row for each source of each language: the result holds the square of that.
    known: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
    for r in groups.select(*KEYS, "n", "v").toArrow().to_pylist():
        known[r["lang"]][r["source"]] = r["n"], r["v"]
    ordered = terms.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    sums = ordered.select("lang", "entries").mapInArrow(
        intersected(dict(known)), "lang string, source string, item string, value long"
    )
    summed = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select(*KEYS).join(groups.select("lang", F.col("source").alias("item")), "lang")
    pairs = pairs.filter(F.col("source") != F.col("item"))
    return pairs.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that are more probable in a source than in its language."""
    told = terms.select("lang", "term", "total", F.explode("entries").alias("e"))
    told = told.select("lang", F.col("e.source").alias("source"), "term", F.col("e.count").alias("count"), "total")
    told = told.join(F.broadcast(groups), KEYS)  # as many rows as groups, see pair_values
    p, q = probability(F.col("count"), F.col("n"), F.col("v")), probability(F.col("total"), F.col("n_lang"), F.col("v"))
    told = told.select(*KEYS, F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    gap = F.col("p") - F.col("q")
    return told.select(*KEYS, "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))


def source_divergence(
    docs: DataFrame, least_docs: int = 3, most_terms: int = 200, *, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source parts from every other, and by which terms from its language.

    NULL in any column reads as the empty text. Groups without a term stay: all counts are 0 there. A language without a
    kept term has values of 0. Repeated rows count as often as they stand; columns beyond the three are not looked at.
    An empty table gives no rows.
    """
    terms = term_columns(docs, least_docs, lang=lang, source=source, text=text)
    groups = group_totals(docs, terms, lang=lang, source=source)
    order = Window.partitionBy(*KEYS).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = pair_values(terms, groups).select(*KEYS, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    best = term_values(terms, groups).withColumn("rank", rank).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(best.select(*KEYS, F.lit("term").alias("part"), "item", "value", "rank"))
