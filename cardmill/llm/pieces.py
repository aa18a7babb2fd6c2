"""SentencePiece encoding and decoding: a lattice of pieces made by an equality join, and the best path by a fold."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.llm.common import shuffle_partitions, small_batches, whole

#: Stands for a space in pieces.
MARK = "▁"
#: A character without a piece scores this much less than the worst piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Words of more characters are folded in Python by the same recurrence: a fold copies its state at every step.
LONG_WORD = 256
#: The piece table is copied to every task only up to this many pieces.
MOST_PIECES = 1_000_000
#: What a decoder shows for ids that stand for nothing.
LOST = "\N{REPLACEMENT CHARACTER}".encode()
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20

#: A character that is no letter, digit or mark.
SIGN = re.compile(f"[^\\w{MARK}]")


@dataclass
class Pieces:
    """The piece table of a model file, and what else of the model encoding needs."""

    rows: list[tuple[str, int, float]]
    names: list[str]
    byte_ids: dict[int, int]
    unknown: int
    longest: int = field(init=False)
    unknown_score: float = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)
        self.unknown_score = min((s for _, _, s in self.rows), default=0.0) - UNKNOWN_PENALTY
        if len(self.rows) > MOST_PIECES:
            raise ValueError(f"{len(self.rows)} pieces are too many to copy to every task")
        if any("\n" in p or MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p, _, _ in self.rows):
            raise ValueError("pieces of this model reach over words or lines")

    @cached_property
    def pairs(self) -> frozenset[str]:
        """All two characters that stand side by side in a piece; no piece reaches over any others."""
        return frozenset(p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1))

    def cut(self, word: str) -> list[str]:
        """A word cut beside its signs where no piece reaches over; its path is that of its parts.

        Words that differ in the signs around them have parts in common, so there are fewer different ones.
        """
        if word.isalnum() or SIGN.search(word) is None:
            return [word]
        if word[:-1].isalnum():  # nearly all words with a sign have one at their end
            return [word] if word[-2:] in self.pairs else [word[:-1], word[-1]]
        places = {at for sign in SIGN.finditer(word) for at in (sign.start(), sign.end())} - {0, len(word)}
        gaps = sorted(at for at in places if word[at - 1 : at + 1] not in self.pairs)
        return [word[a:b] for a, b in zip([0, *gaps], [*gaps, len(word)], strict=True)]

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.rows}

    @cached_property
    def bytes_of(self) -> dict[int, int]:
        return {i: b for b, i in self.byte_ids.items()}


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    plain = [
        i
        for i in range(len(model))
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    byte_ids = {int(names[i][3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
    return Pieces([(names[i], i, model.get_score(i)) for i in plain], names, byte_ids, model.unk_id())


#: No piece reaches over the beginning of a word's marks, or over a line's end.
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def words_of(text: str) -> list[str]:
    """The words of a text as it is encoded: a mark in front, a mark for each space."""
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


# --- the lattice of distinct words, as rows ---------------------------------------------------------------------


def best_path(edges: Column) -> Column:
    """Piece ids of the best path through a word's edges, by a fold over them in the order of their ends.

    The state has for each end so far the best score and the ids of the path that gave it. Of paths with equal scores
    the one whose last differing piece is longer wins.
    """

    def step(state: Column, edge: Column) -> Column:
        before = F.get(state, edge["start"])
        score = before["score"] + edge["score"]
        entry = F.struct(score.alias("score"), F.concat(before["ids"], F.array(edge["piece"])).alias("ids"))
        known = F.coalesce(F.get(state, edge["end"])["score"] >= score, F.lit(False))
        return F.when(known, state).otherwise(F.concat(F.slice(state, 1, edge["end"]), F.array(entry)))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))
    return F.aggregate(F.sort_array(edges), first, step, lambda state: F.element_at(state, -1)["ids"])


def encode_words(words: DataFrame, pieces: Pieces, *also: str) -> DataFrame:
    """(also, word, ids) for distinct words: substrings up to the longest piece, joined to the pieces, folded by word.

    `also` are columns that depend on the word; words dealt out by them are not dealt out again.
    """
    spark = words.sparkSession
    table = spark.createDataFrame(pieces.rows, "_piece string, _id int, _score double")
    length = F.char_length("word")
    starts = words.filter(length > 0).select(*also, "word", F.explode(F.sequence(F.lit(0), length - 1)).alias("start"))
    ends = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), length - F.col("start")))
    spans = starts.select(*also, "word", "start", F.explode(ends).alias("length"))
    exploded = spans.withColumn("_piece", F.substring("word", F.col("start") + 1, F.col("length")))
    # A single character without a piece is an edge too, so every word has a path.
    edges = exploded.join(F.broadcast(table), "_piece", "left").filter(F.col("_id").isNotNull() | (F.col("length") == 1))
    edge = F.struct(
        (F.col("start") + F.col("length")).alias("end"),
        "start",
        F.coalesce("_id", F.lit(pieces.unknown)).alias("piece"),
        F.coalesce("_score", F.lit(pieces.unknown_score)).alias("score"),
    )
    lattice = edges.groupBy(*also, "word").agg(F.collect_list(edge).alias("edges"))
    return lattice.select(*also, "word", best_path(F.col("edges")).alias("ids"))


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """The same path in Python, for words too long for a fold."""
    states: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        best = None
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.table.get(word[start:end])
            if found is None and end - start > 1:
                continue
            piece, score = found or (pieces.unknown, pieces.unknown_score)
            score += states[start][0]
            if best is None or score > best[0]:
                best = (score, start, piece)
        states.append(best)
    ids, at = [], len(word)
    while at:
        ids.append(states[at][2])
        at = states[at][1]
    return ids[::-1]


def with_bytes(word: str, ids: list[int], pieces: Pieces) -> list[int]:
    """Characters without a piece as the pieces of their bytes, where the model has them."""
    if pieces.unknown not in ids or not pieces.byte_ids:
        return ids
    out, at = [], 0
    for i in ids:
        if i == pieces.unknown:
            out += [pieces.byte_ids[b] for b in word[at].encode()]
            at += 1
        else:
            out.append(i)
            at += len(pieces.names[i])
    return out


# --- documents: chunks ask for the ids of their distinct words -----------------------------------------------------


def squeezed(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    lengths = struct.pack(f"<{len(parts)}I", *map(len, parts))
    return zstandard.compress(struct.pack("<I", len(parts)) + lengths + b"".join(parts), 3)


def opened(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    count = struct.unpack_from("<I", data)[0]
    at, out = 4 + 4 * count, []
    for length in struct.unpack_from(f"<{count}I", data, 4):
        out.append(data[at : at + length])
        at += length
    return out


def lines_of(text: str) -> Iterator[tuple[str | None, list[str], list[str]]]:
    """The words of a text a line at a time, split as quickly as can be.

    A line gives its first word where that has no mark (None in the first line, which begins with one), the words that
    have one mark, without it, and those of a line with runs of spaces as they are.
    """
    for number, line in enumerate(text.split("\n")):
        parts = line.split(" ")
        head = parts.pop(0) if number else None
        if "" in parts:
            yield head, [], WORD.findall(MARK + MARK.join(parts))
        else:
            yield head, parts, []


class Job:
    def __init__(self, pieces: Pieces, buckets: int):
        self.pieces, self.buckets = pieces, buckets

    def words(self, table: pa.Table) -> dict[str, list[str]]:
        """The distinct words of a chunk, each with its parts."""
        marked: set[str] = set()
        distinct: set[str] = set()
        for blob in table.column("texts").to_pylist():
            for data in opened(blob):
                if data:
                    for head, parts, odd in lines_of(data.decode()):
                        marked.update(parts)
                        distinct.update(odd)
                        if head is not None:
                            distinct.update(("\n", head) if head else ("\n",))
        cut = self.pieces.cut
        words = {word: cut(word) for word in distinct}
        for word in marked:
            # A mark reaches over to any letter as far as cutting goes, so a word is cut without it.
            head, *rest = (word,) if word.isalnum() else cut(word)
            words[MARK + word] = [MARK + head, *rest]
        return words

    def asked(self, words: dict[str, list[str]]) -> Iterator[tuple[int, list[bytes]]]:
        """The distinct parts of words by bucket, in order."""
        by_bucket: list[list[bytes]] = [[] for _ in range(self.buckets)]
        crc, count = zlib.crc32, self.buckets
        for part in sorted({part.encode() for parts in words.values() for part in parts}):
            by_bucket[crc(part) % count].append(part)
        return ((bucket, own) for bucket, own in enumerate(by_bucket) if own)

    def ask(self, key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        rows = [(bucket, chunk, squeezed(words)) for bucket, words in self.asked(self.words(table))]
        return arrow(rows, [("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())])

    @staticmethod
    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for blob in table.column("words").to_pylist():
            words.update(opened(blob))
        short = [w for w in map(bytes.decode, sorted(words)) if len(w) <= LONG_WORD]
        buckets = np.full(len(short), key[0].as_py(), dtype=np.int32)
        return pa.table({"bucket": pa.array(buckets), "word": pa.array(short, pa.string())})

    def reply(self, asked: pa.Table, folded: pa.Table) -> pa.Table:
        ids = {}
        paths = folded.column("ids").combine_chunks()
        flat, ends = paths.values.to_numpy().astype("<i4"), paths.offsets.to_numpy()
        for i, word in enumerate(folded.column("word").to_pylist()):
            path = flat[ends[i] : ends[i + 1]]
            if self.pieces.unknown in path:
                path = np.array(with_bytes(word, path.tolist(), self.pieces), dtype="<i4")
            ids[word.encode()] = path.tobytes()
        rows = []
        for bucket, chunk, blob in zip(*(asked.column(c).to_pylist() for c in ("bucket", "chunk", "words")), strict=True):
            words = opened(blob)
            for word in words:
                if word not in ids:
                    text = word.decode()
                    path = with_bytes(text, viterbi(text, self.pieces), self.pieces)
                    ids[word] = np.array(path, dtype="<i4").tobytes()
            rows.append((chunk, bucket, squeezed([ids[word] for word in words])))
        return arrow(rows, [("chunk", pa.int64()), ("bucket", pa.int32()), ("paths", pa.binary())])

    def encode(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        paths = dict(zip(replies.column("bucket").to_pylist(), replies.column("paths").to_pylist(), strict=True))
        words = self.words(table)
        found: dict[str, bytes] = {}
        for bucket, parts in self.asked(words):
            found.update(zip(map(bytes.decode, parts), opened(paths.pop(bucket)), strict=True))
        known = {word: b"".join([found[part] for part in parts]) for word, parts in words.items()}
        marked = {word[1:]: path for word, path in known.items() if word[0] == MARK}
        numbers, ids = [], []
        for row, blob in zip(table.column("doc_ids").to_pylist(), table.column("texts").to_pylist(), strict=True):
            for number, data in zip(row, opened(blob), strict=True):
                out: list[bytes] = []
                for head, parts, odd in lines_of(data.decode()) if data else ():
                    if head is not None:
                        out.append(known["\n"])
                        if head:
                            out.append(known[head])
                    out += map(marked.__getitem__, parts)
                    out += map(known.__getitem__, odd)
                numbers.append(number)
                ids.append(np.frombuffer(b"".join(out), dtype="<i4"))
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        return pa.Table.from_arrays([pa.array(numbers, pa.int64()), lists], names=["doc_id", "ids"])


def arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    schema = pa.schema(fields)
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def packed_texts(docs: DataFrame) -> DataFrame:
    """Documents in compressed groups, dealt into chunks by their id: texts are most of what is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            groups: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for chunk, number, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                groups[chunk][0].append(number)
                groups[chunk][1].append(text.encode())
            rows = [(chunk, ids, squeezed(texts)) for chunk, (ids, texts) in sorted(groups.items())]
            fields = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.binary())]
            yield from arrow(rows, fields).to_batches()

    return docs.mapInArrow(pack, "chunk long, doc_ids array<long>, texts binary")


def encode_documents(docs: DataFrame, pieces: Pieces, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (the pieces of the best path through each word of the whole text) for each row of `docs`.

    A NULL or empty text has no ids. Repeated rows stay. Characters without a piece become byte pieces. Extra columns
    are dropped.

    Texts are dealt into chunks. A chunk asks for each of its words once; the distinct words of all chunks make up the
    lattice, whose rows stay with their word from the first shuffle to the fold; the ids go back in the order in which
    they were asked for. So the lattice grows with the number of different words, not with the text.
    """
    spark = docs.sparkSession
    told = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = shuffle_partitions(spark)
    chunks = max(partitions, math.ceil(size / CHUNK_BYTES))
    # Small parts, as the edges of a part's words are sorted in memory.
    buckets = max(4 * partitions, math.ceil(size / BUCKET_BYTES))
    job = Job(pieces, buckets)
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).alias("chunk")
    texts = packed_texts(told.select(chunk, "doc_id", "text")).groupBy("chunk")
    asked = texts.applyInArrow(lambda key, rows: job.ask(key, rows), "bucket int, chunk long, words binary")
    # Dealt out by bucket twice, with the words alone the second time; lattice and replies stay where the words are.
    asked = asked.repartition(buckets, "bucket")
    words = asked.groupBy("bucket").applyInArrow(lambda key, rows: job.distinct(key, rows), "bucket int, word string")
    folded = encode_words(words.repartition(buckets, "bucket"), pieces, "bucket")
    replies = asked.groupBy("bucket").cogroup(folded.groupBy("bucket"))
    replies = replies.applyInArrow(lambda rows, paths: job.reply(rows, paths), "chunk long, bucket int, paths binary")
    both = texts.cogroup(replies.groupBy("chunk"))
    return both.applyInArrow(lambda key, rows, found: job.encode(rows, found), "doc_id long, ids array<int>")


def decode(ids: Column | str, pieces: Pieces) -> Column:
    """The text of a list of ids; byte pieces are put together, marks become spaces, the first one is left out.

    NULL stays NULL; ids outside the table, and bytes that make up no character, give the replacement character.
    """
    parts = [
        bytes([pieces.bytes_of[i]]) if i in pieces.bytes_of else name.replace(MARK, " ").encode()
        for i, name in enumerate(pieces.names)
    ]
    parts[pieces.unknown] = LOST
    # One constant: the bytes of every piece in hexadecimal.
    table = F.split(F.lit(",".join(part.hex() for part in parts)), ",")
    found = F.transform(ids, lambda i: F.coalesce(F.get(table, F.when(i >= 0, i)), F.lit(LOST.hex())))
    text = F.make_valid_utf8(F.unhex(F.array_join(found, "")).cast("string"))
    return F.regexp_replace(text, r"\A ", "")
