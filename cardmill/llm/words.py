"""Word hashes and word windows of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from cardmill.llm.common import mix

#: A table: is this byte a separator of words?
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spread the number of a word's block of eight bytes; one for each of the two hashes.
STEP, OTHER_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: About this many bytes are hashed at once; a slice ends at the end of a word.
SLICE = 1 << 20
#: Odd factors, one for each place in a window.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
OTHER_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Words:
    """All words of several texts, in order: a hash of each, and the number of the text it is in."""

    hashes: np.ndarray
    text: np.ndarray
    #: For each text the index of its first word, and the number of all words at the end.
    first: np.ndarray
    #: For each wanted length (up to eight) a hash of the word's first bytes, at most so many.
    prefixes: tuple[np.ndarray, ...] = ()
    #: A second hash of each word, which tells nothing about the first; where it was asked for.
    others: np.ndarray | None = None


def slices(data: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        end = min(len(data), start + SLICE)
        while end < len(data):
            gaps = np.flatnonzero(gap[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + 4096)
        yield start, end
        start = end


def words_of(
    texts: list[bytes],
    *,
    lower: bool = False,
    gap: np.ndarray = SPACE,
    prefixes: tuple[int, ...] = (),
    others: bool = False,
) -> Words:
    """Hash each word of each text; equal words have equal hashes wherever they are. `gap` marks the separators.

    A word is read in blocks of eight bytes. Each block is mixed with its number before the blocks are summed, so that
    words of the same bytes in another order, however regular, have nothing in common.
    """
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, seconds, places, heads = [], [], [], [[] for _ in prefixes]
    for start, end in slices(joined, gap):
        data = joined[start:end]
        letters = np.flatnonzero(~gap[data])
        if not len(letters):
            continue
        opens = np.flatnonzero(np.diff(letters, prepend=-2) != 1)
        lengths = np.diff(opens, append=len(letters))
        within = np.arange(len(letters)) - np.repeat(opens, lengths)
        values = (LOWER[data[letters]] if lower else data[letters]).astype(np.uint64)
        values <<= ((within & 7) << 3).astype(np.uint64)
        first = np.flatnonzero((within & 7) == 0)
        blocks, number = np.add.reduceat(values, first), (within[first] >> 3).astype(np.uint64)
        words = np.searchsorted(first, opens)
        size = lengths.astype(np.uint64)
        hashes.append(mix(np.add.reduceat(mix(blocks ^ mix(number * STEP)), words) + size))
        if others:
            seconds.append(mix(np.add.reduceat(mix(mix(blocks + OTHER_STEP) ^ (number * OTHER_STEP)), words) ^ size))
        places.append(letters[opens] + start)
        for head, length in zip(heads, prefixes, strict=True):
            early = blocks[words] & np.uint64((1 << 8 * length) - 1)
            head.append(mix(mix(early) + np.uint64(length)))
    none = np.zeros(0, np.uint64)
    at = np.concatenate([np.zeros(0, np.int64), *places])
    first = np.searchsorted(at, begins)
    parts = tuple(np.concatenate([none, *head]) for head in heads)
    second = np.concatenate([none, *seconds]) if others else None
    return Words(np.concatenate([none, *hashes]), np.repeat(np.arange(len(texts)), np.diff(first)), first, parts, second)


def windows(words: Words, width: int, *, other: bool = False) -> np.ndarray:
    """A hash of the `width` words from each word on; only those that `within_text` marks lie in one text.

    With `other` it is made from the words' second hashes, by other factors.
    """
    hashes, factors = (words.others, OTHER_FACTORS) if other else (words.hashes, FACTORS)
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : j + count] * factors[j]
    return mix(total)


def within_text(words: Words, width: int) -> np.ndarray:
    """Does the window that begins at each word end in the same text?"""
    count = max(0, len(words.hashes) - width + 1)
    return words.text[:count] == words.text[width - 1 : width - 1 + count]


def covered(starts: np.ndarray, width: int, count: int) -> np.ndarray:
    """Marks the `count` words that lie in a window that begins at one of `starts`."""
    edge = np.zeros(count + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers by byte position, low bytes first: high bytes are mostly zero, so the shuffle compresses them."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, count).T
    return out.view("<u8").reshape(-1)
