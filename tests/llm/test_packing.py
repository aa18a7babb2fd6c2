import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cardmill.llm.packing import best_fit, bounds_of, encoder, pack_documents, plan, reduce_by_dominance, token_pieces
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """The least number of bins, by trying all ways."""
    best = len(items)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= items[at] and room not in bins[:i]:
                place(at + 1, [*bins[:i], room - items[at], *bins[i + 1 :]])
        place(at + 1, [*bins, capacity - items[at]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
    fixed, left = reduce_by_dominance(Counter(items), 12)
    count = sum(times for _, times in fixed)
    rest = list(Counter(left).elements())
    assert sorted(rest + [s for sizes, times in fixed for s in sizes * times]) == sorted(items)
    assert all(sum(sizes) <= 12 for sizes, _ in fixed)
    assert count + (fewest(rest, 12) if rest else 0) == fewest(items, 12)


def test_best_fit_is_that_of_single_items():
    rng = random.Random(1)
    for _ in range(50):
        items = sorted((rng.randint(1, 30) for _ in range(80)), reverse=True)
        bins = []
        for size in items:
            fitting = [r for r in bins if r >= size]
            if fitting:
                bins.remove(min(fitting))
                bins.append(min(fitting) - size)
            else:
                bins.append(30 - size)
        made = best_fit(Counter(items), 30)
        assert sum(t for _, t in made) == len(bins)
        assert sorted(s for sizes, t in made for s in sizes * t) == sorted(items)


def test_plan_has_a_slot_for_every_item():
    counts = {1024: 7, 600: 5, 424: 3, 300: 10, 1: 2000}
    for size, count in counts.items():
        ranges = sorted((low, low + n) for s, low, n, _, _ in plan(counts, 1024) if s == size)
        assert ranges[0][0] == 0 and ranges[-1][1] == count
        assert all(a[1] == b[0] for a, b in itertools.pairwise(ranges))


def test_pieces_of_a_document():
    assert bounds_of(1, 4) == [(0, 1)] and bounds_of(4, 4) == [(0, 4)]
    assert bounds_of(9, 4) == [(0, 1), (1, 5), (5, 9)] and bounds_of(8, 4) == [(0, 4), (4, 8)]


def test_ids_are_those_of_the_file():
    slow, quick = Tokenizer.from_file(PATH), encoder(PATH)
    for text in ("", "Hello  world\n\n's été 漢字 😀 <|endoftext|> x", "   ", "a" * 500, "don't\t12345 #!? "):
        assert quick(text) == slow.encode(text, add_special_tokens=False).ids


def check(rows, texts, capacity):
    slow = Tokenizer.from_file(PATH)
    want = Counter()
    for number, text in texts:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for piece, (a, b) in enumerate(bounds_of(len(ids), capacity)):
            want[number, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    return len(filled)


def test_packing(docs_of):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["the", "Zürich", "xq"]) for _ in range(rng.choice([3, 30, 200])))) for i in range(120)]
    rows = pack_documents(docs_of(*texts), PATH, 64, 2).collect()
    used = check(rows, texts, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 2


def test_odd_documents(odd, empty):
    from odd_documents import ODD

    check(pack_documents(odd, PATH, 1024, 2).collect(), ODD, 1024)
    assert pack_documents(empty, PATH).count() == 0
    row = token_pieces(odd.filter("doc_id = 4"), PATH, with_ids=True).first()
    assert row.ids == [2] and row.length == 1


@pytest.mark.parametrize("run", [" ", "\n"])
def test_white_space_that_the_quick_engine_refuses(docs_of, run):
    text = "one two" + run * 2_000_000 + "three<|endoftext|>"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert encoder(PATH)(text) == want
    pieces = token_pieces(docs_of("a b", text), PATH, 1024).filter("doc_id = 1").collect()
    assert sum(p.length for p in pieces) == len(want) + 1
    last = max(pieces, key=lambda p: p.piece)
    assert last.ids_crc32 == zlib.crc32(np.array([*want, 2], dtype="<u4")[-last.length :].tobytes())
