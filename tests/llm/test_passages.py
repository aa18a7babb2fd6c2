import random

from cardmill.llm.passages import remove_repeated_passages
from cardmill.llm.words import from_planes, planes, windows, words_of
from odd_documents import ODD


def brute(rows, window):
    starts = {}
    for number, text in rows:
        words = (text or "").encode().split()
        own = float("inf") if number is None else number
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            starts[key] = min(own, starts.get(key, own))
    out = []
    for number, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            if starts[tuple(words[a : a + window])] < (float("inf") if number is None else number):
                gone[a : a + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((number, len(words), sum(gone), kept))
    return sorted(out, key=str)


def found(docs, window):
    rows = remove_repeated_passages(docs, window).collect()
    for r in rows:
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed
        assert all(x.end - x.start >= window for x in r.repeats)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def test_against_brute_force(docs_of):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 40))) for _ in range(8)]
    texts = [
        " ".join(rng.choice(passages) if rng.random() < 0.4 else rng.choice("klmnopqr") for _ in range(rng.randint(0, 30)))
        for _ in range(60)
    ]
    rows = [(rng.randint(0, 50), t) for t in texts]
    for window in (4, 5, 13):
        assert found(docs_of(*rows), window) == brute(rows, window)


def test_one_passage_in_every_document(docs_of):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"x{i} {shared} y{i} {shared} z{i}") for i in range(300)]
    assert found(docs_of(*rows), 13) == brute(rows, 13)


def test_odd_documents(odd, empty):
    assert found(odd, 13) == brute(ODD, 13)
    assert found(empty, 13) == []


def test_words_are_those_of_the_pattern():
    texts = [b"a b\x0bc\x1cd \xc2\xa0 e", b"", b" \n ", b"z" * 3000000 + b" z"]
    words = words_of(texts)
    assert list(words.first) == [0, 5, 5, 5, 7] and len(words.hashes) == 7
    assert words.hashes[0] == words_of([b"x a"]).hashes[1]
    assert len(windows(words, 7)) == 1 and len(windows(words_of([b"a"]), 2)) == 0
    assert list(from_planes(planes(words.hashes, 8), 7, 8)) == list(words.hashes)


def thue_morse(size, one=b"a", other=b"b"):
    return b"".join((one, other)[bin(i).count("1") % 2] for i in range(size))


def test_regular_words_do_not_collide(docs_of):
    for size in (1 << 10, 1 << 11, 1 << 12):
        words = [thue_morse(size), thue_morse(size, b"b", b"a"), thue_morse(size)[::-1] + b"c", b"a" * size]
        made = words_of([b" ".join(words)], others=True)
        assert len(set(made.hashes.tolist())) == len(set(made.others.tolist())) == 4
        assert not set(made.hashes.tolist()) & set(made.others.tolist())
    rest = " ".join(f"w{i}" for i in range(12))
    one, other = (thue_morse(1 << 10, *letters).decode() for letters in ((b"a", b"b"), (b"b", b"a")))
    rows = remove_repeated_passages(docs_of(f"{one} {rest}", f"{other} {rest}", f"{one} {rest}"), 13).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 0, 2: 13}
    swapped = words_of([b"abcdefgh12345678 12345678abcdefgh abcdefgh abcdefgh1"], prefixes=(4, 8))
    assert len(set(swapped.hashes.tolist())) == 4 and len(set(swapped.prefixes[0].tolist())) == 2
    assert swapped.prefixes[1][0] == swapped.prefixes[1][2] == swapped.prefixes[1][3] != swapped.prefixes[1][1]
