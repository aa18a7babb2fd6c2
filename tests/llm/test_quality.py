import random
import re
from collections import Counter, defaultdict

from cardmill.llm.quality import normalised, quality_rules

from odd_documents import ODD

SPACE = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def slow_line(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return re.sub("[0-9]", "0", " ".join(re.findall(WORD, low)))


def brute(rows, limit, copies_are_one=False):
    """Rows of (doc_id, text, host). With copies_are_one, a text counts once at a host and its first id keeps lines."""
    having = defaultdict(dict)
    for at, (number, text, host) in enumerate(rows):
        document = text if copies_are_one else (text, at if number is None else f"id {number}")
        for line in {slow_line(x) for x in text.split("\n") if x.strip(SPACE)}:
            order = (number is None, number or 0)
            having[host, line][document] = min(order, having[host, line].get(document, order))
    out = []
    for number, text, host in rows:
        words = re.findall(WORD, text)
        seen, repeated_lines = set(), 0
        for line in text.split("\n"):
            if line.strip(SPACE):
                repeated_lines += line in seen
                seen.add(line)
        count = Counter(tuple(words[a : a + 8]) for a in range(len(words) - 7))
        marks = [False] * len(words)
        for a in range(len(words) - 7):
            if count[tuple(words[a : a + 8])] > 1:
                marks[a : a + 8] = [True] * 8
        failed = len(words) < 20 or 100 * sum(marks) > 30 * len(words)
        gone = 0
        for line in text.split("\n"):
            if line.strip(SPACE) and len(had := having[host, slow_line(line)]) > limit:
                stays = copies_are_one and min(had, key=had.get) == text
                gone += 0 if stays else len(re.findall(WORD, line))
        left = len(words) - gone
        kept = not failed and left >= 20 and 2 * left >= len(words)
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        out.append((number, len(words), sum(map(len, words)), symbols, repeated_lines, sum(marks), failed, kept, gone))
    return sorted(out, key=str)


def found(docs, limit, **how):
    rows = quality_rules(docs, limit, **how).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((tuple(r[n] for n in (*names, "n_frequent_words")) for r in rows), key=str)


def test_against_brute_force(docs_of):
    rng = random.Random(7)
    common = [" ".join(rng.choice("abcdef") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 25))) for _ in range(6)]
    rows = []
    for i in range(90):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"{rng.random()} Own # é" * 3 for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines), f"h{i % 3}"))
    docs = None
    for host in ("h0", "h1", "h2"):
        own = docs_of(*[(i, t) for i, t, h in rows if h == host], source=host)
        docs = own if docs is None else docs.unionByName(own)
    assert found(docs, 5, count_copies=False, first_keeps=True) == brute(rows, 5, copies_are_one=True)
    want = brute(rows, 5)
    assert found(docs, 5) == want
    assert any(r[8] for r in want) and any(r[7] for r in want) and not all(r[7] for r in want)


def test_documents_are_counted(docs_of):
    line = " ".join(f"w{i}" for i in range(30))
    own = " ".join(f"o{i}" for i in range(20))
    copies = [(i, f"{line}\n{own}") for i in range(11)]
    assert not any(r.kept for r in quality_rules(docs_of(*copies), 10).collect())
    assert all(r.kept for r in quality_rules(docs_of(*copies[:10], *copies[:10]), 10).collect())  # repeated rows
    no_id = [(None, text) for _, text in copies]
    assert not any(r.kept for r in quality_rules(docs_of(*no_id), 10).collect())


def test_one_document_keeps_a_frequent_line(docs_of):
    line = " ".join(f"w{i}" for i in range(30))
    texts = [f"{line}\nown {i}" for i in range(12)] + [f"{line}\nown 0"] * 50
    docs = docs_of(*texts)
    rows = {r.doc_id: r for r in quality_rules(docs, 10, count_copies=False, first_keeps=True).collect()}
    assert [rows[i].kept for i in range(12)] == [True] + [False] * 11
    assert all(rows[i].kept for i in range(12, 62))  # copies of the first document
    assert not any(r.kept for r in quality_rules(docs, 10).collect())


def test_odd_documents(odd, empty, docs_of):
    assert found(odd, 50) == brute([(i, t or "", "s") for i, t in ODD], 50)
    assert found(empty, 50) == []
    assert found(docs_of((1, "a"), source=None), 0) == brute([(1, "a", None)], 0)
    assert normalised(b" A  b\x0b9 ") == b"a b 0"
