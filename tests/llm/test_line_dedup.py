import random

import corpus_pipeline
from cardmill.llm import line_dedup
from cardmill.llm.line_dedup import line_windows, remove_repeated_runs, repeated_runs

from odd_documents import ODD

SPACE = " \t\n\v\f\r"


def brute(rows, width):
    """Distinct (id, text) in order; a later run of lines goes, judged on the input."""
    first, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for number, text in order:
        lines = (text or "").split("\n")
        places = [i for i, line in enumerate(lines) if line.strip(SPACE)]
        own = [lines[i].strip(SPACE) for i in places]
        gone = set()
        for a in range(len(own) - width + 1):
            key = tuple(own[a : a + width])
            there = first.setdefault(key, (number, text, a))
            if there[:2] != (number, text) or a >= there[2] + width:
                gone |= {places[a + j] for j in range(width)}
        out[number, text] = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def check(docs, rows, width):
    made = remove_repeated_runs(docs, width)
    assert made.columns == docs.columns
    want = brute(rows, width)
    assert sorted(map(str, ((r.doc_id, r.text) for r in made.collect()))) == sorted(
        str((i, want[i, t])) for i, t in rows
    )


def test_against_brute_force(docs_of):
    rng = random.Random(11)
    runs = [[rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))] for _ in range(5)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [f"own {rng.random()}", "", "  a "]
        rows.append((i, "\n".join(lines)))
    for width in (1, 2, 3):
        check(docs_of(*rows), rows, width)


def test_a_line_many_times_and_one_run_everywhere(docs_of):
    rows = [(0, "\n".join("a" * 10)), (1, "b\nc\nd\nown"), *[(i, f"x{i}\nb\nc\nd\ny{i}") for i in range(2, 200)]]
    check(docs_of(*rows), rows, 3)
    text = remove_repeated_runs(docs_of(*rows), 3).filter("doc_id = 0").first().text
    assert text == "a\na\na"


def test_odd_documents(docs_of, odd, empty):
    check(odd, [(i, t) for i, t in ODD], 3)
    assert remove_repeated_runs(empty).count() == 0
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a \n\n b\nc\nd"), (None, "a\nb\nc"), (3, None)]
    check(docs_of(*rows), rows, 3)


def test_repeated_rows_with_and_without_ids(docs_of):
    own, shared = "a\nb\nc", "p\nq\nr\ns"
    rows = [(1, own)] * 3 + [(2, shared)] * 2 + [(None, shared)] * 2 + [(None, f"x\n{shared}")] + [(None, "k\nl\nm")] * 2
    check(docs_of(*rows), rows, 3)
    told = [(r.doc_id, [(x["at"], x["lines"]) for x in r.runs]) for r in repeated_runs(docs_of(*rows), 3).collect()]
    assert sorted(told, key=str) == [(None, [(0, 3), (1, 3)]), (None, [(1, 3), (2, 3)])]


def test_windows_are_stored_unshuffled_and_texts_unsorted(docs_of, monkeypatch):
    plans = []

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    def told(frame, name):
        plans.append(plan(frame))
        return stored(frame, name)

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", told)
    made = remove_repeated_runs(docs_of((1, "a\nb\nc"), (2, "a\nb\nc")), 3)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    outer = [line for line in plan(made).split("\n") if "LeftOuter" in line]
    assert len(outer) == 1 and "ShuffledHashJoin" in outer[0]


def test_equal_runs_select_equal_fingerprints():
    one, two = b"x\na\nb\nc\ny", b"p\nq\na\nb\nc"
    marks = [dict(zip(low.tolist(), mark.tolist(), strict=True)) for mark, _, low, _ in (line_windows(t, 3) for t in (one, two))]
    (shared,) = marks[0].keys() & marks[1].keys()
    assert marks[0][shared] == marks[1][shared] and line_windows(b"a\nb", 3) is None


def brute_with_words(rows, width, least_words):
    """The same as `brute`, where shorter runs of enough words count too."""
    first, out = {}, {}
    for number, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        places = [i for i, line in enumerate(lines) if line.strip(SPACE)]
        own = [lines[i].strip(SPACE) for i in places]
        gone = set()
        for n in range(1, width + 1):
            for a in range(len(own) - n + 1):
                key = tuple(own[a : a + n])
                if n < width and len(" ".join(key).split()) < least_words:
                    continue
                there = first.setdefault(key, (number, text, a))
                if there[:2] != (number, text) or a >= there[2] + n:
                    gone |= {places[a + j] for j in range(n)}
        out[number, text] = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_passages_of_one_or_two_lines(docs_of):
    rng = random.Random(4)
    one, half = " ".join(f"w{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "xy"]
    rows = [(1, f"a\n{one}\nb"), (2, f"c\n {one} \nd"), (3, one), (4, "e\n" + "\n".join(half) + "\nf")]
    rows += [(5, "g\n" + "\n\n".join(half) + "\nh"), (6, f"i\n{half[0]}\nj"), (7, f"{one}\n{one}")]
    lines = [one, *half, "short", *(" ".join(rng.choice("pq") for _ in range(n)) for n in (10, 20, 49, 50, 51))]
    rows += [(100 + i, "\n".join(rng.choice([*lines, f"own {i}"]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    want = brute_with_words(rows, 3, 50)
    made = {r.doc_id: r.text for r in remove_repeated_runs(docs_of(*rows), 3, 50).collect()}
    assert made == {i: want[i, t] for i, t in rows}
    assert [made[i] for i in range(2, 8)] == ["c\nd", "", rows[3][1], "g\n\nh", rows[5][1], ""]
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(None, docs_of(*rows), "").collect()} == made
