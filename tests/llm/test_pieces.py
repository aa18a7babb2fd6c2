import random

import public_tokenizers
import pytest
import sentencepiece
from cardmill.llm.pieces import Pieces, decode, encode_documents, encode_words, load_pieces, viterbi, with_bytes, words_of

from odd_documents import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PATH)


def varint(data, at):
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return value, at


def as_unigram(data):
    """The same pieces in a model file of the kind whose encoding is the best-scoring path (field 3 of field 2)."""
    at, out = 0, bytearray(data)
    while at < len(data):
        key, at = varint(data, at)
        size, at = varint(data, at)
        if key == 2 << 3 | 2:
            inner = at
            while inner < at + size:
                field, inner = varint(data, inner)
                if field == 3 << 3:
                    out[inner] = 1
                    return bytes(out)
                if field & 7 == 0:
                    _, inner = varint(data, inner)
                elif field & 7 == 5:
                    inner += 4
                else:
                    skip, inner = varint(data, inner)
                    inner += skip
        at += size
    raise ValueError("no model type")


def test_encoding_is_that_of_the_library(spark, pieces):
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(PATH, "rb").read()))
    texts = ["Hello world", "  two  spaces", "été 漢字 😀 \x7f", "line\nbreak\n", "internationalisation of words", "a" * 40]
    scores = {i: s for _, i, s in pieces.rows}
    for text in texts:
        own = [i for w in words_of(text) for i in with_bytes(w, viterbi(w, pieces), pieces)]
        theirs = library.encode(text)
        # Paths of equal score may differ; the scores may not.
        assert sum(scores.get(i, 0) for i in own) == sum(scores.get(i, 0) for i in theirs)
        assert library.decode(own) == text == library.decode(theirs)


def test_fold_agrees_with_python(spark, pieces):
    rng = random.Random(12)
    words = {"▁" + "".join(rng.choice("etaoinsé漢.") for _ in range(rng.randint(0, 14))) for _ in range(300)} | {"▁▁▁", "\n"}
    rows = encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()
    assert {r.word: r.ids for r in rows} == {w: viterbi(w, pieces) for w in words}


def test_words_are_cut_where_no_piece_reaches_over(pieces):
    for word in ("▁end.", "▁naïve漢字x", "▁▁▁", "\n", "a", "▁...!!#abc"):
        parts = pieces.cut(word)
        assert "".join(parts) == word and [i for p in parts for i in viterbi(p, pieces)] == viterbi(word, pieces)
    assert pieces.cut("▁end.") == ["▁end", "."] or "d." in pieces.pairs


def test_ties_go_to_the_longer_last_piece(spark):
    pieces = Pieces([("▁", 1, 0.0), ("a", 2, -1.0), ("b", 3, -1.0), ("c", 4, -1.0), ("ab", 5, -1.0), ("bc", 6, -1.0)],
                    ["<unk>", "▁", "a", "b", "c", "ab", "bc"], {}, 0)
    row = encode_words(spark.createDataFrame([("▁abcz",)], "word string"), pieces).first()
    assert row.ids == viterbi("▁abcz", pieces) == [1, 2, 6, 0]


def test_pieces_that_reach_over_words_are_refused():
    with pytest.raises(ValueError, match="reach over"):
        Pieces([("a▁b", 1, 0.0)], ["a▁b"], {}, 0)


def test_documents(spark, docs_of, odd, empty, pieces):
    texts = [*ODD, (20, "w" * 600 + " x"), (21, "  lead and trail  ")]
    rows = encode_documents(docs_of(*texts), pieces).withColumn("back", decode("ids", pieces)).collect()
    want = sorted(
        str((i, [p for w in words_of(t or "") for p in with_bytes(w, viterbi(w, pieces), pieces)], t or "")) for i, t in texts
    )
    assert sorted(str((r.doc_id, r.ids, r.back)) for r in rows) == want
    assert encode_documents(empty, pieces).count() == 0
    half = pieces.byte_ids[0xC3]
    lists = spark.createDataFrame([(None,), ([],), ([0, 99999, None, -1],), ([half],)], "ids array<int>")
    assert [r[0] for r in lists.select(decode("ids", pieces)).collect()] == [None, "", "����", "�"]
