import os
import random

import pytest

from threadloom.llm import sentencepiece_codec as codec

pytestmark = pytest.mark.skipif(not os.path.exists(codec.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return open(codec.MODEL, "rb").read()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(seed, n=1500):
    r = random.Random(seed)
    alphabet = " " * 6 + "etaoinshr" + "éüñß漢字\n\t.,0123" + "ABC"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + [" " * n + t for n in range(40) for t in ("", "x", "hello", "漢")]


def test_ids_are_those_of_the_library(model, library):
    c = codec.Codec.load(model, "bpe")
    every = texts(1) + ["a" * 3000, "thetheand" * 900, "===" * 700, "é" * 2000, "0123456789" * 300, "the quick brown fox " * 500]
    assert [list(x) for x in c.encode_all(every)] == library.encode(every)


def test_unigram_paths_have_the_best_score(model):
    c = codec.Codec.load(model, "unigram")
    r = random.Random(3)

    def best(text):
        top = [0.0] + [None] * len(text)
        for e in range(1, len(text) + 1):
            top[e] = max(top[s] + c.score.get(text[s:e], c.missing if e - s == 1 else float("-inf")) for s in range(max(0, e - c.longest), e))
        return top[-1]

    for _ in range(200):
        text = "".join(r.choice("thean ds") for _ in range(r.randint(1, 40))).replace("  ", " ")
        pieces = [c._text(p) for p in c.pieces_of(text)]
        assert "".join(pieces) == text and sum(c.score.get(p, c.missing) for p in pieces) == best(text)


def test_long_stretches_are_committed_as_they_go(model, library):
    c = codec.Codec.load(model, "bpe")
    text = "x" + "abcdefghij" * 2000
    seen = c.pieces_of(" " + text)
    first = next(seen)
    assert [first, *c._numbers(seen)] == library.encode(text)


def test_round_trip_with_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "a▁b ▁"), (4, " x  y \n"), (5, "word " * 60_000), (5, "word " * 60_000), (6, "<s></s><unk><0x41>"), (7, "\u0000\u0001😀"), (None, "q")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, ids string, exact string")
    got = codec.round_trip(df).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert [r.n_ids for r in got if r.doc_id in (1, 2)] == [0, 0]
    back = df.select("text", codec.decoded(codec.encoded(df["text"])).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert codec.round_trip(df.limit(0)).count() == 0
