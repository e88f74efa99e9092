"""Collocations against plain counting, and shards that end anywhere."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import collocation as co


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counts(texts):
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        for piece in words_of(text):
            n[lang] += len(piece)
            for size in (1, 2, 3):
                f[lang].update(tuple(piece[i : i + size]) for i in range(len(piece) - size + 1))
    return f, n


def plain(texts, least, top):
    out = []
    f, n = counts([(lang if lang is not None else "und", t) for lang, t in texts])
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in cand.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string")
    return sorted(tuple(r) for r in co.mined(df, **more).collect())


TEXTS = [
    ("en", "New York, new york! NEW YORK city\tof  new york."), (None, "a b a b a b"), ("en", None), ("en", ""), ("de", "Über Über über Ñ über ñ"), ("de", "größe x größe x\nweiter größe x"),
    ("en", "a a a a a a a a a a"), ("", "x y z. x y z? x y z; x y"), ("en", "new york new york \x00 b \x00 b"), ("en", "x" * 5000 + " y " + "x" * 5000 + " y"),
]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_plain_counting(spark, least):
    assert found(spark, TEXTS * 2, least=least, top=7) == plain(TEXTS * 2, least, 7)


def test_drawn_texts(spark):
    draw = np.random.default_rng(4)
    texts = [("en" if draw.random() < 0.8 else "fr", " ".join(draw.choice(["a", "b", "c", "dd", "e.", "f", ",", "G"], draw.integers(0, 60)))) for _ in range(120)]
    assert found(spark, texts, least=5, top=50) == plain(texts, 5, 50)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), (None, " . ")]) == []


@pytest.mark.parametrize("most", [1, 3, 10, 64])
@pytest.mark.parametrize("span", [1, 5, 1 << 20])
def test_shards_end_anywhere(monkeypatch, most, span):
    monkeypatch.setattr(co, "SPAN", span)
    texts = [(lang or "und", t) for lang, t in TEXTS if t is not None]
    want, n = counts(texts)
    words, phrases, total = defaultdict(Counter), defaultdict(Counter), Counter()
    passes = co.Filter([{"block": 0, "longs": [-1] * 512}], 32768)
    for shard in co.shards(((lang, t.encode()) for lang, t in texts), most):
        for batch in co._count_hashed(shard):
            for r in batch.to_pylist():
                if r["word"] is not None:
                    (words[r["lang"]] if r["word"] else total)[r["word"] and (r["word"].decode(),) or r["lang"]] += r["n"]
        for batch in co._count_phrases(shard, passes):
            for r in batch.to_pylist():
                phrases[r["lang"]][tuple(r["phrase"].decode().split(" "))] += r["n"]
    for lang, c in want.items():
        assert words[lang] == Counter({p: a for p, a in c.items() if len(p) == 1})
        assert phrases[lang] == Counter({p: a for p, a in c.items() if len(p) > 1})
    assert total == +n


def test_the_filter_holds_back_rare_phrases():
    shard = next(iter(co.shards([("en", b"a b c. a b c")])))
    none = co.Filter([{"block": 0, "longs": [0] * 512}], 32768)
    assert sum(b.num_rows for b in co._count_phrases(shard, none)) == 0


def test_scores_are_exact(spark):
    big = 10**14
    got = spark.createDataFrame([(big - 1, big, big + 3)], "a long, l long, r long").select(co._score("a", "l", "r")).first()[0]
    assert got == 1000000 * (big - 1) ** 2 // (big * (big + 3))
