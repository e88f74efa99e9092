import random
import re

import pytest

from threadloom.llm import common, decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = set()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for key, it in items:
            x = words(it)
            if key is None or not x:
                continue
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found.add(str(key))
        out.add((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n_hit int, wid string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontam.contamination(d, b).collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ab", "AB", "K", "naïve"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 9, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (52, "hi"), (53, "hi"), (None, text(20)), (9, text(13))]
    docs = [(i, text(r.randint(0, 60))) for i in range(20)]
    for i in range(20, 45):
        _, it = r.choice(items[:12])
        docs.append((i, f"{text(r.randint(0, 30))}. {it.upper() if i % 2 else it}, {text(r.randint(0, 400))}"))
    docs += [(60, None), (61, ""), (62, "!!"), (63, "hi"), (64, "hi hi " * 5000), (None, items[5][1]), (70, "hi"), (70, "hi"), (70, "other"), (71, items[7][1] * 2)]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("full", [True, False])
def test_with_a_full_and_an_empty_bit_filter(spark, monkeypatch, full):
    if full:
        monkeypatch.setattr(common, "bit_set", lambda longs, bit: longs.isNotNull())
    items = [(1, " ".join(f"a{i}" for i in range(20))), (2, "one two three")]
    docs = [(1, "x " * 10 + items[0][1]), (2, "one two three four"), (3, "one three two")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == set()
    assert run(spark, [(1, "a b"), (2, None)], []) == {(1, 2, 0, 0, "", False), (2, 0, 0, 0, "", False)}
