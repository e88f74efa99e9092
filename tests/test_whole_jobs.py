"""Queries read the whole text and ask for all rows: fixtures whose answers lie beyond a prefix or a bound."""

import math
import random
import re

from threadloom.operators import provenance
from threadloom.plans.catalogue import QUERIES


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_rationale_pairs_read_the_whole_answer(spark, tmp_path):
    late = "word " * 120 + "we decided on purpose, the reason is that it would break backwards compatibility"
    turns = [(n, 0, "user", "why so?") for n in (1, 2, 3)] + [(1, 1, "assistant", "short"), (2, 1, "assistant", late), (3, 1, "assistant", "x " * 1500)]
    got = {r["number"]: r["score"] for r in QUERIES["mine_rationale_pairs"](spark, put(spark, tmp_path, "conversations", turns, CONVERSATIONS)).collect()}
    assert set(got) == {1, 2}  # over 2000 characters is refused
    assert got[2] > got[1]


def brute_scores(docs, items):
    words = {k: re.findall("[a-z0-9_]+", t.lower()) for k, t in docs}
    asked = {k: re.findall("[a-z0-9_]+", t.lower()) for k, t in items}
    mean, recall5, mrr = sum(map(len, words.values())) / len(words), [], []
    for q in asked.values():
        size = min(13, len(q))
        windows = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)}
        wanted = {k for k, w in words.items() if any(tuple(w[i : i + size]) in windows for i in range(len(w) - size + 1))}
        if not wanted:
            continue
        score = {}
        for t in set(q):
            df = sum(t in w for w in words.values())
            for k, w in words.items():
                if t in w:
                    score[k] = score.get(k, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
        rank = {k: n for n, k in enumerate(sorted(score, key=lambda k: (-round(score[k], 6), k)), 1)}
        recall5.append(sum(rank.get(k, 99) <= 5 for k in wanted) / len(wanted))
        mrr.append(1 / min(rank[k] for k in wanted))
    return len(mrr), round(sum(recall5) / len(mrr), 6), round(sum(mrr) / len(mrr), 6)


def test_bench_asks_all_words_and_wants_later_passages(spark, tmp_path):
    item = [" ".join(f"{c}{n}" for n in range(40)) for c in "abc"] + ["only five words are here"]
    part = lambda c, a, z: " ".join(f"{c}{n}" for n in range(a, z))
    docs = [(1, "start " + part("a", 20, 36) + " end"), (2, item[0]), (3, part("b", 25, 40)), (4, part("b", 0, 12)), (5, "so only five words are here too"), (6, "a0 a1 a2 a3 " * 5), (7, "nothing")]
    docs += [(10 + n, f"a{n % 4} b{n % 4} filler") for n in range(30)]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    d = put(spark, tmp_path, "benchmark", list(enumerate(item)), "item_id long, text string")
    got = QUERIES["bench_recall_mrr"](spark, d).first()
    assert (got["questions"], got["recall_5"], got["mrr"]) == brute_scores(docs, list(enumerate(item)))
    assert got["questions"] == 3


def test_paths_are_read_from_all_lines(spark, tmp_path):
    text = 'Look at lib/deep/core.py first.\nThen tests/unit/test_x.py::test_y fails:\n  File "pkg/run.py", line 3, in go\nsrc/a/b.rs:12 is not it, https://host.org/no/way.py neither'
    d = put(spark, tmp_path, "conversations", [(1, 0, "user", text), (2, 0, "user", "plain")], CONVERSATIONS)
    got = {(r["number"], r["path"]) for r in QUERIES["extract_paths"](spark, d).collect()}
    heads = {(n, f"src/m{n}.py") for n in (1, 2)} | {(n, f"tests/test_m{n}.py") for n in (1, 2)}
    assert got == heads | {(1, p) for p in ("lib/deep/core.py", "tests/unit/test_x.py", "pkg/run.py", "src/a/b.rs")}


def test_file_histories_of_all_threads(spark):
    r = random.Random(3)
    files = [("r", n, f"p{p}", r.choice(["changed", "changed", "mentioned"])) for n in range(150) for p in r.sample(range(12), r.choice([1, 2, 3, 6, 11]))]
    threads = [(n, "r", r.choice([None, "2020-01-01", "2021-01-01", "2022-01-01"])) for n in range(150)]
    f, t = spark.createDataFrame(files, "repo string, number long, path string, source string"), spark.createDataFrame(threads, "number long, repo string, merged_at string")
    columns = ["asked", "number", "shared", "merged_at", "position"]
    want = sorted(map(tuple, provenance.file_history(f, t, f).select(columns).collect()))
    for listed in (0, 3, provenance.MOST_LISTED):
        assert sorted(map(tuple, provenance.file_histories(f, t, listed=listed).select(columns).collect())) == want
