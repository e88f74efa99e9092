"""The pipeline against plain Python on a small fixture, and the rules of its stages."""

import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from threadloom.llm import sentencepiece_codec as codec  # noqa: E402

from .test_decontam import brute as contaminated  # noqa: E402
from .test_langid_urls_licenses import corpus  # noqa: E402
from .test_minhash import brute as near  # noqa: E402


def fixture():
    rows = [(i, t, lang) for i, t, lang in corpus(160)]
    rows += [(200 + k, rows[k][1].replace(" ", "  "), rows[k][2]) for k in range(12)]
    rows += [(300 + k, rows[20 + k][1] + " tail", rows[20 + k][2]) for k in range(12)]
    rows += [(400, "1234 !!", "aa"), (401, "", "aa"), (402, None, "bb")]
    item = " ".join(f"item{j}" for j in range(30))
    rows += [(500, rows[40][1][:200] + " " + item, rows[40][2]), (501, rows[41][1] + " " + rows[42][1] + " item0 item1", rows[41][2])]
    return rows, [(1, item)]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame([(i, t, g, f"src{i % 3}", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    component = near(left, 5)
    left = [(i, t) for i, t in left if component[i] == i]
    bad = {r[0] for r in contaminated(left, items) if r[5]}
    assert bad == {500}
    left = dict(x for x in left if x[0] not in bad)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left)
    reader = codec.Codec.load(open(codec.MODEL, "rb").read(), "bpe")
    assert all(r.exact and list(r.ids) == list(reader.encode(left[i])) for i, r in got.items())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows[:40]], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    sizes = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        sizes[name] = out.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert all(sizes.values())
