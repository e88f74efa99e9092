"""Columns of the input keep their values whatever the operators call their own."""

from pyspark.sql import functions as F

from threadloom.llm import exact_dedup, langid, licenses, pii, sentencepiece_codec, urlfilter

NAMES = ("spare", "sentences", "rest", "Spare_", "block", "uid", "filter_block", "gone_id", "digest")


def test_helper_columns_do_not_replace_those_of_the_input(spark):
    df = spark.createDataFrame([(1, "MIT License, mail a.b@c.de or call +1 555 123 4567", "aa"), (2, None, "aa"), (2, "x y z", "bb"), (2, "x y z", "bb")], "doc_id long, text string, lang string")
    df = df.withColumns({n: F.lit(f"mine {n}") for n in NAMES}).withColumn("url", F.lit("http://a.org/"))
    found = (
        langid.identified(df, langid.fit(df)), licenses.licensed(df), pii.detected(df, pii.Model(pii.Booster(), {})), urlfilter.judged(df), sentencepiece_codec.round_trip(df), exact_dedup.deduplicated(df),
    )
    for out in found:
        rows = out.collect()
        assert len(rows) == (3 if out is found[-1] else 4)
        assert all(r[n] == f"mine {n}" for r in rows for n in NAMES)
    assert found[2].where("doc_id = 1").first().n_spans == 2
    assert "MIT" in found[1].where("doc_id = 1").first().licenses or found[1].where("doc_id = 1").first().n_sentences


def test_tables_of_the_pair_operators_have_other_columns(spark):
    from threadloom.llm import decontam, minhash, suffix_dedup

    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string").withColumns({n: F.lit("x") for n in (*NAMES, "node", "home", "of", "hashes", "h", "signature")})
    items = spark.createDataFrame([("i", "c d e")], "item_id string, text string").withColumns({n: F.lit("x") for n in ("wid", "size", "h", "words")})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_hit for r in decontam.contamination(df, items).collect()} == {1: 3, 2: 3, 3: 0}
    assert suffix_dedup.without_repeats(df).count() == 3
