import random

from pyspark.sql import functions as F

from threadloom.llm import langid, licenses, urlfilter

STEMS = {"aa": ["the", "ing", "and", "ould"], "bb": ["ung", "sch", "ein", "ß"], "cc": ["eau", "çon", "ère", "qui"]}


def corpus(n=400):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = r.choice(list(STEMS))
        rows.append((i, " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(15, 120))), lang))
    return rows


def test_language_held_out_accuracy_and_mixtures(spark):
    rows = corpus()
    mixed = rows[0][1] + " " + " ".join("".join(random.Random(3).choice(STEMS["bb"]) for _ in range(3)) for _ in range(200))
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !", "bb"), (903, "é", None), (904, mixed, None), (905, rows[5][1] * 2000, None), (906, rows[5][1], None), (906, rows[5][1], None), (None, rows[7][1], "cc")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    got = langid.identified(df, model).select("doc_id", "lang", "lang_pred", "score", "mixture", langid.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(got) == len(rows + odd)
    told = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.98
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert all(0 <= r.score <= 1 for r in got) and by[903].lang_pred in STEMS
    assert len(by[904].mixture.split()) == 2 and by[905].lang_pred == rows[5][2]


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identified(df, langid.fit(df)).first().lang_pred == "und"
    assert langid.identified(df.limit(0), langid.fit(df.limit(0))).count() == 0


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for rule, said in urlfilter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), rule, said))
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    listed = any(host == h or host.endswith("." + h) for h in urlfilter.LISTED_HOSTS)
    return host, path, None, "block" if listed else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?q#f", "https://a.b.example.org/en/1", "https://example.org/en/12?x", "https://example.org/en/2", "https://x.com/fr/", "https://x.com/de/#a", "https://x.com", "https://spam-farm.example.net/x", "a://b://c/d", "https://org/", "https://xorg/", "ftp://é.com/DE/", "x://example.org\n/es/", "https://m.spam-farm.example.com", "https://com/de/" + "y" * 100_000]


def test_urls_by_index_and_by_join(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, rule string")
    want = [brute_url(u) for u in URLS + URLS[4:6]]
    for most in (urlfilter.MOST_INDEX_BYTES, 0):
        got = urlfilter.judged(df, most_index_bytes=most).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert urlfilter.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judged(df, rules=(), listed_hosts=()).collect()} == {"allow"}


def test_colliding_keys_are_told_apart(spark):
    index = urlfilter.DigestArray([("ab", True), ("cd", False), ("xyz", True)], key=len)
    probes = spark.createDataFrame([("cd",), ("ab",), ("ef",), ("xyz",), ("zzzz",), ("",)], "entry string")
    at = index.place(F.col("entry"), F.char_length("entry").cast("long"))
    found = probes.select((at >= 0).alias("there"), F.get(index.blocks, at).alias("blocks")).collect()
    assert [r.there for r in found] == [True, True, False, True, False, False]
    assert [r.blocks for r in found if r.there] == [False, True, True]


def test_binary_search_over_many_rules(spark):
    rules = [(f"h{i}.example/p{i % 3}", "block" if i % 2 else "allow") for i in range(777)]
    df = spark.createDataFrame([(f"http://a.h{i}.example/p{i % 3}/x", i) for i in range(0, 900, 7)], "url string, i long")
    for most in (urlfilter.MOST_INDEX_BYTES, 0):
        got = urlfilter.judged(df, rules=rules, listed_hosts=(), most_index_bytes=most).collect()
        assert all((r.rule, r.verdict) == ((f"h{r.i}.example/p{r.i % 3}", "block" if r.i % 2 else "allow") if r.i < 777 else (None, "allow")) for r in got)
    assert [urlfilter.digest(s) for s in ("", "org/", "é" * 40)] == list(spark.range(1).select(*(F.xxhash64(F.lit(s)) for s in ("", "org/", "é" * 40))).first())


def test_long_hosts_and_clashing_columns(spark):
    host = ".".join("ab" for _ in range(300_000)) + ".example.org"
    df = spark.createDataFrame([(1, f"http://{host}/es/x", 1, 2, 3), (2, f"http://{host}", 4, 5, 6)], "page_id long, url string, _m int, met int, probes int")
    for most in (urlfilter.MOST_INDEX_BYTES, 0):
        got = urlfilter.judged(df, most_index_bytes=most).orderBy("page_id")
        assert [(r.rule, r.verdict, r._m, r.met, r.probes) for r in got.collect()] == [("example.org/es/", "block", 1, 2, 3), (None, "allow", 4, 5, 6)]
    plan = urlfilter.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark):
    s = licenses.SENTENCES
    mit = "\n".join(["MIT License", "", "Copyright (c) 2020 Jo", "", s["mit-grant"] + ":", "", s["mit-notice"] + ".", "", s["mit-as-is"] + ". " + s["mit-liable"] + "."])
    wrapped = "\n".join(x for x in (s["bsd-grant"] + ":").replace("provided ", "provided\n").split("\n")) + "\n\n" + s["bsd-source"].replace("copyright notice, ", "copyright\nnotice, ") + ".\n\n" + s["bsd-binary"] + ".\n"
    rows = [
        (1, mit, ["MIT"], 0), (2, "x y.\nLicensed under CC BY-NC 4.0.\nMore.", ["CC-BY-NC-4.0"], 0), (3, wrapped, ["BSD-2-Clause"], 0), (4, "# SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"], 0), (5, None, [], 0), (6, "", [], 0),
        (7, "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only", "MIT"], 0), (8, "MIT", [], 1), (9, "ALL RIGHTS RESERVED!", [], 1), (10, "no license " * 20_000, [], 0), (2, "unlicensed", [], 0),
        (None, "Licensed under the Apache License, Version 2.0", ["Apache-2.0"], 0),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows], "doc_id long, text string, ids string")
    got = licenses.licensed(df).collect()
    assert [(r.doc_id, r.text, r.licenses, r.n_left) for r in got] == [(i, t, names, left) for i, t, names, left in rows]
    assert licenses.licensed(df.limit(0)).count() == 0
