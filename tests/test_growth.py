"""Work that grows with the input, not with its square: results against brute force, and what the plans may not hold."""

from datetime import datetime
from math import log

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.chunking import chunked, chunks_of
from threadloom.operators import evaluation, fulltext, provenance, segments, substrings, systems
from threadloom.plans import derive, index, views
from threadloom.plans.catalogue import QUERIES
from threadloom.plans.landing import Landing
from threadloom.schemas import MAX_CHUNK, RAW
from threadloom.sources import store
from threadloom.sources.bucketed import Bucketed


def test_shas_that_begin_alike_meet_by_equality_only(spark):
    shas = ["0" * 39 + c for c in "123"] + ["0" * 12, "0" * 20 + "7", "0" * 20, "abc", "", "f" * 11, "f" * 12]
    asked = [("r", s, "no number") for s in [*shas, "f" * 40, "0" * 39 + "1"]]
    known = [("r", n, s) for n, s in enumerate([*shas, "f" * 13, "0" * 20])]
    want = sorted(("r", a, n, False) for _, a, _ in asked for _, n, k in known if a[:12] == k[:12] and (a.startswith(k) or k.startswith(a)))
    commits = spark.createDataFrame(known, "repo string, number long, sha string")
    found = provenance.threads_of_commits(spark.createDataFrame(asked, "repo string, sha string, summary string"), commits, commits.select("repo", "number"))
    assert sorted(map(tuple, found.collect())) == want
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("StartsWith" in line for line in joins)


def test_threads_without_a_path_have_no_history(spark):
    files = [("r", 1, None, "changed"), ("r", 2, None, "changed"), ("r", 3, "a", "changed"), ("r", 4, "a", "mentioned")]
    heads = [("r", n, datetime(2020, 1, n)) for n in (1, 2, 3, 4)]
    got = provenance.file_histories(spark.createDataFrame(files, "repo string, number long, path string, source string"), spark.createDataFrame(heads, "repo string, number long, merged_at timestamp"))
    assert [tuple(r) for r in got.select("asked", "number", "shared", "position").collect()] == [(4, 3, 1, 1)]


def test_histories_of_threads_with_the_same_files(spark):
    """Each of many threads with the same files leaves out only itself; sets too large to list give the same rows."""
    files = [("r", n, p, "changed" if n % 3 else "mentioned") for n in range(40) for p in "abcde"[: 1 + n % 5]]
    heads = [("r", n, datetime(2020, 1, 1 + n % 28) if n % 4 else None) for n in range(40)]
    changed = {n: {p for _, m, p, s in files if m == n and s == "changed"} for n in range(40)}
    own, merged = {n: {p for _, m, p, _ in files if m == n} for n in range(40)}, {n: at for _, n, at in heads if at}
    want = []
    for asked in range(40):
        shared = sorted((-len(own[asked] & changed[n]), -merged[n].toordinal(), n) for n in merged if n != asked and own[asked] & changed[n])
        want += [(asked, n, -s, i) for i, (s, _, n) in enumerate(shared[:5], 1)]
    f, t = spark.createDataFrame(files, "repo string, number long, path string, source string"), spark.createDataFrame(heads, "repo string, number long, merged_at timestamp")
    for listed in (0, 2, provenance.MOST_LISTED):
        got = provenance.file_histories(f, t, listed=listed).select("asked", "number", "shared", "position")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chunks_of_short_texts_are_those_of_long_ones(spark):
    blank = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [None, "", blank, blank + "a" + blank + "b" + blank, "\u200b a \ufeff", "x" * MAX_CHUNK, " " + "x" * MAX_CHUNK + "\n", "# a\n" + "x" * MAX_CHUNK, "\U0001f600" * MAX_CHUNK, "a\n\n" * MAX_CHUNK, " " * 300_000 + "b" + " " * 300_000 + "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for split in (True, False):
        got = dict(map(tuple, rows.select("n", chunked(F.col("text"), split)).collect()))
        assert got == {n: chunks_of(t, split) if t is not None else [] for n, t in enumerate(texts)}


def test_a_batch_is_read_once_for_its_threads(spark, tmp_path):
    """What a batch fetched is computed once, and everything else asks what was written of it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(payload: str) -> str:
        seen.add(1)
        return payload

    def stage(rows, name):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}")

    none = spark.createDataFrame([], RAW)
    fetched = spark.createDataFrame([("r", "issue", "1", None, '{"number": 1, "title": "t"}', None, None)], RAW)
    fetched = fetched.withColumn("payload", F.udf(counted)("payload"))
    authority, marks = spark.createDataFrame([], "repo string, login string, permission string"), spark.createDataFrame([], "repo string, high_water timestamp")
    found = index.indexed(none, fetched, derive.documents(derive.sources(none), authority), authority, marks, stage=stage)
    assert [r["body_text"] for r in found.documents.collect()] == ["t"] and seen.value == 1


def test_a_landed_batch_is_read_once_and_sorted_without_samples(spark, tmp_path, monkeypatch):
    """A batch into a folder computes each payload once, and what is written aside is dealt by bucket, not by sampled ranges."""
    seen = spark.sparkContext.accumulator(0)

    def counted(payload: str) -> str:
        seen.add(1)
        return payload

    fetched = spark.createDataFrame([("r", "issue", str(n), None, f'{{"number": {n}, "title": "t{n}", "user": {{"login": "ann"}}, "author_association": "MEMBER"}}', None, None) for n in range(1, 4)], RAW)
    fetched = fetched.withColumn("payload", F.udf(counted)("payload"))
    monkeypatch.delattr(type(fetched), "repartitionByRange")
    land = Landing(spark, f"{tmp_path}/index", 4)
    assert land.apply(fetched, spark.createDataFrame([("r", "ann", "write")], "repo string, login string, permission string")) == {"insert": 3} and seen.value == 3
    assert sorted((r.number, r.body_text, r.trust) for r in land.read("documents").collect()) == [(n, f"t{n}", "authoritative") for n in range(1, 4)]


def test_texts_are_cut_before_an_author_s_texts_meet(spark, tmp_path):
    """Only rows with their chunks are shuffled by author; nothing stored yet needs no workers and leaves the plan."""
    texts = derive.sources(spark.createDataFrame([("r", "issue", "1", None, '{"number": 1, "title": " t ", "body": "\\u200b \\u0007"}', None, None)], RAW))
    found = derive.documents(texts, spark.createDataFrame([], "repo string, login string, permission string"))
    assert [(r.source_type, r.body_text) for r in found.collect()] == [("title", "t")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Generate")
    stored = Bucketed(spark, f"{tmp_path}/none", texts.schema)
    plan = texts.join(stored.of(texts, [0]).select("repo", "number"), ["repo", "number"], "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti, ((repo" not in plan and "bucket" not in plan


def test_grams_of_a_text_are_written_once(spark, tmp_path):
    """However many rows have a text, its trigrams are in the index once, and all its rows are found."""
    rows = spark.createDataFrame([(n, t) for n in range(300) for t in ("expected features", f"only {n % 2}", None)], "number long, message string")
    index = substrings.Trigrams.build(rows, f"{tmp_path}/grams", ["number"], "message")
    written = spark.read.parquet(f"{tmp_path}/grams/grams") if (tmp_path / "grams" / "grams").exists() else spark.read.parquet(f"{tmp_path}/grams")
    assert written.count() == len("expected features") - 2 + 2 * (len("only 0") - 2)
    assert index.candidates(substrings.of_literal("features")).count() == 300
    assert index.candidates(substrings.of_pattern("y 1|zzz")).count() == 150
    assert index.candidates(substrings.of_literal("features only")).count() == 0  # a text must hold all of it, not a key


def test_texts_are_dealt_before_they_are_cut_into_words(spark):
    """Counting words shuffles texts, not a row a word of a text; rows that share a key are counted together."""
    rows = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, None), (3, "b")], "doc_id long, text string")
    found = fulltext.postings(rows)
    assert sorted(map(tuple, found.select("doc_id", "term", "tf").collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (3, "b", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_scores_from_a_floor_are_those_of_all_pairs(spark):
    """Rare terms bring the candidates; what is left out lies below the floor, with ties and questions of frequent words only."""
    texts = {n: [f"w{k}" for k in range(1, 13) for _ in range(1 + n % 3) if n % k == 0] for n in range(1, 200)} | {200: ["w12"] * 300}
    asked = {"a": {"w1", "w2", "w12"}, "b": {"w1"}, "c": {"w7", "w11", "w1"}, "d": {"none"}}
    df = {t: sum(t in ws for ws in texts.values()) for t in {t for ws in texts.values() for t in ws}}
    mean = sum(map(len, texts.values())) / len(texts)
    part = lambda t, ws: log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    every = {q: sorted((-round(sum(part(t, ws) for t in terms if t in ws), 6), n) for n, ws in texts.items() if terms & set(ws)) for q, terms in asked.items()}
    found = spark.createDataFrame([(n, t, ws.count(t), len(ws)) for n, ws in texts.items() for t in set(ws)], "item long, term string, tf long, doc_len long")
    questions = spark.createDataFrame([(q, t) for q, terms in asked.items() for t in terms], "question string, term string")
    total = spark.createDataFrame([(len(texts), mean)], "n long, mean_len double")
    weights = systems.weights_of(found, questions, total)
    for place in (0, 9, 60):
        floors = spark.createDataFrame([(q, -rows[min(place, len(rows) - 1)][0]) for q, rows in every.items() if rows], "question string, floor double")
        got = systems.scores_from(floors, found, weights)
        want = sorted((q, n, -s) for q, rows in every.items() for s, n in rows if s <= rows[min(place, len(rows) - 1)][0])
        assert sorted(map(tuple, got.collect())) == want
    got = systems.index_system(found.withColumnRenamed("item", "doc_id"), questions, total, most=10)
    assert sorted(map(tuple, got.collect())) == sorted((q, n, i) for q, rows in every.items() for i, (_, n) in enumerate(rows[:10], 1))


def test_passages_meet_the_documents_of_their_rarest_word(spark):
    """Only documents with the rarest word of a passage are cut into words."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text: str) -> list[str]:
        seen.add(1)
        return text.split()

    items = spark.createDataFrame([(1, "x a b"), (2, "a"), (3, "b a"), (4, ""), (5, "q a")], "question long, text string")
    texts = [(n, "a b") for n in range(50)] + [(50, "c x a b"), (51, "x a c b"), (52, "x a b x a b")]
    docs = spark.createDataFrame(texts, "item long, text string")
    postings = docs.select("item", F.explode(F.split("text", " ")).alias("term")).distinct()
    of = lambda questions: sorted(map(tuple, evaluation.holders(docs, items.where(F.col("question").isin(questions)), postings, F.udf(counted, "array<string>"), 3).collect()))
    assert of([1, 4, 5]) == [(1, 50), (1, 52)]
    assert seen.value < 20
    assert of([2, 3]) == sorted([(2, n) for n in range(53)])


def test_literals_are_searched_in_the_different_pieces_of_files(spark):
    """Terms with blanks, at the edge of pieces or of blanks alone are found as a plain search finds them, without the characters of whole files."""
    texts = {1: "a models, b", 2: "xmodels,y\u00a0z", 3: "models ,", 4: "foo  bar", 5: "foo bar\nmodels,", 6: "xfoo barx", 7: "", 8: "\u0442\u0435\u043a\u0441\u0442\tmodels", 9: None}
    terms = ["models,", "foo bar", "o b", " ", "\n", "\u0442\u0435\u043a", "\u00a0", "a", " b", "none of"]
    files = spark.createDataFrame(list(texts.items()), "path long, content string")
    found = systems.files_with(files, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, found.select("path", "term").collect())) == sorted((n, t) for n, x in texts.items() for t in terms if x and t in x)
    assert "regexp_extract_all(content" not in found._jdf.queryExecution().analyzed().toString()


def test_segments_deal_texts_and_sample_nothing(spark, tmp_path, monkeypatch):
    """Words with their places are not shuffled to be counted, and no range is sampled for the order of a segment."""
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string")
    found = segments.positional(rows, "doc_id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    monkeypatch.delattr(type(rows), "repartitionByRange")
    index = segments.Segments(spark, f"{tmp_path}/index")
    index.append(rows)
    index.append(rows.where("doc_id = 3").withColumn("text", F.lit("c a")))
    index.merged()
    got = index.postings(["a", "b", "c"]).select("doc_id", "term", "tf", "positions").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2, [0, 2]), (1, "b", 1, [1]), (3, "a", 1, [1]), (3, "c", 1, [0])]


def _dealt_once(spark, name: str, shuffles: int) -> None:
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == shuffles


def test_signals_of_hits_are_dealt_by_number(spark, monkeypatch):
    """The parts of a view follow the rows of its table, and what is joined by number is dealt by it once."""
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000)
    assert views.dealt(spark, "/root/testdata/sf0.001", "h_files").rdd.getNumPartitions() >= 6
    plan = QUERIES["post_filter_temporal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Union" not in plan


def test_ranks_by_day_are_those_of_one_window(spark):
    rows = spark.createDataFrame([(n % 2, datetime(2020, 1, 1 + n % 5, n % 3) if n % 7 else None, n) for n in range(100)], "leg int, at timestamp, n int")
    order = [F.col("at").desc_nulls_last(), F.col("n").desc()]
    got = evaluation.ranked_by_day(rows, ["leg"], F.col("at").cast("date"), order, 5)
    assert sorted(map(tuple, got.select("n", "rank").collect())) == sorted(map(tuple, evaluation.ranked(rows, ["leg"], order).select("n", "rank").collect()))
    plan = QUERIES["rrf_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(leg_order" not in plan or "_day" in plan.split("row_number() windowspecdefinition(leg_order")[1][:20]


def test_sets_are_compared_value_by_value(spark):
    old, new = [(1, "a"), (1, "b"), (2, "a"), (3, None), (5, "a"), (5, "a"), (6, "a")], [(1, "b"), (1, "a"), (2, "b"), (4, "a"), (5, "a"), (6, "a"), (6, None)]
    found = store.changed_sets(spark.createDataFrame(old, "k int, v string"), spark.createDataFrame(new, "k int, v string"), ["k"], ["v"])
    assert sorted(r["k"] for r in found.collect()) == [2, 3, 4, 6]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_errors_are_distinct_where_they_are(spark):
    _dealt_once(spark, "distinctive_words", 1)


def test_errors_are_distinct_where_they_are(spark):
    _dealt_once(spark, "extract_errors", 1)


def test_a_batch_stages_only_what_it_may_change(spark, tmp_path):
    """Payloads of other threads stay where they are, a comment that moved is replaced, one that is gone is not kept, and the newest version stands."""
    head = lambda n, body: ("r", "issue", str(n), None, f'{{"number": {n}, "body": "{body}"}}')
    note = lambda i, n, body: ("r", "issue_comment", i, None, f'{{"id": 1, "body": "{body}", "issue_url": "https://h/repos/r/issues/{n}"}}')
    batch = lambda rows, day: spark.createDataFrame([(*r, datetime(2025, 1, day), datetime(2025, 1, day)) for r in rows], RAW)
    raw = batch([*(head(n, "old") for n in range(1, 21)), note("a", 3, "gone"), note("b", 4, "moved"), note("c", 5, "stays"), note("d", 3, "newer"), ("r", "issue_comment", None, 3, '{"body": "no id"}')], 2)
    fetched = batch([head(3, "new"), note("b", 3, "here"), note("d", 3, "older")], 3).unionByName(batch([head(7, "late")], 1))
    fetched = fetched.withColumn("updated_at", F.when(F.col("object_id") == "d", F.lit(datetime(2025, 1, 1))).otherwise(F.col("updated_at")))

    def stage(rows, name):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}")

    none = spark.createDataFrame([], RAW)
    authority, marks = spark.createDataFrame([], "repo string, login string, permission string"), spark.createDataFrame([], "repo string, high_water timestamp")
    found = index.indexed(raw, fetched, derive.documents(derive.sources(none), authority), authority, marks, stage=stage)
    body = F.get_json_object("payload", "$.body")
    want = [("3", "new"), ("7", "old"), ("b", "here"), ("d", "newer"), (None, "no id")]
    assert sorted(map(str, map(tuple, spark.read.parquet(f"{tmp_path}/raw").select("object_id", body).collect()))) == sorted(map(str, want))
    rest = [(str(n), "old") for n in range(1, 21) if n not in (3, 7)] + [("c", "stays")]
    assert sorted(map(str, map(tuple, found.staged.select("object_id", body).collect()))) == sorted(map(str, want + rest))


def test_payloads_are_parsed_once_for_their_texts(spark):
    raw = spark.createDataFrame([("r", "pr", "1", None, '{"number": 1, "title": "t", "body": "\\u200b"}', None, None)], RAW)
    assert [(r.source_type, r.markdown) for r in derive.sources(raw).collect()] == [("title", "t")]
    plan = derive.sources(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("from_json" in line and "regexp_replace" in line for line in plan.splitlines() if "Filter" in line)


def test_texts_without_a_sign_go_around_the_patterns(spark):
    """What each pattern changes has a sign; the rest is the same text."""
    keys = ["-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "ghp_" + "a" * 36, "hf_" + "a" * 34, "xoxb-" + "1" * 10, "A3TX" + "A" * 16, *(k + "A" * 16 for k in ("AKIA", "ASIA", "ABIA", "ACCA"))]
    keys += ["AIza" + "a" * 35, "sk-ant-" + "a" * 20, "sk-" + "b" * 20, "eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8, "http://u:p@h", "AK​IA" + "A" * 16, "a\x01b"]
    marked = [" a", "a ", "a\r\nb", "a​b", "a<!-- b -->", "![a](b)", "[a](b)", "[](b)", "a \nb", "a\n\n\n\nb"]
    plain = ["", "a b", "note 1\n\nnote 2", "[a] (b)", None]
    rows = spark.createDataFrame([(t,) for t in [*keys, *marked, *plain]], "text string").select("text", text.redact(F.col("text")), text.normalize(F.col("text"))).collect()
    redacted, normal = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    assert all(redacted[k] != k for k in keys) and all("REDACTED" in redacted[k] for k in keys[:-1]) and all(redacted[t] == t for t in plain)
    assert all(normal[m] != m for m in marked) and all(normal[t] == t for t in plain)
    plan = spark.range(1).select(text.redact(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan


def test_words_are_placed_in_the_row_of_their_document(spark):
    """Nothing is grouped by word: places are those of brute force, rows of one key are one document, and documents without words have no row."""
    rows = [(1, "b a b"), (1, "a"), (2, None), (3, " ,"), (4, "the a the"), (None, "z")]
    found = segments.positional(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", stopwords=("the",))
    assert sorted(map(str, map(tuple, found.select("doc_id", "term", "tf", "positions", "doc_len").collect()))) == sorted(map(str, [(1, "a", 2, [0, 1], 4), (1, "b", 2, [0, 2], 4), (4, "a", 1, [1], 1), (None, "z", 1, [0], 1)]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("term" in line for line in plan.splitlines() if "Aggregate [" in line)


def test_files_of_histories_are_dealt_by_number_once(spark):
    """The lines of a thread meet once: what is distinct, joined with its thread and listed from them is not dealt again; sets travel as digests."""
    rows = QUERIES["brief_file_history"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_NUM" in plan and "md5" in plan
