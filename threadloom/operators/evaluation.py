"""Mining, judging and scoring of retrieval questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import cue_score, named
from threadloom.operators.filters import KEY

#: Fixed value: what a reference to a precedent looks like; group 1 is the number.
PRECEDENT = (
    r"(?i)\b(?:like|same (?:as|issue as|way as)|as in|as we did in|similar to|done in|was done in|following|follow[- ]?up (?:to|of)|refer to|as per|port of|mirrors?|introduced in|landed in|added in|cf\.?|see)"
    r"\s+#(\d{2,6})\b"
)


def failure_groups(signals: DataFrame, value: str, least: int = 2, most: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    """Signal values that a few threads share, so that finding one should find the others."""
    return signals.groupBy(value).agg(F.countDistinct(*key).alias("threads")).where(F.col("threads").between(least, most))


def rationale_pairs(comments: DataFrame, parent: Column, shortest: int = 60, longest: int = 2000) -> DataFrame:
    """Authoritative replies to somebody else's remark, with a score of how settled they sound."""
    asked = comments.select("repo", "number", F.col("source_id").alias("parent_id"), F.col("author").alias("asked_by"), F.col("body_text").alias("remark"))
    said = comments.where((F.col("trust") == "authoritative") & F.char_length("body_text").between(shortest, longest)).withColumn("parent_id", parent)
    pairs = said.join(asked, ["repo", "number", "parent_id"]).where("author <> asked_by")
    return pairs.withColumn("score", cue_score(F.col("body_text")) + F.when(F.col("asked_by").rlike(r"(?i)\[bot\]$"), 5).otherwise(0))


def precedent_references(documents: DataFrame, text: Column, threads: DataFrame) -> DataFrame:
    """Numbers that a text refers to as precedents, if they are indexed and not its own."""
    found = documents.select("repo", "number", F.explode(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PRECEDENT), F.lit(1))), lambda n: n.cast("long"))).alias("precedent")).where("precedent <> number")
    return found.join(threads.select("repo", F.col("number").alias("precedent")), ["repo", "precedent"], "left_semi")


def holders(documents: DataFrame, items: DataFrame, postings: DataFrame, words: Callable[[Column], Column], window: int = 13) -> DataFrame:
    """(question, item), distinct: the documents (item, text) that hold a passage of an item (question, text).

    A passage is `window` consecutive words, or the whole item if it is shorter. postings: (item, term), the words of the documents. A passage
    meets only the documents that have its rarest word, which are then searched for it; texts of other documents are not cut, and a text is cut once
    for all that is asked of it.
    """
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    cut = items.select("question", words(F.col("text")).alias("words")).where("size(words) > 0").withColumn("size", F.least(F.size("words"), F.lit(window)))
    cut = cut.select("question", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.slice("words", i, F.col("size")))).alias("window")).distinct()
    each = cut.select("question", "window", F.explode(F.array_distinct("window")).alias("term"))
    found = postings.select("item", "term").join(each.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    known = each.join(df, "term").groupBy("question", "window").agg(F.count("*").alias("n"), F.min_by("term", F.struct("df", "term")).alias("term"))
    anchors = known.where(F.col("n") == F.size(F.array_distinct("window"))).groupBy("term", "question").agg(F.collect_list(spaced(F.col("window"))).alias("windows"))
    met = found.join(anchors, "term").groupBy("item").agg(F.collect_list(F.struct("question", "windows")).alias("asked"))
    read = documents.join(met, "item").select("item", words(F.col("text")).alias("words"), "asked")
    held = named(spaced(F.col("words")), lambda text: F.filter("asked", lambda a: F.exists(a["windows"], lambda w: F.contains(text, w))))
    return read.select("item", F.explode(F.array_distinct(F.transform(held, lambda a: a["question"]))).alias("question")).select("question", "item").distinct()


def question_key(kind: Column, query: Column, filters: Column) -> Column:
    return F.struct(kind.alias("kind"), F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))).alias("query"), filters.alias("filters"))


def last_verdicts(labels: DataFrame, key: Sequence[str], at: Sequence[Column]) -> DataFrame:
    """The last verdict on each (question, thread) stands."""
    rest = [c for c in labels.columns if c not in key]
    return labels.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("h")).select(*key, "h.*")


def judged(labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Questions by what their verdicts amount to: relevant ones decide, contradictory ones are ambiguous, else dropped."""
    counts = labels.groupBy(*key).agg(F.count_if(F.col("verdict").isin("relevant", "decisive")).alias("yes"), F.count_if(F.col("verdict") == "not_relevant").alias("no"))
    return counts.withColumn("outcome", F.when((F.col("yes") > 0) & (F.col("no") > 0), "ambiguous").when(F.col("yes") > 0, "minted").otherwise("dropped"))


def retrieval_scores(results: DataFrame, relevant: DataFrame, groups: Sequence[str], ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Recall at each k and mean reciprocal rank.

    results: (question, rank, item); relevant: (question, item) and the groups. A question without a result scores 0.
    """
    wanted = relevant.groupBy("question", *groups).agg(F.countDistinct("item").alias("wanted"))
    met = relevant.select("question", "item").distinct().join(results, ["question", "item"]).groupBy("question", "item").agg(F.min("rank").alias("rank"))
    hits = met.groupBy("question").agg(*(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks), F.min("rank").alias("first"))
    rows = wanted.join(hits, "question", "left")
    recall = [F.avg(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("wanted")).alias(f"recall_{k}") for k in ks]
    return rows.groupBy(*groups).agg(F.count("*").alias("questions"), *recall, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def keep_before(hits: DataFrame, signals: DataFrame, cutoff, threads: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Hits that stay when every signal is read as of the cutoff: prose signals from documents before it, the diff of a
    pull request only if it was merged before it."""
    merged = threads.where(F.col("merged_at") < F.lit(cutoff)).select(*key).distinct().withColumn("_merged", F.lit(True))
    by_diff, by_prose = F.col("source") == "changed", (F.col("source") != "changed") & (F.col("first_seen_at") < F.lit(cutoff))
    known = signals.where(by_diff | by_prose).join(merged, list(key), "left").where(by_prose | F.col("_merged"))
    return hits.join(known.select(*key, "path"), [*key, "path"], "left_semi")


def corpus_lines(documents: DataFrame) -> DataFrame:
    """(place, value): the JSON line of each row, with its columns by name; place orders the lines of an export."""
    place = F.struct("repo", "number", "source_type", "source_id", "chunk_index")
    return documents.select(place.alias("place"), F.to_json(F.struct(*sorted(documents.columns))).alias("value"))


def corpus_digest(lines: DataFrame) -> DataFrame:
    """One row: how many lines there are, and a digest that does not depend on their order or partitions.

    The digests of the lines are summed in four parts, which combine before any shuffle, and the sums are hashed.
    """
    d = F.sha2("value", 256)
    parts = [F.sum(F.conv(F.substring(d, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = [F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]
    return lines.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *sums), 256).alias("digest"))


def export(documents: DataFrame, path: str, dataset: str = "corpus") -> str:
    """Write a header line, then the rows as JSON lines in the order of their identity; return the digest of the rows."""
    lines = corpus_lines(documents)
    head = corpus_digest(lines).select(F.lit(0).alias("part"), F.lit(None).cast(lines.schema["place"].dataType).alias("place"), F.to_json(F.struct(F.lit(dataset).alias("dataset"), "rows", "digest")).alias("value"))
    head.unionByName(lines.withColumn("part", F.lit(1))).orderBy("part", "place").select("value").write.mode("overwrite").text(path)
    return corpus_digest(lines).first()["digest"]


def repeat_share(pages: DataFrame, key: str, text: str) -> DataFrame:
    """How much of each page is lines that it has more than once."""
    lines = pages.select(key, F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> ''")
    counted = lines.groupBy(key, "line").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeated"))


def ranked_by_day(rows: DataFrame, by: Sequence[str], day: Column, order: Sequence[Column], parts: int) -> DataFrame:
    """`ranked` for large groups: rows are numbered within each day, on from the rows of the days before it, so that no group is one task.

    day: a date that the order follows, later dates first and null last.
    """
    place = F.coalesce(-F.unix_date(day), F.lit(2**31 - 1))  # a row a day and group is counted on
    rows = rows.withColumn("_day", place)
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*by, "_day").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = ranked(rows.repartition(parts, *by, "_day"), [*by, "_day"], order)
    return numbered.join(days, [*by, "_day"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_day", "_n", "_before")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
