"""Small questions about what is staged, indexed and named: each is a filter, a semi-join or one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import is_symbol, named
from threadloom.operators.filters import KEY, in_scope
from threadloom.schemas import HUMAN

#: Words that say nothing about an error.
PLAIN_WORDS = (
    "the", "a", "an", "and", "or", "but", "for", "with", "from", "this", "that", "have", "has", "must", "been", "will", "your", "you", "not", "are", "was", "were", "only", "when",
    "where", "what", "which", "while", "into", "over", "under", "than", "then", "them", "they",
)
QUERY_CHARACTERS = 256
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def staged_numbers(raw: DataFrame, after: int | None = None) -> DataFrame:
    """The threads that are staged, in order, from a cursor on."""
    found = raw.where("number is not null").select(*KEY).distinct()
    return (found if after is None else found.where(F.col("number") > after)).orderBy(*KEY)


def threads_of_objects(raw: DataFrame, objects: DataFrame) -> DataFrame:
    return raw.join(objects, [c for c in ("repo", "object_type", "object_id") if c in objects.columns], "left_semi").select(*KEY).distinct()


def orphans(raw: DataFrame, threads: DataFrame) -> DataFrame:
    """Numbers that comments name and no thread has."""
    return raw.where("number is not null").select(*KEY).distinct().join(threads.select(*KEY), list(KEY), "left_anti")


def mergers(threads: DataFrame, merged_by: Column) -> DataFrame:
    """Who has merged a pull request of a repository, which only those who may write can."""
    return threads.where(F.col("merged_at").isNotNull()).select("repo", merged_by.alias("login")).where("login is not null").distinct()


def member_authors(documents: DataFrame) -> DataFrame:
    """Members whose right to write is still to be looked up."""
    return documents.where((F.col("association") == "MEMBER") & ~F.col("author_is_bot") & F.col("author").isNotNull()).select("repo", "author").distinct()


def threads_by(documents: DataFrame, logins: DataFrame) -> DataFrame:
    """Threads that carry a document by any of (repo, login)."""
    return documents.join(logins.select("repo", F.col("login").alias("author")), ["repo", "author"], "left_semi").select(*KEY).distinct()


def freshness(threads: DataFrame) -> DataFrame:
    return threads.where("updated_at is not null").select(*KEY, "updated_at")


def indexed_repos(threads: DataFrame) -> DataFrame:
    return threads.select("repo").distinct().orderBy("repo")


def floors(state: DataFrame, repo: str) -> DataFrame:
    """The declared samples of a repository and where they begin."""
    return state.where((F.col("repo") == repo) & F.col("pass").startswith("sample:") & F.col("high_water").isNotNull()).select("pass", "high_water").orderBy("pass")


def paths_to_threads(files: DataFrame) -> DataFrame:
    """The threads of each path, in order."""
    return files.groupBy("repo", "path").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def first_errors(errors: DataFrame) -> DataFrame:
    """One error a thread, as "Type: message": the first by type and message."""
    shown = F.concat_ws(": ", "exception_type", "message_norm")
    return errors.groupBy(*KEY).agg(F.min_by(shown, F.struct(F.col("exception_type").isNull(), "exception_type", "message_norm")).alias("error"))


def one_comment(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, number, source_id, status, body) for each comment wanted (repo, number, source_id).

    served with its whole text; suppressed if only a machine said it; absent if the thread has no such comment.
    """
    key = [*KEY, "source_id"]
    said = documents.where(~F.col("source_type").isin("title", "body")).join(wanted, key, "left_semi")
    human = F.col("trust").isin(*HUMAN)
    parts = F.array_sort(F.collect_list(F.when(human, F.struct("chunk_index", "body_text"))))
    found = said.groupBy(*key).agg(F.bool_or(human).alias("human"), F.array_join(F.transform(parts, lambda p: p["body_text"]), "\n").alias("body"))
    status = F.when(F.col("human").isNull(), "absent").when(F.col("human"), "served").otherwise("suppressed")
    return wanted.select(*key).distinct().join(found, key, "left").select(*key, status.alias("status"), F.when(F.col("human"), F.trim("body")).alias("body"))


@dataclass(frozen=True)
class AsOf:
    """A cutoff for every question. A request may narrow it: the earlier cutoff wins, exclusions add up."""

    before: datetime | None = None
    exclude: tuple[int, ...] = ()

    def narrowed(self, before: datetime | None = None, exclude: Sequence[int] = ()) -> AsOf:
        cutoffs = [t for t in (self.before, before) if t is not None]
        return AsOf(min(cutoffs, default=None), tuple(dict.fromkeys((*self.exclude, *exclude))))

    def reachable(self, threads: DataFrame) -> DataFrame:
        """The threads that may be named at all."""
        return threads.where(in_scope(None, self.before, self.exclude))

    def known(self, rows: DataFrame, created: str = "created_at") -> DataFrame:
        """Documents and signals that could be known by then, of any thread that is not excluded."""
        return rows.where(in_scope(None, self.before, self.exclude, created=created))


def without_staged(wanted: DataFrame, staged: DataFrame) -> DataFrame:
    return wanted.join(staged.select(*KEY), list(KEY), "left_anti")


def first_positions(results: DataFrame, question: str = "question", item: str = "item", position: str = "position") -> DataFrame:
    """Each item once a question, where it came first, ranked again from 1."""
    one = results.groupBy(question, item).agg(F.min(position).alias("first"))
    return one.select(question, item, F.row_number().over(Window.partitionBy(question).orderBy("first", item)).alias("rank"))


def best_candidates(candidates: DataFrame, question: Sequence[str], most: int, kind: str = "kind", score: str = "score", ident: str = "id") -> DataFrame:
    """Mined candidates: one a question, the best first, `most` of each kind."""
    order = [F.col(score).desc(), F.col(ident)]
    one = candidates.withColumn("n_", F.row_number().over(Window.partitionBy(*question).orderBy(*order))).where("n_ = 1")
    return one.withColumn("n_", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("n_") <= most).drop("n_")


def slice_counts(examples: DataFrame, by: str, values: Sequence[str], of: str = "kind") -> DataFrame:
    return examples.groupBy(of).pivot(by, list(values)).count().na.fill(0, list(values))


def run_summary(calls: DataFrame, run: Sequence[str]) -> DataFrame:
    """How each run went: calls, refusals, sizes, when it first met the evidence, lines it was shown again, repeated calls."""
    open_ = ~F.col("refused")
    chars, lines = F.when(open_, F.col("chars")), F.sum(F.when(open_, F.col("lines")))
    return calls.groupBy(*run).agg(
        F.count("*").alias("calls"), F.count_if("refused").alias("refused"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars_total"), F.round(F.avg(chars), 1).alias("chars_mean"), F.median(chars).alias("chars_median"),
        F.max(chars).alias("chars_max"), F.min(F.when(F.col("reached_evidence"), F.col("position"))).alias("time_to_evidence"), F.round(1 - F.sum(F.when(open_, F.col("new_lines"))) / F.nullif(lines, F.lit(0)), 3).alias("repeat_share"),
        (F.count("*") - F.count_distinct("argv")).alias("rerolls"),
    )


def replaced_labels(stored: DataFrame, wanted: DataFrame, touched: DataFrame) -> DataFrame:
    """(repo, number, label) after the labels of the touched threads were replaced."""
    return stored.join(touched.select(*KEY).distinct(), list(KEY), "left_anti").select(*KEY, "label").unionByName(wanted.select(*KEY, "label").distinct())


def progressed(state: DataFrame, steps: DataFrame) -> DataFrame:
    """Cursors of passes (repo, pass, cursor) after steps (repo, pass, cursor, done): a pass that ended has none, and each
    pass goes on by itself."""
    key = ["repo", "pass"]
    met = state.select(*key, F.col("cursor").alias("old")).join(steps.select(*key, F.col("cursor").alias("new"), "done"), key, "full_outer")
    return met.select(*key, F.when(F.col("done").isNull(), F.col("old")).when(~F.col("done"), F.col("new")).alias("cursor"))


def labelled_examples(labels: DataFrame, examples: DataFrame, key: Column) -> DataFrame:
    """Labels with the example that asks the same, whatever its spacing and case."""
    return labels.withColumn("asked_", key).join(examples.withColumn("asked_", key).select("asked_", F.col("id").alias("example")), "asked_", "inner").drop("asked_")


# -- words of a question -----------------------------------------------------------------------------------------------


def _first(words: Column, want: int) -> Column:
    return F.slice(words, 1, want)


def _distinct_folded(words: Column) -> Column:
    """Words once each, whatever their case, the first spelling of each."""
    return named(words, lambda w: F.filter(w, lambda x, i: ~F.exists(F.slice(w, 1, i), lambda y: F.lower(y) == F.lower(x))))


def query_terms(primary: Column, secondary: Column, want: int = 2) -> Column:
    """Up to `want` identifiers from code spans, primary text first: the part behind the last dot, if it has 4 characters or more."""
    spans = lambda text: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`{1,3}([^`\n]+)`{1,3}"), F.lit(1)), lambda s: F.trim(s))
    found = F.transform(F.filter(F.concat(spans(primary), spans(secondary)), lambda s: is_symbol(s)), lambda s: F.substring_index(s, ".", -1))
    return _first(_distinct_folded(F.filter(found, lambda t: F.char_length(t) >= 4)), want)


def title_terms(title: Column, want: int = 2) -> Column:
    """Up to `want` words of a title that pass the symbol test, cut to the part behind the last dot; case does not tell words apart."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"[A-Za-z_][\w.]{3,}"), F.lit(0))
    return _first(F.transform(_distinct_folded(F.filter(words, lambda w: is_symbol(w))), lambda w: F.substring_index(w, ".", -1)), want)


def distinctive(message: Column, want: int = 3) -> Column:
    """Up to `want` different lower-case words of a message, in order, without those of PLAIN_WORDS and those under 4 letters."""
    words = F.regexp_extract_all(F.lower(message), F.lit("[a-z_][a-z_]{3,}"), F.lit(0))
    return _first(F.array_distinct(F.filter(words, lambda w: ~w.isin(*PLAIN_WORDS))), want)


def fitted(terms: Column, scope: Column, budget: int = QUERY_CHARACTERS) -> Column:
    """Every scope qualifier, and in front of them as many terms, in order, as the budget leaves."""
    start = F.array_join(scope, " ")
    put = lambda query, t: F.when(query == "", t).otherwise(F.concat(t, F.lit(" "), query))
    return F.trim(F.aggregate(terms, start, lambda query, t: F.when(F.char_length(put(query, t)) <= budget, put(query, t)).otherwise(query)))


def interval_seconds(value: Column) -> Column:
    """`30s`, `5m`, `2h`, `1d` or plain seconds, as seconds; null for what is neither."""
    v = F.trim(value)
    unit = F.create_map(*(F.lit(x) for pair in UNIT_SECONDS.items() for x in pair))
    return F.when(v.rlike(r"^\d+[smhd]$"), F.try_element_at(unit, F.substring(v, -1, 1)) * F.expr("1.0D") * F.regexp_extract(v, r"^\d+", 0).try_cast("double")).otherwise(v.try_cast("double"))


