"""Reading one or many threads: heads, people, comments, samples, claims, files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.schemas import MAX_CLAIMS, MAX_COMMENTS, MAX_OUTLINE, MAX_PEOPLE, OUTLINE_SNIPPET

from threadloom.functions.text import clip


def passages(documents: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many chunks each comment has."""
    return documents.groupBy(*key, "source_type", "source_id").agg(F.count("*").alias("passages"))


def first_chunks(documents: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a comment: its first chunk."""
    n = F.row_number().over(Window.partitionBy(*key, "source_type", "source_id").orderBy(*order))
    return documents.withColumn("_n", n).where("_n = 1").drop("_n")


def rejoined(documents: DataFrame, key: Sequence[str], text: Column, order: Column, between: str = "\n\n") -> DataFrame:
    """The whole text of each comment, from its chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return documents.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), between).alias("body"), F.count("*").alias("chunks"))


def participants(comments: DataFrame, key: Sequence[str], source: str = "source_id", most: int | None = MAX_PEOPLE) -> DataFrame:
    """Who speaks in a thread, the authoritative first, then the latest; machine comments are counted, not listed."""
    people = comments.where(F.col("trust") != "machine").groupBy(*key, "author", "trust").agg(F.countDistinct(source).alias("comments"), F.max("created_at").alias("last_at"))
    machines = comments.where(F.col("trust") == "machine").groupBy(*key).agg(F.countDistinct(source).alias("machine_comments"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.when(F.col("trust") == "authoritative", 0).otherwise(1), F.col("last_at").desc_nulls_last(), F.col("author"), F.col("trust")))
    people = people.withColumn("position", n)
    people = people if most is None else people.where(F.col("position") <= most)
    return people.join(machines, list(key), "left").withColumn("machine_comments", F.coalesce("machine_comments", F.lit(0)))


def author_records(threads: DataFrame) -> DataFrame:
    """What each author has opened: issues, pull requests, merged ones, and since when."""
    pr = F.col("thread_type") == "pr"
    return threads.groupBy("repo", "author").agg(
        F.count_if(F.col("thread_type") == "issue").alias("issues"), F.count_if(pr).alias("prs"), F.count_if(pr & F.col("merged_at").isNotNull()).alias("merged"), F.min("created_at").alias("first_at")
    )


def claims(links: DataFrame, threads: DataFrame, targets: DataFrame | None = None, most: int | None = MAX_CLAIMS) -> DataFrame:
    """Work in flight: who claims to close a number; open ones first, then those touched last, with the total before the cap.

    Links and threads meet on repo and number; targets have target_number, and repo if they are of several repositories. Threads without an
    updated_at column go by their creation.
    """
    rows = links.join(threads, ["repo", "number"])
    if targets is not None:
        rows = rows.join(targets, [c for c in ("repo", "target_number") if c in targets.columns], "left_semi")
    by = Window.partitionBy("repo", "target_number")
    touched = "updated_at" if "updated_at" in rows.columns else "created_at"
    order = by.orderBy(F.when(F.col("state") == "open", 0).otherwise(1), F.col(touched).desc_nulls_last(), F.col("number"))
    rows = rows.withColumns({"position": F.row_number().over(order), "total": F.count("*").over(by)})
    return rows if most is None else rows.where(F.col("position") <= most)


def resolved(links: DataFrame, threads: DataFrame) -> DataFrame:
    """Every claim with the thread it names, if that is indexed."""
    heads = threads.select("repo", F.col("number").alias("target_number"), F.lit(True).alias("resolved"))
    return links.join(heads, ["repo", "target_number"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def ends_and_middle(comments: DataFrame, key: Sequence[str], order: Sequence[Column], review: Column, head: int = 2, tail: int = 2, slots: int = MAX_COMMENTS - 4) -> DataFrame:
    """A sample of a long thread: its ends whole, and from the middle reviews first, then the rest, each spread evenly.

    The picks are round(i * (n - 1) / (slots - 1)), halves to even, for the n rows of the class.
    """
    by = Window.partitionBy(*key)
    rows = comments.withColumns({"position": F.row_number().over(by.orderBy(*order)), "n": F.count("*").over(by)})
    middle = (F.col("position") > head) & (F.col("position") <= F.col("n") - tail)
    rows = rows.withColumns({"_middle": middle, "_review": middle & review})
    kind = Window.partitionBy(*key, "_middle", "_review")
    rows = rows.withColumns({"_i": F.row_number().over(kind.orderBy(*order)) - 1, "_m": F.count("*").over(kind), "_reviews": F.count_if("_review").over(by)})
    taken = F.least(F.col("_reviews"), F.lit(slots))
    room = F.when(F.col("_review"), F.lit(slots)).otherwise(slots - taken)
    even = F.transform(F.sequence(F.lit(0), F.greatest(room - 1, F.lit(0))), lambda i: F.when(room > 1, F.bround(i * (F.col("_m") - 1) / (room - 1), 0)).otherwise(F.lit(0.0)).cast("long"))
    picked = ~F.col("_middle") | ((room > 0) & ((F.col("_m") <= room) | F.array_contains(even, F.col("_i").cast("long"))))
    return rows.where(picked | (F.col("n") <= head + tail + slots)).drop("_middle", "_review", "_i", "_m", "_reviews")


def ends(comments: DataFrame, key: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first limit // 2 and the last of the rest."""
    by = Window.partitionBy(*key)
    rows = comments.withColumns({"position": F.row_number().over(by.orderBy(*order)), "n": F.count("*").over(by)})
    return rows.where((F.col("position") <= limit // 2) | (F.col("position") > F.col("n") - (limit - limit // 2)))


def after(comments: DataFrame, created, source_type: str, source_id) -> DataFrame:
    """Keyset paging: what comes strictly after (created, source_type, source_id); rows without a date come last."""
    c, t, s = F.col("created_at"), F.col("source_type"), F.col("source_id")
    if created is None:
        return comments.where(c.isNull() & ((t > source_type) | ((t == source_type) & (s > source_id))))
    return comments.where(c.isNull() | (c > F.lit(created)) | ((c == F.lit(created)) & ((t > source_type) | ((t == source_type) & (s > source_id)))))


def outline(comments: DataFrame, key: Sequence[str], order: Sequence[Column], text: str = "body_text", most: int = MAX_OUTLINE) -> DataFrame:
    """One short line a comment, in order, up to `most` a thread, with how many there are."""
    by = Window.partitionBy(*key)
    rows = comments.withColumns({"position": F.row_number().over(by.orderBy(*order)), "reachable": F.count("*").over(by)})
    return rows.where(F.col("position") <= most).withColumn("line", clip(F.col(text), OUTLINE_SNIPPET))


def focused(comments: DataFrame, terms: Sequence[str], text: str = "body_text") -> DataFrame:
    """Comments that carry any of the terms, with how many of them."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(t.lower())).cast("int") for t in terms]
    return comments.withColumn("carried", sum(hits[1:], hits[0])).where("carried > 0")


def anchored(documents: DataFrame, matches: Column, key: Sequence[str], text_size: Column, ties: Sequence[Column]) -> DataFrame:
    """For each thread the comment anchored to a path that says most: authoritative first, then the longest."""
    rank = F.struct((F.col("trust") == "authoritative").cast("int").alias("a"), text_size.alias("b"), *(t.alias(f"t{i}") for i, t in enumerate(ties)))
    rest = [c for c in documents.columns if c not in key]
    rows = documents.where(matches & F.col("trust").isin("authoritative", "reported"))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("h")).select(*key, "h.*")


def provenance(files: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a path: changed beats comment beats mentioned; files without a source are judged by their change type."""
    source = F.coalesce("source", F.when(F.col("change_type").isNotNull(), "changed").otherwise("mentioned")) if "change_type" in files.columns else F.col("source")
    level = F.when(source == "changed", 0).when(source == "comment", 1).otherwise(2)
    return files.groupBy(*key, "path").agg(F.min_by(source, level).alias("source"))


def review_decision(reviews: DataFrame, key: Sequence[str], at: str = "created_at", ties: Sequence[Column] = ()) -> DataFrame:
    """The latest decisive review of each reviewer decides; one request for changes blocks, else approvals count.

    A dismissal is decisive, and takes back what its reviewer said before.
    """
    decisive = reviews.where(F.col("state").isin("APPROVED", "CHANGES_REQUESTED", "DISMISSED"))
    latest = decisive.groupBy(*key, "author").agg(F.max_by("state", F.struct(F.col(at), *ties)).alias("state"))
    by = lambda s: F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("author"))))
    both = latest.groupBy(*key).agg(by("CHANGES_REQUESTED").alias("_block"), by("APPROVED").alias("_ok"))
    decision = F.when(F.size("_block") > 0, "CHANGES_REQUESTED").when(F.size("_ok") > 0, "APPROVED")
    return both.select(*key, decision.alias("decision"), F.when(F.size("_block") > 0, F.col("_block")).otherwise(F.col("_ok")).alias("decided_by")).where("decision is not null")


def path_shape(files: DataFrame, key: Sequence[str], top: int = 3) -> DataFrame:
    """The leading directories (two segments) of a thread's files, and the rest as one count."""
    where = F.when(F.size(F.split("path", "/")) > 2, F.substring_index("path", "/", 2)).otherwise(F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("."))
    groups = files.select(*key, where.alias("directory")).groupBy(*key, "directory").agg(F.count("*").alias("files"))
    by = Window.partitionBy(*key)
    groups = groups.withColumns({"position": F.row_number().over(by.orderBy(F.col("files").desc(), F.col("directory"))), "directories": F.count("*").over(by)})
    shown = F.when(F.col("position") <= top, F.col("directory")).otherwise("(rest)")
    return groups.groupBy(*key, shown.alias("directory"), "directories").agg(F.sum("files").alias("files"))
