"""Raw payloads to threads, documents and signals, for all changed threads at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import schemas as S
from threadloom.functions import extract
from threadloom.functions.chunking import chunked
from threadloom.functions.text import content_hash, definitive_path, normalize, redact, strip_hidden, timestamp, trust_tier
from threadloom.sources.landed import numbered_by_url, payloads

BOTS = ("dependabot", "github-actions", "codecov", "renovate")


def _bot(user: str) -> Column:
    return F.coalesce((F.col(f"{user}.type") == "Bot") | F.regexp_replace(F.lower(f"{user}.login"), r"\[bot\]$", "").isin(*BOTS), F.lit(False))


def threads(raw: DataFrame) -> DataFrame:
    """One row a thread. A merge time comes from the detail node, the thread itself or its pull request part, in this order."""
    heads = payloads(raw, ("issue", "pr"), S.THREAD_PAYLOAD)
    details = payloads(raw, "pr_details", S.DETAIL_PAYLOAD).select("repo", F.col("p.number").alias("number"), "p.mergedAt", "p.mergedBy.login")
    rows = heads.select("repo", F.col("p.number").alias("number"), "p").join(details, ["repo", "number"], "left")
    return rows.select(
        "repo", "number", F.when(F.col("p.pull_request").isNotNull(), "pr").otherwise("issue").alias("thread_type"), "p.title", F.col("p.user.login").alias("author"), "p.state", F.col("p.html_url").alias("url"),
        *(timestamp(F.col(f"p.{c}")).alias(c) for c in ("created_at", "updated_at", "closed_at")), timestamp(F.coalesce("mergedAt", "p.merged_at", "p.pull_request.merged_at")).alias("merged_at"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("p.labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]))).alias("labels"),
        F.struct(F.col("login").alias("merged_by"), F.col("p.state_reason"), F.col("p.closed_by.login").alias("closed_by"), F.array_sort(F.transform("p.requested_reviewers", lambda x: x["login"])).alias("requested_reviewers")).alias("events"),
    )


def adapted_reviews(raw: DataFrame) -> DataFrame:
    """Reviews of both kinds in one shape: those of the detail node that the list did not have are added."""
    listed = payloads(raw, "review", S.REVIEW_PAYLOAD).select("repo", F.col("thread_number").alias("number"), "p.id", "p.body", "p.state", F.col("p.user.login").alias("login"), F.col("p.user.type").alias("type"), F.col("p.author_association").alias("association"), "p.submitted_at", F.col("p.html_url").alias("url"))
    nodes = payloads(raw, "pr_details", S.DETAIL_PAYLOAD).select("repo", F.col("p.number").alias("number"), F.explode("p.reviews.nodes").alias("n"))
    nodes = nodes.select("repo", "number", F.col("n.databaseId").alias("id"), "n.body", "n.state", "n.author.login", F.col("n.author.__typename").alias("type"), F.col("n.authorAssociation").alias("association"), F.col("n.submittedAt").alias("submitted_at"), "n.url")
    return listed.unionByName(nodes.join(listed.select("repo", "number", "id"), ["repo", "number", "id"], "left_anti"))


def sources(raw: DataFrame) -> DataFrame:
    """Every text with where it came from, redacted and not yet cut: what signals are read from. A payload is parsed once for all of its texts."""
    heads = payloads(raw, ("issue", "pr"), S.THREAD_PAYLOAD).withColumn("number", F.col("p.number"))
    comments = numbered_by_url(payloads(raw, "issue_comment", S.COMMENT_PAYLOAD)).withColumn("number", F.col("thread_number"))
    inline = numbered_by_url(payloads(raw, "review_comment", S.REVIEW_COMMENT_PAYLOAD)).withColumn("number", F.col("thread_number"))
    reviews = adapted_reviews(raw)
    none = F.lit(None).cast("string")

    def row(kind: str, source_id: Column, body: Column, login: Column, bot: Column, association: Column, at: Column, metadata: Column, hunk: Column = none, path: Column = none):
        return F.struct(F.lit(kind).alias("source_type"), source_id.cast("long").alias("source_id"), body.alias("markdown"), login.alias("author"), bot.alias("author_is_bot"), association.alias("association"), timestamp(at).alias("created_at"), metadata.alias("metadata"), hunk.alias("diff_hunk"), path.alias("path"))

    def texts(rows: DataFrame, *each: Column) -> DataFrame:
        return rows.select("repo", "number", F.inline(F.array(*each)))  # what is asked of a text is not asked of a payload parsed once more

    user = (F.col("p.user.login"), _bot("p.user"), F.col("p.author_association"), F.col("p.created_at"))
    where = ("diff_hunk", "in_reply_to_id", "line", "original_line", "path", "pull_request_review_id", "side", "start_line", "subject_type")
    review_bot = F.coalesce(F.col("type") == "Bot", F.lit(False))
    parts = [
        texts(heads, *(row(c, F.col("number"), F.col(f"p.{c}"), *user, F.lit("{}")) for c in ("title", "body"))),
        texts(comments, row("issue_comment", F.col("p.id"), F.col("p.body"), *user, F.lit("{}"))),
        texts(reviews, row("review", F.col("id"), F.col("body"), F.col("login"), review_bot, F.col("association"), F.col("submitted_at"), F.to_json(F.struct("state")))),
        texts(inline, row("review_comment", F.col("p.id"), F.col("p.body"), *user, F.to_json(F.struct(*(F.col(f"p.{c}") for c in where))), redact(F.col("p.diff_hunk")), F.col("p.path"))),
    ]
    every = reduce(DataFrame.unionByName, parts)
    written = F.coalesce("markdown", F.lit(""))
    shown = every.where(F.trim(strip_hidden(written)) != "")  # what is redacted leaves a text with its name, so this says it of redacted texts
    return shown.withColumn("markdown", redact(written))


def documents(texts: DataFrame, authority: DataFrame, stored: bool = False) -> DataFrame:
    """Chunks with their trust. `authority` (repo, login, permission) is a dimension; it is joined, and broadcast only if
    the session finds it small. Texts are cut where they are, not where all texts of an author meet. stored: the texts cost little to read
    twice, so that only long ones are sent to Python workers."""
    whole = F.col("source_type").isin("title", "review_comment")
    long = ~whole & (F.char_length("markdown") > S.MAX_CHUNK)

    def pieces(rows: DataFrame, split: bool) -> DataFrame:
        parts = F.when(whole, F.array(F.trim("markdown"))).otherwise(chunked(F.col("markdown"), split))
        return rows.select("repo", "number", "source_type", "source_id", "author", "author_is_bot", "association", "created_at", "metadata", F.posexplode(parts).alias("chunk_index", "body_markdown"))

    cut = pieces(texts.where(~long), False).unionByName(pieces(texts.where(long), True)) if stored else pieces(texts, True)
    cut = cut.withColumn("body_text", normalize(F.col("body_markdown")))
    cut = cut.withColumn("content_hash", content_hash(F.col("body_markdown"), F.col("metadata"), F.lit(S.CHUNKING_VERSION)))
    ranks = authority.select("repo", F.col("login").alias("author"), "permission")
    trust = trust_tier(F.col("author_is_bot"), F.col("association"), F.col("permission")).alias("trust")
    rows = cut.join(ranks, ["repo", "author"], "left")
    return rows.select("repo", "number", "source_type", "source_id", "author", "author_is_bot", trust, "created_at", "metadata", "chunk_index", "body_markdown", "body_text", "content_hash")


def signals(texts: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """The signal tables of all threads, each with the earliest time at which it could be known."""
    text = F.concat_ws("\n", "markdown", "diff_hunk")
    key = ("repo", "number")
    details = payloads(raw, "pr_details", S.DETAIL_PAYLOAD).select("repo", F.col("p.number").alias("number"), F.col("p").alias("detail"))
    said = extract.paths(texts, text, *key, "created_at").select(*key, "path", F.lit(None).cast("string").alias("change_type"), F.lit("mentioned").alias("source"), F.col("created_at").alias("first_seen_at"))
    attached = texts.where("path is not null").select(*key, definitive_path(F.col("path")).alias("path"), F.lit(None).cast("string").alias("change_type"), F.lit("comment").alias("source"), F.col("created_at").alias("first_seen_at")).where("path is not null")
    changed = extract.changed_files(details, *key).select(*key, "path", "change_type", F.lit("changed").alias("source"), F.lit(None).cast("timestamp").alias("first_seen_at"))
    level = F.when(F.col("source") == "changed", 0).when(F.col("source") == "comment", 1).otherwise(2)
    files = said.unionByName(attached).unionByName(changed).groupBy(*key, "path").agg(F.min_by("change_type", level).alias("change_type"), F.min_by("source", level).alias("source"), F.min("first_seen_at").alias("first_seen_at"))
    heads = threads(raw).select(*key, "thread_type")
    return {
        "files": files,
        "errors": extract.errors(texts, text, *key),
        "tests": extract.tests(texts, text, *key),
        "symbols": extract.symbols(texts, text, *key),
        "commits": extract.commits(details, *key),
        "links": extract.links(texts.join(heads, list(key)), F.col("markdown"), *key).union(extract.closing_references(details, *key)).distinct().withColumn("relationship", F.lit("closes")),
    }
