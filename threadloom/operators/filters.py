"""Scope, trust and signal filters. Each is a predicate or a semi-join, put before any window."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import error_norm, error_query_form
from threadloom.operators import substrings
from threadloom.schemas import ENGAGEMENT, HUMAN, KINDS, MAX_HITS, TRUST

KEY = ("repo", "number")


@dataclass(frozen=True)
class SearchQuery:
    """A search after validation. Lists hold alternatives; kinds of filter narrow one another."""

    text: str = ""
    kind: str | None = None
    trust: str | None = None
    repos: tuple[str, ...] | None = None
    files: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    errors: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    since: datetime | None = None
    before: datetime | None = None
    exclude: tuple[int, ...] = ()
    limit: int = MAX_HITS
    sort: str = "relevance"
    match: str = "all"

    def checked(self) -> SearchQuery:
        """The query with its limit clamped and its logins in one form; ValueError for what can't be asked."""
        if self.kind is not None and self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.trust is not None and self.trust not in TRUST:
            raise ValueError(f"unknown trust {self.trust!r}")
        if self.sort not in ("relevance", "newest"):
            raise ValueError(f"unknown sort {self.sort!r}")
        if self.match not in ("all", "any"):
            raise ValueError(f"unknown match {self.match!r}")
        for name in ("since", "before"):
            value = getattr(self, name)
            if value is not None and value.tzinfo is None:
                raise ValueError(f"{name} needs a time zone")
        if self.since and self.before and self.since >= self.before:
            raise ValueError("since must be earlier than before")
        logins = tuple(dict.fromkeys(a.strip().removeprefix("@").lower() for a in self.authors if a.strip()))
        return replace(self, limit=max(1, min(self.limit, MAX_HITS)), authors=logins)


@dataclass(frozen=True)
class Corpus:
    """The relations that a search reads. Frames that a corpus lacks are None; key says how they join.

    error_grams and tails are indexes of errors and files; where they are there, they are asked instead of the whole tables.
    """

    threads: DataFrame
    documents: DataFrame
    files: DataFrame | None = None
    symbols: DataFrame | None = None
    errors: DataFrame | None = None
    tests: DataFrame | None = None
    labels: DataFrame | None = None
    links: DataFrame | None = None
    key: tuple[str, ...] = field(default=KEY)
    error_grams: substrings.Trigrams | None = None
    tails: substrings.PathTails | None = None

    def errors_with(self, pasted: Sequence[str]) -> DataFrame:
        return self.errors.where(error_matches(self.errors["message_norm"], pasted)) if self.error_grams is None else substrings.errors_with(self.errors, self.error_grams, pasted)

    def files_at(self, needles: Sequence[str]) -> DataFrame:
        return self.files.where(file_matches(self.files["path"], needles)) if self.tails is None else self.tails.matching(needles)


def in_scope(repos: Sequence[str] | None = None, before=None, exclude: Sequence[int] = (), repo: str = "repo", number: str = "number", created: str = "created_at") -> Column:
    """One predicate for scope, cutoff and exclusions. An empty list of repositories admits nothing, a null date nothing
    once there is a cutoff."""
    terms = [F.lit(True)]
    if repos is not None:
        terms.append(F.col(repo).isin(*repos) if repos else F.lit(False))
    if before is not None:
        terms.append(F.coalesce(F.col(created) < F.lit(before), F.lit(False)))
    if exclude:
        terms.append(~F.col(number).isin(*exclude))
    return reduce(lambda a, b: a & b, terms)


def trusted(kind: str | None = None, trust: str | None = None, tier: str = "trust", merged: str = "merged_at") -> Column:
    """Machine text only where it is asked for; reported text of merged threads counts for precedents."""
    if trust is not None:
        tiers = {"authoritative": ("authoritative",), "reported": HUMAN, "machine": TRUST}[trust]
        return F.col(tier).isin(*tiers)
    if kind == "precedent":
        return F.col(tier).isin("authoritative") | (F.col(merged).isNotNull() & F.col(tier).isin(*HUMAN))
    if kind == "rationale":
        return F.col(tier).isin("authoritative")
    return F.col(tier).isin(*HUMAN)


def file_matches(path: Column, needles: Sequence[str]) -> Column:
    """The path itself or its tail from a directory on."""
    wanted = [n for n in (x.strip().removeprefix("./") for x in needles) if n]
    return reduce(lambda a, b: a | b, ((path == n) | path.endswith(f"/{n}") for n in wanted), F.lit(False))


def error_matches(message: Column, pasted: Sequence[str]) -> Column:
    """Literal containment of any pasted error, once it has the stored form."""
    return reduce(lambda a, b: a | b, (F.contains(message, error_query_form(F.lit(p))) for p in pasted), F.lit(False))


def narrowed(rows: DataFrame, corpus: Corpus, q: SearchQuery) -> DataFrame:
    """Semi-joins for every kind of signal that the query names."""
    key = list(corpus.key)
    kinds = (
        (q.files, corpus.files, lambda d: corpus.files_at(q.files)),
        (q.symbols, corpus.symbols, lambda d: d.where(d["symbol"].isin(*q.symbols))),
        (q.errors, corpus.errors, lambda d: corpus.errors_with(q.errors)),
        (q.tests, corpus.tests, lambda d: d.where(d["test_id"].isin(*q.tests))),
        (q.labels, corpus.labels, lambda d: d.where(d["label"].isin(*q.labels))),
    )
    for values, signals, carrying in kinds:
        if values and signals is not None:
            rows = rows.join(carrying(signals).select(*key).distinct(), key, "left_semi")
    return rows


def admissible(corpus: Corpus, q: SearchQuery) -> DataFrame:
    """documents joined to their threads, under every filter but the text."""
    heads = corpus.threads.select(*corpus.key, *(c for c in ("repo",) if c not in corpus.key), F.col("merged_at"), F.col("author").alias("thread_author"), F.col("thread_type"))
    rows = corpus.documents.join(heads, list(corpus.key)).where(in_scope(q.repos, q.before, q.exclude) & trusted(q.kind, q.trust))
    if q.since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(q.since))
    if q.authors:
        rows = rows.where(F.lower("author").isin(*q.authors))
    return narrowed(rows, corpus, q)


def untested_by_files(corpus: Corpus, q: SearchQuery) -> DataFrame:
    """How many pull requests pass every filter but the files and have no changed file that could be tested."""
    key = list(corpus.key)
    rows = admissible(corpus, replace(q, files=())).where(F.col("thread_type") == "pr")
    changed = corpus.files.where(F.col("source") == "changed").select(*key).distinct()
    return rows.join(changed, key, "left_anti").agg(F.countDistinct(*key).alias("files_untested"))


def engagement(documents: DataFrame, opener: str = "thread_author") -> DataFrame:
    return documents.where(F.col("source_type").isin(*ENGAGEMENT) & F.col("author").isNotNull() & (F.col("author") != F.col(opener)))


def commentary(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("source_type").isin("title", "body"))


def merged_pulls(threads: DataFrame) -> DataFrame:
    return threads.where((F.col("thread_type") == "pr") & F.col("merged_at").isNotNull())


def open_pulls(threads: DataFrame, after: int | None = None) -> DataFrame:
    found = threads.where((F.col("thread_type") == "pr") & (F.col("state") == "open") & F.col("merged_at").isNull())
    return found if after is None else found.where(F.col("number") > after)


def globbed(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Shell-style matching of whole paths: * and ? may cross directories, [abc], [a-z] and [!abc] name characters.

    A bracket that is not closed stands for itself.
    """
    regex, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + 1 + pattern.startswith("!", i)) if c == "[" else -1
        if end > 0:
            chosen, i = pattern[i:end], end + 1
            ranges = re.sub(r"([\\\[\]^&])", r"\\\1", chosen.removeprefix("!"))
            regex += f"[{'^' * chosen.startswith('!')}{ranges}]"
        else:
            regex += {"*": ".*", "?": "."}.get(c, re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c))
    return files.where(F.col(path).rlike(f"(?s)^{regex}$"))


__all__ = ["KEY", "Corpus", "SearchQuery", "admissible", "commentary", "engagement", "error_matches", "error_norm", "file_matches", "globbed", "in_scope", "merged_pulls", "narrowed", "open_pulls", "trusted", "untested_by_files"]
