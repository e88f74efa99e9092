"""The verbs as methods: each returns a DataFrame, or a few under their names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import asof, codelens, datasets, filters, fulltext, lookups, provenance, ranking, segments, substrings, threads
from threadloom.operators.filters import Corpus, SearchQuery
from threadloom.operators.lookups import AsOf
from threadloom.plans import derive
from threadloom.schemas import ENGLISH_STOPWORDS, MAX_COMMENTS, MAX_THREADS

#: How documents become postings: all words, positions with the stopwords, stems.
ENGLISH = {"analyzer": fulltext.words, "stopwords": ENGLISH_STOPWORDS, "stemming": True}
_RELATIONS = ("threads", "documents", "files", "symbols", "errors", "tests", "labels", "links")


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    corpus: Corpus
    postings: DataFrame | segments.Segments
    commits: DataFrame | None = None
    history: DataFrame | None = None
    pin: AsOf = field(default_factory=AsOf)
    unpinned: Engine | None = None

    @staticmethod
    def over(spark: SparkSession, raw: DataFrame, authority: DataFrame) -> Engine:
        """An engine over landed payloads."""
        texts, heads = derive.sources(raw), derive.threads(raw)
        signals = derive.signals(texts, raw)
        docs = derive.documents(texts, authority).withColumn("doc_key", F.concat_ws(":", "repo", "number", "source_type", "source_id", "chunk_index"))
        corpus = Corpus(heads, docs, signals["files"], signals["symbols"], signals["errors"], signals["tests"], heads.select("repo", "number", F.explode("labels").alias("label")), signals["links"])
        return Engine(spark, corpus, fulltext.postings(docs, "doc_key", "body_text", stemming=True, analyzer=fulltext.english), signals["commits"])

    def saved(self, path: str) -> Engine:
        """Write the relations and the full-text index to a folder, and open them from there: verbs read tables then."""
        path = path.rstrip("/")
        if segments.Segments(self.spark, f"{path}/index", "doc_key").segments():
            raise ValueError(f"{path} holds an engine already")
        for name in _RELATIONS:
            rows = getattr(self.corpus, name)
            if name == "documents":  # in folders of threads, so that a thread or a page reads its own
                rows = rows.withColumn("doc_bucket", ranking.doc_bucket(F.col("repo"), F.col("number"))).repartitionByRange("doc_bucket", "repo", "number")
                rows.sortWithinPartitions("doc_bucket", "repo", "number").write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{path}/{name}")
            else:
                rows.write.mode("overwrite").parquet(f"{path}/{name}")
        self.commits.write.mode("overwrite").parquet(f"{path}/commits")
        opened = Engine.opened(self.spark, path)
        substrings.Trigrams.build(opened.corpus.errors, f"{path}/error_grams", opened.corpus.key, "message_norm")
        substrings.PathTails.build(opened.corpus.files, f"{path}/tails")
        opened.postings.append(opened.corpus.documents, "body_text", ranking.FACETS, **ENGLISH)
        return opened

    @staticmethod
    def opened(spark: SparkSession, path: str) -> Engine:
        """An engine over a folder that `saved` wrote."""
        path = path.rstrip("/")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        corpus = Corpus(**{name: read(name) for name in _RELATIONS}, error_grams=substrings.Trigrams(spark, f"{path}/error_grams", filters.KEY), tails=substrings.PathTails(spark, f"{path}/tails"))
        return Engine(spark, corpus, segments.Segments(spark, f"{path}/index", "doc_key"), read("commits"))

    def pinned(self, before: datetime | None = None, exclude: Sequence[int] = ()) -> Engine:
        """This engine as of a time: no verb of it can tell what was said, edited or merged later, or anything of the excluded threads.

        A pin can be narrowed by another one and never loosened. Texts are the versions that stood then (history holds the superseded
        ones), signals are read from them again. `saved` writes the pinned engine with an index of its own. Labels and commit lists carry no
        times: labels are left out, commits are kept for threads that were merged by then.
        """
        if before is not None and before.tzinfo is None:
            raise ValueError("before needs a time zone")
        whole, pin = self.unpinned or self, self.pin.narrowed(before, exclude)
        c, key = whole.corpus, list(filters.KEY)
        kept = lambda rows: rows.where(~F.col("number").isin(*pin.exclude)) if pin.exclude else rows
        if pin.before is None:
            relations = {n: kept(rows) for n in _RELATIONS if (rows := getattr(c, n)) is not None}
            commits = kept(whole.commits) if whole.commits is not None else None
        else:
            at = F.lit(pin.before)
            heads = asof.threads_at(kept(c.threads), pin.before)
            stood = asof.versions(c.documents.drop("doc_bucket"), whole.history).where(asof.stood_at(at) & (F.col("created_at") < at)).drop("valid_from", "valid_to")
            docs = stood.join(heads.select(*key), key, "left_semi")
            signals = asof.signals_at(asof.rejoined_texts(docs), heads, c.files, pin.before)
            relations = {"threads": heads, "documents": docs, "labels": c.labels.where(F.lit(False)) if c.labels is not None else None, **signals}
            merged = heads.where("merged_at is not null").select(*key)
            commits = whole.commits.join(merged, key, "left_semi") if whole.commits is not None else None
        return Engine(self.spark, Corpus(**relations), fulltext.postings(relations["documents"], "doc_key", "body_text", stemming=True, analyzer=fulltext.english), commits, None, pin, whole)

    def _of(self, rows: DataFrame, repo: str, number: int) -> DataFrame:
        """A thread's own rows; a table in folders is read in one of them."""
        mine = rows.where((F.col("repo") == repo) & (F.col("number") == number))
        return mine.where(F.col("doc_bucket") == ranking.doc_bucket(F.lit(repo), F.lit(number))) if "doc_bucket" in rows.columns else mine

    def search(self, text: str = "", how: str = "bm25", **filters_: object) -> tuple[DataFrame, bool]:
        q = SearchQuery(text=text, **filters_)
        page, widened = ranking.search(self.corpus, q, self.postings, terms_of=fulltext.asked_english, how=how)
        return ranking.with_snippets(page, q), widened

    def thread(self, repo: str, number: int, focus: str = "", comment: int | None = None, after: tuple[datetime | None, str, int] | None = None) -> dict[str, DataFrame]:
        """A thread's page. after: (created_at, source_type, source_id) of the last comment that was shown; the next ones follow, in order. comment: one
        comment whole, with a status that tells whether it is served, suppressed or absent."""
        mine = self._of(self.corpus.documents, repo, number)
        order = [F.col("created_at").asc_nulls_last(), F.col("source_type"), F.col("source_id")]
        talk = threads.first_chunks(filters.commentary(mine).where("trust <> 'machine'"), ["repo", "number"], [F.col("chunk_index")])
        talk = threads.focused(talk, re.findall(r"[A-Za-z0-9_]+", focus)) if focus else talk
        page = threads.ends_and_middle(talk, ["repo", "number"], order, F.col("source_type").startswith("review")) if after is None else threads.after(talk, *after).orderBy(*order).limit(MAX_COMMENTS)
        here = lambda rows: rows.where((F.col("repo") == repo) & (F.col("number") == number))
        found = {
            "head": here(self.corpus.threads),
            "body": threads.rejoined(mine.where("source_type = 'body'"), ["repo", "number"], F.col("body_text"), F.col("chunk_index")),
            "comments": page,
            "outline": threads.outline(talk, ["repo", "number"], order),
            "people": threads.participants(filters.commentary(mine), ["repo", "number"]),
            "files": here(self.corpus.files),
            "links": threads.resolved(here(self.corpus.links), self.corpus.threads),
            "error": here(lookups.first_errors(here(self.corpus.errors))),
        }
        if self.corpus.labels is not None:
            found["labels"] = here(self.corpus.labels).select("label").distinct().orderBy("label")
        if comment is not None:
            found["comment"] = lookups.one_comment(mine, self.spark.createDataFrame([(repo, number, comment)], "repo string, number long, source_id long"))
        return found

    def inflight(self, repo: str, number: int) -> DataFrame:
        target = self.spark.createDataFrame([(repo, number)], "repo string, target_number long")
        return threads.claims(self.corpus.links, self.corpus.threads, target)

    def brief(self, repo: str, number: int) -> dict[str, DataFrame]:
        """The briefing on one thread: what it closes and who else does, the history of its files, threads with its error, who opened it, who
        talks in it, and threads like it that no other section shows. The title's words are asked as any words."""
        c = self.corpus
        found = provenance.brief(repo, number, c.threads, c.links, c.files, c.errors)
        mine = self._of(c.documents, repo, number)
        found["opener"] = threads.author_records(c.threads.where(F.col("repo") == repo).join(found["head"].select("author"), "author", "left_semi"))
        found["people"] = threads.participants(filters.commentary(mine), ["repo", "number"])
        title = found["head"].select("title").first()
        if title and title[0] and fulltext.asked_english(title[0]):
            shown = [found["competing"].select("number"), found["closes"].select(F.col("target_number").alias("number")), found["file_history"].select("number"), found["same_error"].select("number")]
            seen = shown[0].union(shown[1]).union(shown[2]).union(shown[3]).distinct()
            like, _ = self.search(title[0], repos=(repo,), exclude=(number,), match="any")
            best = like.groupBy("repo", "number").agg(F.max("score").alias("score")).join(seen, "number", "left_anti")
            found["similar"] = best.orderBy(F.col("score").desc(), "number").limit(MAX_THREADS)
        return found

    def why(self, blamed: DataFrame) -> DataFrame:
        """blamed: (repo, sha, summary) rows, as a clone gives them. With path and line as well, each thread brings the review comments
        nearest the place (level 0 near the line, 1 in the file, 2 anywhere in the thread), where it has any."""
        found = provenance.threads_of_commits(blamed, self.commits, self.corpus.threads)
        if not {"path", "line"} <= set(blamed.columns):
            return found
        places = found.join(blamed.select("repo", "sha", "path", "line"), ["repo", "sha"]).select("repo", "number", "sha", "guessed", "path", "line").distinct()
        where = lambda name: F.get_json_object("metadata", f"$.{name}")
        reviews = self.corpus.documents.where("source_type in ('review', 'review_comment') and trust <> 'machine'").select("repo", "number", "source_type", "source_id", "author", "trust", "body_text", where("path").alias("path"), F.coalesce(where("line"), where("original_line")).cast("int").alias("line"))
        said = provenance.argument(reviews, places).select("repo", "number", F.col("at_path").alias("path"), F.col("at_line").alias("line"), "level", "source_type", "source_id", "author", "body_text")
        return places.join(said, ["repo", "number", "path", "line"], "left")

    def label(self, requests: DataFrame, path: str) -> DataFrame:
        """Store the relevance judgements of callers that may give any; the requests with why they were refused, if they were."""
        return datasets.append_labels(requests, path)

    def status(self) -> DataFrame:
        docs = self.corpus.documents.groupBy("repo").agg(F.count("*").alias("documents"))
        return self.corpus.threads.groupBy("repo").agg(F.count("*").alias("threads"), F.max("updated_at").alias("updated_at")).join(docs, "repo", "left")

    def code(self, files: DataFrame) -> dict[str, DataFrame]:
        defs, refs = codelens.definitions(files), codelens.references(files)
        return {"defs": defs, "refs": refs, "map": codelens.repo_map(defs, refs), "copies": codelens.copies(defs)}
