"""Scores, page selection, fusion and widening."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ERROR_LINE, SOURCE_EXTENSIONS, SYMBOL_STOPWORDS, decay, snippet
from threadloom.operators import fulltext
from threadloom.operators.segments import Segments, cover_density, widened_density
from threadloom.operators.filters import Corpus, SearchQuery, admissible, error_matches, file_matches
from threadloom.schemas import DECAY_ENABLED, MAX_HITS, MAX_HITS_PER_THREAD, MAX_LEGS, MAX_PER_KIND, RRF_K, WEIGHTS


def overlap(signals: DataFrame, key: Sequence[str], value: Column, wanted: Sequence[str], predicate=None) -> DataFrame:
    """(key, overlap): the share of the wanted values that a thread carries; threads with none have no row.

    Each value is tested once and threads are pre-aggregated, so a score costs one join a kind, whatever it asks for.
    """
    hits = [F.max((predicate(value, w) if predicate else value == w).cast("int")) for w in wanted]
    total = sum(hits[1:], hits[0])
    keep = [predicate(value, w) if predicate else value == w for w in wanted]
    anything = keep[0]
    for k in keep[1:]:
        anything = anything | k
    return signals.where(anything).groupBy(*key).agg((total / len(wanted)).alias("overlap"))


#: What only a page shows: fetched for its rows, after the limit.
BODIES = ("body_text", "body_markdown", "metadata")
#: What an index with facets keeps of a document, so that a page is chosen without reading documents.
FACETS = ("repo", "number", "source_type", "source_id", "chunk_index", "author", "author_is_bot", "trust", "created_at")


def scored(rows: DataFrame, corpus: Corpus, q: SearchQuery, lexical: DataFrame | None = None, doc_key: str = "doc_key", now=None, required: Sequence[str] = ()) -> DataFrame:
    """rows with score and breakdown (a map of the terms that were asked for).

    Rows may bring their text score as _lexical. required: the kinds of signal that a row must have, which saves their semi-joins.
    """
    key = list(corpus.key)
    asked: dict[str, Column] = {}
    kinds = (
        ("error", q.errors, corpus.errors, lambda v, w: error_matches(v, [w]), "message_norm"),
        ("test", q.tests, corpus.tests, None, "test_id"),
        ("symbol", q.symbols, corpus.symbols, None, "symbol"),
        ("file", q.files, corpus.files, lambda v, w: file_matches(v, [w]), "path"),
    )
    for name, values, signals, predicate, column in kinds:
        if values and signals is not None:
            if name == "error":
                signals = corpus.errors_with(values)
            elif name == "file":
                signals = corpus.files_at(values)
            share = overlap(signals, key, F.col(column), values, predicate).withColumnRenamed("overlap", f"_{name}")
            rows = rows.join(share, key, "inner" if name in required else "left")
            asked[name] = F.coalesce(f"_{name}", F.lit(0.0))
    if "_lexical" in rows.columns:
        asked["lexical"] = F.coalesce("_lexical", F.lit(0.0))
    elif lexical is not None:
        rows = rows.join(lexical.select(doc_key, F.col("score").alias("_lexical")), doc_key, "inner" if q.text else "left")
        asked["lexical"] = F.coalesce("_lexical", F.lit(0.0))
    if not asked:
        return rows.withColumns({"score": F.lit(None).cast("double"), "breakdown": F.create_map().cast("map<string,double>")})
    total = None
    for name, term in asked.items():
        part = WEIGHTS[name] * term
        total = part if total is None else total + part
    if DECAY_ENABLED and now is not None:
        total = total * decay(F.datediff(F.lit(now), "created_at"), q.kind)
    breakdown = F.create_map(*(x for n, t in asked.items() for x in (F.lit(n), t)))
    return rows.withColumns({"score": total, "breakdown": breakdown}).drop(*(f"_{n}" for n in asked))


def select_page(rows: DataFrame, key: Sequence[str], ties: Sequence[Column], limit: int = MAX_HITS, per_thread: int = MAX_HITS_PER_THREAD) -> DataFrame:
    """The best row of each (thread, source type), per_thread rows of a thread, then the first `limit` of the page.

    Both caps are row_number() filters, which Spark turns into partial and final group limits, so no thread is sorted whole.
    """
    order = [F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), *ties]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "source_type").orderBy(*order))).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= per_thread).drop("_n")
    return rows.orderBy(*order).limit(limit)


def presented(page: DataFrame, sort: str, ties: Sequence[Column]) -> DataFrame:
    """A page in the order it is shown; what is on it was chosen by relevance before."""
    if sort == "newest":
        return page.orderBy(F.col("created_at").desc_nulls_last(), *ties)
    return page.orderBy(F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), *ties)


# -- expansion -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leg:
    name: str
    query: SearchQuery


_ERROR = re.compile(ERROR_LINE)
_NODE = re.compile(r"[\w./-]+\.py::[\w:.-]*\w(?:\[[^\]\n]*\])?")
_PATH = re.compile(r"(?<![\w.-])((?:[\w.+-]+/)*[\w.+-]+\.[A-Za-z][A-Za-z0-9]{0,4})(?![\w/])")
_SPAN = re.compile(r"`{1,3}([^`\n]+)`{1,3}")


def looks_like_symbol(word: str) -> bool:
    """The driver's form of functions.text.is_symbol, for a question of a few words."""
    if len(word) < 3 or word.lower() in SYMBOL_STOPWORDS or not re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", word):
        return False
    return word.rpartition(".")[2].lower() not in SOURCE_EXTENSIONS and bool(re.search("[a-z][A-Z]", word) or "_" in word or "." in word)


def expanded(q: SearchQuery) -> list[Leg]:
    """The question as asked, and one leg for each signal that its text shows, unless the caller named that kind already."""
    text = q.text
    errors = [m.group(0).strip() for m in _ERROR.finditer(text)]
    raised = {m.group(1).rsplit(".", 1)[-1] for m in _ERROR.finditer(text)}
    tests = list(dict.fromkeys(_NODE.findall(text)))
    paths = [p for p in dict.fromkeys(_PATH.findall(text)) if "/" in p or p.rpartition(".")[2].lower() in SOURCE_EXTENSIONS]
    in_paths = {w for p in paths for w in re.findall(r"[A-Za-z0-9_]+", p)}
    symbols = [s.removesuffix("()") for s in _SPAN.findall(text)] + re.findall(r"[A-Za-z0-9_]+", text)
    symbols = [s for s in dict.fromkeys(symbols) if looks_like_symbol(s) and s not in raised and s not in in_paths]
    bare = replace(q, text="")
    legs = [Leg("text", q)]
    for name, found, kind in (("error", errors, "errors"), ("test", tests, "tests"), ("symbol", symbols, "symbols"), ("file", paths, "files")):
        if not getattr(q, kind):
            legs += [Leg(f"{name}:{v}", replace(bare, **{kind: (v,)})) for v in list(dict.fromkeys(found))[:MAX_PER_KIND]]
    if q.files or q.symbols or q.errors or q.tests:
        legs.append(Leg("filters", bare))
    unique: dict[tuple, Leg] = {}
    for leg in legs:
        unique.setdefault((leg.query.text, leg.query.files, leg.query.symbols, leg.query.errors, leg.query.tests), leg)
    return list(unique.values())[:MAX_LEGS]


def fused(ranked: DataFrame, key: Sequence[str], limit: int = MAX_HITS, per_thread: int = MAX_HITS_PER_THREAD) -> DataFrame:
    """Reciprocal-rank fusion of (leg, leg_order, rank, key, source_type, ...): the hit of the first leg that has it."""
    rest = [c for c in ranked.columns if c not in (*key, "source_type", "leg", "leg_order", "rank", "score")]
    one = ranked.groupBy(*key, "source_type").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min_by(F.struct("leg", "leg_order", *rest), F.struct("leg_order", "rank")).alias("h"))
    one = one.select(*key, "source_type", "score", "h.*")
    order = [F.col("score").desc(), F.col("leg_order"), *(F.col(k) for k in key), F.col("source_type")]
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= per_thread).drop("_n")
    return one.orderBy(*order).limit(limit)


def relevance(index: DataFrame | fulltext.Index | Segments, terms: Sequence[str], match: str, doc_key: str, how: str = "bm25", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_key, score, keep...) of the documents with all the terms or any of them, by BM25 or by the density of covers."""
    if how == "density":
        found = index if isinstance(index, DataFrame) else index.postings(terms)
        return cover_density(found, terms, "all", doc_key, keep) if match == "all" else widened_density(found, terms, doc_key, keep)
    found = fulltext.bm25(index, terms, match, doc_key, keep=keep)
    return found if match == "all" else fulltext.coverage(found, len(set(terms)))


def with_bodies(page: DataFrame, documents: DataFrame, doc_key: str = "doc_key") -> DataFrame:
    """A page with the long columns of its rows. The page is what is sent: at most MAX_HITS rows, so tables that are partitioned by
    doc_bucket are read in the folders of these rows only."""
    more = [c for c in BODIES if c in documents.columns and c not in page.columns]
    if not more:
        return page
    on = [c for c in (doc_key, "doc_bucket", "repo", "number") if c in documents.columns and c in page.columns]
    return documents.select(*on, *more).join(F.broadcast(page), on)


def search(
    corpus: Corpus, q: SearchQuery, postings: DataFrame | fulltext.Index | Segments | None = None, doc_key: str = "doc_key", expand: bool = True, now=None, terms_of: Callable[[str], list[str]] = fulltext.asked_words,
    how: str = "bm25",
) -> tuple[DataFrame, bool]:
    """(page, widened). Legs are ranked apart and fused in one plan; a page that would be empty is asked for any term.

    terms_of cuts the question as the postings were cut. A leg without text of its own is still ranked by what the caller
    asked for: by the caller's words, any of them, and by the signals that the caller named. Pages are chosen on short columns; bodies are
    read for the rows of the last one. With an index that has facets, a leg with text reads no documents at all.
    """
    q = q.checked()
    key, ties, wide = list(corpus.key), [F.col(doc_key).desc()], corpus.documents
    if "doc_bucket" in wide.columns:  # a stored table: its bodies are read later, by folder
        corpus = replace(corpus, documents=wide.drop(*BODIES))

    def page(one: SearchQuery, limit: int, asked: SearchQuery) -> DataFrame:
        terms = terms_of(one.text)
        lexical, from_ = None, corpus
        if one.text:
            if not terms or postings is None:
                return admissible(corpus, one).where(F.lit(False)).withColumns({"score": F.lit(0.0), "breakdown": F.create_map().cast("map<string,double>")})
            if isinstance(postings, Segments):
                facets = [c for c in FACETS if c in wide.columns]
                rows = relevance(postings, terms, one.match, doc_key, how, facets).withColumnRenamed("score", "_lexical").drop("matched")
                if "doc_bucket" in wide.columns:
                    rows = rows.withColumn("doc_bucket", doc_bucket(F.col("repo"), F.col("number")))
                from_ = replace(corpus, documents=rows)
            else:
                lexical = relevance(postings, terms, one.match, doc_key, how)
        elif postings is not None and (terms := terms_of(asked.text)):
            lexical = relevance(postings, terms, "any", doc_key, how)
        kinds = {k: tuple(dict.fromkeys((*getattr(asked, k), *getattr(one, k)))) for k in ("files", "symbols", "errors", "tests")}
        # a kind that filters and scores by the same values is joined once
        same = [k for k, values in kinds.items() if values and values == getattr(one, k) and getattr(corpus, k) is not None]
        rows = admissible(from_, replace(one, **{k: () for k in same}))
        return select_page(scored(rows, corpus, replace(one, **kinds), lexical, doc_key, now, [k.removesuffix("s") for k in same]), key, ties, limit)

    def best(asked: SearchQuery) -> DataFrame:
        legs = expanded(asked) if expand else [Leg("text", asked)]
        if len(legs) == 1:
            return page(legs[0].query, asked.limit, asked)
        rank = Window.partitionBy("leg_order").orderBy(F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), *ties)
        parts = [page(leg.query, MAX_HITS * MAX_HITS_PER_THREAD, asked).withColumns({"leg": F.lit(leg.name), "leg_order": F.lit(i)}) for i, leg in enumerate(legs)]
        together = parts[0]
        for p in parts[1:]:
            together = together.unionByName(p, allowMissingColumns=True)
        return fused(together.withColumn("rank", F.row_number().over(rank)), key, asked.limit)

    first, widened = best(q), False
    if len(terms_of(q.text)) >= 2 and q.match == "all" and first.isEmpty():
        first, widened = best(replace(q, match="any")), True
    return presented(with_bodies(first, wide, doc_key), q.sort, ties), widened


def doc_bucket(repo: Column, number: Column, buckets: int = 64) -> Column:
    """The folder of a thread's documents in a table that is partitioned by doc_bucket."""
    return F.pmod(F.xxhash64(repo, number.cast("long")), F.lit(buckets)).cast("int")


def with_snippets(page: DataFrame, q: SearchQuery, text: str = "body_text") -> DataFrame:
    """Snippets of the rows of a page, after its limit."""
    return page.withColumn("snippet", snippet(F.col(text), re.findall(r"[A-Za-z0-9_]+", q.text)))
