"""Systems that answer a whole set of questions at once, and the report that compares them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import error_literal
from threadloom.operators.lookups import first_positions
from threadloom.schemas import MAX_HITS

#: A person greps a few things before reading, not thirty.
GREP_TERMS = 3
#: Slices whose answer's thread may hold the question itself, so that finding it is no retrieval.
LEAKY = ("rationale",)
CUTOFFS = (5, 10)
_GRAM = 3
#: Sums of terms are compared with rounded scores: more than both may be off.
_SLACK = 1e-5
#: What may write a frame that is read several times, and reads it back.
Stage = Callable[[DataFrame, str], DataFrame]


def _kept(rows: DataFrame, name: str) -> DataFrame:
    return rows


def top(scored: DataFrame, most: int = MAX_HITS) -> DataFrame:
    """(question, item, rank) of the best of (question, item, score)."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc(), "item"))
    return scored.withColumn("rank", place).where(F.col("rank") <= most).select("question", "item", "rank")


def weights_of(found: DataFrame, asked: DataFrame, total: DataFrame) -> DataFrame:
    """(question, term, df, idf, mean_len, most): what a term is worth, and at most adds to the score of any document.

    found: (item, term, tf, doc_len), all postings of the asked terms; asked: (question, term), distinct; total: one row (n, mean_len).
    """
    rows = found.join(total)
    by_term = rows.groupBy("term").agg(F.count("*").alias("df"), F.max(_share()).alias("share"), F.any_value("n").alias("n"), F.any_value("mean_len").alias("mean_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(by_term, "term").select("question", "term", "df", idf.alias("idf"), "mean_len", (idf * F.col("share")).alias("most"))


def _share() -> Column:
    return F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / F.col("mean_len")))


def scores_of(pairs: DataFrame, found: DataFrame, weights: DataFrame) -> DataFrame:
    """(question, item, score) of distinct pairs (question, item), by BM25 over any of the question's terms."""
    every = pairs.select("question", "item").join(weights.select("question", "term", "idf", "mean_len"), "question")
    return every.join(found, ["item", "term"]).groupBy("question", "item").agg(F.round(F.sum(F.col("idf") * _share()), 6).alias("score"))


def scores_from(floors: DataFrame, found: DataFrame, weights: DataFrame) -> DataFrame:
    """(question, item, score): every document that scores its question's floor or more. floors: (question, floor); other questions get no row.

    Terms that together cannot reach the floor bring no candidates: a document that has only such terms stays below it. Documents with one
    of the other terms, which are the rare ones, are scored if these and all of the rest can reach it.
    """
    least = Window.partitionBy("question").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = weights.join(floors, "question").withColumn("reach", F.sum("most").over(least)).where(F.col("reach") >= F.col("floor") - _SLACK)
    needed = needed.withColumn("rest", F.min(F.col("reach") - F.col("most")).over(Window.partitionBy("question")))
    partly = found.join(needed.select("question", "term", "idf", "mean_len", "rest", "floor"), "term").groupBy("question", "item")
    pairs = partly.agg(F.sum(F.col("idf") * _share()).alias("part"), F.any_value("rest").alias("rest"), F.any_value("floor").alias("floor")).where(F.col("part") + F.col("rest") >= F.col("floor") - _SLACK)
    scored = scores_of(pairs, found, weights).join(floors, "question")
    return scored.where(F.col("score") >= F.col("floor") - _SLACK / 2).select("question", "item", "score")


def floors_of(scored: DataFrame, most: int) -> DataFrame:
    """(question, floor): the score of the last of each question's best `most` of (question, item, score)."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc(), "item"))
    return scored.withColumn("place", place).where(F.col("place") <= most).groupBy("question").agg(F.min("score").alias("floor"), F.count("*").alias("of"))


def index_system(postings: DataFrame, asked: DataFrame, total: DataFrame, key: str = "doc_id", most: int = MAX_HITS) -> DataFrame:
    """(question, item, rank): the postings' best documents for each question by BM25 over any of its terms.

    postings: (key, term, tf, doc_len); asked: (question, term), distinct; total: one row (n, mean_len). Only the postings of asked terms are counted.
    """
    found = of_terms(postings, asked, key)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").join(total).select("question", "term", "mean_len", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / F.col("mean_len")))
    # what is dealt are the postings, by document, and not a row a question for each of them; weights are a row a question term
    scored = found.repartition("item").join(F.broadcast(weights), "term").groupBy("question", "item").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, most)


def of_terms(postings: DataFrame, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(item, term, tf, doc_len): the postings of asked terms."""
    return postings.select(F.col(key).alias("item"), "term", "tf", "doc_len").join(asked.select("term").distinct(), "term", "left_semi").select("item", "term", "tf", "doc_len")


def grep_terms(query: Column, errors: Column | None = None, tests: Column | None = None, symbols: Column | None = None, most: int = GREP_TERMS) -> Column:
    """What somebody would grep for: literals of errors, tests and symbols before words of more than three characters; null asks nothing."""
    none = F.array().cast("array<string>")
    parts = [F.transform(errors, lambda e: error_literal(e))] if errors is not None else []
    parts += [c for c in (tests, symbols) if c is not None]
    parts.append(F.filter(F.split(query, r"\s+"), lambda w: F.char_length(w) > 3))
    every = F.concat(*(F.coalesce(p, none) for p in parts))
    return F.slice(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != ""))), 1, most)


def _grams(text: Column, size: int) -> Column:
    """The hashes of every stretch of `size` characters; one pass over the text, as characters have no places of their own in it."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))), lambda g: F.xxhash64(g))


def _with_grams(files: DataFrame, terms: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """`files_with` for short contents: a term meets only the files that have its rarest three characters (or all of a shorter term), which the files are then searched for.
    """
    asked = terms.select("term").distinct().withColumn("size", F.least(F.char_length("term"), F.lit(_GRAM)))
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # three values at most
    if not sizes:
        return files.select(path).withColumn("term", F.lit("")).where(F.lit(False))
    of_term = F.coalesce(*(F.when(F.col("size") == s, _grams(F.col("term"), s)) for s in sizes))
    wanted = asked.select("term", F.explode(F.array_distinct(of_term)).alias("gram"))
    none = F.array().cast("array<bigint>")
    of_file = F.array_distinct(F.concat(none, *(F.coalesce(_grams(F.col(content), s), none) for s in sizes)))
    held = files.select(path, F.explode(of_file).alias("gram")).join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi")  # a row three characters of a term
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    met = held.join(F.broadcast(rarest), "gram").groupBy(path).agg(F.collect_set("term").alias("terms"))
    found = files.join(met, path).select(path, F.explode(F.filter("terms", lambda t: F.contains(F.col(content), t))).alias("term"))
    return found.distinct()


def files_with(files: DataFrame, terms: DataFrame, path: str = "path", content: str = "content", stage: Stage = _kept) -> DataFrame:
    """(path, term) for each file that holds a term literally, case and all. terms: (term), neither null nor empty.

    Files are cut at blanks. A term's longest stretch without blanks lies in one such piece of a file, so the different pieces of all files are
    searched for it once each, and only terms with blanks are looked for in whole files. Terms of blanks alone are looked for in every file. Pieces that are
    shorter than every stretch hold none.
    """
    asked = terms.select("term").distinct()
    stretch = F.reduce(F.split("term", r"\s+"), F.lit(""), lambda best, s: F.when(F.char_length(s) > F.char_length(best), s).otherwise(best))
    asked = asked.withColumn("stretch", stretch)
    blank = F.col("term").rlike(r"\s")
    least, blanks = asked.agg(F.min(F.when(F.col("stretch") != "", F.char_length("stretch"))), F.bool_or(blank)).first()
    pieces = files.select(path, F.explode(F.array_distinct(F.split(content, r"\s+"))).alias("piece")).where(F.char_length("piece") >= F.lit(least))
    different = stage(pieces.select("piece").distinct(), "pieces")
    met = stage(_with_grams(different, asked.where("stretch <> ''").select(F.col("stretch").alias("term")), "piece", "piece").withColumnRenamed("term", "stretch"), "met")
    held = pieces.join(met.join(asked, "stretch").groupBy("piece").agg(F.collect_set("term").alias("terms")), "piece").select(path, F.explode("terms").alias("term")).distinct()
    if not blanks:
        return held
    spaced = held.where(blank).unionByName(files.select(path).crossJoin(asked.where("stretch = ''").select("term")))
    spaced = files.join(spaced.groupBy(path).agg(F.collect_set("term").alias("terms")), path).select(path, F.explode(F.filter("terms", lambda t: F.contains(F.col(content), t))).alias("term"))
    return held.where(~blank).unionByName(spaced).distinct()


def grep_system(files: DataFrame, asked: DataFrame, threads_of: DataFrame, most: int = MAX_HITS, stage: Stage = _kept) -> DataFrame:
    """(question, item, rank): threads by how many matches of a question's terms lie in their files, each term once a file.

    files: (path, content); asked: (question, terms); threads_of: (path, item).
    """
    terms = asked.select("question", F.explode("terms").alias("term")).distinct()
    weights = files_with(files, terms, stage=stage).join(terms, "term").groupBy("question", "path").agg(F.count("*").alias("weight"))
    return top(weights.join(threads_of.select("path", "item").distinct(), "path").groupBy("question", "item").agg(F.sum("weight").alias("score")), most)


def report(results: DataFrame, relevant: DataFrame, examples: DataFrame, systems: Mapping[str, str | None], ranking: str, ks: Sequence[int] = CUTOFFS) -> DataFrame:
    """(system, slice, leak_free, questions, recall_k ..., mrr, empty): a row a system and slice, and for leaky slices one without leaking examples.

    results: (system, question, item, rank), of which an item counts once, at its first place; relevant: (question, item); examples: (question, slice,
    leaks). A system that finds nothing for a question scores 0 there. systems: each with the ranking that it ran on, or None for one
    without an index; ValueError for another ranking than the report's, as its figures describe another engine.
    """
    other = {s: r for s, r in systems.items() if r is not None and r != ranking}
    if other:
        raise ValueError(f"this report is about {ranking}, not {other}")
    names = F.explode(F.array(*map(F.lit, systems))).alias("system") if systems else F.explode(F.array().cast("array<string>")).alias("system")
    rows = examples.select("question", "slice", F.coalesce("leaks", F.lit(False)).alias("leaks"), names)
    by = F.struct("system", "question").alias("asked")
    places = first_positions(results.select(by, "item", "rank"), "asked", "item", "rank").select("asked.system", "asked.question", "item", "rank")
    right = relevant.select("question", "item").distinct()
    wanted = right.groupBy("question").agg(F.count("*").alias("wanted"))
    hits = places.join(right, ["question", "item"]).groupBy("system", "question").agg(*(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks), F.min("rank").alias("first"))
    answered = places.select("system", "question").distinct().withColumn("answered", F.lit(True))
    rows = rows.join(wanted, "question", "left").join(hits, ["system", "question"], "left").join(answered, ["system", "question"], "left")
    rows = rows.withColumn("leak_free", F.explode(F.when(F.col("slice").isin(*LEAKY) & ~F.col("leaks"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    recall = [F.avg(F.coalesce(F.col(f"hits_{k}") / F.nullif(F.col("wanted"), F.lit(0)), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    mrr = F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)).cast("double")).alias("mrr")
    return rows.groupBy("system", "slice", "leak_free").agg(F.count("*").alias("questions"), *recall, mrr, F.count_if(F.col("answered").isNull()).alias("empty"))


def corpus_windows(threads: DataFrame, documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(repo, thread_type, since, selector, threads, documents): what an index holds of each repository, which every baseline is restricted to.

    threads: (repo, number, thread_type); samples: (repo, thread_type, indexed_from, selector). A repository without a sample was filled whole and
    gets one row of type `all` without a floor. A sample of a type that has no thread counts 0.
    """
    kind = ["repo", "thread_type"]
    counted = threads.groupBy(*kind).agg(F.count("*").alias("threads"))
    texts = documents.groupBy("repo", "number").agg(F.count("*").alias("n")).join(threads.select(*kind, "number"), ["repo", "number"]).groupBy(*kind).agg(F.sum("n").alias("documents"))
    held = counted.join(texts, kind, "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))
    sampled = samples.select(*kind, F.date_format("indexed_from", "yyyy-MM-dd").alias("since"), "selector").join(held, kind, "left")
    sampled = sampled.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("threads", "documents")})
    whole = held.join(samples.select("repo").distinct(), "repo", "left_anti").groupBy("repo").agg(F.sum("threads").alias("threads"), F.sum("documents").alias("documents"))
    whole = whole.select("repo", F.lit("all").alias("thread_type"), F.lit(None).cast("string").alias("since"), F.lit("full history").alias("selector"), "threads", "documents")
    return sampled.select(whole.columns).unionByName(whole)
