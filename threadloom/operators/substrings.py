"""Substring and path-tail searches that read what can match: a trigram index, and paths sorted from their end."""

from __future__ import annotations

import re
import re._constants as R
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import error_query_form

BUCKETS = 64
#: Parts of a bucket, so that a frequent gram is no single task and a bucket no more files than this.
DEALT = 16
#: Strings that a stretch of a pattern may stand for before the stretch is cut, characters of a class that are tried one by one, and
#: trigrams that are looked up for one string. Beyond these a condition gets weaker, never wrong.
MOST_STRINGS, MOST_CLASS, MOST_GRAMS = 16, 4, 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)

#: What a text must hold: None for anything, a trigram, or ("and" | "or", conditions).
Condition = None | str | tuple[str, tuple]


def _every(parts: Sequence[Condition]) -> Condition:
    parts = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _some(parts: Sequence[Condition]) -> Condition:
    parts = tuple(dict.fromkeys(parts))
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", parts)


def of_literal(literal: str) -> Condition:
    """Every trigram of a literal (evenly spread ones, of a long literal). Literals under three characters need nothing."""
    low = literal.translate(_ASCII_LOWER)
    grams = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
    step = max(1, -(-len(grams) // MOST_GRAMS))
    return _every(grams[::step])


def of_pattern(pattern: str) -> Condition:
    """What every text with a match of the regular expression must hold.

    A pattern that is not understood, or whose meaning differs between regular-expression dialects, needs nothing: all texts are read.
    """
    if re.search(r"\\[0QEpPXRhHGzZ]|&&|\(\?[a-zA-Z-]*[uUxX]|\[\^?\[", pattern):
        return None
    try:
        return _of(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None


def _class(items: Sequence) -> list[str] | None:
    """The characters of a small class, lower-cased; None for others."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is R.LITERAL:
            chars.add(chr(value).translate(_ASCII_LOWER))
        elif kind is R.RANGE and value[1] - value[0] < MOST_CLASS:
            chars |= {chr(c).translate(_ASCII_LOWER) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(chars) if len(chars) <= MOST_CLASS else None


def _of(sequence) -> Condition:
    """The condition of a parsed sequence: stretches of known characters, and the conditions of what stands between."""
    needed: list[Condition] = []
    run = [""]

    def flush() -> None:
        nonlocal run
        needed.append(_some([of_literal(s) for s in run]))
        run = [""]

    def walk(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind in (R.LITERAL, R.IN):
                chars = [chr(value).translate(_ASCII_LOWER)] if kind is R.LITERAL else _class(value)
                if chars is None:
                    flush()
                    continue
                if len(run) * len(chars) > MOST_STRINGS:
                    flush()
                run = [s + c for s in run for c in chars]
            elif kind is R.AT or kind is R.ASSERT_NOT or kind is R.ASSERT:
                continue  # takes no characters
            elif kind is R.SUBPATTERN:
                walk(value[3])
            elif kind is R.ATOMIC_GROUP:
                walk(value)
            elif kind is R.BRANCH:
                flush()
                needed.append(_some([_of(x) for x in value[1]]))
            elif kind in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT):
                flush()
                if value[0] > 0:
                    needed.append(_of(value[2]))
            else:
                flush()

    walk(sequence)
    flush()
    return _every(needed)


def grams_of(condition: Condition) -> list[str]:
    if condition is None:
        return []
    if isinstance(condition, str):
        return [condition]
    return list(dict.fromkeys(g for part in condition[1] for g in grams_of(part)))


def holds(condition: Condition, have: Column) -> Column:
    """Whether an array of trigrams meets a condition."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, str):
        return F.array_contains(have, condition)
    parts = [holds(part, have) for part in condition[1]]
    return reduce(lambda a, b: (a & b) if condition[0] == "and" else (a | b), parts)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, A-Z lower-cased. Linear in its length."""
    chars = F.split(F.translate(text, _UPPER, _LOWER), "")
    after = lambda n: F.slice(chars, n + 1, F.greatest(F.size(chars), F.lit(0)))
    joined = F.zip_with(F.zip_with(chars, after(1), lambda a, b: F.concat(a, b)), after(2), lambda ab, c: F.concat(ab, c))
    return F.array_distinct(F.filter(joined, lambda g: g.isNotNull()))


@dataclass(frozen=True)
class Trigrams:
    """(gram, text_id) of each different text in a folder, by bucket of the gram and sorted by gram, long lists dealt over several
    files; and the keys (text_id, key columns) that have the text. text_id is a hash: texts that share one are candidates together.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]

    @staticmethod
    def build(rows: DataFrame, path: str, key: Sequence[str], text: str) -> Trigrams:
        known = F.xxhash64(text).alias("text_id")
        texts = rows.select(F.col(text)).where(F.col(text).isNotNull()).distinct()
        found = texts.select(known, F.explode(trigrams(F.col(text))).alias("gram")).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
        dealt = found.repartition("bucket", F.pmod("text_id", F.lit(DEALT)))
        dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
        rows.select(known, *key).write.mode("overwrite").parquet(f"{path}/texts")
        return Trigrams(rows.sparkSession, path, tuple(key))

    def candidates(self, condition: Condition) -> DataFrame | None:
        """The keys of the texts that meet a condition; None where it says nothing. At most MOST_GRAMS grams a string are gathered for a text."""
        grams = grams_of(condition)
        if not grams:
            return None
        buckets = sorted({crc32(g.encode()) % BUCKETS for g in grams})
        found = self.spark.read.parquet(f"{self.path}/grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        if not isinstance(condition, str):
            found = found.groupBy("text_id").agg(F.collect_set("gram").alias("have")).where(holds(condition, F.col("have")))
        return self.spark.read.parquet(f"{self.path}/texts").join(found.select("text_id"), "text_id", "left_semi").select(*self.key).distinct()

    def narrowed(self, rows: DataFrame, condition: Condition) -> DataFrame:
        """The rows that can match; which of them do is for the caller to verify."""
        found = self.candidates(condition)
        return rows if found is None else rows.join(found, list(self.key), "left_semi")


def errors_with(errors: DataFrame, index: Trigrams, pasted: Sequence[str], message: str = "message_norm") -> DataFrame:
    """The stored errors that hold any of the pasted ones."""
    wanted = [r[0] for r in errors.sparkSession.createDataFrame([(p,) for p in pasted], "pasted string").select(error_query_form(F.col("pasted"))).collect()]
    test = reduce(lambda a, b: a | b, (F.contains(F.col(message), F.lit(w)) for w in wanted), F.lit(False))
    return index.narrowed(errors, _some([of_literal(w) for w in wanted]) if wanted else None).where(test)


@dataclass(frozen=True)
class PathTails:
    """A table of paths sorted from their end, so that all paths with one tail stand together."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(files: DataFrame, path: str, column: str = "path") -> PathTails:
        files.withColumn("reversed", F.reverse(column)).repartitionByRange("reversed").sortWithinPartitions("reversed").write.mode("overwrite").parquet(path)
        return PathTails(files.sparkSession, path)

    def matching(self, needles: Sequence[str]) -> DataFrame:
        """The rows whose path is a needle, or ends with it from a directory on: equality and prefix tests that the scan takes."""
        wanted = [n for n in (x.strip().removeprefix("./") for x in needles) if n]
        here = F.col("reversed")
        test = reduce(lambda a, b: a | b, ((here == n[::-1]) | here.startswith(n[::-1] + "/") for n in wanted), F.lit(False))
        return self.spark.read.parquet(self.path).where(test).drop("reversed")
