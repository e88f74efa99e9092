"""Phrase collocation mining: a compressed position bitmap for each word, extended depth-first by shift, AND and popcount.

A task cuts texts into pieces and words and lays them on a line of positions, with a gap between pieces. A shard is some million
positions of one language. For each of its words the shard has a bitmap of positions, compressed by bytes: only bytes that are not zero
are stored, as (word, byte, bits). A phrase's bitmap marks the positions of its last word. To extend a phrase its bitmap is shifted by one
position and ANDed with the bitmaps of the words in those bytes; what is left is the bitmap of the longer phrase, and its popcount
the number of occurrences in the shard. Gaps hold no word, so nothing crosses a piece. Prefixes are extended depth-first, a block of
first words at a time. Counts are summed over shards by a shuffle of one row for each phrase and shard.

Pass 1 counts words, and two-word phrases under a 64-bit hash. Hashes whose sum reaches the least count form a bit filter of bounded size.
Pass 2 counts two-word phrases in the filter, and three-word phrases both of whose halves are in it, by their words. A hash that two phrases
share, or a full filter, lets more phrases pass and changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BLOCK_BITS, bit_blocks, cell_of, filter_bits, staged

LEAST_COUNT, MOST_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: Positions in a shard, bytes of a text that are cut at a time, and bitmap entries of the first words that are extended together.
SHARD, SPAN, PREFIXES = 1 << 21, 1 << 20, 1 << 17
#: Salts of the first of two rankings, so that no task ranks a language alone.
SALTS = 16
_CONTEXT = 8  # the first byte of a shard's line: words before it that phrases may begin with

_SEPARATOR = b"."
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _SEPARATOR * 9 + b" ")


class _Ids(dict):
    """Words to numbers in the order of their first occurrence; 0 is the gap between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def spans(text: bytes) -> Iterator[bytes]:
    """Lower-cased parts of a text, separators as full stops. Cut after a separator or a space, so words stay whole."""
    text, start = text.translate(_BYTES), 0
    while start < len(text):
        end = start + SPAN
        if end < len(text):
            cut = max(text.rfind(_SEPARATOR, start, end), text.rfind(b" ", start, end))
            if cut < 0:
                cut = min((x for x in (text.find(_SEPARATOR, end), text.find(b" ", end)) if x >= 0), default=len(text))
            end = cut + 1
        yield text[start:end]
        start = end


class Shard:
    """A line of words of one language."""

    def __init__(self, language: str, before: list[bytes]):
        """before: up to two words that the line goes on from."""
        self.language, self.ids = language, _Ids({_SEPARATOR: 0})
        self.line = [np.array([0] * (_CONTEXT - len(before)) + [self.ids[w] for w in before], np.int32)]
        self.size = _CONTEXT

    def add(self, words: list[bytes]) -> None:
        self.line.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def tail(self) -> list[bytes]:
        """The last words, as far as they stand in one piece."""
        last = np.concatenate(self.line[-3:])[-(MOST_WORDS - 1) :]
        gaps = np.flatnonzero(last == 0)
        words = list(self.ids)
        return [words[i] for i in last[gaps[-1] + 1 if len(gaps) else 0 :]]


class Bitmaps:
    """The position bitmaps of a shard's words: entries (word, byte, bits), ordered by word; `at` orders them by byte."""

    def __init__(self, shard: Shard):
        line = np.concatenate(shard.line)
        here = np.flatnonzero(line)
        keys = np.sort((line[here].astype(np.int64) << 32) | here)
        starts = np.flatnonzero(np.diff(keys >> 3, prepend=-1))
        self.word, self.byte = (keys[starts] >> 32).astype(np.int32), ((keys[starts] & 0xFFFFFFFF) >> 3).astype(np.int32)
        self.bits = np.add.reduceat((1 << (keys & 7)).astype(np.uint8), starts) if len(keys) else np.empty(0, np.uint8)
        order = np.argsort(self.byte, kind="stable")
        self.at_word, self.at_bits = self.word[order], self.bits[order]
        self.at = np.searchsorted(self.byte[order], np.arange(len(line) // 8 + 3))

    def extended(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, byte, bits) of the phrases that are one word longer: shift by one position, AND with each word there."""
        carried = bits >> 7 != 0
        phrase, byte, bits = np.append(phrase, phrase[carried]), np.append(byte, byte[carried] + 1), np.append((bits << 1).astype(np.uint8), np.ones(carried.sum(), np.uint8))
        words = self.at[byte + 1] - self.at[byte]
        entry = np.repeat(np.arange(len(byte), dtype=np.int32), words)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(words) - words - self.at[byte], words)
        met = bits[entry] & self.at_bits[other]
        some = np.flatnonzero(met)
        entry, other = entry[some], other[some]
        return phrase[entry], self.at_word[other], byte[entry], met[some]


def _summed(key: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, occurrences that end in the shard's own bytes, the key's place of each entry): popcounts by key."""
    keys, place = np.unique(key, return_inverse=True)
    return keys, np.bincount(place, np.where(byte > 0, np.bitwise_count(bits), 0), len(keys)).astype(np.int64), place


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in their order."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return h


class Filter:
    """A bit filter as an array of blocks of longs; None lets all pass."""

    def __init__(self, blocks: list | None, bits: int):
        self.longs = None
        if blocks is not None:
            self.longs = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 64), np.int64)
            for row in blocks:
                self.longs[row["block"]] = row["longs"]

    def has(self, h: np.ndarray) -> np.ndarray:
        block, bit = ((h >> np.uint64(15)) % np.uint64(len(self.longs))).astype(np.int64), (h & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        return (self.longs[block, bit >> 6] >> (bit & 63)) & 1 == 1


def _first_words(bitmaps: Bitmaps) -> Iterator[slice]:
    """Entries of whole words, about PREFIXES at a time."""
    start = 0
    while start < len(bitmaps.word):
        end = min(start + PREFIXES, len(bitmaps.word))
        end = int(np.searchsorted(bitmaps.word, bitmaps.word[end - 1], side="right"))
        yield slice(start, end)
        start = end


def _pairs(bitmaps: Bitmaps, part: slice, n: int) -> tuple[np.ndarray, ...]:
    """(first word, second word, count) of each two-word phrase, and (place, byte, bits) of its bitmaps' entries."""
    first, second, byte, bits = bitmaps.extended(bitmaps.word[part], bitmaps.byte[part], bitmaps.bits[part])
    keys, counts, place = _summed(first.astype(np.int64) * n + second, byte, bits)
    return keys // n, keys % n, counts, place, byte, bits


def _hashes(shard: Shard) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(shard.language.encode("utf-8", "surrogatepass"))
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in shard.ids], np.uint64)


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("hash", pa.int64()), ("n", pa.int64())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("n", pa.int64())])


def _count_hashed(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Words with their counts, the language's number of words under the empty word, and hashes of two-word phrases."""
    bitmaps, n = Bitmaps(shard), len(shard.ids)
    counts = np.bincount(bitmaps.word, np.where(bitmaps.byte > 0, np.bitwise_count(bitmaps.bits), 0), n).astype(np.int64)
    own = np.flatnonzero(counts)
    words = pa.array([*shard.ids], pa.binary()).take(pa.array(own))
    yield pa.RecordBatch.from_arrays([pa.array([shard.language] * (len(own) + 1)), pa.concat_arrays([words, pa.array([b""], pa.binary())]), pa.nulls(len(own) + 1, pa.int64()), pa.array(np.append(counts[own], counts.sum()))], schema=_COUNTED)
    hashes = _hashes(shard)
    for part in _first_words(bitmaps):
        first, second, found, *_ = _pairs(bitmaps, part, n)
        own = np.flatnonzero(found)
        h = _mixed(hashes[first[own]], hashes[second[own]])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), pa.nulls(len(own), pa.binary()), pa.array(h.view(np.int64)), pa.array(found[own])], schema=_COUNTED)


def _count_phrases(shard: Shard, passes: Filter) -> Iterator[pa.RecordBatch]:
    """Two-word phrases in the filter, and three-word phrases both of whose halves are in it."""
    bitmaps, n, hashes = Bitmaps(shard), len(shard.ids), _hashes(shard)
    words = pa.array([*shard.ids], pa.binary())

    def rows(parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in parts), b" ")
        return pa.RecordBatch.from_arrays([pa.array([shard.language] * len(counts), pa.string()), phrase, pa.array(np.full(len(counts), len(parts), np.int32)), pa.array(counts)], schema=_PHRASES)

    for part in _first_words(bitmaps):
        first, second, counts, place, byte, bits = _pairs(bitmaps, part, n)
        passed = passes.has(_mixed(hashes[first], hashes[second]))
        own = np.flatnonzero(passed & (counts > 0))
        yield rows([first[own], second[own]], counts[own])
        on = passed[place]
        pair, third, byte, bits = bitmaps.extended(place[on], byte[on], bits[on])
        keys, counts, _ = _summed(pair.astype(np.int64) * n + third, byte, bits)
        pair, third = keys // n, keys % n
        own = np.flatnonzero((counts > 0) & passes.has(_mixed(hashes[second[pair]], hashes[third])))
        yield rows([first[pair[own]], second[pair[own]], third[own]], counts[own])


def shards(texts: Iterable[tuple[str, bytes]], most: int = SHARD) -> Iterator[Shard]:
    """The shards of (language, text): those that are open hold about `most` positions together. A text may go on in the next shard."""
    held: dict[str, Shard] = {}
    for language, text in texts:
        for span in spans(text):
            if language not in held:
                held[language] = Shard(language, [])
            held[language].add(_words(span))
            if sum(s.size for s in held.values()) >= most:
                before = held[language].tail()
                yield from held.values()
                held = {language: Shard(language, before)}
        if language in held:
            held[language].add([_SEPARATOR])
    yield from held.values()


def _over_shards(texts: DataFrame, count: Callable[[Shard], Iterator[pa.RecordBatch]], types: str) -> DataFrame:
    """What count yields for each shard of (lang, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards((language.as_py(), text.as_py()) for batch in batches for language, text in zip(batch.column("lang"), batch.column("text"), strict=True)):
            yield from count(shard)

    return texts.mapInArrow(run, types)


def _words(span: bytes) -> list[bytes]:
    """Words and gaps. Of white space only blanks are left in a span, so split() cuts at blanks alone."""
    return span.replace(_SEPARATOR, b" . ").split()


def counted(texts: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, word, n), (lang, phrase, words, n)) with n of at least `least`; the empty word has a language's number of words."""
    found = _over_shards(texts, _count_hashed, "lang string, word binary, hash long, n long")
    sums = found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == F.lit(b"")))
    sums = staged(sums, "collocation-words")
    frequent = sums.where(F.col("word").isNull()).select("hash")
    bits = filter_bits(frequent.count())
    block, bit = cell_of(F.col("hash"), bits)
    passes = texts.sparkSession.sparkContext.broadcast(Filter(bit_blocks(frequent.select(block.alias("block"), bit.alias("bit"))).collect(), bits))
    phrases = _over_shards(texts, lambda shard: _count_phrases(shard, passes.value), "lang string, phrase binary, words int, n long")
    phrases = phrases.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sums.where(F.col("word").isNotNull()).select("lang", F.col("word").cast("string").alias("word"), "n"), staged(phrases, "collocation-phrases")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts under 10^15: both products fit into 38 digits."""
    a, left, right = (f"cast({x} as decimal(15,0))" for x in (a, left, right))
    return F.expr(f"cast((cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right}) as long)")


def mined(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """Each language's `top` phrases of two or three words: lang, rank, phrase, a, l, r, n, score, as the task's contract defines them.

    Null texts have no words; a null language is `und`. Texts that repeat count again. Ties in score go to the more frequent phrase, then to
    the first in the order of its bytes. Counts of 10^15 and more raise an error, as the score could not be exact. A language without
    candidates, and an empty table, give no rows. Texts may have any length: a shard ends where it is full, and phrases go on into the next one
    by its context. Other columns are not read.
    """
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    words, phrases = counted(texts, least)
    parts = words.where(F.col("word") != "").select("lang", F.col("word").alias("part"), "n").unionByName(phrases.where("words = 2").select("lang", F.col("phrase").alias("part"), "n"))

    each = F.split("phrase", " ")
    two, three = F.array(F.struct(F.lit(1).alias("k"), each[0].alias("left"), each[1].alias("right"))), F.array(
        F.struct(F.lit(1).alias("k"), each[0].alias("left"), F.concat_ws(" ", each[1], each[2]).alias("right")),
        F.struct(F.lit(2).alias("k"), F.concat_ws(" ", each[0], each[1]).alias("left"), each[2].alias("right")),
    )
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.when(F.col("words") == 2, two).otherwise(three)).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("n").alias(count)), ["lang", side])
    scored = cuts.withColumn("score", _score("a", "l", "r")).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    halves = F.array(F.concat_ws(" ", each[0], each[1]), F.concat_ws(" ", each[1], each[2]))
    longer = phrases.where("words = 3").select("lang", F.explode(halves).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = words.where(F.col("word") == "").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (select lang, row_number() over () as piece_id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
w as materialized (select lang, piece_id, generate_subscripts(ws, 1) as i, unnest(ws) as w1 from split),
line as (select lang, w1, lead(w1, 1) over run as w2, lead(w1, 2) over run as w3 from w window run as (partition by piece_id order by i)),
one as materialized (select lang, w1 as phrase, count(*) as f from line group by all),
two as materialized (select lang, w1, w2, w1 || ' ' || w2 as phrase, count(*) as f from line where w2 is not null group by all having count(*) >= 10),
three as materialized (select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 as phrase, count(*) as f from line where w3 is not null group by all having count(*) >= 10),
totals as (select lang, sum(f) as n from one group by lang),
cuts as (
  select t.lang, t.phrase, t.f as a, 1 as k, x.f as l, y.f as r from two t join one x on (x.lang, x.phrase) = (t.lang, t.w1) join one y on (y.lang, y.phrase) = (t.lang, t.w2)
  union all
  select t.lang, t.phrase, t.f, 1, x.f, y.f from three t join one x on (x.lang, x.phrase) = (t.lang, t.w1) join two y on (y.lang, y.w1, y.w2) = (t.lang, t.w2, t.w3)
  union all
  select t.lang, t.phrase, t.f, 2, x.f, y.f from three t join two x on (x.lang, x.w1, x.w2) = (t.lang, t.w1, t.w2) join one y on (y.lang, y.phrase) = (t.lang, t.w3)),
scored as (select *, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from three union all select lang, w2, w3, f from three) group by all),
kept as (
  select s.* from lowest s left join two t on (t.lang, t.phrase) = (s.lang, s.phrase) left join longer g on (g.lang, g.w1, g.w2) = (t.lang, t.w1, t.w2)
  where g.f is null or 100 * g.f < 50 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from kept join totals using (lang)
qualify rank <= 2000
"""
