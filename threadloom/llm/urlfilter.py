"""URL filtering with a sorted digest array, in DataFrame functions only.

Rules (host, path prefix) and listed hosts are kept as a sorted array of 64-bit xxhash keys with the full strings beside them. The
arrays are constants of the plan, as every task needs them whole. A url is probed with the last labels of its host, and only with as many
labels and path characters as some rule has, so a probe costs a bounded number of binary searches however long the host is. The
stored string is compared as well, so a collision of keys can't give a verdict. Larger sets are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, spare_name

#: The rules of the production query, (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that are blocked, with all subdomains, where no rule fits.
LISTED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")
#: Larger rule sets are joined instead of searched: a plan's constants go to every task.
MOST_INDEX_BYTES = 4 << 20
#: Spark's seed of xxhash64.
_SEED = 42


def digest(entry: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(entry.encode(), _SEED)
    return h - (1 << 64) if h >> 63 else h


class DigestArray:
    """Keys in ascending order, and the string and verdict (blocks or not) behind each."""

    def __init__(self, entries: Iterable[tuple[str, bool]], key=digest):
        found = sorted((key(s), s, b) for s, b in dict(entries).items())
        self.size, runs, last = len(found), 0, None
        self.longest_run = 1  # of equal keys
        for k, _, _ in found:
            runs = runs + 1 if k == last else 1
            last, self.longest_run = k, max(self.longest_run, runs)
        # text that the optimizer turns into one constant array each
        self.keys = F.split(F.lit(" ".join(str(k) for k, _, _ in found)), " ").cast("array<bigint>")
        self.strings = F.split(F.lit("\0".join(s for _, s, _ in found)), "\0")
        self.blocks = F.split(F.lit(" ".join(str(b).lower() for _, _, b in found)), " ").cast("array<boolean>")
        self.bytes = sum(len(s.encode()) + 17 for _, s, _ in found)

    def place(self, entry: Column, key: Column | None = None) -> Column:
        """Where an entry stands in the array, -1 where it doesn't: a binary search among the keys, then the strings."""
        if not self.size:
            return F.lit(-1)
        key = F.xxhash64(entry) if key is None else key
        steps = F.array(*(F.lit(1 << i) for i in range(self.size.bit_length() - 1, -1, -1)))
        below = F.aggregate(steps, F.lit(-1), lambda low, step: F.when((low + step < self.size) & (F.get(self.keys, low + step) < key), low + step).otherwise(low))
        run = F.transform(F.array(below), lambda low: F.filter(F.sequence(low + 1, F.least(low + self.longest_run, F.lit(self.size - 1))) if self.longest_run > 1 else F.array(low + 1), lambda i: (F.get(self.keys, i) == key) & (F.get(self.strings, i) == entry)))
        return F.coalesce(F.get(F.get(run, F.lit(0)), F.lit(0)), F.lit(-1))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null and for urls without "://"."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def _labels(host: str) -> int:
    return host.count(".") + 1


def _shapes(rules: Iterable[tuple[str, str]], listed_hosts: Iterable[str]) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) that entries have; listed hosts have no path."""
    return sorted({(_labels(r[: r.index("/")]), len(r) - r.index("/")) for r, _ in rules} | {(_labels(h), 0) for h in listed_hosts})


def _probes(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of (path_chars, host_chars, entry) for each shape that the url is long enough for."""

    def probe(labels: int, chars: int) -> Column:
        own = F.substring_index(host, ".", -labels)
        entry = F.concat(own, F.substring(path, 1, chars)) if chars else own
        there = (F.char_length(path) >= chars) if chars else (host != "")
        return F.when(there, F.struct(F.lit(chars).alias("path_chars"), F.char_length(own).alias("host_chars"), entry.alias("entry")))

    return F.filter(F.array(*(probe(*s) for s in shapes)), lambda p: p.isNotNull())


def _better(path_chars: Column, host_chars: Column) -> Column:
    """Of two entries that fit, the greater one wins: rules before listed hosts, then the longer, then the one with the longer host."""
    return F.struct((path_chars > 0).alias("rule"), F.when(path_chars > 0, path_chars + host_chars).otherwise(0).alias("chars"), host_chars.alias("host_chars"))


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, listed_hosts: Iterable[str] = LISTED_HOSTS, url: str = "url", most_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule wins, of
    equally long ones the one with the longer host. Where no rule fits, rule is null and the verdict is "block" for
    listed hosts and their subdomains, else "allow". Null urls and urls without "://" have an empty host and path, which
    only the listed hosts could block: they are allowed. Repeated rows give repeated rows; input columns with the names
    of the result are replaced.
    """
    rules, listed_hosts = tuple(rules), tuple(listed_hosts)
    host, path = split_url(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    shapes = _shapes(rules, listed_hosts)
    if not shapes:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    index = DigestArray([(h, True) for h in listed_hosts] + [(r, v == "block") for r, v in rules])
    if index.bytes > most_index_bytes:
        return _joined(parsed, rules, listed_hosts, shapes)
    p, m = spare_name(parsed, "probes"), spare_name(parsed, "met")
    probed = parsed.withColumn(p, _probes(F.col("host"), F.col("path"), shapes))
    placed = F.transform(p, lambda x: F.struct(_better(x["path_chars"], x["host_chars"]).alias("better"), x["path_chars"].alias("path_chars"), x["entry"].alias("entry"), index.place(x["entry"]).alias("at")))
    best = probed.withColumn(m, F.array_max(F.filter(placed, lambda x: x["at"] >= 0)))
    said = F.when(F.get(index.blocks, F.col(f"{m}.at")), "block").otherwise("allow")
    return best.withColumns({"rule": F.when(F.col(f"{m}.path_chars") > 0, F.col(f"{m}.entry")), "verdict": F.when(F.col(m).isNull(), "allow").otherwise(said)}).drop(p, m)


def _joined(parsed: DataFrame, rules: tuple, listed_hosts: tuple, shapes: list[tuple[int, int]]) -> DataFrame:
    """The same for rule sets of any size: an equi-join on the probes of each distinct host and path."""
    spark = parsed.sparkSession
    table = spark.createDataFrame([(r, v) for r, v in rules] + [(h, "block") for h in listed_hosts], "entry string, said string")
    probes = parsed.select("host", "path").distinct().select("host", "path", F.explode(_probes(F.col("host"), F.col("path"), shapes)).alias("probe")).select("host", "path", "probe.*")
    m = spare_name(parsed, "met")
    met = probes.join(table, "entry").groupBy("host", "path").agg(F.max_by(F.struct("entry", "path_chars", "said"), _better(F.col("path_chars"), F.col("host_chars"))).alias(m))
    out = parsed.drop("rule", "verdict").join(met, ["host", "path"], "left")
    return out.withColumns({"rule": F.when(F.col(f"{m}.path_chars") > 0, F.col(f"{m}.entry")), "verdict": F.coalesce(f"{m}.said", F.lit("allow"))}).drop(m)


ORACLE_SQL = r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
r(rule, said) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
s as (select *, split_part(rule, '/', 1) as rh, substr(rule, instr(rule, '/')) as rp from r),
m as (select page_id, arg_max(rule, length(rule) * 1000 + length(rh)) as rule, arg_max(said, length(rule) * 1000 + length(rh)) as said
  from p join s on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select p.page_id, host, path, rule, coalesce(said, case when regexp_matches(host, '(^|\.)spam-farm\.example\.(com|net|org)$') then 'block' else 'allow' end) as verdict
from p left join m using (page_id)
"""
