"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Texts that are equal but for case and white space are one class, a node from here on. The set of word shingles of each
   gives a signature of COORDINATES coordinates, each of which is a pair of minima: two sets agree in it with a chance of
   their similarity squared, so unlike texts hardly ever meet and posting lists do not grow with the square of the corpus.
2. A node is posted under its coordinate-value pairs (tokens). Two sets that agree in at least MATCHES coordinates share
   one of the COORDINATES - MATCHES + 1 rarest of either, so only that prefix is posted; pairs that one node alone has
   take up places of the prefix without a posting.
3. Every posting list names its heaviest node, and every node is at home with the one that most of its lists name. Two
   nodes that share a posting have one home, or the one visits the other's: so each pair that can reach the threshold
   meets in a home, and a group of g near-copies is g rows, not g * g pairs.
4. A home is dealt into cells of a bounded number of shingles. In a cell a probe merges the posting lists of its own
   tokens: the shortest lists give the candidates, the longest are skipped and only looked up, and collisions below the
   threshold end there. What is left is compared on the full sets, in the cell, and only links come out, one for each
   component that the probe meets. First the home's centre probes all members, then those that it did not link and the
   visitors probe the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import components, maybe_in, numbered, staged

#: Coordinates of a signature, all of which are posted, and those that must agree. At a similarity of 0.8 two sets agree in
#: 15 of 24 on average; fewer than 6 has a chance of about 1 in 51,000.
COORDINATES, MATCHES = 24, 6
#: Shingles of the members of a cell, and of its probes: 8 bytes each.
CELL = 1 << 20
_SLICE = 1 << 20

_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 2**64, 2 * COORDINATES, np.uint64)
_MULTIPLY = _random.integers(0, 2**64, 2 * COORDINATES, np.uint64) | np.uint64(1)
_PLACE = _random.integers(0, 2**64, COORDINATES, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of the text, A-Z lower-cased, in parts of about _SLICE bytes."""
    rest = b""
    for at in range(0, len(text), _SLICE):
        part = rest + text[at : at + _SLICE].lower()
        words = part.split()
        rest = b"" if not words or part[-1:].isspace() or at + _SLICE >= len(text) else words.pop()
        yield words


def words_of(text: bytes) -> tuple[np.ndarray, bytes]:
    """(a hash of each word, a digest of the sequence of words)."""
    parts, digest = [], hashlib.blake2b(digest_size=16)
    for words in _slices(text):
        if words:
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            digest.update(b" ".join(words) + b" ")
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), digest.digest()


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words if there are fewer; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, np.uint64(min(size, len(words))))
    for i in range(min(size, len(words))):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    """The tokens of a set: a hash of each coordinate and its value."""
    low = np.full(2 * COORDINATES, 2**32 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (((s[at : at + 4096, None] ^ _XOR) * _MULTIPLY) >> np.uint64(32)).min(0))
    return _mixed((low[::2] << np.uint64(32) | low[1::2]) ^ _PLACE)


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        raw = value.as_buffer()
        yield raw.to_pybytes() if raw is not None else b""


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, signatures = [], [], [], []
            for text in _bytes_of(batch.column(2)):
                words, digest = words_of(text)
                s = shingles(words, size)
                n.append(len(s))
                high.append(int.from_bytes(digest[:8], "big", signed=True))
                low.append(int.from_bytes(digest[8:], "big", signed=True))
                signatures.append(signature(s).view(np.int64) if len(s) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, signatures)]).astype(np.int32)
            flat = np.concatenate(signatures) if signatures else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], ["doc_id", "of", "n_shingles", "high", "low", "signature"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(text)[0], size).tobytes() for text in _bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "home", "cells", "leads")), pa.array(sets, pa.binary())], ["node", "home", "cells", "leads", "shingles"])

    return run


class Cell:
    """The members of a cell, the posting lists of their tokens, and which of them are known to be linked."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray], percent: int, matches: int):
        self.nodes, self.sets, self.percent, self.matches = nodes, sets, percent, matches
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.signatures = np.stack([signature(s) for s in sets])
        tokens = self.signatures.ravel()
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.posted = tokens[order], order // COORDINATES
        self.distinct, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.component = np.arange(len(sets))

    def _collisions(self, own: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The open members that agree with a signature in enough coordinates, by prefix and skip merging."""
        first, last = np.searchsorted(self.tokens, own), np.searchsorted(self.tokens, own, "right")
        shortest = np.argsort(last - first, kind="stable")[: COORDINATES - self.matches + 1]
        met = np.zeros(len(self.nodes), bool)
        for k in shortest.tolist():
            met[self.posted[first[k] : last[k]]] = True
        found = np.flatnonzero(met & open_)
        return found[(self.signatures[found] == own).sum(1) >= self.matches]

    def linked(self, s: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The open members whose sets are similar enough to s."""
        fits = (100 * self.sizes >= self.percent * len(s)) & (100 * len(s) >= self.percent * self.sizes)
        found = self._collisions(signature(s), open_ & fits)
        if not len(found):
            return found
        at = np.minimum(np.searchsorted(self.distinct, s), len(self.distinct) - 1)
        in_s = np.zeros(len(self.distinct), bool)
        in_s[at[self.distinct[at] == s]] = True
        both = np.array([np.count_nonzero(in_s[self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]]) for i in found.tolist()])
        return found[100 * both >= self.percent * (len(s) + self.sizes[found] - both)]

    def probe(self, node: int, s: np.ndarray, component: int) -> Iterator[tuple[int, int]]:
        """The links of a node to the components that it meets; they are one with it from then on."""
        found = self.linked(s, (self.component != component) & (self.nodes != node))
        if len(found):
            met, first = np.unique(self.component[found], return_index=True)
            yield from ((node, int(self.nodes[i])) for i in found[first])
            self.component[np.isin(self.component, met)] = component


def _in_cell(percent: int, matches: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows of a cell -> (a, b): links, and (a, null) for members that probe the other cells of their home."""
        nodes, kinds, alone = (table.column(k).to_pylist() for k in ("node", "kind", "alone"))
        sets = [np.frombuffer(s, np.uint64) for s in _bytes_of(table.column("shingles"))]
        members = [i for i, k in enumerate(kinds) if k == "member"]
        out: list[tuple[int, int | None]] = []
        if members:
            cell = Cell(np.array([nodes[i] for i in members], np.int64), [sets[i] for i in members], percent, matches)
            for i in sorted((i for i, k in enumerate(kinds) if k != "member"), key=lambda i: nodes[i]):
                out += cell.probe(nodes[i], sets[i], -1 - i)
            if "centre" in kinds:
                centre = kinds.index("centre")
                loose = np.flatnonzero((cell.component != -1 - centre) & (cell.nodes != nodes[centre]))
                if not alone[0]:
                    out += [(int(cell.nodes[i]), None) for i in loose]
                else:
                    for i in loose.tolist():
                        out += cell.probe(int(cell.nodes[i]), cell.sets[i], int(cell.component[i]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _most(value: str, rank: Column) -> Column:
    """The value of the largest rank, a bounded count; a hash decides between equals."""
    return F.max_by(value, rank * (1 << 20) + F.pmod(F.xxhash64(value), F.lit(1 << 20)))


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, node, weight): the prefix of each node, in lists of two nodes or more. weight sums the node's list lengths."""
    tokens = classes.select("node", F.explode("signature").alias("token"))
    lists = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_node = tokens.join(lists, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("have"))
    places = F.greatest(F.size("have") - (matches - 1), F.lit(0))
    weight = F.aggregate("have", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    posted = staged(by_node.select("node", weight.alias("weight"), F.explode(F.slice("have", 1, places)).alias("p")).select("node", "weight", "p.token"), "minhash-posted")
    several = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return staged(posted.join(several, "token"), "minhash-postings")


def _roster(classes: DataFrame, postings: DataFrame, cell: int) -> DataFrame:
    """(node, home, cells, leads, n_shingles, doc_id, of): the home of each posted node, the cells of the home, and the
    cells of the home that the node is the centre of, if there is one."""
    centres = postings.groupBy("token").agg(_most("node", F.col("weight")).alias("centre"))
    met = postings.join(centres, "token").groupBy("node", "centre").agg(F.count("*").alias("lists"))
    homes = met.groupBy("node").agg(_most("centre", F.col("lists")).alias("home"))
    homes = staged(homes.join(classes.select("node", "n_shingles", "doc_id", "of"), "node"), "minhash-homes")
    cells = homes.groupBy("home").agg(F.ceil(F.sum("n_shingles") / cell).cast("int").alias("cells"))
    led = cells.select(F.col("home").alias("node"), F.col("cells").alias("leads"))
    return staged(homes.join(cells, "home").join(led, "node", "left"), "minhash-roster")


def _visits(postings: DataFrame, roster: DataFrame) -> DataFrame:
    """(node, home, cells): the homes that a node has to visit. Of two homes that share a list, the members of the one
    with fewer cells and the smaller id visit the other."""
    at_home = postings.select("token", "node").join(roster.select("node", "home", "cells"), "node")
    homes = at_home.groupBy("token", "home", "cells").agg(F.count("*").alias("n")).drop("n")
    mixed = homes.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    hosts = homes.join(mixed, "token").select("token", F.col("home").alias("host"), F.col("cells").alias("host_cells"))
    order = F.struct("host_cells", "host") > F.struct("cells", "home")
    return at_home.join(hosts, "token").where(order).select("node", F.col("host").alias("home"), F.col("host_cells").alias("cells")).distinct()


def _first_round(members: DataFrame, percent: int, matches: int) -> DataFrame:
    """Each home's centre meets all its members; in homes of one cell, those that it did not link meet the others."""
    dealt = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    own = members.select("home", dealt.alias("cell"), "node", F.lit("member").alias("kind"), (F.col("cells") == 1).alias("alone"), "shingles")
    led = members.where("leads is not null").select(F.col("node").alias("home"), F.explode(F.sequence(F.lit(0), F.col("leads") - 1)).alias("cell"), "node", F.lit("centre").alias("kind"), (F.col("leads") == 1).alias("alone"), "shingles")
    return own.unionByName(led).groupBy("home", "cell").applyInArrow(_in_cell(percent, matches), "a long, b long")


def _second_round(members: DataFrame, roster: DataFrame, probes: DataFrame, cell: int, percent: int, matches: int) -> DataFrame:
    """Each probe (node, home, cells) meets all members of the home. Where probes have more than `cell` shingles, they are
    dealt into lanes, each with its own copy of the members."""
    probes = probes.join(roster.select("node", "n_shingles"), "node")
    lanes = probes.groupBy("home").agg(F.ceil(F.sum("n_shingles") / cell).cast("int").alias("lanes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lane, at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lanes")).cast("int"), F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    going = probes.join(lanes, "home").select("node", "home", lane.alias("lane"), every("cells").alias("cell"), F.lit("probe").alias("kind"))
    staying = roster.join(lanes, "home").select("node", "home", every("lanes").alias("lane"), at.alias("cell"), F.lit("member").alias("kind"))
    rows = going.unionByName(staying).join(members.select("node", "shingles"), "node").withColumn("alone", F.lit(False))
    return rows.groupBy("home", "cell", "lane").applyInArrow(_in_cell(percent, matches), "a long, b long")


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, matches: int = MATCHES, cell: int = CELL) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of word shingles; a text of fewer than
    `size` words is one shingle. Null, empty and blank texts have no shingles and are linked with nothing. component_id is
    the smallest doc_id that can be reached over links. Rows with a null doc_id stay, linked with nothing. Rows that
    repeat a doc_id count as one document: its texts are linked, and each row is returned. An empty table gives none.
    doc_id is a long; keys that are not numbers are an error. Other columns are not read.
    """
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).cast("binary").alias("text"))
    features = staged(source.mapInArrow(_features(size), "doc_id long, of long, n_shingles long, high long, low long, signature array<long>"), "minhash-features")
    linked = features.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "of", "n_shingles", "signature")).alias("first")
    classes = staged(numbered(linked.groupBy("high", "low").agg(first).select("high", "low", "first.*"), "node"), "minhash-classes")

    postings = _postings(classes, matches)
    roster = _roster(classes, postings, cell)
    texts = maybe_in(source, ["doc_id", "of"], roster).join(roster.drop("n_shingles"), ["doc_id", "of"])
    texts = texts.groupBy("doc_id", "of").agg(*(F.first(k).alias(k) for k in ("node", "home", "cells", "leads", "text"))).drop("doc_id", "of")
    members = staged(texts.mapInArrow(_sets(size), "node long, home long, cells int, leads int, shingles binary"), "minhash-members")

    met = staged(_first_round(members, percent, matches), "minhash-first")
    loose = met.where("b is null").select(F.col("a").alias("node")).join(roster.select("node", "home", "cells"), "node")
    visits = staged(_visits(postings, roster).unionByName(loose), "minhash-probes")
    links = staged(_second_round(members, roster, visits, cell, percent, matches), "minhash-second").unionByName(met.where("b is not null"))

    ids = staged(features.select("doc_id", "n_shingles", "high", "low").join(classes.select("high", "low", "node"), ["high", "low"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "minhash-ids")
    again = ids.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    again = again.join(ids, "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    label = components(documents.sparkSession, links.unionByName(again), "minhash").select("node", "component")
    joined = ids.where("node is not null").join(label, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(label.join(joined, "component").select("node", "component_id"), "minhash-named")
    copies = classes.select("node", F.col("doc_id").alias("first_id")).join(named, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    out = ids.join(copies, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
