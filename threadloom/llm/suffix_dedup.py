"""Repeated passages by deep-shallow suffix sorting.

A passage of LENGTH bytes repeats when the same LENGTH bytes start in a document with a smaller doc_id. Only starts that
can repeat are sorted:

1. Texts go into blocks (staged, compressed). Each start has an anchor, the least hash of the GRAM-byte strings inside its
   LENGTH bytes; equal passages have equal anchors. A stretch of starts with one anchor, and the bytes they cover, is a
   segment.
2. Anchors meet in buckets by their hash; those seen in one document only go no further. Those seen in more than HEAVY
   blocks are cut again with anchors of FINE bytes, so that no bucket holds the varied surroundings of a common passage.
3. Each block sends its distinct segments of the others to their buckets, once for each block with the smallest doc_id
   there, so copies combine before the shuffle.
4. In a bucket the suffixes of the segments are sorted: multikey quicksort on eight-byte characters to a shallow depth,
   then a blind trie for each group that is still equal there; groups too large for a trie go on by quicksort. Neighbours
   with a common prefix of LENGTH bytes are one passage; its smallest doc_id says which starts go.
5. Blocks get the answers back and drop the covered bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged

LENGTH, GRAM = 50, 24
#: Bytes of text in a block and, on average, behind a bucket. Larger inputs get more of them.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 6 << 20, 16
#: An anchor in more blocks than HEAVY is cut again, with grams of FINE bytes. Fine anchors have the bit _FINE.
HEAVY, FINE, _FINE = 48, 46, np.uint64(1 << 62)
#: Shallow depth, in characters of eight bytes, and the largest group that a blind trie orders.
SHALLOW, TRIE = 2, 1024
#: Ranges of fewer suffixes are sorted directly.
SMALL = 128

_BYTE = np.random.default_rng(19990331).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UP: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _UP.get(0) is None or len(_UP[0]) < n:
        size = max(n, 1 << 16)
        _UP[0] = np.cumprod(np.full(size, _BASE, np.uint64))
        _UP[1] = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
    return _UP[0][:n], _UP[1][:n]


def _anchors(total: np.ndarray, down: np.ndarray, gram: int) -> np.ndarray:
    """For each start the least 48-bit hash of the grams inside its LENGTH bytes, from the running hash of the text."""
    h = (total[gram:] - total[:-gram]) * down[: len(total) - gram]
    h = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
    low, width, window = h, 1, LENGTH - gram + 1
    while width * 2 <= window:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    return np.minimum(low[: len(h) - window + 1], low[window - width :])


_NONE = np.empty(0, np.uint64)


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _keys(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor, then 32 bits of the rest: few anchors of a bucket share them, and sharing only adds work."""
    return (anchors % np.uint64(buckets)) << np.uint64(32) | (anchors // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)


def stretches(b: np.ndarray, first: int = 0, part: int = 1 << 20, heavy: np.ndarray = _NONE, buckets: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, from, to): the starts from..to (exclusive) of b have this anchor; heavy has the keys of those that are cut
    again. Long texts go in parts."""
    last = len(b) - LENGTH + 1
    if last - first > part:
        found = [stretches(b[at : min(at + part, last) + LENGTH - 1], 0, part, heavy, buckets) for at in range(first, last, part)]
        at = np.arange(first, last, part)
        return tuple(np.concatenate([x[i] + (np.int64(at[j]) if i else np.uint64(0)) for j, x in enumerate(found)]) for i in range(3))
    if last <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up)])
    low = _anchors(total, down, GRAM)
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    again = _is_in(_keys(low[at], buckets), heavy)
    if again.any():
        low = np.where(np.repeat(again, np.diff(np.append(at, len(low)))), _anchors(total, down, FINE) | _FINE, low)
        at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[at], at, np.append(at[1:], len(low))


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)

        def out(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            raw = pack.compress(b"".join(texts))
            lengths = [len(x) for x in texts]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([sum(lengths)], pa.int64()), pa.array([raw], pa.binary())], ["block", "ids", "lengths", "bytes", "texts"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_buffer()
                ids.append(i)
                texts.append(raw.to_pybytes() if raw is not None else b"")
                held += len(texts[-1])
                if held >= block_bytes:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield out(ids, texts)

    return run


class _Block:
    """A block's texts and all stretches of its documents."""

    def __init__(self, ids, lengths, texts: bytes, buckets: int, heavy: np.ndarray = _NONE):
        self.ids, self.raw = ids, zstandard.ZstdDecompressor().decompress(texts) if sum(lengths) else b""
        self.ends = np.cumsum(lengths, dtype=np.int64)
        b, parts = np.frombuffer(self.raw, np.uint8), []
        for k, (end, n) in enumerate(zip(self.ends, lengths, strict=True)):
            if n >= LENGTH and ids[k] is not None:
                anchor, start, stop = stretches(b[end - n : end], heavy=heavy, buckets=buckets)
                parts.append((anchor, start + (end - n), stop + (end - n), np.full(len(anchor), k, np.int64)))
        self.anchor, self.start, self.stop, self.doc = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64 if i == 0 else np.int64) for i in range(4))
        self.key = _keys(self.anchor, buckets)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, in several documents), distinct, in order: by bucket."""
        order = np.lexsort((self.doc, self.key))
        a, d = self.key[order], self.doc[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        last = np.append(first[1:], len(a)) - 1 if len(a) else first
        return a[first], d[first] != d[last]

    def segments(self, repeated: np.ndarray):
        """The distinct segments with a repeated or a fine anchor, as {bytes: (number, anchor, smallest doc_id)}, and for each stretch
        the number of its segment, or -1."""
        use = np.flatnonzero(_is_in(self.key, repeated) | (self.anchor >= _FINE))
        number, found = np.full(len(self.anchor), -1, np.int64), {}
        anchors, owner = [], []
        for i, s, e, a, k in zip(use.tolist(), self.start[use].tolist(), self.stop[use].tolist(), self.anchor[use].tolist(), self.doc[use].tolist(), strict=True):
            segment = self.raw[s : e + LENGTH - 1]
            n = found.setdefault(segment, len(found))
            number[i] = n
            if n == len(owner):
                anchors.append(a)
                owner.append(self.ids[k])
            elif self.ids[k] < owner[n]:
                owner[n] = self.ids[k]
        return list(found), anchors, owner, number


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i].as_py() for j in range(batch.num_columns))


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lengths, texts in _rows(batches):
            key, several = _Block(ids, lengths, texts, buckets).anchors()
            bucket = (key >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            parts = [slice(a, z) for a, z in zip(cut, [*cut[1:], len(bucket)], strict=True)] if len(cut) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p.start]) for p in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([key[p].astype("<u4").tobytes() for p in parts], pa.binary()), pa.array([np.packbits(several[p]).tobytes() for p in parts], pa.binary())], ["bucket", "block", "anchors", "several"])

    return run


def _meet_anchors(heavy: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block, which of its anchors are in several documents, and which of these are heavy."""
        parts = [np.frombuffer(x, "<u4") for x in table.column("anchors").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("several").to_pylist(), parts, strict=True)]
        _, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = count > 1
        several[place[np.concatenate(flags)]] = True
        ends = np.cumsum([len(p) for p in parts])
        found = {"block": table.column("block"), "bucket": table.column("bucket")}
        for name, which in (("repeated", several & (count <= heavy)), ("heavy", several & (count > heavy))):
            mine = which[place]
            found[name] = pa.array([p[mine[e - len(p) : e]].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())
        return pa.table(found)

    return run


def _met(buckets: list[dict] | None, name: str) -> np.ndarray:
    """The keys, in order, that the buckets say are repeated or heavy."""
    parts = [np.uint64(m["bucket"]) << np.uint64(32) | np.frombuffer(m[name], "<u4").astype(np.uint64) for m in buckets or ()]
    return np.sort(np.concatenate(parts)) if parts else _NONE


def _send_segments(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for block, ids, lengths, texts, met in _rows(batches):
            segments, anchors, owner, _ = _Block(ids, lengths, texts, buckets, _met(met, "heavy")).segments(_met(met, "repeated"))
            to: dict[int, list[int]] = {}
            for n, a in enumerate(anchors):
                to.setdefault(a % buckets, []).append(n)
            out = [[], [], [], []]
            for bucket, mine in to.items():
                mine.sort(key=anchors.__getitem__)  # like segments next to each other
                head = np.array([[n, len(segments[n]), anchors[n] // buckets & 0xFFFFFFFF] for n in mine], np.uint32).T.tobytes() + np.array([owner[n] for n in mine], np.int64).tobytes()
                for column, value in zip(out, (bucket, block, len(mine), pack.compress(head + b"".join(segments[n] for n in mine))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["bucket", "block", "n", "packed"])

    return run


def blind_trie(strings: list[int], depth: int) -> list[tuple[int, int]]:
    """(index, common prefix with the one before, in bits) in sorted order, for integers of `depth` bits.

    The trie branches on single bits and keeps no labels. A string goes down blindly to a leaf, is compared with that one
    string, and is put in where they first differ.
    """
    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[2] if s >> (depth - 1 - node[0]) & 1 else node[1]
        other = strings[node if isinstance(node, int) else node[0]] if not isinstance(node, tuple) else strings[node[0]]
        differ = depth - (s ^ other).bit_length()
        parent, node = None, root
        while isinstance(node, list) and node[0] < differ:
            parent, side = node, 2 if s >> (depth - 1 - node[0]) & 1 else 1
            node = node[side]
        if differ == depth:
            new = (*node, i) if isinstance(node, tuple) else (node, i)
        else:
            new = [differ, node, i] if s >> (depth - 1 - differ) & 1 else [differ, i, node]
        if parent is None:
            root = new
        else:
            parent[side] = new
    out: list[tuple[int, int]] = []
    todo: list[tuple[object, int]] = [(root, 0)]
    while todo:
        node, common = todo.pop()
        if isinstance(node, list):
            todo += [(node[2], node[0]), (node[1], common)]
        else:
            for k, i in enumerate(node if isinstance(node, tuple) else (node,)):
                out.append((i, depth if k else common))
    return out


def sorted_suffixes(text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of LENGTH bytes that start at `at`, sorted: (order, whether equal to the one before)."""
    padded = np.frombuffer(text + bytes(8), np.uint8)
    character = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    places = [*range(0, LENGTH - 7, 8), LENGTH - 8]  # the last character overlaps the one before
    done, todo = [], [(np.arange(len(at)), 0, False)]
    while todo:
        some, depth, large = todo.pop()
        large |= depth == SHALLOW and len(some) > TRIE
        if len(some) <= 1 or depth == len(places) or depth == SHALLOW and not large:
            done.append((some, large))
            continue
        key = character[at[some] + places[depth]].astype(np.uint64)
        if len(some) < SMALL:
            rest = [character[at[some] + places[d]].astype(np.uint64) for d in range((len(places) if large else SHALLOW) - 1, depth, -1)]
            done.append((some[np.lexsort((*rest, key))], large))
            continue
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        todo += [(some[key > pivot], depth, large), (some[key == pivot], depth + 1, large), (some[key < pivot], depth, large)]
    order = np.concatenate([some for some, _ in done]) if done else np.empty(0, np.int64)
    sorted_ = np.repeat([large for _, large in done], [len(some) for some, _ in done])
    if not len(order):
        return order, np.empty(0, bool)

    def same(offsets: list[int]) -> np.ndarray:
        equal = np.ones(len(order), bool)
        equal[0] = False
        for o in offsets:
            c = character[at[order] + o]
            equal[1:] &= c[1:] == c[:-1]
        return equal

    shallow = same([8 * d for d in range(SHALLOW)])
    deep = shallow & same([*range(8 * SHALLOW, LENGTH - 8, 8), LENGTH - 8])
    group = np.cumsum(~shallow) - 1
    mixed = np.unique(group[shallow & ~deep & ~sorted_])  # what quicksort has ordered to the end needs no trie
    edges = np.append(np.flatnonzero(~shallow), len(order))
    bits = 8 * (LENGTH - 8 * SHALLOW)
    for g in mixed.tolist():
        a, z = edges[g], edges[g + 1]
        members = order[a:z]
        strings = [int.from_bytes(text[p + 8 * SHALLOW : p + LENGTH], "big") for p in at[members].tolist()]
        ranked = blind_trie(strings, bits)
        order[a:z] = members[[i for i, _ in ranked]]
        deep[a:z] = [k > 0 and common == bits for k, (_, common) in enumerate(ranked)]
    return order, deep


def _sort_bucket(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    numbers, owners, anchors, block_of, kinds = [], [], [], [], []
    known: dict[bytes, int] = {}
    for row, (n, packed) in enumerate(zip(table.column("n").to_pylist(), table.column("packed").to_pylist(), strict=True)):
        raw = unpack.decompress(packed)
        number, size, anchor = np.frombuffer(raw, np.uint32, 3 * n).reshape(3, n)
        ends = 20 * n + np.cumsum(size, dtype=np.int64)
        kinds += [known.setdefault(raw[e - s : e], len(known)) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
        numbers.append(number)
        owners.append(np.frombuffer(raw[12 * n : 20 * n], np.int64))
        anchors.append(anchor)
        block_of.append(np.full(n, row))
    kind, number, owner, anchor, row_of = np.array(kinds, np.int64), *(np.concatenate(x) for x in (numbers, owners, anchors, block_of))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owner)
    of_kind = np.zeros(len(known), np.int64)
    of_kind[kind] = anchor
    # segments that share an anchor with another segment: their suffixes are sorted
    _, place, count = np.unique(of_kind, return_inverse=True, return_counts=True)
    lone = count[place] == 1
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    text, ends = b"".join(known), np.cumsum(sizes)
    several = np.flatnonzero(~lone)
    starts = np.where(lone, 0, sizes - LENGTH + 1)
    which = np.repeat(several, starts[several])
    inner = np.arange(len(which)) - np.repeat(np.cumsum(starts[several]) - starts[several], starts[several])
    order, equal = sorted_suffixes(text, (ends - sizes)[which] + inner)
    gone = np.zeros(len(which), bool)
    if len(order):
        first = np.flatnonzero(~equal)
        smallest = np.minimum.reduceat(least[which[order]], first)
        gone[order] = smallest[np.cumsum(~equal) - 1] < least[which[order]]
    # the removed starts of each kind, as runs
    edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (which[1:] == which[:-1])])) if len(gone) else np.empty(0, np.int64)
    stop = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (which[1:] == which[:-1]), [False]])) if len(gone) else edge
    run_kind, run_a, run_z = which[edge], inner[edge], inner[stop] + 1
    run_from = np.searchsorted(run_kind, np.arange(len(known) + 1))
    whole = owner > least[kind]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for n, k, w, r in zip(number.tolist(), kind.tolist(), whole.tolist(), row_of.tolist(), strict=True):
        if w:
            out.setdefault(r, []).append((n, 0, int(sizes[k]) - LENGTH + 1))
        elif run_from[k] < run_from[k + 1]:
            out.setdefault(r, []).extend((n, int(run_a[j]), int(run_z[j])) for j in range(run_from[k], run_from[k + 1]))
    blocks, pack = table.column("block").to_pylist(), zstandard.ZstdCompressor(level=3)
    return pa.table({"block": pa.array([blocks[r] for r in out], pa.int64()), "answer": pa.array([pack.compress(np.array(x, np.uint32).tobytes()) for x in out.values()], pa.binary())})


def _drop(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for _, ids, lengths, texts, met, answers in _rows(batches):
        block = _Block(ids, lengths, texts, buckets, _met(met, "heavy"))
        _, _, owner, number = block.segments(_met(met, "repeated"))
        use = np.flatnonzero(number >= 0)
        runs = np.concatenate([np.frombuffer(unpack.decompress(x), np.uint32).reshape(-1, 3) for x in answers]).astype(np.int64) if answers else np.empty((0, 3), np.int64)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        at = np.searchsorted(runs[:, 0], np.arange(len(owner) + 1))
        change = np.zeros(len(block.raw) + 1, np.int32)
        for s, e, n, k in zip(block.start[use].tolist(), block.stop[use].tolist(), number[use].tolist(), block.doc[use].tolist(), strict=True):
            if block.ids[k] > owner[n]:
                change[s] += 1
                change[e + LENGTH - 1] -= 1
            else:
                for _, a, z in runs[at[n] : at[n + 1]]:
                    change[s + a] += 1
                    change[s + z + LENGTH - 1] -= 1
        removed = np.cumsum(change[:-1]) > 0
        out = [[], [], [], [], []]
        for i, end, n in zip(ids, block.ends.tolist(), lengths, strict=True):
            mine = removed[end - n : end]
            kept = np.frombuffer(block.raw, np.uint8)[end - n : end][~mine].tobytes() if mine.any() else block.raw[end - n : end]
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
            for column, value in zip(out, (i, n, int(mine.sum()), spans, kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY) -> DataFrame:
    """One row for each row of documents: doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes).

    Texts are UTF-8 bytes; null is empty. Passages never cross documents. Rows with a null doc_id are returned whole and
    remove nothing. Rows that repeat a doc_id do not remove each other's bytes. Overlaps count, and passages are judged
    on the input. An empty table gives an empty result.
    """
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    blocks = staged(source.mapInArrow(_blocks(block_bytes), "block long, ids array<long>, lengths array<int>, bytes long, texts binary"), "suffix-blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // bucket_bytes + 1)
    body = blocks.select("block", "ids", "lengths", "texts")
    anchors = body.mapInArrow(_send_anchors(buckets), "bucket int, block long, anchors binary, several binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_meet_anchors(heavy), "block long, bucket int, repeated binary, heavy binary")
    met = repeated.groupBy("block").agg(F.collect_list(F.struct("bucket", "repeated", "heavy")).alias("met"))
    body = body.join(staged(met, "suffix-met"), "block", "left")
    segments = body.mapInArrow(_send_segments(buckets), "bucket int, block long, n int, packed binary")
    answers = segments.groupBy("bucket").applyInArrow(_sort_bucket, "block long, answer binary")
    answers = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))
    return body.join(answers, "block", "left").mapInArrow(partial(_drop, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int, str]]:
    """The same by a table of all passages, for small inputs."""
    first: dict[bytes, int] = {}
    for i, b in rows:
        for p in range(len(b) - LENGTH + 1):
            s = b[p : p + LENGTH]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
