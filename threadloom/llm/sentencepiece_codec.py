"""SentencePiece encoding and decoding by a streaming Viterbi pass over the lattice of pieces.

For every position the pass keeps one backpointer, the last piece of the best segmentation that ends there. It looks back
at most the longest piece; whenever the backpointer paths of all positions in that window meet at one boundary, the ids
before it are final and leave the window. Two path rules are offered, for the two kinds of model files:

* "unigram": the path with the largest sum of piece scores;
* "bpe": the path that the merges of the file give. A segmentation is what merging gives exactly when each pair of
  neighbouring pieces is what merging gives for the pair's own text, so each position has one admissible backpointer.

A space never stands inside a piece after another character, so a word and the spaces before it form a stretch at whose
start all paths meet; stretches are remembered, within a bound.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spare_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries that a worker remembers for each kind, in each of two generations.
REMEMBERED = 150_000
#: Positions after which a stretch is searched for a boundary where all paths meet.
COMMIT_EVERY = 256
#: Characters of text that are cut into stretches at once.
GROUP = 3_000_000
#: A character without a piece of its own is this and its code point; before the first piece stands _START.
_CHARACTER, _START = 1 << 20, -1
#: Rows that are encoded before their ids are handed on.
ROWS = 2500
_STRETCH = re.compile(r" +[^ ]*|[^ ]+")


class Recent:
    """A memory of two generations: what was used lately stays, the rest goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], unknown: int, kind: str, remembered: int = REMEMBERED):
        """pieces: text (spaces as such) and score by id, the text empty for ids that no text may match."""
        self.kind, self.unknown = kind, unknown
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.score = {p: s for p, s in pieces if p}
        self.longest = max(map(len, self.ids), default=1)
        self.missing = min(self.score.values(), default=0.0) - 10.0
        self.byte_ids = byte_ids
        self.texts = [p for p, _ in pieces]
        self.lengths = [len(p) for p, _ in pieces]
        self.out = [p.encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            tails.setdefault(p[-3:], set()).add(len(p))
        #: Sizes of the pieces that end in three characters, the largest first, with those of the shorter ends; any
        #: character may stand alone.
        self.sizes = {k: tuple(sorted(v.union(tails.get(k[1:], ()) if len(k) == 3 else (), [1]), reverse=True)) for k, v in tails.items()}
        self.edges: dict[str, tuple | None] = {}
        self.stretches, self.pairs = Recent(remembered), {}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(model: bytes, kind: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        pieces = [("" if special[i] else sp.id_to_piece(i).replace("▁", " "), sp.get_score(i)) for i in range(n)]
        by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return Codec(pieces, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], sp.unk_id(), kind)

    def _tree(self, text: str):
        """How merging builds a text of one piece, as (text, left, right), always the best-scored pair, the leftmost of
        equals; None if it builds several pieces."""
        parts = [(c, None, None) for c in text]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]
        return parts[0]

    def _edges(self, piece: str):
        """(right edges, left edges) of a piece: what stands at its border while it is being merged, from the single
        character up to the piece, each with the score of the merge that ends it (None for the piece itself)."""
        found = self.edges.get(piece, False)
        if found is False:
            found, tree = None, self._tree(piece)
            if tree is not None:
                sides = []
                for side in (2, 1):
                    node, ends, chain = tree, None, []
                    while node is not None:
                        chain.append((node[0], ends))
                        ends, node = self.score.get(node[0]), node[side]
                    sides.append(tuple(reversed(chain)))
                found = tuple(sides)
            if len(piece) > 1 or len(self.edges) < 1 << 17:
                self.edges[piece] = found
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbouring pieces apart: no pair of border parts that stand at the same time has a
        merge that comes before the merges which end them. Of equal scores the leftmost merge comes first."""
        mine, other = self._edges(left), self._edges(right)
        if mine is None or other is None:
            return False
        mine, other, score, i, j = mine[0], other[1], self.score, 0, 0
        while True:
            x, ends_x = mine[i]
            y, ends_y = other[j]
            s = score.get(x + y)
            if s is not None and (ends_x is None or s > ends_x) and (ends_y is None or s >= ends_y):
                return False
            if ends_x is None:
                if ends_y is None:
                    return True
                j += 1
            elif ends_y is None or ends_x >= ends_y:
                i += 1
            else:
                j += 1

    def _text(self, piece: int) -> str:
        return self.texts[piece] if piece < _CHARACTER else chr(piece - _CHARACTER)

    def _length(self, piece: int) -> int:
        return self.lengths[piece] if piece < _CHARACTER else 1

    def _may_follow(self, piece: int, before: int) -> bool:
        if before == _START:
            return self._edges(self._text(piece)) is not None
        return self._apart(self._text(before), self._text(piece))

    def _extend(self, text: str, last: list[int], best: list[float], base: int, upto: int) -> None:
        """The pass: one backpointer for each position after base + len(last) - 1 up to `upto`. last[k] is the last piece of
        the admitted path that ends k characters after base, best[k] its score."""
        if self.kind == "bpe":
            return self._extend_bpe(text, last, base, upto)
        for end in range(base + len(last), upto + 1):
            top, found, most = None, _CHARACTER, end - base
            for size in range(min(self.longest, most), 0, -1):
                piece = text[end - size : end]
                s = self.score.get(piece, self.missing if size == 1 else None)
                if s is not None and (top is None or best[most - size] + s > top):
                    top, found = best[most - size] + s, self.ids.get(piece, _CHARACTER + ord(piece[0]))
            last.append(found)
            best.append(top)

    def _extend_bpe(self, text: str, last: list[int], base: int, upto: int) -> None:
        ids, pairs, sizes, most, one = self.ids.get, self.pairs, self.sizes.get, 4 * self.stretches.most, (1,)
        if len(pairs) > most:
            pairs.clear()
        for end in range(base + len(last), upto + 1):
            room = end - base
            for size in (end > 2 and sizes(text[end - 3 : end])) or sizes(text[end - 2 : end] if end > 1 else text[:1], one):
                if size > room:
                    continue
                piece = ids(text[end - size : end])
                if piece is None:
                    if size > 1:
                        continue
                    piece = _CHARACTER + ord(text[end - 1])
                before = last[room - size]
                pair = before << 22 | piece
                apart = pairs.get(pair)
                if apart is None:
                    apart = pairs[pair] = self._may_follow(piece, before)
                if apart:
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no path to {end} in {text[max(0, end - 40) : end]!r}")

    def pieces_of(self, stretch: str) -> Iterator[int]:
        """The pieces of one stretch, yielded as soon as they are final."""
        last, best, base, n = [_START], [0.0], 0, len(stretch)
        while base + len(last) - 1 < n:
            self._extend(stretch, last, best, base, min(n, base + len(last) - 1 + COMMIT_EVERY))
            here = len(last) - 1
            if base + here < n:
                paths = set(range(max(0, here - self.longest + 1), here + 1))
                while len(paths) > 1 and (far := max(paths)) > 0:
                    paths.discard(far)
                    paths.add(far - self._length(last[far]))
                meet = paths.pop()
                if meet > 0:
                    yield from self._path(last, meet)
                    # what was committed still borders on the next piece
                    last, best, base = last[meet:], [x - best[meet] for x in best[meet:]], base + meet
        yield from self._path(last, n - base)

    def _path(self, last: list[int], end: int) -> list[int]:
        found = []
        while end > 0:
            found.append(last[end])
            end -= self._length(last[end])
        return found[::-1]

    def _numbers(self, pieces) -> tuple[int, ...]:
        found: list[int] = []
        for piece in pieces:
            if piece < _CHARACTER:
                found.append(piece)
            else:
                found += [self.byte_ids[b] for b in chr(piece - _CHARACTER).encode()] if self.byte_ids else [self.unknown]
        return tuple(found)

    def _learn(self, stretches: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each stretch. Backpointers look back only, so of sorted neighbours the later one goes on from what both
        have in common; long ones commit on their way."""
        found, before, last, best, lengths = {}, "", [_START], [0.0], self.lengths
        for stretch in sorted(stretches):
            if len(stretch) > COMMIT_EVERY:
                found[stretch] = self._numbers(self.pieces_of(stretch))
                continue
            same, most = 0, min(len(before), len(stretch))
            while same < most and before[same] == stretch[same]:
                same += 1
            del last[same + 1 :], best[same + 1 :]
            self._extend(stretch, last, best, 0, len(stretch))
            path, end = [], len(stretch)
            while end > 0 and last[end] < _CHARACTER:
                path.append(last[end])
                end -= lengths[last[end]]
            found[stretch] = self._numbers(self._path(last, len(stretch))) if end else tuple(path[::-1])
            before = stretch
        return found

    def encode_all(self, texts: list[str]) -> list[array]:
        """The ids of each text. Texts go in groups of about GROUP characters, so what is held at once is bounded."""
        out: list[array] = []
        at = 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and (not group or held + len(texts[at]) <= GROUP):
                group.append(_STRETCH.findall(f" {texts[at]}") if texts[at] else [])
                held += len(texts[at])
                at += 1
            get = self.stretches.get
            known = {x: get(x) for x in set().union(*group)}
            fresh = self._learn([x for x, ids in known.items() if ids is None])
            known.update(fresh)
            out += [array("i", chain.from_iterable(map(known.__getitem__, stretches))) for stretches in group]
            for x, ids in fresh.items():
                if len(x) <= COMMIT_EVERY:  # longer ones seldom come again
                    self.stretches.put(x, ids)
        return out

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _as_numpy(ids: array) -> np.ndarray:
    return np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)


def _model(path: str) -> bytes:
    return Path(path).read_bytes()  # on the driver; half a megabyte travels to the tasks


def encoded(text: Column, model: str = MODEL, kind: str = "bpe") -> Column:
    """array<int>: the ids of each whole text. Null stays null; empty text has no ids.

    Characters without a piece become their UTF-8 bytes' ids, U+2581 too, which stands for a space in the file only; so
    decoding gives every text back exactly.
    """
    proto = _model(model)

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec.load(proto, kind)
        for series in texts:
            for at in range(0, len(series), ROWS):
                some = series.iloc[at : at + ROWS]
                found = codec.encode_all([x if isinstance(x, str) else "" for x in some])
                yield pd.Series([_as_numpy(ids) if isinstance(x, str) else None for x, ids in zip(some, found, strict=True)], dtype=object)

    return encode(text)


def decoded(ids: Column, model: str = MODEL, kind: str = "bpe") -> Column:
    """string: the text of each array of ids. Null stays null; no ids give the empty text."""
    proto = _model(model)

    @F.pandas_udf("string")
    def decode(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec.load(proto, kind)
        for series in arrays:
            yield pd.Series([None if x is None else codec.decode(x.tolist()) for x in series], dtype=object)

    return decode(ids)


def round_trip(documents: DataFrame, text: str = "text", model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """documents with ids, n_ids, decoded_sha256 and exact: encoded, decoded again and compared in one pass.

    Null text has null ids, 0 of them, the digest of the empty text, and is exact. Every row stays one row; columns with
    the names of the result are replaced.
    """
    proto = _model(model)

    @F.pandas_udf("ids array<int>, decoded_sha256 string, exact boolean")
    def there_and_back(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec.load(proto, kind)
        for series in texts:
            for at in range(0, len(series), ROWS):
                ids, digests, exact = [], [], []
                some = [x if isinstance(x, str) else "" for x in series.iloc[at : at + ROWS]]
                for x, found in zip(some, codec.encode_all(some), strict=True):
                    back = codec.decode(found)
                    ids.append(_as_numpy(found))
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == x)
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded_sha256": digests, "exact": exact})

    r = spare_name(documents)
    out = documents.withColumn(r, there_and_back(F.col(text)))
    columns = {"ids": F.when(F.col(text).isNotNull(), F.col(f"{r}.ids")), "n_ids": F.size(f"{r}.ids").cast("long"), "decoded_sha256": F.col(f"{r}.decoded_sha256"), "exact": F.col(f"{r}.exact")}
    return out.withColumns(columns).drop(r)
