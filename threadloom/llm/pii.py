"""Personal data by candidate gradient boosting.

Four kinds have exact formats (the base): email, ip, card, phone. High-recall generators propose further spans, which may
overlap: values after a key word, long hexadecimal runs, digit groups without a plus sign, spelled-out addresses, IPv6.
Boosted trees score each candidate by its format and its context; a threshold for each kind, calibrated on rows that the
trees were not fitted on, selects which are redacted. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import draw_limit, spare_name

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "id_number", "email_spelled", "ipv6")
KINDS = (*BASE_KINDS, *MORE_KINDS)
#: Texts with a sign of each added kind that the trees are fitted and calibrated on: the expected size of a sample by hash.
SAMPLE_TEXTS = 3000
#: Candidates of one sampled text that are learnt from, spread over the text.
SAMPLE_PER_TEXT = 200
PRECISION = 0.98
LEAST_SELECTED = 10

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words that announce a value, and those that stand near personal data.
_KEYS = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential)"
_NEAR = ("pass", "token", "secret", "key", "phone", "tel", "call", "mail", "card", "account", "iban", "id", "ip", "ssn", "version", "page", "year")
_AFTER_KEY = re.compile(_KEYS + r"[\x20\x09]{0,3}(?:=|:|\bis\b)[\x20\x09]{0,3}[\"']?([A-Za-z0-9_./+=-]{4,}+)", re.I)
_KEY_PARTS = ("pass", "pwd", "token", "secret", "key", "credential")
_HEX_RUN = re.compile(r"(?<![A-Za-z0-9])([0-9a-fA-F]{12,}+)(?![A-Za-z0-9])")
_DIGIT_GROUPS = re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20().-]{0,4}[0-9])++")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])((?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4})(?![0-9A-Za-z:])")
_AT = re.compile(r"[\x20]?(?:\(at\)|\[at\]|(?<![A-Za-z0-9])at(?![A-Za-z0-9]))[\x20]?([A-Za-z0-9-]++)[\x20]?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)[\x20]?([A-Za-z]{2,}+)", re.I)
_DIGIT, _WORDY = re.compile(r"[0-9]"), re.compile(r"[0-9A-Za-z]")
#: Numbers whose grouping says what they are, and words before a number that do.
_GROUPED_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}\)?[\x20.-]{1,2})[0-9]{3}[\x20.-][0-9]{4}")
_ID_BEFORE = re.compile(r"\b(?:phone|tel|telephone|mobile|fax|call|ssn|social\x20security|account|acct|iban|passport|tax\x20id|id)\b\W{0,3}(?:(?:no|nr|number|is|at|me|us)\b\W{0,3}){0,2}$", re.I)
#: What a text with a candidate of the kind has in it, as Spark reads patterns.
SIGNS = {
    "secret": r"(?i)(?:pass|pwd|token|secret|key|credential)|[0-9a-f]{12}", "id_number": r"[0-9][0-9\x20().-]{5}", "email_spelled": r"(?i)\(at\)|\[at\]|\x20at\x20?[a-z0-9-]+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z]{2}",
    "ipv6": r"(?:[0-9a-fA-F]{1,4}:){2}[0-9a-fA-F]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each @ outwards, so a long run of letters is read once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose: (kind, start, end), each once. A generator runs where its sign stands in the text."""
    low, found = text.lower(), []
    if any(k in low for k in _KEY_PARTS):
        found += [("secret", *m.span(1)) for m in _AFTER_KEY.finditer(text)]
    if _DIGIT.search(text):
        found += [("secret", *m.span(1)) for m in _HEX_RUN.finditer(text)]
        found += [("id_number", *m.span()) for m in _DIGIT_GROUPS.finditer(text) if m.end() - m.start() >= 7 and not _WORDY.match(text, m.end())]
    if " at " in low or "(at)" in low or "[at]" in low:
        free = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email_spelled", start, m.end()))
            free = m.end()
    if ":" in text:
        found += [("ipv6", *m.span(1)) for m in _IPV6.finditer(text)]
    return list(dict.fromkeys(found))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format, then context."""
    s, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 8]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    counts = np.fromiter(Counter(s).values(), float) / n
    plain = "".join(c for c in s if "0" <= c <= "9")
    return [
        MORE_KINDS.index(kind), n, digits, digits / n, letters / n, hexes / n, float(-(counts * np.log2(counts)).sum()), float(s.islower()), float(s.isupper()), sum(c in " -().:" for c in s),
        float(8 <= len(plain) <= 19 and luhn(plain)), float(bool(re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", s))), max(map(len, re.split(r"[^0-9]+", s))), s.count("."),
        float(before[-1:] in "=:\"'"), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(after[:1] in "\"'"), float(after[:1].isalnum()), *(float(w in before) for w in _NEAR),
    ]


class Covered:
    """Whether a span lies within one of many: starts in order, and the furthest end up to each."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        order = sorted((a, z) for _, a, z in spans)
        self.starts, self.ends = [a for a, _ in order], list(accumulate((z for _, z in order), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


def weak_label(text: str, kind: str, start: int, end: int) -> bool:
    """What the trees learn from, and what decides for kinds without a threshold: a format and context that leave no doubt."""
    s, before = text[start:end], text[max(0, start - 32) : start]
    if kind == "secret":
        mixed = len(s) >= 12 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        return mixed and (bool(re.search(_KEYS + r"\W{0,8}$", before, re.I)) or len(s) in (32, 40, 64) and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s)))
    if kind == "email_spelled":
        return bool(re.search(r"[(\[]at[)\]]", s, re.I)) and bool(re.search(r"[(\[]dot[)\]]|\.", s, re.I))
    if kind == "ipv6":
        return s.count(":") == 7
    return bool(_GROUPED_ID.fullmatch(s)) or sum(c.isdigit() for c in s) >= 7 and bool(_ID_BEFORE.search(before))


@dataclass
class Booster:
    """Trees of `depth` levels on binned features, for the logistic loss."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score, width = np.full(len(y), self.start), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            which, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.zeros(n)
                at = node - first
                all_g, all_h = np.bincount(at, g, n), np.bincount(at, h, n)
                for f in range(x.shape[1]):
                    key = at * width + binned[:, f]
                    left_g, left_h = (np.bincount(key, w, n * width).reshape(n, width).cumsum(1)[:, : len(cuts[f])] for w in (g, h))
                    gain = left_g**2 / (left_h + 1) + (all_g[:, None] - left_g) ** 2 / (all_h[:, None] - left_h + 1) - (all_g**2 / (all_h + 1))[:, None]
                    if gain.shape[1]:
                        j = gain.argmax(1)
                        top = gain[np.arange(n), j]
                        better = top > best + 1e-9
                        best[better], which[first : first + n][better], cut[first : first + n][better] = top[better], f, cuts[f][j[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), which[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            score += value[leaf]
            self.trees.append((which, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


@dataclass(frozen=True)
class Model:
    booster: Booster
    thresholds: dict[str, float]  # of kinds that calibration could not place, weak_label decides

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """(base, all) of each text."""
        base, proposed, rows = [], [], []
        for text in texts:
            base.append(base_spans(text))
            covered = Covered(base[-1])
            proposed.append([c for c in candidates(text) if not covered(*c[1:]) and (c[0] in self.thresholds or weak_label(text, *c))])
            rows += [features(text, *c) for c in proposed[-1]]
        scores, out, at = self.booster.predict(np.array(rows)) if rows else np.empty(0), [], 0
        for text, own, more in zip(texts, base, proposed, strict=True):
            ranked = sorted(zip(scores[at : at + len(more)].tolist(), more, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2]))
            at += len(more)
            taken: list[tuple[str, int, int]] = []
            used = bytearray(len(text) if ranked else 0)
            for score, (kind, a, z) in ranked:  # what crosses a better candidate is left out
                if score >= self.thresholds.get(kind, 0.0) and used.find(1, a, z) < 0:
                    used[a:z] = b"\x01" * (z - a)
                    taken.append((kind, a, z))
            out.append((own, sorted(own + taken, key=lambda x: (KINDS.index(x[0]), x[1]))))
        return out


def calibrated(booster: Booster, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """The lowest threshold of each kind at which held-out candidates reach the precision, if any does."""
    found, p = {}, booster.predict(x) if len(x) else np.empty(0)
    for k, kind in enumerate(MORE_KINDS):
        mine = np.flatnonzero(x[:, 0] == k) if len(x) else []
        if len(mine) and y[mine].sum() >= LEAST_SELECTED:
            order = mine[np.argsort(-p[mine], kind="stable")]
            good = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
            last = np.flatnonzero((good >= precision) & (np.append(p[order][1:], -1) < p[order]))
            if len(last):
                found[kind] = float(p[order[last[-1]]])
    return found


def fit(documents: DataFrame, text: str = "text", key: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Trees and thresholds from the candidates of about sample_texts texts with a sign of each added kind, drawn by the hash of
    their text, so a rare kind is drawn from all the texts that may have it.

    Two of three sampled texts fit the trees, the third calibrates. The driver gets one row of numbers a candidate.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("draw"))
    n = rows.agg(*(F.count_if(F.col("text").rlike(sign)).alias(kind) for kind, sign in SIGNS.items())).first()
    drawn = [(F.col("draw") <= draw_limit(sample_texts, n[kind])) & F.col("text").rlike(sign) for kind, sign in SIGNS.items()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label, hold = [], [], []
            for value, draw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                covered = Covered(base_spans(value))
                open_ = [c for c in candidates(value) if not covered(*c[1:])]
                for c in open_[:: 1 + len(open_) // SAMPLE_PER_TEXT]:
                    x.append(features(value, *c))
                    label.append(weak_label(value, *c))
                    hold.append(draw % 3 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(label, pa.bool_()), pa.array(hold, pa.bool_())], ["x", "label", "hold"])

    found = rows.where(reduce(lambda a, b: a | b, drawn)).mapInArrow(describe, "x array<double>, label boolean, hold boolean").toPandas()
    if not found["label"].any() or found["label"].all():
        return Model(Booster(), {})
    order = sorted(range(len(found)), key=lambda i: list(found["x"][i]))  # the same trees whatever the order of rows
    x, y, hold = np.array([list(v) for v in found["x"]], float)[order], found["label"].to_numpy(float)[order], found["hold"].to_numpy(bool)[order]
    booster = Booster().fit(x[~hold], y[~hold]) if (~hold).any() else Booster()
    return Model(booster, calibrated(booster, x[hold], y[hold]) if booster.trees else {})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def found_in(text: Column, model: Model) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base_sha256, spans). The counts are those of the base."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out = []
            for base, every in model.spans([x if isinstance(x, str) else "" for x in series]):
                counts = Counter(k for k, _, _ in base)
                ranked = sorted(base, key=lambda x: (BASE_KINDS.index(x[0]), x[1]))
                out.append((*(counts[k] for k in BASE_KINDS), hashlib.sha256(joined(ranked).encode()).hexdigest(), joined(every)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find(text)


def detected(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    n_spans counts all spans, of the base and added. Offsets are code points, the end exclusive. Null and empty texts have none. Every row stays one row; columns with
    the names of the result are replaced.
    """
    f = spare_name(documents)
    found = documents.withColumn(f, found_in(F.col(text), model))
    return found.withColumns({c: F.col(f"{f}.{c}") for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}).withColumn("n_spans", F.when(F.col("spans") != "", F.size(F.split("spans", ","))).otherwise(0).cast("long")).drop(f)


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by [kind]; of overlapping spans the first takes the place."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for value, listed in zip(texts, lists, strict=True):
            if not isinstance(value, str) or not listed:
                out.append(value)
                continue
            parts, free = [], 0
            for kind, a, z in sorted(((k, int(a), int(z)) for k, a, z in (s.split(":") for s in listed.split(","))), key=lambda x: (x[1], -x[2])):
                if a >= free:
                    parts += [value[free:a], f"[{kind}]"]
                free = max(free, z)
            out.append("".join([*parts, value[free:]]))
        return pd.Series(out, dtype=object)

    return redact(text, spans)
