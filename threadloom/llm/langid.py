"""Language identification as mixture inference.

Each language has a distribution over hashed byte trigrams. Expectation-maximisation estimates a text's proportions of
the languages from its trigrams' likelihoods; among the leading one, two, three ... up to all languages the set with the best
penalised likelihood (BIC) is selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import draw_limit, spare_name

BUCKETS = 4096
#: Labelled texts of each language that the distributions are fitted on: the expected size of a sample by hash.
SAMPLE_PER_LANGUAGE = 4000
SMOOTHING = 0.05
#: Expectation-maximisation ends where no proportion moves by more than this.
TOLERANCE = 1e-3
#: Trigrams overlap, so a text of n of them has about n / 3 independent ones.
EFFECTIVE = 1 / 3
UNDETERMINED = "und"
_SLICE = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigram_counts(text: bytes) -> np.ndarray:
    """How often the text has each hashed trigram; letters are folded, other ASCII is a space. Long texts go in slices."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _SLICE):
        b = _FOLD[np.frombuffer(text[at : at + _SLICE + 2], np.uint8)].astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # languages x BUCKETS

    def mixtures(self, counts: np.ndarray) -> np.ndarray:
        """texts x languages: proportions over the selected set; a row of zeros for a text without trigrams."""
        p, n, found = self.likelihood, counts.sum(1, keepdims=True), len(self.languages)

        def fitted(pi: np.ndarray) -> np.ndarray:
            pi, moving = pi.copy(), np.flatnonzero(n[:, 0] > 0)
            while len(moving):
                c, was = counts[moving], pi[moving]
                now = was * ((c / (was @ p + np.float32(1e-30))) @ p.T) / n[moving]
                now /= np.maximum(now.sum(1, keepdims=True), np.float32(1e-30))
                pi[moving] = now
                moving = moving[np.abs(now - was).max(1) > TOLERANCE]
            return pi

        full = fitted(np.full((len(counts), found), 1 / found, np.float32))
        order, rank = np.argsort(-full, axis=1, kind="stable"), None
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(found)[None, :].repeat(len(counts), 0), 1)
        best, best_cost = np.zeros_like(full), np.full(len(counts), np.inf)
        for k in range(1, found + 1):
            pi = np.where(rank < k, np.maximum(full, np.float32(1e-3)), np.float32(0))
            pi /= pi.sum(1, keepdims=True)
            pi = fitted(pi) if k > 1 else pi
            fit = (counts * np.log(pi @ p + np.float32(1e-30))).sum(1)
            cost = -2 * EFFECTIVE * fit + (k - 1) * np.log(np.maximum(n[:, 0] * EFFECTIVE, 2))
            better = cost < best_cost
            best[better], best_cost[better] = pi[better], cost[better]
        return np.where(n > 0, best, 0)


def labelled(documents: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """The rows that may be learnt from."""
    return documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1))


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of all languages that labelled rows show, from about sample_per_language whole texts of each.

    Rows are drawn by the hash of their key and text, so the sample is the same on every run. Null labels, texts and keys
    are left out. What reaches the driver is one count for each language and bucket; languages are few, as labels are.
    """
    rows = labelled(documents, text, lang, key).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(key, text), 1).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), np.zeros((0, BUCKETS), np.float32))
    limits = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, draw_limit(sample_per_language, n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))[:] += trigram_counts(value.as_buffer().to_pybytes())
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.where(F.col("draw") <= limits[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sizes))
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(table, ([languages.index(x) for x in counts["lang"]], counts["bucket"].to_numpy(np.int64)), counts["n"].to_numpy(float))
    return Model(languages, (table / table.sum(1, keepdims=True)).astype(np.float32))


def predicted(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, mixture): mixture is "en:0.81 fr:0.19", for the selected set."""

    @F.pandas_udf("lang_pred string, score double, mixture string")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            names, scores, shown = [], [], []
            for at in range(0, len(series), 128):
                part = [x.encode() if isinstance(x, str) else b"" for x in series.iloc[at : at + 128]]
                pi = model.mixtures(np.stack([trigram_counts(x) for x in part]).astype(np.float32)) if model.languages else np.zeros((len(part), 1))
                top = pi.argmax(1)
                for i, j in enumerate(top):
                    names.append(model.languages[j] if model.languages else UNDETERMINED)
                    scores.append(float(min(1.0, pi[i, j])))
                    shown.append(" ".join(f"{model.languages[k]}:{pi[i, k]:.2f}" for k in np.argsort(-pi[i], kind="stable") if pi[i, k] >= 0.005) if model.languages else "")
            yield pd.DataFrame({"lang_pred": names, "score": scores, "mixture": shown})

    return predict(text)


def identified(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with lang_pred, score, mixture. Only the text decides.

    Null texts and texts without a letter are "und" with score 0 and an empty mixture; a text too short for one trigram
    gets the first language by name with score 0. With no learnt language all is "und". Every row stays one row, equal
    texts get equal answers, and columns with the names of the result are replaced.
    """
    p = spare_name(documents)
    found = documents.withColumn(p, predicted(F.col(text), model))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({
        "lang_pred": F.when(lettered, F.col(f"{p}.lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(lettered, F.col(f"{p}.score")).otherwise(F.lit(0.0)),
        "mixture": F.when(lettered, F.col(f"{p}.mixture")).otherwise(""),
    }).drop(p)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
