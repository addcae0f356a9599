"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and the code point. A trigram is the product of its letters' vectors, the first
permuted (rolled) twice and the second once. A text is the sum of its trigrams' vectors, weighted by the root of their counts and scaled to
length one; a language's prototype is the mean of its texts. The mean of all prototypes is taken off both sides, so that what the languages
have in common does not count, and the language with the largest cosine wins.

Prototypes are sums by language and coordinate: tasks add up their own texts first, so the shuffle has DIMS values per task and language, and
the driver gets DIMS values per language (at most MAX_LANGUAGES languages).

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows without a language teach nothing. With no labelled row at all
every text is ``und``. Ties go to the language first in order. Further columns are left out by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import fold, slices, table, texts, tidy

DIMS = 512
SEED = 20
CACHED = 30_000
SHARPNESS = 12.0
MAX_LANGUAGES = 2000
UNKNOWN = "und"


class Encoder:
    """Texts to unit vectors. Trigram vectors met first are kept, up to CACHED; later ones are made again each time, with the same result."""

    def __init__(self):
        letters = np.zeros(sys.maxunicode + 1, np.bool_)
        letters[[c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]] = True
        self.is_letter = letters
        self.letters: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.rows = np.empty((CACHED, DIMS), np.float32)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMS).astype(np.float32) * 2 - 1
        return v

    def trigram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        known = self.is_letter[codes]
        if not known.any():
            return np.empty(0, np.int64), np.empty(0)
        codes = np.concatenate([[32], np.where(known, codes, 32), [32]])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        keys, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        return keys, counts

    def vector(self, text: str | None) -> np.ndarray | None:
        keys, counts = self.trigrams(text)
        if not len(keys):
            return None
        at = np.empty(len(keys), np.int64)
        rest = []
        for i, key in enumerate(keys.tolist()):
            row = self.at.get(key)
            if row is None:
                if len(self.at) < CACHED:
                    row = self.at[key] = len(self.at)
                    self.rows[row] = self.trigram(key)
                else:
                    row = -1
                    rest.append(i)
            at[i] = row
        weight = np.sqrt(counts).astype(np.float32)
        near = at >= 0
        out = weight[near] @ self.rows[at[near]]
        for i in rest:
            out = out + weight[i] * self.trigram(int(keys[i]))
        return out / max(float(np.linalg.norm(out)), 1e-9)


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def forget() -> None:
    _encoder.clear()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, sums = encoder(), {}
    for batch in slices(batches, "text"):
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist()):
            v = enc.vector(text)
            if v is not None:
                total = sums.setdefault(lang, np.zeros(DIMS + 1))
                total[:-1] += v
                total[-1] += 1
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], ["lang", "dim", "value"])


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their centred unit prototypes; the last row is the common mean."""
    sums = labelled.where("lang IS NOT NULL").select("text", "lang").mapInArrow(tidy(_sums, forget), "lang string, dim long, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = sums.limit(MAX_LANGUAGES * (DIMS + 1) + 1).toPandas()
    if len(rows) > MAX_LANGUAGES * (DIMS + 1):
        raise ValueError(f"More than {MAX_LANGUAGES} languages.")
    if rows.empty:
        return [], np.zeros((1, DIMS))
    grid = rows.pivot(index="lang", columns="dim", values="value").sort_index()
    means = grid.to_numpy()[:, :-1] / grid.to_numpy()[:, -1:]
    common = means.mean(0) if len(means) > 1 else np.zeros(DIMS)
    centred = means - common
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    return list(grid.index), np.vstack([centred, common])


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (langs, profile) = encoder(), shared.value
        for batch in slices(batches, "text"):
            pred, score = [], []
            for text in texts(batch):
                v = enc.vector(text) if langs else None
                if v is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                v = v - profile[-1]
                cosine = profile[:-1] @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cosine))
                pred.append(langs[k])
                score.append(float(1 / np.exp(SHARPNESS * (cosine - cosine[k])).sum()))
            columns = [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def _predicted(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The columns of ``docs`` after the first, which is the text, and the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes(labelled))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return docs.mapInArrow(tidy(_predictor(shared), forget), f"{columns}, lang_pred string, score double")


def predict(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default doc_id), lang_pred, score."""
    return _predicted(docs.select("text", *(keep or ["doc_id"])), labelled)


def keep_known(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``."""
    names = docs.columns
    at = names.index("text")
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    df = _predicted(inner.select(F.col(f"c{at}").alias("text"), *inner.columns), labelled)
    return df.where(F.col("lang_pred") != UNKNOWN).select(*inner.columns).toDF(*names)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    part = fold(docs, 4)
    return predict(docs.withColumn("held_out", part == 2), docs.where(part != 2), ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return keep_known(docs, docs)
