"""Language identification by nearest centroid over TF-IDF character n-grams, with rejection by distance.

Texts become hashed n-gram counts, weighted by log term frequency and inverse document frequency and scaled to unit
length. Each language has several centroids, found by spherical k-means over its training vectors. A text gets the
language of the centroid with the largest cosine; it is rejected where its distance (1 - cosine) is beyond what nearly
all training texts show, plus a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.ngrams import bucket_counts
from gradewise.llm.sampling import bounded_sample

UNKNOWN = "und"
DIM, SIZES, CENTROIDS = 4096, (1, 2, 3), 4
#: Bounds of the training sample: rows of a language, fewer where that would make more rows than the second in all, but
#: never fewer than the third.
PER_LANGUAGE, ROWS, FEWEST = 600, 4000, 50
#: A text is rejected beyond the distance that this share of training texts keeps, times ``SLACK``.
KEPT_SHARE, SLACK = 0.995, 1.25


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Words in lower case; what is no letter only parts them."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # language of each centroid
    farthest: float

    def vector(self, text: str) -> np.ndarray:
        counts = bucket_counts(letters(text), SIZES, DIM)
        x = np.log1p(counts).astype(np.float64) * self.idf
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid (0 to 1), whether it is rejected."""
        if text is None or not len(self.centroids) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(text)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.owner[best]], score, 1 - score > self.farthest


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [bucket_counts(letters(t or ""), SIZES, DIM).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "counts"])


def spherical_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``k`` unit centroids at most of the unit rows of ``x``; starts are spread by farthest-first choice."""
    rng = np.random.RandomState(seed)
    k = min(k, len(x))
    centers = [x[rng.randint(len(x))]]
    while len(centers) < k:
        near = np.max(x @ np.array(centers).T, axis=1)
        centers.append(x[int(near.argmin())])
    c = np.array(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from text and language of ``rows`` (null languages and null texts are left out).

    At most ``per_language`` texts of each language, chosen by hash of the id, are read whole for this; their n-gram
    counts (16 kB each) are what reaches the driver, so it grows with the languages, not with the rows. Every language
    can be predicted. Rows that repeat an id are all read; other columns are not. No usable rows, as in an empty table,
    give a model that answers ``und``.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.where("text is not null and lang is not null")
    seen = max(1, named.select(F.approx_count_distinct("lang")).first()[0])
    picked = bounded_sample(named, "lang", min(per_language, max(FEWEST, ROWS // seen)))
    texts = named.select("id", "text").join(F.broadcast(picked), "id").select("lang", "text")
    got = sorted((r["lang"], bytes(r["counts"])) for r in texts.mapInArrow(_counts, "lang string, counts binary").collect())
    if not got:
        return LanguageModel([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, dtype=np.int64), 1.0)
    # one matrix of 32-bit floats, worked on in place: the sample is the most that the driver holds
    names = np.array([lang for lang, _ in got])
    x, seen_in = np.empty((len(got), DIM), dtype=np.float32), np.zeros(DIM)
    for i, (_, b) in enumerate(got):
        counts = np.frombuffer(b, dtype="<u4")
        seen_in += counts > 0
        x[i] = np.log1p(counts)
    idf = np.log((1 + len(got)) / (1 + seen_in)) + 1
    del got
    for row in x:
        row *= idf
        row /= max(float(np.sqrt(row @ row)), 1e-12)
    languages = sorted(set(names.tolist()))
    parts = [spherical_means(x[names == lang], CENTROIDS, 7 + k) for k, lang in enumerate(languages)]
    owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
    centroids = np.concatenate(parts).astype(np.float64)
    distance = np.sort(1 - (x @ centroids.T).max(axis=1))
    farthest = float(min(1.0, distance[min(len(distance) - 1, int(KEPT_SHARE * len(distance)))] * SLACK))
    return LanguageModel(languages, idf, centroids, owner, farthest)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"]
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, rejected`` for every row; only the text is looked at, whole.

    A null text, and one without a letter, gives ``und``, 0 and rejected. Repeated rows each give a row; ids may be
    null; an empty table gives no rows. The model (a few hundred kB a language) goes out as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predictor(shared), "id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
