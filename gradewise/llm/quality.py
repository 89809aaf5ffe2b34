"""Quality classifier: naive Bayes support vectors.

Indicators of hashed character n-grams are scaled by their log-count ratio between the classes; a linear hinge-loss
model over them is fitted by dual coordinate descent; a logistic curve through held-back margins gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.ngrams import bucket_counts
from gradewise.llm.sampling import bounded_sample

DIM, SIZES = 16_384, (1, 2, 3, 4)
#: Bound of the training sample: rows of each of the two labels.
PER_LABEL = 2500
COST, EPOCHS, SMOOTH = 0.1, 30, 1.0
#: Every such row of the sample is held back to fit the score's curve.
HELD_BACK = 4
ACCEPT = 0.7


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # log-count ratio times the linear model's weight
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        x = indicators(text)
        margin = float(self.weights[x].sum() / np.sqrt(max(1, len(x)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def indicators(text: str | None) -> np.ndarray:
    """The buckets that the text's n-grams hit, ascending."""
    return np.flatnonzero(bucket_counts(text or "", SIZES, DIM))


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [indicators(t).astype("<u2").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "label", "hits"])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + sum cost * hinge, by coordinate steps on the dual."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[dim]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[dim] += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of ``y`` (0 or 1) on ``margin``; a little weight pulls it to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(p - y) @ margin + 0.05 * (a - 1), (p - y).sum() + 0.05 * b])
        v = p * (1 - p)
        h = np.array([[v @ margin**2 + 0.05, v @ margin], [v @ margin, v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> QualityModel:
    """Learn from the texts that ``labels`` marks 0 or 1 (others and nulls are left out).

    At most ``per_label`` rows of each label, chosen by hash of the id, are read whole; the buckets that they hit (two
    bytes each) are what reaches the driver. Ids that repeat are taken once a label row and all their texts are read; other
    columns are not read; empty tables are tables without labels. Without both labels the model scores every text with the share of ones.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = bounded_sample(marked, "label", per_label)
    rows = texts.join(F.broadcast(picked), "id").select("id", "label", "text").mapInArrow(_hits, "id long, label int, hits binary").collect()
    rows = sorted((r["id"], r["label"], bytes(r["hits"])) for r in rows)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return QualityModel(np.zeros(DIM), 0.0, 1.0, float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))))
    hits = [np.frombuffer(r[2], dtype="<u2") for r in rows]  # two bytes a hit, as they came
    ones, zeros = np.full(DIM, SMOOTH), np.full(DIM, SMOOTH)
    for h, k in zip(hits, y, strict=True):
        (ones if k == 1 else zeros)[h] += 1
    ratio = np.log((ones / ones.sum()) / (zeros / zeros.sum()))
    held = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), dtype=bool)
    learn = np.flatnonzero(~held)
    values = [(ratio[h] / np.sqrt(max(1, len(h)))).astype(np.float32) for h in hits]
    # classes count alike, however many rows each has
    share = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * len(learn)
    w = dual_coordinate_descent([hits[i] for i in learn], [values[i] for i in learn], 2 * y[learn] - 1, 10 * COST * share[learn], DIM)
    weights, bias = ratio * w[:DIM], float(w[DIM])
    check = np.flatnonzero(held) if held.any() else learn
    margin = np.array([weights[hits[i]].sum() / np.sqrt(max(1, len(hits[i]))) + bias for i in check])
    slope, shift = _curve(margin, y[check])
    # the sample holds the labels in other shares than the corpus does; the score goes by the corpus
    total = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shift += float(np.log(total[1] / total[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return QualityModel(weights, bias, slope, shift)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row: ``predicted`` is 1 from a score of 0.7 on.

    Whole texts are looked at; a null text counts as empty and is scored too. Repeated rows each give a row; ids may be
    null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "id long, score double").withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model scores at 0.7 or more, unchanged; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) >= ACCEPT for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
