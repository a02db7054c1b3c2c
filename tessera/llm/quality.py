"""Quality classification by a byte convolutional network over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _bytecnn, _text
from tessera.llm.language_id import sample

CHUNK = 512
OVERLAP = 32
#: Bound of the sample that the model is fitted on: so many texts of each label.
TEXTS_PER_LABEL = 1200


@dataclass
class Model:
    """The network and the logistic combination of a document's chunks (mean, least, largest, 1)."""

    net: _bytecnn.Network
    weights: np.ndarray


def _features(net: _bytecnn.Network, tables: list, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    windows, row = _bytecnn.cut(raw, offsets, CHUNK, OVERLAP)
    z = _bytecnn.logits(net, tables, windows).astype(np.float64)
    margin, n = np.clip(z[:, -1] - z[:, 0], -30, 30), len(offsets) - 1
    count = np.bincount(row, minlength=n)
    least, most = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(least, row, margin)
    np.maximum.at(most, row, margin)
    mean = np.bincount(row, margin, n) / np.maximum(count, 1)
    return np.where((count > 0)[:, None], np.stack([mean, least, most, np.ones(n)], axis=1), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for ridge-penalised logistic regression, classes weighted equally."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def fit(rows: DataFrame, per_label: int = TEXTS_PER_LABEL) -> Model | None:
    """Train on (id, text, quality) rows with quality 0 or 1; None without both labels."""
    texts = sample(rows.where("quality in (0, 1)"), "quality", per_label)
    labels = [int(y) for _, y in texts]
    if len(set(labels)) < 2:
        return None
    net = _bytecnn.train([t for t, _ in texts], labels, CHUNK, steps=900, batch=48)
    tables = net.tables()
    raw, offsets = _text.utf8(pa.array([t for t, _ in texts], pa.binary()))
    x = np.concatenate([_features(net, tables, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.chunks(offsets)])
    model = Model(net, _logistic(x, np.array(labels, float)))
    del texts, raw, offsets, x
    _text.trim()
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.net.tables() if model else []
        for batch in batches:
            raw, offsets = _text.utf8(batch.column(1))
            score = np.full(batch.num_rows, 0.5)
            for lo, hi in _text.chunks(offsets) if model else ():
                x = _features(model.net, tables, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(x @ model.weights, -40, 40)))
            score[np.diff(offsets) == 0] = 0.0
            score = np.round(score, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (1 if score >= 0.5), one row per input row.

    Overlapping chunks cover the whole text.  Null and empty texts score 0; without a model all others score
    0.5.  Scores have six places; repeated rows get equal results.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_text.lean(_score(model)), "doc_id long, score double, predicted int")


def _keep(model: Model | None, text_at: int):
    grade = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            for scored in grade(iter([pa.RecordBatch.from_arrays([ids, batch.column(text_at)], names=["doc_id", "text"])])):
                yield batch.filter(pa.array(scored.column(2).to_numpy() == 1))

    return run


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that ``score`` predicts as 1, with all their columns, in one pass and without a join.

    Null and empty texts go, as they score 0; without a model all others stay.  Ids and other columns, of any name,
    are of no concern; repeated rows go or stay together; an empty table gives an empty one.
    """
    at = docs.columns.index(text_col)
    return docs.mapInArrow(_text.lean(_keep(model, at)), docs.schema)
