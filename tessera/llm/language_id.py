"""Language identification by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _bytecnn, _text

WINDOW = 256
#: Bound of the sample that the network is fitted on: so many texts of each language.
TEXTS_PER_LANGUAGE = 500
#: Bytes of each sampled text that reach the driver: windows are drawn from this many, at a random place.
TEXT_BYTES = 16384
#: Labels that are learned, by falling number of rows: the bound of the model and of the plan.
MOST_LABELS = 256
UNKNOWN = "und"


def sample(rows: DataFrame, label: str, per_class: int, text_bytes: int = TEXT_BYTES) -> list[tuple[bytes, object]]:
    """About ``per_class`` rows of (id, text, label) for each label, chosen by a hash of the id.

    A longer text gives ``text_bytes`` characters from a place that the hash chooses.  The MOST_LABELS labels with the
    most rows are learned.  At most 2 x per_class x labels rows reach the driver; everything that is scored is scored
    whole.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()}
    keep, part = F.lit(False), F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (part < -(-(per_class << 20) // n)))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - text_bytes + 1)) + 1
    piece = F.substring(F.col("text"), place.cast("int"), F.lit(text_bytes))
    chosen = rows.where(keep).select(F.xxhash64("id").alias("h"), label, piece.alias("piece"))
    got = chosen.orderBy("h", label, "piece").limit(2 * per_class * len(counts)).collect() if counts else []
    return [(r["piece"].encode(), r[label]) for r in got if r["piece"]]


def fit(rows: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> _bytecnn.Network | None:
    """Train on (id, text, lang) rows; None where no language is known."""
    texts = sample(rows, "lang", per_language)
    net = _bytecnn.train([t for t, _ in texts], [y for _, y in texts], WINDOW) if texts else None
    del texts
    _text.trim()
    return net


def _predict(net: _bytecnn.Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            raw, offsets = _text.utf8(batch.column(1))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi in _text.chunks(offsets) if net else ():
                windows, row = _bytecnn.cut(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WINDOW, _bytecnn.REACH)
                weight = (windows != 0).sum(axis=1)
                prob = _bytecnn.softmax(_bytecnn.logits(net, tables, windows).astype(np.float64)) * weight[:, None]
                total = np.stack([np.bincount(row, prob[:, k], hi - lo) for k in range(prob.shape[1])], axis=1)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
                best[lo:hi], score[lo:hi] = total.argmax(axis=1), total.max(axis=1)
            known = np.array(batch.column(2).to_numpy(zero_copy_only=False), bool) & bool(net)
            names = [net.classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)] if net else [UNKNOWN] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(np.where(known, np.clip(score, 0, 1), 0.0), 6))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: _bytecnn.Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1), one row per input row.

    Windows of WINDOW bytes cover the whole text; their probabilities are averaged by their bytes.  A null
    text, one without any letter, or a network of no language gives ``und`` and 0.  Scores have six places;
    repeated rows get equal results.  Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(_text.lean(_predict(net)), "doc_id long, lang_pred string, score double")
