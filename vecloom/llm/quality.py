"""Quality by compression: two zstandard dictionaries, one built from good, one from bad text.

A text is compressed under both, whole, in frames of ``FRAME`` bytes so that the dictionary stays
in reach; the difference of the two sizes over their maximum is turned into a probability by a logistic
curve fitted on rows that the dictionaries have not seen. Label, language, source and id are no input.

The fit uses a bounded sample: at most ``SAMPLE`` labelled rows of each class, those with the least
hash of their id, outside the held-out fold, of at most ``LONGEST`` bytes each. Scoring reads every row.

Edge cases: null and empty texts score the curve at difference zero; with no labelled rows of one
class the score is the other's share; rows that repeat score alike; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, release, text_of

SAMPLE = 3000
LONGEST = 16_384  # bytes, so that a sample has 98 MB at most
DICT_BYTES = 112_640
FRAME = 4096
LEVEL = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int = LONGEST) -> list[tuple[int, bytes]]:
    """``(label, text)`` of at most ``per_class`` rows of each class outside the held-out fold.

    The sample is chosen among the labels alone; only its bounded id list is broadcast to the documents.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold_of() != 0)).select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"), F.xxhash64("doc_id").alias("_h"))
    picked = known.where("_y = 1").orderBy("_h", "_id").limit(per_class).union(known.where("_y = 0").orderBy("_h", "_id").limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.octet_length(text_of()) <= longest)
    got = rows.select("_h", "_id", "_y", text_of().cast("binary").alias("text")).collect()  # at most 2 x per_class rows
    return [(r[2], bytes(r[3])) for r in sorted(got, key=lambda r: (r[0], r[1], bytes(r[3])))]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def measure(self) -> DifferenceMeter:
        return DifferenceMeter(self.good, self.bad)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * difference, -30, 30)))


class DifferenceMeter:
    def __init__(self, good: bytes, bad: bytes):
        def make(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = make(good), make(bad)

    def __call__(self, text: bytes) -> float:
        g = b = 0
        for k in range(0, len(text), FRAME):
            part = text[k : k + FRAME]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / max(g, b, 1)


def _dictionary(texts: list[bytes]) -> bytes:
    size = min(DICT_BYTES, max(1024, sum(map(len, texts)) // 8))
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples: their plain content serves
        return b"\n".join(texts)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small ridge."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(sample: list[tuple[int, bytes]], shares: tuple[float, float]) -> CompressionModel:
    """Two thirds of the sample build the dictionaries, a third fits the curve, weighted to the true class shares."""
    fit = [x for k, x in enumerate(sample) if k % 3]
    rest = [x for k, x in enumerate(sample) if k % 3 == 0]
    good, bad = [t for y, t in fit if y == 1 and t], [t for y, t in fit if y == 0 and t]
    if not good or not bad or len({y for y, _ in rest}) < 2:
        p = shares[1] / sum(shares) if sum(shares) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return CompressionModel(b"", b"", 0.0, math.log(p / (1 - p)))
    model = CompressionModel(_dictionary(good), _dictionary(bad), 1.0, 0.0)
    meter = model.measure()
    x, y = np.array([meter(t) for _, t in rest]), np.array([float(y) for y, _ in rest])
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    weight = np.where(y == 1, shares[1] / n[1], shares[0] / n[0]) * len(y) / max(sum(shares), 1)
    model.slope, model.offset = _logistic(x, y, weight)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> CompressionModel:
    counts = dict(labels.where(fold_of() != 0).groupBy(label).count().where(F.col(label).isin(0, 1)).collect())
    return train(labelled_sample(docs, labels, label, per_class), (counts.get(0, 0), counts.get(1, 0)))


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        meter = m.measure()
        for b in batches:
            p = m.probability(np.array([meter(t) for t in b.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, in one pass."""
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        meter = m.measure()
        for b in batches:
            p = m.probability(np.array([meter((t or "").encode()) for t in b.column(at).to_pylist()], float))
            yield b.filter(pa.array(p >= threshold))
            release()

    return docs.mapInArrow(run, schema)
