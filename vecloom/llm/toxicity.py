"""Toxicity by a factorization machine over hashed terms.

Every distinct lower-cased word of the whole text, and every distinct stem (its first ``STEMS``
letters, so that inflected and compound forms share a term), is hashed to one of ``SLOTS`` slots. The score is the
logistic of ``bias + sum w_i + sum_{i<j} <v_i, v_j>``: the pairwise part, computed in linear time as
half of (sum v)^2 - sum v^2, catches pairs such as an insult with a group name that neither linear weight
would. Label, language, source and id are no input.

The fit uses a bounded sample: at most ``SAMPLE`` labelled rows of each class (least hash of the id)
outside the held-out fold; the positive class is weighted to ``lift`` of the loss. Terms seen in fewer than
``LEAST`` sample rows carry no weight. Scoring reads every row.

Edge cases: null and empty texts score the bias; without labelled rows of both classes the bias alone
is fitted; rows that repeat score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of
from .quality import labelled_sample

SLOTS = 1 << 18
FACTORS = 8
SAMPLE = 4000
LEAST = 8
STEMS = (4, 5)
_TERM = re.compile(r"[^\W\d_]+")


def slots_of(text: str, slots: int = SLOTS) -> list[int]:
    """The hashed slots of the distinct words and stems of a text."""
    h = xxhash.xxh32_intdigest
    words = set(_TERM.findall(text.lower()))
    out = [h(w) % slots for w in words]
    for n in STEMS:
        out += [h(s, n) % slots for s in {w[:n] for w in words if len(w) > n}]
    return out


@dataclass
class FactorMachine:
    bias: float
    place: np.ndarray  # slot -> row of the weights, 0 for none
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        flat = self.place[np.fromiter((i for r in rows for i in r), np.int64, at[-1])]
        keep = flat > 0
        doc = np.repeat(np.arange(len(rows)), np.diff(at))[keep]
        return self.bias + self._sums(flat[keep], doc, len(rows))[0]

    def _sums(self, flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[flat]
        s = np.stack([np.bincount(doc, v[:, k], n) for k in range(v.shape[1])], axis=1)
        q = np.bincount(doc, (v * v).sum(axis=1), n)
        return np.bincount(doc, self.w[flat], n) + 0.5 * ((s * s).sum(axis=1) - q), s


def train(sample: list[tuple[int, str]], shares: tuple[float, float], epochs: int = 12, rate: float = 0.5, ridge: float = 1e-3, least: int = LEAST, lift: float = 0.3) -> FactorMachine:
    """Adagrad on the log loss, in mini-batches of a fixed order."""
    y = np.array([float(a) for a, _ in sample])
    rows = [sorted(set(slots_of(t))) for _, t in sample]
    p = min(max(shares[1] / sum(shares) if sum(shares) else 0.5, 1e-3), 1 - 1e-3)
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    seen = np.bincount(flat, minlength=SLOTS)
    used = np.flatnonzero(seen >= least) if len(set(y.tolist())) == 2 else np.zeros(0, np.int64)
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    rng = np.random.default_rng(5)
    m = FactorMachine(math.log(p / (1 - p)), place, np.zeros(len(used) + 1), rng.normal(0, 0.01, (len(used) + 1, FACTORS)))
    m.v[0] = 0
    if not len(used):
        return m
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.where(y == 1, lift / n[1], (1 - lift) / n[0]) * len(y)
    lists = [place[np.array(r, np.int64)] for r in rows]
    lists = [x[x > 0] for x in lists]
    gw, gv, gb = np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            at = np.concatenate([lists[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(lists[i]) for i in part])
            f, s = m._sums(at, doc, len(part))
            miss = weight[part] * (1 / (1 + np.exp(-np.clip(m.bias + f, -30, 30))) - y[part]) / len(part)
            terms, back = np.unique(at, return_inverse=True)
            e = miss[doc]
            dw = np.bincount(back, e, len(terms)) + ridge * m.w[terms]
            v = m.v[at]
            dv = np.stack([np.bincount(back, e * (s[doc, j] - v[:, j]), len(terms)) for j in range(FACTORS)], axis=1) + ridge * m.v[terms]
            gw[terms] += dw * dw
            gv[terms] += dv * dv
            m.w[terms] -= rate * dw / np.sqrt(gw[terms])
            m.v[terms] -= 0.3 * rate * dv / np.sqrt(gv[terms])
            db = miss.sum()
            gb += db * db
            m.bias -= rate * db / math.sqrt(gb)
    return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> FactorMachine:
    counts = dict(labels.where(fold_of() != 0).groupBy(label).count().where(F.col(label).isin(0, 1)).collect())
    sample = [(y, t.decode()) for y, t in labelled_sample(docs, labels, label, per_class)]
    return train(sample, (counts.get(0, 0), counts.get(1, 0)))


def score_toxicity(docs: DataFrame, model: FactorMachine, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SLOTS rows of FACTORS + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [m.logits([slots_of(t) for t in texts[k : k + 256]]) for k in range(0, len(texts), 256)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
