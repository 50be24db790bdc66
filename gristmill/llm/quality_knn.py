"""A quality classifier: nearest neighbours among labelled latent-semantic vectors.

A text becomes counts of hashed character pairs, of word shapes and of repeated
words, log-scaled and weighted by inverse document frequency, then projected on
the main directions of a labelled sample (latent semantic analysis). The labelled
vectors, at most `MAX_PER_CLASS` for each label, are broadcast; every document's
cosines to all of them are computed exactly, in blocks, and the `NEIGHBOURS`
nearest vote with their similarity as weight.

Defined results: texts without a word (null, empty, white space alone) have no
vector, hence no neighbours, and score the share of label 1 among the labelled
rows, as does a text that no neighbour is similar to; of neighbours that are
equally near the first by the hash order of the sample count; rows with null or
repeated doc_id are scored each for itself; with no labelled rows all score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import labelled_texts, remainder

MAX_PER_CLASS = 2048
NEIGHBOURS = 15
DIMENSIONS = 48
PAIRS, SHAPES = 1024, 64
FEATURES = PAIRS + SHAPES + 8
#: Weight of word shapes against character pairs.
SHAPE_WEIGHT = 2.0
_PAIR = (K.mix(np.arange(1 << 16, dtype=K.U) + K.U(5)) % K.U(PAIRS)).astype(np.int64)
_CLASS = np.select([K.LOWER, K.UPPER, K.DIGIT, K.BYTES >= 0x80], [1, 2, 4, 8], 16) * (K.BYTES > 0)


def features(t: K.Texts) -> np.ndarray:
    """Log-scaled counts, each group of unit length."""
    out = np.zeros((t.n, FEATURES), np.float32)
    of_byte = K.owner(t.offsets)
    if len(t.data) > 1:
        pair = _PAIR[t.data[:-1].astype(np.int64) * 256 + t.data[1:]]
        inside = of_byte[:-1] == of_byte[1:]
        out[:, :PAIRS] = np.bincount((of_byte[:-1] * PAIRS + pair)[inside], minlength=t.n * PAIRS).reshape(t.n, PAIRS)
    starts, ends, firsts = t.spans(K.NOT_SPACE)
    if len(starts):
        of = K.owner(firsts)
        has = np.zeros(len(starts), np.int64)
        for bit in (1, 2, 4, 8, 16):
            has += bit * (t.count(_CLASS == bit, starts, ends) > 0)
        single = (ends - starts) == 1
        shape = np.where(single, 32 + has, has)
        out[:, PAIRS : PAIRS + SHAPES] = np.bincount(of * SHAPES + np.minimum(shape, SHAPES - 1), minlength=t.n * SHAPES).reshape(t.n, SHAPES)
        words = t.hashes(starts, ends)
        for back in (1, 2, 3, 4):
            same = np.zeros(len(words), bool)
            same[back:] = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
            out[:, PAIRS + SHAPES + back - 1] = 8 * np.bincount(of[same], minlength=t.n)
    np.log1p(out, out=out)
    for part, weight in ((slice(0, PAIRS), 1.0), (slice(PAIRS, FEATURES), SHAPE_WEIGHT)):
        out[:, part] *= weight / np.maximum(np.linalg.norm(out[:, part], axis=1, keepdims=True), 1e-9)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    def __init__(self, rows: list):
        self.prior = float(np.mean([r["label"] for r in rows])) if rows else 0.5
        self.empty = not rows
        if self.empty:
            return
        counts = np.concatenate([features(t) for t in K.texts(pa.array([r["text"] for r in rows], pa.string()))])
        self.idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        _, vectors = np.linalg.eigh((counts * self.idf).T.astype(np.float64) @ (counts * self.idf))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
        self.vectors = _unit((counts * self.idf) @ self.basis).T.copy()
        self.labels = np.array([r["label"] for r in rows], np.float32)

    def score(self, t: K.Texts, block: int = 256) -> np.ndarray:
        if self.empty:
            return np.full(t.n, self.prior)
        out = np.empty(t.n)
        own = _unit((features(t) * self.idf) @ self.basis)
        k = min(NEIGHBOURS, len(self.labels))
        worded = np.diff(t.spans(K.NOT_SPACE)[2]) > 0
        for lo in range(0, t.n, block):
            cosines = own[lo : lo + block] @ self.vectors
            near = np.argpartition(cosines, -k, axis=1)[:, -k:]
            least = np.take_along_axis(cosines, near, 1).min(1)
            # where others are as near as the last of these, the first of them in the sample's order count
            for i in np.flatnonzero((cosines >= least[:, None]).sum(1) > k):
                above, equal = np.flatnonzero(cosines[i] > least[i]), np.flatnonzero(cosines[i] == least[i])
                near[i] = np.concatenate([above, equal[: k - len(above)]])
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 8
            weight[~worded[lo : lo + block]] = 0
            total = weight.sum(1, dtype=float)
            out[lo : lo + block] = np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0), *(model.value.score(t) for t in K.texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores).astype(float))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_per_class: int = MAX_PER_CLASS) -> Model:
    return Model(labelled_texts(docs, labels, label, {0: max_per_class, 1: max_per_class}))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
