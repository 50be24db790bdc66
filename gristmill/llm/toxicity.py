"""Toxicity by a string subsequence kernel and a linear support vector machine.

The units of a sentence are its words without anything but letters, and runs of
single letters joined to one (so that 'i.d.i.o.t' and 'i d i o t' are seen). A
unit is compared with landmarks, word beginnings that labelled sentences teach,
by the subsequence kernel: common subsequences of three characters, each gap
costing a factor; characters put between those of an insult only lower it. The
kernel counts as 0 unless the unit has all characters of the landmark, but for
one, in order. The Nyström map of the landmarks' kernel matrix turns the values
into vectors, on which a squared-hinge support vector machine is trained. As a
labelled text doesn't say which sentence is toxic, training picks the strongest
units of each toxic text and takes all units of the others as clean, in rounds.

A sentence is as strong as its strongest unit. A logistic curve over the values
of a text's three strongest distinct units gives its probability.

Defined results: texts without letters (null, empty) score as texts in which no
unit is near a landmark; rows with null or repeated doc_id are scored each for
itself; without toxic rows to learn from all score 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import labelled_texts, remainder

#: Labelled rows that are learnt from, at most, by label.
MAX_ROWS = {1: 1000, 0: 3000}
LANDMARKS = 32
#: Landmarks are sought until each toxic text has so many.
COVER = 4
LENGTH, DECAY = 3, 0.7
WIDEST = 48
MARK = ord("^")
LETTER = K.UPPER | K.LOWER | (K.BYTES >= 0x80)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of row i of s with row i of t, byte matrices filled up with zeros."""
    n, m = t.shape
    steps = np.arange(m)
    decay = np.triu(DECAY ** np.maximum(steps[None, :] - steps[:, None], 0)).astype(np.float64)
    inner = [np.ones((n, m + 1)), *(np.zeros((n, m + 1)) for _ in range(1, LENGTH))]
    out = np.zeros(n)
    for a in range(s.shape[1]):
        equal = (s[:, a : a + 1] == t) & (s[:, a : a + 1] != 0)
        if not equal.any():
            for i in range(1, LENGTH):
                inner[i] *= DECAY
            continue
        out += DECAY**2 * (equal * inner[-1][:, :-1]).sum(1)
        for i in range(LENGTH - 1, 0, -1):
            inner[i] *= DECAY
            inner[i][:, 1:] += (equal * (DECAY**2 * inner[i - 1][:, :-1])) @ decay
    return out


def _rows(units: list[bytes]) -> np.ndarray:
    out = np.zeros((len(units), max(map(len, units), default=1)), np.uint8)
    for i, u in enumerate(units):
        out[i, : len(u)] = np.frombuffer(u, np.uint8)
    return out


class Units:
    """The units of some texts: distinct ones as rows of bytes, and which unit and text each occurrence is of."""

    def __init__(self, t: K.Texts):
        keep = LETTER[t.data] | K.SPACE[t.data]
        kept = np.concatenate([[0], np.cumsum(keep)])
        plain = K.Texts(t.data[keep], kept[t.offsets], 0)
        starts, ends, firsts = plain.spans(LETTER)
        letters = np.concatenate([[0], np.cumsum(LETTER[plain.data])])
        solid = K.Texts(K.FOLD[plain.data[LETTER[plain.data]]], letters[plain.offsets], 0)
        a, b, of = letters[starts], letters[ends], K.owner(firsts)
        # runs of three single letters or more
        single = plain.count(K.LEAD, starts, ends) == 1
        new = np.ones(len(a), bool)
        new[1:] = ~(single[1:] & single[:-1] & (of[1:] == of[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        long = (last - first >= 2) if len(first) else np.zeros(0, bool)
        a = np.concatenate([a, a[first[long]]])
        b = np.concatenate([b, b[last[long]]])
        self.of = np.concatenate([of, of[first[long]]])
        hashes = solid.hashes(a, b)
        self.hashes, at, self.unit = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends, self.data = a[at], b[at], solid.data

    def __len__(self) -> int:
        return len(self.hashes)

    def pieces(self):
        """(unit, bytes) matrices by width, each row begun by a mark; units wider than the widest in overlapping pieces."""
        size = self.ends - self.starts
        lower = 0
        for width in (8, 16, 32, WIDEST):
            own = np.flatnonzero((size > lower) & (size <= width))
            lower = width
            if len(own):
                yield own, self._matrix(self.starts[own], size[own], width)
        wide = np.flatnonzero(size > WIDEST)
        if len(wide):
            counts = -(-(size[wide] - WIDEST) // (WIDEST // 2)) + 1
            own = np.repeat(wide, counts)
            step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = self.starts[own] + step * (WIDEST // 2)
            yield own, self._matrix(start, np.minimum(WIDEST, self.ends[own] - start), WIDEST)

    def _matrix(self, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(width)
        inside = at[None, :] < size[:, None]
        out = np.zeros((len(starts), width + 1), np.uint8)
        out[:, 0] = MARK
        out[:, 1:][inside] = self.data[(starts[:, None] + at[None, :])[inside]]
        return out


class Landmarks:
    def __init__(self, marks: list[bytes]):
        self.rows = _rows(marks)
        self.size = np.array([len(m) for m in marks])
        self.own = np.sqrt(subsequence_kernel(self.rows, self.rows))
        self.letters = np.array([np.bitwise_or.reduce(np.left_shift(K.U(1), np.frombuffer(m, np.uint8).astype(K.U) & K.U(63))) for m in marks], K.U)
        self.table = np.zeros((len(marks), 256), K.U)
        for i, m in enumerate(marks):
            for j, c in enumerate(m):
                self.table[i, c] |= K.U(1 << j)

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, landmark) pairs where the row has all of the landmark in order, but for one character."""
        letters = np.bitwise_or.reduce(np.left_shift(K.U(1), rows.astype(K.U) & K.U(63)) * (rows != 0), axis=1)
        out = []
        for i, size in enumerate(self.size):
            maybe = np.flatnonzero(np.bitwise_count(letters & self.letters[i]) >= np.bitwise_count(self.letters[i]) - 1)
            full = K.U((1 << int(size)) - 1)
            v = np.full(len(maybe), full, K.U)
            for column in rows[maybe].T:
                u = v & self.table[i][column]
                v = ((v + u) | (v - u)) & full
            maybe = maybe[size - np.bitwise_count(v) >= size - 1]
            out.append((maybe, np.full(len(maybe), i)))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def kernel(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows near some landmark, and their normalised kernel values."""
        row, mark = self.near(rows)
        some, at = np.unique(row, return_inverse=True)
        out = np.zeros((len(some), len(self.size)))
        if len(some):
            own = np.sqrt(subsequence_kernel(rows[some], rows[some]))
            out[at, mark] = subsequence_kernel(rows[row], self.rows[mark]) / np.maximum(own[at] * self.own[mark], 1e-12)
        return some, out


def choose_landmarks(words: list[set[str]], toxic: np.ndarray, most: int = LANDMARKS) -> list[bytes]:
    """Word beginnings (3 to 10 characters), each time that with the largest share of the toxic texts that have too few so far, less its share of clean texts."""
    begins = lambda own: {w[:n] for w in own for n in range(3, min(10, len(w)) + 1)}
    counts: Counter = Counter()
    for i in np.flatnonzero(toxic):
        counts.update(begins(words[i]))
    counts = Counter({x: n for x, n in counts.items() if n >= 2})
    clean: Counter = Counter()
    for i in np.flatnonzero(~toxic):
        clean.update(x for x in begins(words[i]) if x in counts)
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    strong = {x: set() for x, n in counts.items() if n / n_toxic > 4 * clean[x] / n_clean}
    for i in np.flatnonzero(toxic):
        for x in begins(words[i]):
            if x in strong:
                strong[x].add(i)
    out: list[str] = []
    need = Counter({i: COVER for i in np.flatnonzero(toxic)})
    while strong and len(out) < most:
        # of beginnings found in as many texts the longest, which says most
        best = max(strong, key=lambda x: (len(strong[x]) / n_toxic - 3 * clean[x] / n_clean, len(x), x))
        hit = strong[best]
        if len(hit) < 2 or len(hit) / n_toxic <= 3 * clean[best] / n_clean:
            break
        out.append(best)
        need.subtract(hit)
        strong = {x: {i for i in s if need[i] > 0} for x, s in strong.items() if not x.startswith(best) and not best.startswith(x)}
        strong = {x: s for x, s in strong.items() if s}
    return [b"^" + x.encode() for x in out]


class Model:
    def __init__(self, rows: list):
        toxic = np.array([r["label"] == 1 for r in rows], bool)
        self.marks = None
        if not toxic.any():
            return
        pieces = list(K.texts(pa.array([r["text"] for r in rows], pa.string())))
        units = [Units(t) for t in pieces]
        words: list[set[str]] = []
        for t, u in zip(pieces, units):
            names = [intern(u.data[a:b].tobytes().decode("utf-8", "ignore")) for a, b in zip(u.starts, u.ends)]
            own: list[set[str]] = [set() for _ in range(t.n)]
            for i, j in zip(u.of, u.unit):
                own[i].add(names[j])
            words += own
        marks = choose_landmarks(words, toxic)
        if not marks:
            return
        self.marks = Landmarks(marks)
        gram = np.stack([subsequence_kernel(self.marks.rows, np.repeat(self.marks.rows[i : i + 1], len(marks), 0)) for i in range(len(marks))], 1)
        gram /= self.marks.own[:, None] * self.marks.own[None, :]
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = values > 1e-6
        self.map = vectors[:, good] / np.sqrt(values[good])
        texts, vectors = [], []
        for t, u in zip(pieces, units):
            of, phi = self._occurrences(u)
            texts.append(of + t.first)
            vectors.append(phi)
        self._train(np.concatenate(texts), np.concatenate(vectors), toxic)

    def _occurrences(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        at, phi = self.vectors(u)
        place = np.full(len(u), -1)
        place[at] = np.arange(len(at))
        pairs = np.unique(np.stack([u.of, place[u.unit]], 1)[place[u.unit] >= 0], axis=0)
        return pairs[:, 0], phi[pairs[:, 1]]

    def vectors(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """Units near some landmark (the nearest piece of each) and their Nyström vectors."""
        at, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.marks.size)))]
        for own, rows in u.pieces():
            some, k = self.marks.kernel(rows)
            at.append(own[some])
            values.append(k)
        at, values = np.concatenate(at), np.concatenate(values)
        units, place = np.unique(at, return_inverse=True)
        most = np.zeros((len(units), values.shape[1]))
        np.maximum.at(most, place, values)
        return units, most @ self.map

    def _train(self, of: np.ndarray, phi: np.ndarray, toxic: np.ndarray) -> None:
        n, d = len(toxic), self.map.shape[1]
        phi = np.concatenate([phi, np.zeros((1, d))])
        strength = (phi[:-1] ** 2).sum(1)
        for _ in range(4):
            order = np.lexsort((-strength, of))
            rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            first = order[rank < 2]
            positive = first[toxic[of[first]]]
            negative = np.append(np.flatnonzero(~toxic[of]), len(phi) - 1)
            x = np.concatenate([phi[positive], phi[negative]])
            y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
            c = np.full(len(y), 1 / max(1, len(positive)))
            c[-1] = 0.2
            self.w, self.b = _squared_hinge(x, y, c)
            strength = phi[:-1] @ self.w + self.b
        self.curve = _logistic(self._strongest(n, of, strength), toxic)

    def _strongest(self, n: int, of: np.ndarray, strength: np.ndarray) -> np.ndarray:
        """The values of each text's three strongest units; the bias, which is that of any other unit, where there are fewer."""
        out = np.full((n, 3), self.b)
        order = np.lexsort((-strength, of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        top = order[rank < 3]
        out[of[top], rank[rank < 3]] = np.maximum(strength[top], self.b)
        return out

    def score(self, t: K.Texts) -> np.ndarray:
        if self.marks is None:
            return np.zeros(t.n)
        of, phi = self._occurrences(Units(t))
        top = self._strongest(t.n, of, phi @ self.w + self.b)
        return 1 / (1 + np.exp(-np.clip(top @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, reg: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps over the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        margin = y * (x @ w)
        act = margin < 1
        h = (x[act] * c[act, None]).T @ x[act] + reg * np.eye(x.shape[1])
        new = np.linalg.solve(h, (x[act] * c[act, None]).T @ y[act])
        if np.abs(new - w).max() < 1e-8:
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of a logistic curve, fitted to smoothed labels; a toxic text weighs as two others."""
    weight = np.where(y, 2.0, 1.0)
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, z.T @ (weight * (goal - p)) - 0.5 * w), -5, 5)
    return w


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0), *(model.value.score(t) for t in K.texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: dict[int, int] | None = None) -> Model:
    return Model(labelled_texts(docs, labels, label, max_rows or MAX_ROWS))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
