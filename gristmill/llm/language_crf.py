"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label. Features of a word are its affixes, character
pairs and triples (with marks for both ends) and the word itself as a lexicon
entry, all hashed into one table of weights; learnt transitions join neighbouring
words. Training splices stretches of texts of known language into code-switched
chains, whose word labels are known, and follows the gradient of the likelihood.

The forward-backward algorithm gives each word's label probabilities over the
whole text, exactly: all texts of a piece form one chain, cut at text starts by
transitions that forget, and evaluated in blocks. A text's language is the label
with the largest mean probability over its words; the mean is the score.

`label_words` gives the labels themselves, as spans of neighbouring words of one
label: the switches of code-switched text.

At most `MAX_LANGUAGES` languages are learnt; more raise. The words trained on grow
with their number.

Defined results: `und` with score 0 for texts that are null or have no letter;
rows with null or repeated doc_id are labelled each for itself; rows with a null
lang aren't learnt from; with nothing to learn from all texts are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import remainder

#: Rows that are learnt from: about so many for each language, and in all.
ROWS_PER_LANGUAGE, MAX_ROWS = 300, 6000
#: Words of the spliced chains, at least and for each language.
TRAIN_WORDS, WORDS_PER_LANGUAGE = 60_000, 2_000
MAX_LANGUAGES = 500
BUCKETS = 1 << 15
ROUNDS = 30
BLOCK = 64
LETTER = K.UPPER | K.LOWER | (K.BYTES >= 0x80)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (K.mix(x) & K.U(BUCKETS - 1)).astype(np.int32)


class Words:
    """The words of some texts with their features: `grams` for each byte (rows of `first`), `whole` for each word."""

    def __init__(self, t: K.Texts):
        starts, ends, self.firsts = t.spans(LETTER)
        size = ends - starts
        letters = K.FOLD[t.data[LETTER[t.data]]]
        self.first = np.concatenate([[0], np.cumsum(size)])
        a = self.first[:-1]
        n = len(letters)
        if not n:
            self.grams = np.zeros((2, 0), np.int32)
            self.whole = np.zeros((3, 0), np.int32)
            return
        before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        before[1:], after[:-1] = letters[:-1], letters[1:]
        before[a] = 0
        after[self.first[1:] - 1] = 0
        pair = (before << np.uint32(8)) | letters
        triple = (pair << np.uint32(8)) | after
        self.grams = np.stack([_PAIR[pair], _bucket(triple.astype(K.U) + K.U(1 << 32))])
        hashes = t.hashes(starts, ends)
        head, tail = np.zeros(len(a), K.U), np.zeros(len(a), K.U)
        for i in range(4):
            inside = size > i
            head[inside] = head[inside] * K.U(257) + letters[a[inside] + i]
            tail[inside] = tail[inside] * K.U(257) + letters[self.first[1:][inside] - 1 - i]
        self.whole = np.stack([_bucket(hashes), _bucket(head + K.U(1 << 40)), _bucket(tail + K.U(1 << 41))])

    def __len__(self) -> int:
        return len(self.first) - 1

    def new_text(self) -> np.ndarray:
        out = np.zeros(len(self), bool)
        out[self.firsts[:-1][np.diff(self.firsts) > 0]] = True
        return out


_PAIR = _bucket(np.arange(1 << 16, dtype=K.U) + K.U(3 << 32))


class Crf:
    def __init__(self, labels: list[str]):
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of the labels for each word: of its character n-grams on average, of the rest in sum."""
        if not len(w):
            return np.zeros((0, len(self.labels)), np.float32)
        grams = np.add.reduceat(self.weights[w.grams[0]] + self.weights[w.grams[1]], w.first[:-1], axis=0)
        grams /= np.diff(w.first)[:, None].astype(np.float32)
        for column in w.whole:
            grams += self.weights[column]
        return grams

    def marginals(self, scores: np.ndarray, new: np.ndarray, pairs: bool = False):
        """Label probabilities of each word; with `pairs` also the expected number of each transition."""
        n, k = scores.shape
        if not n:
            return (scores, np.zeros((k, k))) if pairs else scores
        blocks = -(-n // BLOCK)
        e = np.ones((blocks * BLOCK, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        e = e.reshape(blocks, BLOCK, k)
        start = np.ones(blocks * BLOCK, bool)  # what fills up the last block forgets too
        start[:n] = new
        start = start.reshape(blocks, BLOCK)
        move = np.exp(self.moves.astype(np.float64))
        # the product of each block's steps, all blocks at once
        product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for i in range(BLOCK):
            fresh = product.sum(2, keepdims=True)
            product = np.where(start[:, i, None, None], fresh, product @ move) * e[:, i, None, :]
            product /= product.sum((1, 2), keepdims=True)
        # what enters each block from the left and from the right
        left, right = np.empty((blocks, k)), np.empty((blocks, k))
        v = np.full(k, 1 / k)
        for b in range(blocks):
            left[b] = v
            v = v @ product[b]
            v /= v.sum()
        v = np.ones(k)
        for b in range(blocks - 1, -1, -1):
            right[b] = v
            v = product[b] @ v
            v /= v.sum()
        forward, backward = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
        v = left
        for i in range(BLOCK):
            v = np.where(start[:, i, None], v.sum(1, keepdims=True), v @ move) * e[:, i]
            v = v / v.sum(1, keepdims=True)
            forward[:, i] = v
        v = right
        for i in range(BLOCK - 1, -1, -1):
            backward[:, i] = v
            u = v * e[:, i]
            v = np.where(start[:, i, None], u.sum(1, keepdims=True), u @ move.T)
            v = v / v.sum(1, keepdims=True)
        both = (forward * backward).reshape(-1, k)[:n]
        both /= both.sum(1, keepdims=True)
        if not pairs:
            return both
        f, u = forward.reshape(-1, k)[: n - 1], (backward * e).reshape(-1, k)[1:n]
        joined = np.flatnonzero(~new[1:])
        f, u = f[joined], u[joined]
        total = ((f @ move) * u).sum(1)
        return both, ((f / total[:, None]).T @ u) * move

    def fit(self, w: Words, new: np.ndarray, truth: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Adaptive gradient steps on the log-likelihood of the labels."""
        k = len(self.labels)
        known = np.zeros((len(w), k))
        known[np.arange(len(w)), truth] = 1
        inside = np.flatnonzero(~new[1:])
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[inside], truth[inside + 1]), 1)
        of = np.repeat(np.arange(len(w)), np.diff(w.first))
        share = 1 / np.diff(w.first)[of]
        squares, move_squares = np.full(self.weights.shape, 1e-6), np.full((k, k), 1e-6)
        for _ in range(rounds):
            expected, moved = self.marginals(self.emissions(w), new, pairs=True)
            miss = (known - expected) / len(w)
            gradient = np.empty(self.weights.shape)
            for j in range(k):
                own = miss[of, j] * share
                gradient[:, j] = sum(np.bincount(g, own, BUCKETS) for g in w.grams) + sum(np.bincount(c, miss[:, j], BUCKETS) for c in w.whole)
            gradient -= decay * self.weights / len(w)
            squares += gradient**2
            self.weights += (rate * gradient / np.sqrt(squares)).astype(np.float32)
            step = (seen - moved) / len(w)
            move_squares += step**2
            self.moves += (rate * step / np.sqrt(move_squares)).astype(np.float32)

    def words(self, t: K.Texts) -> tuple[Words, np.ndarray]:
        """The words of some texts and the label probabilities of each."""
        w = Words(t)
        return w, self.marginals(self.emissions(w), w.new_text())

    def spans(self, w: Words, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words of one text with one most likely label: first word, word after the last, label, mean probability; in order."""
        best, n = p.argmax(1), len(p)
        new = w.new_text()
        new[1:] |= best[1:] != best[:-1]
        first = np.flatnonzero(new)
        after = np.append(first[1:], n)[: len(first)]
        sums = np.concatenate([[0.0], np.cumsum(p[np.arange(n), best])])
        return first, after, best[first], (sums[after] - sums[first]) / (after - first)

    def label_texts(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label number (-1: no words), score and number of spans for each text."""
        w, p = self.words(t)
        sums = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(p, axis=0)])
        size = np.diff(w.firsts)
        mean = (sums[w.firsts[1:]] - sums[w.firsts[:-1]]) / np.maximum(size, 1)[:, None]
        first = self.spans(w, p)[0]
        n_spans = np.diff(np.searchsorted(first, w.firsts))
        return np.where(size > 0, mean.argmax(1), -1), np.clip(mean.max(1), 0, 1), n_spans


def splice(texts: list[str], of: np.ndarray, words: int = TRAIN_WORDS, seed: int = 5) -> tuple[Words, np.ndarray, np.ndarray]:
    """Code-switched chains of some 200 words, of stretches of 5 to 40 words from texts of any language; each language equally often."""
    rng = np.random.RandomState(seed)
    split = [x.split() for x in texts]
    by = [[i for i in np.flatnonzero(of == j) if split[i]] for j in range(of.max() + 1)]
    by = [x for x in by if x]
    chains, sizes, total = [], [], 0
    while by and total < words:
        chain, size = [], 0
        while size < 200:
            i = rng.choice(by[rng.randint(len(by))])
            n = rng.randint(5, 41)
            at = rng.randint(0, max(1, len(split[i]) - n + 1))
            chain.append((" ".join(split[i][at : at + n]), int(of[i])))
            size += n
        chains.append(" ".join(x for x, _ in chain))
        sizes.append(chain)
        total += size
    (t,) = list(K.texts(pa.array(chains, pa.string()), 1 << 40)) or [None]
    pieces = [p for chain in sizes for p, _ in chain]
    own = [len(Words(x).first) - 1 for p in pieces for x in K.texts(pa.array([p]))]
    truth = np.repeat([j for chain in sizes for _, j in chain], own)
    w = Words(t)
    return w, w.new_text(), truth


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most: int = MAX_ROWS, folds: int = 4, held_out: int = 2) -> Crf | None:
    """Learns from a bounded sample: rows picked by a hash of the id, about `per_language` of each language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not counts:
        return None
    each = max(1, min(per_language, most // len(counts)))
    chance = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = usable.filter(u < F.coalesce(F.try_element_at(chance, F.col("lang")), F.lit(0.0))).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * most).collect()
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    model = Crf(labels)
    w, new, truth = splice([r["text"] for r in rows], np.array([labels.index(r["lang"]) for r in rows]), max(TRAIN_WORDS, WORDS_PER_LANGUAGE * len(labels)))
    if len(w):
        model.fit(w, new, truth)
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        names = np.array([*crf.labels, "und"], object)
        for batch in batches:
            at, scores, spans = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for t in K.texts(batch.column(1)):
                for out, values in zip((at, scores, spans), crf.label_texts(t)):
                    out.append(values)
            columns = [pa.array(names[np.concatenate(at)], pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(spans).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "lettered", "label", "p", "n_spans"])

    return run


def predict(docs: DataFrame, model: Crf | None, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans (runs of words of one language) for each row of docs."""
    out = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        out = out.select("doc_id", "lettered", F.lit("und").alias("label"), F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("n_spans"))
    else:
        kind = docs.schema["doc_id"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(model)
        out = out.mapInArrow(_predict(shared), f"doc_id {kind}, lettered boolean, label string, p double, n_spans long")
    known = F.col("lettered") & (F.col("label") != "und")
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        F.when(known, F.col("label")).otherwise("und").alias("lang_pred"), F.when(known, F.col("p")).otherwise(0.0).alias("score"), F.when(known, F.col("n_spans")).otherwise(0).alias("n_spans"),
    )


SPAN = "lang: string, first_word: bigint, n_words: bigint, p: double"


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for t in K.texts(batch.column(1)):
                w, p = crf.words(t)
                first, after, label, mean = crf.spans(w, p)
                cut = np.searchsorted(first, w.firsts)
                start = first - np.repeat(w.firsts[:-1], np.diff(cut))
                fields = [pa.array(np.array(crf.labels, object)[label], pa.string()), pa.array(start.astype(np.int64)), pa.array((after - first).astype(np.int64)), pa.array(mean.astype(float))]
                spans = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(fields, ["lang", "first_word", "n_words", "p"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), spans], ["doc_id", "spans"])

    return run


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, spans for each row of docs: runs of words (of letters, counted from 0) of one language, in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_label(shared), f"doc_id {kind}, spans array<struct<{SPAN}>>")
