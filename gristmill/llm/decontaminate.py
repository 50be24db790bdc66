"""Benchmark decontamination by winnowing.

Of every run of `window` words a text keeps the smallest hash of its k-grams
(k = 5 words). Equal runs keep equal fingerprints, so that joining the
fingerprints of documents and benchmark items finds every shared run of `window`
words. Each hit is then extended: of the texts with hits, the runs of `window`
words around them are joined with the benchmark's, and the words of equal ones
are hit. Items shorter than the window form one run of their own length, winnowed
at that length.

All of it is joins of narrow tables: texts are read, not moved, but for those with
a hit, and nothing of the benchmark passes through the driver but the lengths of
its runs (`window` numbers at most). Which side is broadcast, if any, is left to
Spark, which knows the sizes, but for the fingerprints that texts with hits have:
these are counted first. Texts are named by their MD5, so equal ones are
judged once. Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and are never contaminated.
Rows with null or repeated doc_id are judged each for itself. Items of equal
item_id count once; a null item_id is named ''. Extra columns stay, but for any of
the name of a new column, in any case; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .columns import others, private
from .storage import Scratch

GRAM = 5
WORD = K.ALNUM
#: Copies of one text with hits are dealt over so many tasks before one of them is kept.
SALTS = 16
#: So many fingerprints of texts with hits are broadcast at most; more are joined, by salted keys.
BROADCAST_HITS = 1_000_000


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _minima(words: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words the smallest hash of its k-grams."""
    k = min(GRAM, n)
    return _sliding_min(K.grams(words, k), n - k + 1) if len(words) >= n else np.zeros(0, K.U)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column(1)):
                starts, ends, firsts = t.spans(WORD)
                words = t.hashes(starts, ends)
                rows = []
                for i in range(t.n):
                    own = words[firsts[i] : firsts[i + 1]]
                    if len(own):
                        n = min(window, len(own))
                        rows.append((t.first + i, n, K.grams(own, n), _minima(own, n)))
                at = np.concatenate([np.zeros(0, np.int64), *(np.full(len(r[2]), r[0]) for r in rows)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array(np.concatenate([np.zeros(0, np.int32), *(np.full(len(r[2]), r[1], np.int32) for r in rows)])),
                        pa.array(np.concatenate([np.zeros(0, K.U), *(r[2] for r in rows)]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(0, K.U), *(r[3] for r in rows)]).view(np.int64)),
                    ],
                    ["item", "n", "run", "fingerprint"],
                )

    return run


def _fingerprints(lengths: list[int]):
    """Fingerprints of whole texts at each length of runs; one that stays the minimum of a stretch of runs is given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column(1)):
                starts, ends, firsts = t.spans(WORD)
                words, of = t.hashes(starts, ends), K.owner(firsts)
                for n in lengths:
                    minima = _minima(words, n)
                    at = np.flatnonzero(K.starts_of_grams(firsts, n)[: len(minima)])
                    own, text = minima[at], of[at]
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
                    own, text = own[fresh], text[fresh]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t.first + text)), pa.array(np.full(len(own), n, np.int32)), pa.array(own.view(np.int64))], ["key", "n", "fingerprint"])

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with hits, the runs of words whose fingerprint is one, and where they begin."""
    mark = lambda text, x: K.mix(x + text.astype(K.U) * K.U(0x9E3779B97F4A7C15))
    for batch in batches:
        for t in K.texts(batch.column(1)):
            starts, ends, firsts = t.spans(WORD)
            words, of = t.hashes(starts, ends), K.owner(firsts)
            hits = batch.column(2).slice(t.first, t.n)
            text = np.repeat(np.arange(t.n), hits.value_lengths().to_numpy())
            n_of, hit = (hits.flatten().field(i).to_numpy() for i in (0, 1))
            for n in np.unique(n_of):
                minima, mine = _minima(words, int(n)), n_of == n
                at = np.flatnonzero(K.starts_of_grams(firsts, int(n))[: len(minima)])
                at = at[np.isin(mark(of[at], minima[at]), mark(text[mine], hit[mine].view(K.U)))]
                whole = words[at].copy()
                for i in range(1, int(n)):
                    whole *= K.U(0x9FB21C651E98DF25)
                    whole += words[at + i]
                arrays = [batch.column(0).take(pa.array(t.first + of[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(K.mix(whole + K.U(n)).view(np.int64)), pa.array((at - firsts[of[at]]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "run", "begin"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of words of the last column, the text."""
    for batch in batches:
        n = [np.zeros(0, np.int64), *(np.diff(t.spans(WORD)[2]) for t in K.texts(batch.column(batch.num_columns - 1)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n))], [*batch.schema.names, "words"])


def _covered(spans):
    """How many words spans (begin, n) cover together."""
    start = F.struct(F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("total"))

    def add(s, x):
        until = F.greatest(s["until"], x["begin"] + x["n"])
        return F.struct(until.alias("until"), (s["total"] + until - F.greatest(s["until"], F.least(x["begin"], until))).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["total"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items (distinct ids of items found, sorted as strings) and hit_spans (begin, n: the runs of words hit)."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    windows = scratch.written(items.mapInArrow(_item_windows(window), "item string, n int, run long, fingerprint long").distinct(), "benchmark-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    columns = others(docs, "n_words", "n_hit", "items", "hit_spans", text)
    rows = private(docs, columns, key=F.unhex(F.md5(F.col(f"`{text}`"))), text=F.col(f"`{text}`"))
    schema = type(rows.schema)(list(rows.schema.fields)).add("words", "long")
    rows = rows.mapInArrow(_count_words, schema)
    texts = docs.select(F.unhex(F.md5(F.col(f"`{text}`"))).alias("key"), F.col(f"`{text}`").alias("text"))

    own = texts.mapInArrow(_fingerprints(lengths), "key binary, n int, fingerprint long")
    hits = own.join(windows.select("n", "fingerprint").distinct(), ["n", "fingerprint"], "left_semi").distinct()
    hits = scratch.written(hits.groupBy("key").agg(F.collect_list(F.struct("n", "fingerprint")).alias("hits")), "fingerprint-hits")
    near = texts.withColumn("salt", F.spark_partition_id() % SALTS)
    if (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_HITS:
        near = near.join(F.broadcast(hits), "key")
    else:
        near = near.join(hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
    near = near.dropDuplicates(["key", "salt"]).dropDuplicates(["key"]).select("key", "text", "hits")
    runs = near.mapInArrow(_extended, "key binary, n int, run long, begin long").join(windows.select("n", "run").distinct(), ["n", "run"], "left_semi")
    runs = scratch.written(runs, "shared-runs")
    spans = runs.groupBy("key").agg(F.collect_list(F.struct("begin", "n")).alias("spans"))
    named = runs.select("key", "n", "run").distinct().join(windows.select("n", "run", "item").distinct(), ["n", "run"])
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("found"))
    found = spans.join(named, "key").select("key", _covered(F.col("spans")).alias("hit"), "found", F.array_sort("spans").alias("spans"))
    found = scratch.written(found, "contaminated-texts")
    scratch.drop(windows, hits, runs)

    # texts without hits stay where they are; where results are too many to broadcast, copies of one text are dealt over salts
    size = found.agg(F.sum(F.size("spans") + F.size("found"))).first()[0] or 0
    if size <= BROADCAST_HITS:
        out = rows.join(F.broadcast(found), "key", "left")
    else:
        rows = rows.withColumn("salt", F.spark_partition_id() % SALTS)
        out = rows.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")
    place = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(columns)} | {text: F.col("text").alias(text)}
    return out.select(
        *(place[c] for c in docs.columns if c in place),
        F.col("words").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<begin: bigint, n: int>>")).alias("hit_spans"),
    )


def contaminated(share: int = 20):
    """The contract's rule: at least one word in so many is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
