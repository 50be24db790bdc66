"""Importance resampling towards a target distribution, with a distributed quickselect.

Runs of 1 to n words are hashed to buckets by the CRC-32 of their bytes. Counts of
all raw and of all target texts give each bucket a gain, the logarithm of how much
likelier it is in the target; the gains are one array of fixed size that scores
every document. Gumbel noise from a hash of the id turns the highest scores into a
draw without replacement.

The k-th highest key is found without sorting: each round takes some of the keys
still in question at random, counts how many lie between, at and beyond them,
exactly, and goes on with the only range that holds the k-th. The keys are composite
(score, id, row), so that no two are alike. Only those drawn are then sorted, in
ranges, and ranked.

Defined results: a null text has no words; a null id is hashed as '' and comes last
among equal scores; rows that repeat an id are drawn by row. Columns stay, but for
any of the name of a new column, in any case; an empty table gives none, and without
target texts gains are of zero counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .columns import others, private, public
from .storage import Scratch

NEW = ("n_features", "weight", "score", "rank")
#: Keys that a round of the quickselect takes.
PIVOTS = 31

_STEP = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _STEP[_i] = _c
#: Words up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48


def _zero_bytes(levels: int) -> np.ndarray:
    """[level, byte, value]: what 2^level more bytes make of each byte of a CRC; the sum over its bytes is a linear map."""
    basis = np.array([1 << i for i in range(32)], np.uint32)
    columns = _STEP[basis & 255] ^ (basis >> np.uint32(8))  # one zero byte
    out = np.zeros((levels, 4, 256), np.uint32)
    for level in range(levels):
        for byte in range(4):
            for bit in range(8):
                on = (np.arange(256) >> bit & 1).astype(bool)
                out[level, byte, on] ^= columns[8 * byte + bit]
        columns = _apply(out[level], columns)
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_LEVELS = _zero_bytes(32)


def joined_crcs(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts one after the other, from those of both and the second's length."""
    out, left, level = first.copy(), lengths.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(_LEVELS[level], out[odd])
        left, level = left >> 1, level + 1
    return out ^ second


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    sizes = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(sizes, SIDE_BY_SIDE + 1), kind="stable")
    order = order[np.searchsorted(-np.minimum(sizes, SIDE_BY_SIDE + 1)[order], -SIDE_BY_SIDE) :]
    state, at = out[order], starts[order]
    ends_at = np.searchsorted(-sizes[order], -np.arange(SIDE_BY_SIDE + 1), side="left")
    for i in range(SIDE_BY_SIDE):
        n = ends_at[i]  # so many are longer than i
        if not n:
            break
        state[:n] = _STEP[(state[:n] ^ data[at[:n] + i]) & 255] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > SIDE_BY_SIDE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


_BLANK = np.uint32(zlib.crc32(b" "))


def features(texts: K.Texts, n: int, buckets: int):
    """Buckets of all runs of 1 to n words, the text each belongs to, and the number of words of each text."""
    data = K.FOLD[texts.data]
    starts, ends, firsts = texts.spans(K.ALNUM)
    owner, sizes = K.owner(firsts), ends - starts
    words = span_crcs(data, starts, ends)
    spaced = joined_crcs(np.full(len(words), _BLANK, np.uint32), words, sizes)
    run, out, owners = words, [words % np.uint32(buckets)], [owner]
    for k in range(1, n):
        here = np.flatnonzero(K.starts_of_grams(firsts, k + 1))
        full = np.zeros(len(words), np.uint32)
        full[here] = joined_crcs(run[here], spaced[here + k], sizes[here + k] + 1)
        run = full
        out.append(full[here] % np.uint32(buckets))
        owners.append(owner[here])
    return np.concatenate(out), np.concatenate(owners), np.diff(firsts)


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how often features fall into each bucket, over all texts; a task hands on one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in K.texts(batch.column(0)):
                total += np.bincount(features(piece, n, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str = "text", n: int = 3, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of each bucket, with one more of each counted."""
    both = []
    for df in (raw, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, text, n, buckets).collect():  # at most `buckets` rows
            counts[r["bucket"]] = r["n"]
        both.append(counts)
    s, t = both
    ratio = ((t + 1) * float(s.sum() + buckets)) / ((s + 1) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", n: int = 3, seed: int = 42) -> DataFrame:
    """docs (without their texts) with n_features, weight, score, and n_words."""
    columns, buckets = others(docs, *NEW, "n_words", text), len(gain)
    rows = private(docs, columns, t=F.col(f"`{text}`").cast("string"), id=F.col(f"`{doc_id}`"))
    schema = rows.drop("t").select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_features", "weight", "n_words"))).schema

    def run(batches):
        for batch in batches:
            at, kept = batch.schema.get_field_index("t"), batch.drop_columns(["t"])
            for piece in K.texts(batch.column(at)):
                found, owner, words = features(piece, n, buckets)
                own = np.argsort(owner, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[found[own]])])
                ends = np.searchsorted(owner[own], np.arange(piece.n + 1))
                numbers = np.diff(ends), sums[ends[1:]] - sums[ends[:-1]], words
                yield pa.RecordBatch.from_arrays([*kept.slice(piece.first, piece.n).columns, *(pa.array(x.astype(np.int64)) for x in numbers)], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    return scored.select(*public(columns), "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), "n_words")


def quickselect(keys: DataFrame, key: str, k: int, pivots: int = PIVOTS):
    """The k-th smallest (from 1) of keys that are all different; None if there are fewer."""
    scratch, left, typ, turn = Scratch(keys.sparkSession), keys.select(key), keys.schema[key].dataType, 0
    while True:
        turn += 1
        at = [r[0] for r in left.orderBy(F.xxhash64(F.lit(turn), F.col(key))).limit(pivots).collect()]
        if not at:
            return None
        lits = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, typ.fields))) for p in at]
        below = lambda i: F.count_if(F.col(key) < lits[i]).alias(f"b{i}")
        counts = left.agg(*(below(i) for i in range(len(at))), *(F.count_if(F.col(key) == p).alias(f"e{i}") for i, p in enumerate(lits)), F.count("*").alias("n")).first()
        if k > counts["n"]:
            return None
        lo, hi, skipped = None, None, 0
        for i in sorted(range(len(at)), key=lambda i: counts[f"b{i}"]):
            if counts[f"b{i}"] < k <= counts[f"b{i}"] + counts[f"e{i}"]:
                scratch.drop()
                return lits[i]
            if k > counts[f"b{i}"]:
                lo, skipped = lits[i], counts[f"b{i}"] + counts[f"e{i}"]
            elif hi is None:
                hi = lits[i]
        k -= skipped
        inside = left if lo is None else left.filter(F.col(key) > lo)
        old, left = left, scratch.written(inside if hi is None else inside.filter(F.col(key) < hi), "keys-left")
        if turn > 1:
            scratch.drop(old)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, text: str = "text", doc_id: str = "doc_id", n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """docs (without their texts) with n_features, weight, score, and the rank of those drawn: so many in a hundred of the documents of enough words."""
    scratch = Scratch(docs.sparkSession)
    scored = score(docs, gains(docs, target, text, n, buckets), text, doc_id, n, seed)
    columns = [c for c in scored.columns if c not in (*NEW, "n_words")]
    rows = private(scored, columns, id=F.col(f"`{doc_id}`"), **{c: F.col(c) for c in ("n_features", "weight", "score", "n_words")})
    rows = scratch.written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    key = F.struct((-F.col("score")).alias("score"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    rows = rows.withColumn("key", key)
    able = F.col("n_words") >= min_words
    k = percent * rows.filter(able).count() // 100
    last = quickselect(rows.filter(able), "key", k) if k else None
    drawn = able & (F.col("key") <= last) if last is not None else F.lit(False)
    # ranges in order, then places within each, after those of the ranges before
    ranged = rows.filter(drawn).repartitionByRange("key").withColumn("range", F.spark_partition_id())
    ranged = scratch.written(ranged, "drawn")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    out = lambda df, rank: df.select(*public(columns), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    ranked = ranged.withColumn("place", place).join(F.broadcast(before), "range")
    return out(ranked, F.col("place") + F.col("before")).union(out(rows.filter(~drawn), F.lit(None)))
