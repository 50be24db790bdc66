"""Near-duplicate join on word n-grams with Bayesian pruning of candidates.

1. Every document gives the hash of its set of n-grams (equal sets form a class
   of copies, represented by the smallest id) and its MinHash values.
2. Classes that agree in one band of MinHash values are candidates. Buckets are
   cut into blocks by a hash of the id; a task gets two blocks, compares MinHash
   values in steps, and drops a pair as soon as the posterior probability that
   its similarity reaches the threshold falls below the tolerance. What survives
   leaves the task as a spanning forest, never as all pairs.
3. Components of these forests hold every surviving pair. Again in blocks, the
   n-gram sets of a component's classes are compared exactly; each class gets the
   number of documents linked to it, and links leave as a spanning forest, whose
   components are the groups of near-duplicates.

A link at the threshold is missed with probability (1 - t^4)^24, below 4e-6 at
t = 0.8, plus the tolerance. No bucket, block or number of partners is capped.

Defined results: texts with fewer than n words, but not none, have their words as
their only n-gram; texts without words (null, empty) are linked to nothing. Rows
that repeat a doc_id are one document, linked where any of its texts is. Rows with
a null doc_id are one document for each text; they come after all others, and a
class of them alone has a null class_id. A doc_id is any whole number of 64 bits, or
text that is one; other text raises. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .storage import Scratch

BANDS, ROWS, HASHES, STEP = 24, 4, 128, 16
BLOCK = 256
#: N-grams of one block at most, but for a single text with more.
BLOCK_GRAMS = 1 << 20
#: Documents to verify whose ids are broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Rows with a null id get one from here on, by a hash of their text; where others are as large, all are numbered anew.
NO_ID = 1 << 62
_MULTIPLIERS = K.mix(np.arange(1, HASHES + 1, dtype=K.U) * K.U(0xC2B2AE3D27D4EB4F)) | K.U(1)
SKETCH = "id long, set_a long, set_b long, n_grams long, buckets binary, low binary"


def _gram_lists(t: K.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams, and the texts' offsets into them."""
    starts, ends, firsts = t.spans(K.ALNUM)
    words = t.hashes(starts, ends)
    ok = K.starts_of_grams(firsts, n)[: max(0, len(words) - n + 1)]
    of, grams = K.owner(firsts)[: len(ok)][ok], K.grams(words, n)[ok]
    size = np.diff(firsts)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = np.concatenate([K.grams(words[firsts[i] : firsts[i + 1]], int(size[i])) for i in short])
        of, grams = np.concatenate([of, short]), np.concatenate([grams, own])
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    return grams, np.searchsorted(of, np.arange(t.n + 1))


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column(1)):
                grams, firsts = _gram_lists(t, n)
                of = K.owner(firsts).astype(K.U)
                filled = np.flatnonzero(np.diff(firsts))
                at = firsts[filled]
                signature = np.zeros((t.n, HASHES), np.uint32)
                set_a, set_b, size = np.zeros(t.n, K.U), np.zeros(t.n, K.U), np.zeros(t.n, np.int64)
                if len(at):
                    for k in range(HASHES):
                        signature[filled, k] = np.minimum.reduceat(grams * _MULTIPLIERS[k], at) >> K.U(32)
                    # equal n-grams of a text side by side: text number above 44 bits of the hash
                    own = np.sort((of << K.U(44)) | (grams >> K.U(20)))
                    first = np.ones(len(own), bool)
                    first[1:] = own[1:] != own[:-1]
                    own, text = (own & K.U((1 << 44) - 1))[first], (own >> K.U(44))[first].astype(np.int64)
                    cut = np.searchsorted(text, filled)
                    set_a[filled] = np.add.reduceat(K.mix(own + K.U(11)), cut)
                    set_b[filled] = np.add.reduceat(K.mix(own * K.U(0xD6E8FEB86659FD93) + K.U(7)), cut)
                    size += np.bincount(text, minlength=t.n)
                buckets = np.zeros((t.n, BANDS), K.U)
                for r in range(ROWS):
                    buckets = K.mix(buckets + signature[:, r : BANDS * ROWS : ROWS].astype(K.U) + K.U(r + 1))
                buckets = K.mix(buckets + np.arange(BANDS, dtype=K.U))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, t.n),
                        pa.array(set_a.view(np.int64)),
                        pa.array(set_b.view(np.int64)),
                        pa.array(size),
                        pa.array([x.tobytes() for x in buckets], pa.binary()),
                        pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary()),
                    ],
                    ["id", "set_a", "set_b", "n_grams", "buckets", "low"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of a class: the bucket and the id."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["bucket", "id"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step the fewest equal MinHash values with which a pair stays.

    With m of n values equal and a uniform prior, the similarity has a Beta(m + 1,
    n - m + 1) posterior, and exceeds t with the probability that n + 1 trials of
    chance t have at most m successes.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number connected with each of 0..n-1 by pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the first columns; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
        held = whole.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]])


def _prune(threshold: float, tolerance: float, pairs_at_once: int = 1 << 17):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, 3):
            if not held.num_rows:
                continue
            bucket, bi, bj, ids, block = (held.column(i).to_numpy() for i in range(5))
            low = np.frombuffer(b"".join(held.column(5).to_pylist()), np.uint8).reshape(-1, HASHES)
            starts = _group_starts(bucket, bi, bj)
            ends = np.repeat(starts[1:], np.diff(starts))
            partners = ends - np.arange(len(ends)) - 1
            bounds = np.concatenate([[0], np.cumsum(partners)])
            kept_a, kept_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            row = 0
            while row < len(partners):
                to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + pairs_at_once, side="right")) - 1)
                a = np.repeat(np.arange(row, to), partners[row:to])
                b = a + 1 + np.arange(len(a)) - np.repeat(bounds[row:to] - bounds[row], partners[row:to])
                cross = (bi[a] == bj[a]) | (block[a] != block[b])
                a, b = a[cross], b[cross]
                matches = np.zeros(len(a), np.int64)
                for step, least_now in enumerate(least):
                    at = slice(step * STEP, (step + 1) * STEP)
                    matches += (low[a, at] == low[b, at]).sum(1)
                    stay = matches >= least_now
                    a, b, matches = a[stay], b[stay], matches[stay]
                kept_a.append(a)
                kept_b.append(b)
                row = to
            root = _forest(len(ids), np.concatenate(kept_a), np.concatenate(kept_b))
            child = np.flatnonzero(root != np.arange(len(root)))
            edges = np.unique(np.stack([ids[child], ids[root[child]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    return run


def _emit_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column(2)):
                grams, firsts = _gram_lists(t, n)
                sets = [np.unique(grams[firsts[i] : firsts[i + 1]]).tobytes() for i in range(t.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), batch.column(1).slice(t.first, t.n), pa.array(sets, pa.binary())], ["id", "root", "grams"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. N-grams that the same sets have are one column, weighted by their number."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    marks = K.mix(np.arange(1, len(sets) + 1, dtype=K.U) * K.U(0x9E3779B97F4A7C15))
    pattern = np.zeros(len(values), K.U)
    np.add.at(pattern, at, marks[owner])
    shared = np.bincount(at) > 1
    _, column, weight = np.unique(pattern[shared], return_inverse=True, return_counts=True)
    of_value = np.full(len(values), -1)
    of_value[shared] = column
    out = np.zeros((len(sets), len(sets)))
    columns = of_value[at]
    for lo in range(0, len(weight), 4096):
        part = (columns >= lo) & (columns < lo + 4096)
        m = np.zeros((len(sets), min(4096, len(weight) - lo)), np.float32)
        m[owner[part], columns[part] - lo] = 1
        out += (m * weight[lo : lo + 4096]) @ m.T.astype(np.float64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, 3, 256):
            if not held.num_rows:
                continue
            comp, bi, bj, ids, block, copies = (held.column(i).to_numpy() for i in range(6))
            blobs = held.column(6).to_pylist()
            starts = _group_starts(comp, bi, bj)
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                sets = [np.frombuffer(x, K.U) for x in blobs[a:b]]
                size = np.array([len(s) for s in sets], float)
                both = intersections(sets)
                union = size[:, None] + size[None, :] - both
                linked = both >= threshold * union - 1e-9
                np.fill_diagonal(linked, False)
                if bi[a] != bj[a]:
                    linked &= block[a:b, None] != block[None, a:b]
                x, y = np.nonzero(np.triu(linked))
                root = _forest(b - a, x, y)
                for i in np.flatnonzero(linked.any(1)):
                    out.append((ids[a + i], ids[a + root[i]], int(linked[i] @ copies[a:b])))
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "links"])

    return run


def _two_blocks(rows: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """One row for each pair of blocks that a row's block is in, dealt by group and sorted, so that the first of a forest is its smallest id; needs columns blocks and block."""
    own, other = F.col("block"), F.col("__other")
    pairs = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*keys, F.least(own, other).alias("bi"), F.greatest(own, other).alias("bj"), *rest)
    return pairs.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj", "id")


def _renumbered(ids: DataFrame, **how) -> DataFrame:
    """`near_duplicates` over numbers in the order of ids, null ones last, and their ids again."""
    scratch, null = Scratch(ids.sparkSession), F.col("id").isNull()
    mark = F.when(null, F.xxhash64(F.coalesce("text", F.lit("")))).alias("mark")
    order = [null, F.col("id"), F.col("mark")]
    numbers = ids.select("id", mark).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = scratch.written(numbers.withColumn("number", F.monotonically_increasing_id()), "numbers")
    right = numbers.select(F.col("id").alias("own"), F.col("mark").alias("own_mark"), "number")
    rows = ids.select("id", mark, "text").join(right, F.col("id").eqNullSafe(F.col("own")) & F.col("mark").eqNullSafe(F.col("own_mark")))
    out = near_duplicates(scratch.written(rows.select("number", "text"), "numbered-texts"), doc_id="number", text="text", **how)
    for c in ("doc_id", "class_id", "copy_of"):
        out = out.withColumnRenamed(c, "number").join(numbers.select("number", F.col("id").alias(c)), "number").drop("number")
    return out.select("doc_id", "class_id", "copy_of", "n_links")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, class_id (smallest id of its group), copy_of (smallest id with the same n-grams), n_links (documents linked to it)."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    most, nulls = given.agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
    if nulls and most is not None and most >= NO_ID:
        return _renumbered(given, n=n, threshold=threshold, tolerance=tolerance)
    own = F.lit(NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    ids = given.select(F.coalesce("id", own).alias("id"), "text")
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.written(ids.mapInArrow(_sketch(n), SKETCH), "sketches")
    classes = sketches.filter("n_grams > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    classes = scratch.written(classes, "copy-classes")

    # candidates; MinHash values go along only with classes that share a bucket
    own = sketches.join(classes.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"]).dropDuplicates(["set_a", "set_b"])
    own = scratch.written(own.select("id", "buckets", "low"), "representatives")
    members = own.select("id", "buckets").mapInArrow(_bands, "bucket long, id long")
    buckets = scratch.written(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    shared = scratch.written(members.join(buckets, "bucket"), "shared-buckets")
    blocked = shared.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(own.select("id", "low"), "id")
    survivors = _two_blocks(blocked, ["bucket"], ["id", "block", "low"]).mapInArrow(_prune(threshold, tolerance), "u long, v long")
    survivors = scratch.written(survivors.distinct(), "survivors")
    nearby = connected_components(survivors)
    scratch.drop(own, buckets, shared, survivors)

    # exact verification
    labels = nearby.select(F.col("node").alias("id"), "root")
    few = labels.count() <= BROADCAST_IDS
    found = ids.join(F.broadcast(labels) if few else labels, "id").select("id", "root", "text")
    sets = scratch.written(found.mapInArrow(_emit_sets(n), "id long, root long, grams binary").dropDuplicates(["id", "grams"]), "gram-sets")
    sizes = scratch.written(sets.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.length("grams") / 8).alias("total")), "component-sizes")
    copies = classes.groupBy(F.col("rep").alias("id")).agg(F.max("copies").alias("copies"))
    blocked = sets.join(copies, "id").join(sizes, "root").withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    links = scratch.written(_two_blocks(blocked, ["root"], ["id", "block", "copies", "grams"]).mapInArrow(_verify(threshold), "u long, v long, links long"), "links")
    groups = connected_components(links.select("u", "v"))
    linked = links.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    judged = scratch.written(classes.join(linked, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left"), "judged-classes")

    out = sketches.select("id", "set_a", "set_b", "n_grams").join(judged, ["set_a", "set_b"], "left")
    alone = F.col("n_grams") == 0
    shown = lambda c: F.when(c < NO_ID, c) if nulls else c
    rep = F.when(alone, F.col("id")).otherwise(F.col("rep"))
    out = out.select(
        shown(F.col("id")).alias("doc_id"),
        shown(F.when(alone, F.col("id")).otherwise(F.coalesce("root", "rep"))).alias("class_id"),
        shown(rep).alias("copy_of"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    # the result is narrow: written, so that the tables behind it can go
    out = scratch.written(out, "near-duplicates")
    scratch.drop(keep=out)
    return out
