"""Drops lines that many documents share, keeping each in one document.

1. Every document gives the hashes of its distinct long lines, and these give the
   distinct line hashes with the number of documents that have them and the
   largest id. Those of one document alone can't be shared and go.
2. The rest is cut into shards of about `SHARD_KEYS` hashes. A task builds, for
   one shard, a minimal perfect hash (levels of collision-free bit positions) that
   indexes compact arrays of fingerprints, counts and keepers. The index serves
   any number of documents from two on: the counts decide when it is probed.
3. Documents send the hashes of their lines to the shards, and get back those of
   the lines to drop. Lines themselves are never joined or shuffled. A shard is
   copied once for each `PROBES` probes that it gets, by the counts it holds, so
   that copies grow with the lines of all documents and not faster, and a line
   that a third of them has is met by many tasks.

A key is hashed twice, in different ways, to 126 bits in all; a pair of lines
that agrees in the first alone is told apart, and the line with fewer documents
stays.

Defined results: a null or empty text is one empty line and comes back as ''.
Rows with a null doc_id count as one document with the smallest id. Rows that
repeat a doc_id are one document: they lose the same lines. Extra columns stay,
but for any of the name of a new column, in any case; an empty table gives an
empty table. Lines of equal key in the keeper all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import kernels as K
from .columns import others, private
from .storage import Scratch

SHARD_KEYS = 1 << 16
#: Documents that one copy of a shard is probed by, about.
PROBES = 1 << 16
NULL_ID = -(1 << 63)


def _line_keys(t: K.Texts, min_chars: int):
    """Spans of lines, the texts' offsets into them, which are long enough, and two hashes of their keys."""
    a, b, firsts = t.lines()
    x, y = t.strip(a, b)
    return a, b, firsts, t.count(K.LEAD, x, y) >= min_chars, t.hashes(x, y), t.second_hashes(x, y)


def _distinct(of: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    order = np.lexsort((h2, h1, of))
    of, h1, h2 = of[order], h1[order], h2[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return of[new], h1[new], h2[new]


def _emit_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for t in K.texts(batch.column(1)):
                _, _, firsts, long, h1, h2 = _line_keys(t, min_chars)
                of, h1, h2 = _distinct(K.owner(firsts)[long], h1[long], h2[long])
                yield pa.RecordBatch.from_arrays([pa.array(ids[t.first + of]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "h1", "h2"])

    return run


def _emit_probes(min_chars: int, shards: int):
    """For each row and shard, the two hashes of each of its lines; rows are named by their id and the hash of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for t in K.texts(batch.column(1)):
                _, _, firsts, long, h1, h2 = _line_keys(t, min_chars)
                of, h1, h2 = _distinct(K.owner(firsts)[long], h1[long], h2[long])
                shard = (h1 % K.U(shards)).astype(np.int32)
                order = np.lexsort((shard, of))
                of, h1, h2, shard = of[order], h1[order], h2[order], shard[order]
                cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (shard[1:] != shard[:-1])]) if len(of) else np.zeros(0, np.int64)
                both = np.stack([h1, h2], 1)
                keys = [x.tobytes() for x in np.split(both, cuts[1:])] if len(cuts) else []
                own = t.first + of[cuts]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(marks[own]), pa.array(shard[cuts]), pa.array(keys, pa.binary())], ["id", "mark", "shard", "keys"])

    return run


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: each level keeps the positions that one key alone takes, the rest goes on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(keys + K.U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % K.U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, keys = [], np.unique(keys)
        while len(keys):
            size = 2 * len(keys) + 8
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; some index or -1 for keys that aren't among those it was built for."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, taken in enumerate(self.levels):
            at = self._at(keys[rest], level, len(taken))
            here = taken[at]
            out[rest[here]] = self.before[level] + self.ranks[level][at[here]]
            rest = rest[~here]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, data: bytes, sizes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels)


SHARD_SCHEMA = "shard int, bits binary, sizes array<int>, fingerprints binary, counts binary, keepers binary"


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h1", "n_docs", "h2"], ascending=[True, False, True]).drop_duplicates("h1")
    h1 = rows["h1"].to_numpy(np.int64).view(K.U)
    index = PerfectHash.build(h1)
    order = np.argsort(index(h1))
    bits, sizes = index.dump()
    arrays = (rows[c].to_numpy(np.int64)[order].tobytes() for c in ("h2", "n_docs", "keeper"))
    return pd.DataFrame([[key[0], bits, sizes, *arrays]], columns=["shard", "bits", "sizes", "fingerprints", "counts", "keepers"])


def _probe(min_docs: int):
    def run(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(shard):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "mark": pd.Series([], dtype="int64"), "drops": []})
        s = shard.iloc[0]
        index = PerfectHash.load(s["bits"], s["sizes"])
        fingerprints, counts, keepers = (np.frombuffer(s[c], np.int64) for c in ("fingerprints", "counts", "keepers"))
        sizes = probes["keys"].map(len).to_numpy() // 16
        keys = np.frombuffer(b"".join(probes["keys"]), K.U).reshape(-1, 2)
        ids, marks = (probes[c].to_numpy(np.int64) for c in ("id", "mark"))
        at = index(keys[:, 0])
        known = at >= 0
        at = np.where(known, at, 0)
        drop = known & (fingerprints[at].view(K.U) == keys[:, 1]) & (counts[at] >= min_docs) & (keepers[at] != np.repeat(ids, sizes))
        first = np.cumsum(sizes) - sizes
        some = np.add.reduceat(drop, first) > 0
        drops = [keys[a : a + n][drop[a : a + n]].tobytes() for a, n in zip(first[some], sizes[some])]
        return pd.DataFrame({"id": ids[some], "mark": marks[some], "drops": drops})

    return run


_PAIR = np.dtype([("h1", K.U), ("h2", K.U)])


def _rewrite(min_chars: int, n_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(n_columns + 1)
            kept, n_lines, n_dropped = [], [], []
            for t in K.texts(batch.column(n_columns)):
                some = [i for i in range(t.n) if drops[t.first + i].is_valid]
                n_lines.append(np.diff(t.lines()[2]))
                lost = np.zeros(t.n, np.int64)
                out = [t.text(i) for i in range(t.n)]
                if some:
                    a, b, firsts, long, h1, h2 = _line_keys(t, min_chars)
                    for i in some:
                        gone = np.unique(np.frombuffer(b"".join(drops[t.first + i].as_py()), _PAIR))
                        at = slice(firsts[i], firsts[i + 1])
                        own = np.empty(firsts[i + 1] - firsts[i], _PAIR)
                        own["h1"], own["h2"] = h1[at], h2[at]
                        near = np.minimum(np.searchsorted(gone["h1"], own["h1"]), len(gone) - 1)
                        # of lines with one first hash at most one is in the index
                        lose = long[at] & (gone[near] == own)
                        lost[i] = lose.sum()
                        out[i] = b"\n".join(t.data[x:y].tobytes() for x, y in zip(a[at][~lose], b[at][~lose]))
                n_dropped.append(lost)
                kept += out
            arrays = [*batch.columns[:n_columns], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *n_lines])), pa.array(np.concatenate([np.zeros(0, np.int64), *n_dropped]))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:n_columns], "kept", "n_lines", "n_dropped"])

    return run


def line_index(docs: DataFrame, min_chars: int = 20) -> tuple[DataFrame, int]:
    """The shards over keys that two documents or more have, each with its number of copies, and their number. docs: id, text."""
    keys = docs.select("id", "text").mapInArrow(_emit_keys(min_chars), "id long, h1 long, h2 long")
    lines = keys.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
    seen = Observation()
    lines = lines.observe(seen, F.count_if(F.col("n_docs") == 1).alias("alone"), F.count_if(F.col("n_docs") > 1).alias("shared"))
    scratch = Scratch(docs.sparkSession)
    shared = scratch.written(lines.filter("n_docs > 1"), "shared-lines")
    shards = max(1, -(-(seen.get.get("shared") or 0) // SHARD_KEYS))
    # h1 is unsigned in the tasks: the remainder of a negative one needs the two halves
    unsigned = (F.shiftrightunsigned("h1", 1) % shards * 2 + F.col("h1").bitwiseAND(F.lit(1))) % shards
    shared = shared.withColumn("shard", unsigned.cast("int"))
    # what a shard is probed for: its own keys in all their documents, and its share of the lines of one document
    probes = F.sum("n_docs") + F.lit((seen.get.get("alone") or 0) // shards)
    copies = shared.groupBy("shard").agg(F.ceil(probes / PROBES).cast("int").alias("copies"))
    index = shared.groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA).join(copies, "shard")
    index = scratch.written(index, "line-shards")
    scratch.drop(keep=index)
    return index, shards


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with such lines dropped from `text`; adds n_lines (before) and n_dropped. min_docs is two at least."""
    if min_docs < 2:
        raise ValueError("a line of one document is not shared")
    columns = others(docs, "n_lines", "n_dropped", text)
    rows = private(docs, columns, id=F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)), text=F.col(f"`{text}`"), mark=F.xxhash64(f"`{text}`"))
    index, shards = line_index(rows, min_chars)
    numbers = index.select(F.col("shard").alias("number"), F.col("copies").alias("m"))
    probes = rows.select("id", "text", "mark").mapInArrow(_emit_probes(min_chars, shards), "id long, mark long, shard int, keys binary")
    probes = probes.join(numbers, F.col("shard") == F.col("number")).withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.col("m")).cast("int"))
    probes = probes.select("id", "mark", "shard", "salt", "keys")
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_probe(min_docs), "id long, mark long, drops binary")
    # rows of equal id and text have equal drops
    drops = found.groupBy("id", "mark").agg(F.collect_set("drops").alias("drops"))
    names = [f"c{i}" for i in range(len(columns))]
    wide = rows.join(drops, ["id", "mark"], "left").select(*names, "text", "drops")
    schema = rows.select(*names).schema.add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    kept = wide.mapInArrow(_rewrite(min_chars, len(columns)), schema)
    place = {c: F.col(n).alias(c) for c, n in zip(columns, names)} | {text: F.col("kept").alias(text)}
    return kept.select(*(place[c] for c in docs.columns if c in place), "n_lines", "n_dropped")
