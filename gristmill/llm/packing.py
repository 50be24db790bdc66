"""Packing token sequences by minimum bin slack.

Documents are turned into ids, an end id each. As many whole windows of
`capacity` ids as fit are cut off; what remains of a document has a length below
the capacity, and of all those lengths only a histogram is needed, which has as
many numbers as the capacity whatever the corpus. Minimum bin slack works on it:
the longest length opens a window, and a subset-sum dynamic programme over a
bitset of reachable fills takes those lengths, with their counts, that come
closest to the room left; the choice is walked back from the bitsets. The same
window is used again for as long as its lengths last. Where even the closest fill
leaves slack, one more remainder is cut to close it, and its rest is a length
like others, so that windows are full but for the last. That is cut into powers
of two, which need no padding.

Remainders of one length differ only in their ordinal: its place within the task
that made it, plus how many there were in the tasks before. A document finds the
windows of its pieces from its length and ordinal alone; no group of documents is
ever gathered.

Defined results: a null or empty text is the end id alone. Rows are packed by row,
so repeated and null ids are packed like others. Columns of docs stay, but for the
text and any of the name of a new column, in any case; an empty table gives none.
Where a run of over 64 KB has a blank it is cut there before it is tokenized, which
changes no id, as no token spans white space (other tokenizers: say `cut=None`).
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_right
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import others, private, public
from .storage import Scratch

NEW = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
#: Words, and pieces of words, that a worker remembers the ids of, and the longest ones that it does.
CACHED_WORDS, LONGEST_CACHED = 3 << 17, 32
# How the default tokenizer normalises texts and cuts them to pieces. Apostrophes can begin a piece.
PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words of Latin letters, digits and ASCII signs but for the apostrophe, and their pieces in lower case.
SIMPLE = re.compile(r"[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch
PIECES = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^0-9a-z\u00DF-\u00F6\u00F8-\u00FF]+").findall
#: Bytes that are no printable Latin-1 characters, as the letters that stand for them in byte-level vocabularies.
_BYTE_LETTERS = {b: 289 + b - 127 for b in range(127, 161)} | {173: 323}
#: Bytes of ids in one batch handed on.
FLUSH = 1 << 22
#: Rows of (task, length) offsets that are broadcast (24 MB); beyond it they are joined by a shuffle.
BROADCAST_OFFSETS = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Table(dict):
    """What `find` says of a text, kept for short ones up to a number of them."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[text] = found
        return found


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    With `cut`, characters that no token spans, texts are encoded by the words
    between them, and ids of short words are kept in a bounded table. For a tokenizer
    that cuts as `PIPELINE` does, a word of Latin letters and ASCII signs is further
    cut to runs of letters, digits, and runs of signs, which its model takes directly.
    """

    def __init__(self, path: str, cut: str | None = " \t\n\r"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = re.compile(f"[^{cut}]+").findall if cut else lambda text: [text]
        given = json.loads(self.tokenizer.to_str())
        self.simple = bool(cut) and all(json.dumps(given[k]) == json.dumps(v) for k, v in PIPELINE.items())
        model = self.tokenizer.model

        def piece(text: str) -> bytes:
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
            return _bytes([t.id for t in model.tokenize(letters)])

        self.pieces, self.known = Table(piece).__getitem__, Table(self._word).__getitem__

    def _word(self, word: str) -> bytes:
        if self.simple and SIMPLE(word) and "<|" not in word:
            return b"".join(map(self.pieces, PIECES(word.lower())))
        return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known, self.words(text)))


@lru_cache(maxsize=1)
def encoder(path: str, cut: str | None) -> Encoder:
    """One for all tasks that a worker runs: what it has looked up stays."""
    return Encoder(path, cut)


def tokenize(docs: DataFrame, tokenizer: str | None = None, end: int | None = 1, text: str = "text", cut: str | None = " \t\n\r") -> DataFrame:
    """docs with `ids`, the whole text's, instead of the text."""
    path = tokenizer or default_tokenizer()
    columns = others(docs, "ids", text)
    rows = private(docs, columns, own=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    schema = rows.drop("own").withColumn("ids", F.lit(b"")).schema
    last = np.array([] if end is None else [end], "<u4").tobytes()

    def run(batches):
        encode = encoder(path, cut)
        for batch in batches:
            kept, at, size, found = batch.drop_columns(["own"]), 0, 0, []
            for i, t in enumerate(batch.column("own")):
                found.append(encode(t.as_py()) + last)
                size += len(found[-1])
                if size > FLUSH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*kept.slice(at, len(found)).columns, pa.array(found, pa.binary())], names=schema.names)
                    at, size, found = i + 1, 0, []

    return rows.mapInArrow(run, schema).select(*public(columns), "ids")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how many of each, whose sum comes closest to room without going beyond it."""
    reached, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            n = min(k, left)
            steps.append((length, n, reached))
            reached |= (reached << (length * n)) & mask
            left, k = left - n, 2 * k
        if reached >> room & 1:
            break
    out, total = defaultdict(int), reached.bit_length() - 1
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            out[length] += n
            total -= length * n
    return dict(out)


class Plan:
    """Which windows the remainders of each length go to.

    `entries[length, shift]`: of the remainders of a length, what is left of them
    from `shift` ids on, in ranges of ordinals, each with (first ordinal, ids
    taken, first window, pieces of it a window, pieces of it before, offset).
    """

    def __init__(self, counts: dict[int, int], capacity: int, first: int = 0):
        self.capacity, self.sequences = capacity, first
        self.entries: dict[tuple[int, int], list] = defaultdict(list)
        self.counts = {n: c for n, c in counts.items() if c and n}
        self.runs = {n: deque([(n, 0, 0, c)]) for n, c in self.counts.items()}
        while self.counts:
            self._window()
        for found in self.entries.values():
            found.sort()

    def _take(self, length: int, n: int, used: int, window: int, each: int, offset: int) -> None:
        """Places n pieces of a length, their first `used` ids; the rest of each is a length again."""
        done = 0
        while done < n:
            origin, shift, first, left = self.runs[length].popleft()
            part = min(left, n - done)
            if part < left:
                self.runs[length].appendleft((origin, shift, first + part, left - part))
            self.entries[origin, shift].append((first, used, window, each, done, offset))
            if used < length:
                self.runs.setdefault(length - used, deque()).append((origin, shift + used, first, part))
                self.counts[length - used] = self.counts.get(length - used, 0) + part
            done += part
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]

    def _window(self) -> None:
        longest = max(self.counts)
        need = fill({**self.counts, longest: self.counts[longest] - 1}, self.capacity - longest)
        need[longest] = need.get(longest, 0) + 1
        slack = self.capacity - sum(length * n for length, n in need.items())
        spare = max((length for length in self.counts if self.counts[length] > need.get(length, 0)), default=0)
        if slack and not spare:
            return self._last(need)
        asked = {**need, spare: need.get(spare, 0) + 1} if slack else need
        times = min(self.counts[length] // n for length, n in asked.items())
        offset = 0
        for length in sorted(need, reverse=True):
            self._take(length, need[length] * times, length, self.sequences, need[length], offset)
            offset += length * need[length]
        if slack:  # what the fill leaves out is longer than the slack
            self._take(spare, times, slack, self.sequences, 1, offset)
        self.sequences += times

    def _last(self, need: dict[int, int]) -> None:
        total = sum(length * n for length, n in need.items())
        pieces = [length for length in sorted(need, reverse=True) for _ in range(need[length])]
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            offset = 0
            while offset < size:
                used = min(pieces[0], size - offset)
                self._take(pieces[0], 1, used, self.sequences, 1, offset)
                offset += used
                pieces[:1] = [pieces[0] - used] if used < pieces[0] else []
            self.sequences += 1

    def pieces(self, length: int, ordinal: int):
        """(ids before it, ids, window, offset) of each piece of a remainder."""
        shift = 0
        while shift < length:
            found = self.entries[length, shift]
            first, used, window, each, before, offset = found[bisect_right(found, (ordinal + 1,)) - 1]
            i = before + ordinal - first
            yield shift, used, window + i // each, offset + i % each * used
            shift += used


def pack(tokens: DataFrame, capacity: int = 2048) -> DataFrame:
    """tokens with `ids`: a row for each piece, with start, length, ids, doc_tokens, sequence_id and offset."""
    scratch = Scratch(tokens.sparkSession)
    columns = others(tokens, *NEW)
    rows = private(tokens, columns, ids=F.col("ids"))
    names = [f"c{i}" for i in range(len(columns))]
    numbered = rows.select("*", *(F.lit(0).cast("long").alias(c) for c in ("part", "rest", "nth", "wholes_before"))).schema

    def number(batches):
        part, seen, wholes = TaskContext.get().partitionId(), np.zeros(capacity, np.int64), 0
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in batch.column("ids")], np.int64)
            out = np.zeros((4, len(sizes)), np.int64)
            for i, n in enumerate(sizes):
                rest = n % capacity
                out[:, i] = part, rest, seen[rest], wholes
                seen[rest] += 1
                wholes += n // capacity
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=numbered.names)

    rows = scratch.written(rows.mapInArrow(number, numbered), "tokens")
    # how many of each length, and whole windows, a task has: as many rows as tasks times lengths
    wholes = F.shiftright(F.octet_length("ids"), 2).cast("long")
    counts = scratch.written(rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(wholes / capacity)).alias("w")), "lengths")
    total = {r["rest"]: r for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}  # at most `capacity` rows
    whole = sum(r["w"] for r in total.values())
    plan = Plan({k: r["n"] for k, r in total.items()}, capacity, whole)
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "rest", F.coalesce(F.sum("n").over(earlier("rest")), F.lit(0)).alias("before"))
    tasks = counts.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(earlier(F.lit(0))), F.lit(0)).alias("tasks_before"))
    before = scratch.written(before.join(tasks, "part"), "offsets")
    rows = rows.join(F.broadcast(before) if before.count() <= BROADCAST_OFFSETS else before, ["part", "rest"])
    rows = rows.select(*names, "ids", "rest", (F.col("nth") + F.col("before")).alias("ordinal"), (F.col("wholes_before") + F.col("tasks_before")).alias("window"))
    placed = rows.select(*names, "ids", *(F.lit(0).cast("long").alias(c) for c in NEW if c != "ids")).schema

    def place(batches):
        for batch in batches:
            kept = batch.select(names)
            owner, cut, numbers, size = [], [], [], 0

            def flush():
                got = kept.take(pa.array(owner, pa.int64()))
                arrays = np.array(numbers, np.int64).reshape(-1, 5).T
                return pa.RecordBatch.from_arrays([*got.columns, pa.array(cut, pa.binary()), *map(pa.array, arrays)], names=placed.names)

            for i, (ids, rest, ordinal, window) in enumerate(zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("rest", "ordinal", "window")))):
                ids = ids.as_py() or b""
                n = len(ids) // 4
                spans = [(s, capacity, window + j, 0) for j, s in enumerate(range(0, n - rest, capacity))]
                spans += [(n - rest + s, used, w, o) for s, used, w, o in plan.pieces(rest, ordinal)]
                for start, used, w, o in spans:
                    owner.append(i)
                    cut.append(ids[4 * start : 4 * (start + used)])
                    numbers.append((start, used, n, w, o))
                    size += 4 * used
                    if size > FLUSH:
                        yield flush()
                        owner, cut, numbers, size = [], [], [], 0
            if owner:
                yield flush()

    return rows.mapInArrow(place, placed).select(*public(columns), *NEW)


def sequences(pieces: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """sequence_id, ids and n_tokens (without padding) of each sequence; those of a power of two stay as they are."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    rows = pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    blank = F.lit(np.full(capacity, pad, "<u4").tobytes())
    short = F.substring(blank, F.lit(1), (4 * (capacity - F.col("n_tokens"))).cast("int"))
    return rows.withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", short)))
