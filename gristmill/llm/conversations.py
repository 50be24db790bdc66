"""Repairing the structure of conversations by grammar-compressed dynamic programming.

A conversation should have the roles of `(system? (user assistant)+)?`. Edits keep a
row, give it another role, delete it, or insert one without text, at a cost each;
the cheapest are asked for, ties by the least text of the edits' initials.

What an edit costs depends on a row's role and fault alone, one of nine symbols. A
symbol is a min-plus transfer matrix between four states: nothing, system, user,
assistant seen. Re-Pair builds one grammar for the symbol sequences of all
conversations: each round counts neighbouring symbols over the distinct sequences
and replaces the most frequent pairs, chosen so that they don't overlap, by new
symbols. The matrix of a rule is the product of its two, with the initials of the
cheapest edits as a rope, made once, bottom-up, and shared by all conversations. A
conversation is a row vector times the matrices of what its sequence is compressed
to.

Two ways of the same cost are told apart by the first initial in which they differ;
where one way is the beginning of the other, what differs comes later. So each two
states carry the order of their ways, or what one has beyond the other, and no
ways are compared from their beginnings again.

Rows are numbered in ranges of (conversation, turn, role, digest of the text), and
sequences cut to blocks of `BLOCK` rows, so that a conversation with any share of all
rows is spread over tasks; one task sees its blocks' symbols, one character a row,
and only to join them. Texts are moved once to what stays of them.

Defined results: turns order rows, nulls first, then roles, then digests of texts; a
null role or text is one space; null conversation ids are one conversation, null
turns are left out of gaps. A row that equals an earlier one of its conversation in
role and text is a duplicate, wherever it stands. Roles other than user, assistant
and system (by their first letter, as it is) can be deleted or changed only. Other
columns are not carried; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from itertools import groupby, islice, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .storage import Scratch

KEEP, REROLE, DELETE, INSERT = "KRDI"
RELABEL_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Rows of one block of a conversation's symbols.
BLOCK = 1 << 12
#: Rounds of the grammar, and pairs that each replaces; what is left uncompressed is multiplied as it is.
ROUNDS, PAIRS = 12, 32
#: Sequences whose edits a task remembers.
REMEMBERED = 1 << 14

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: x: must go; otherwise the role, in capitals where truncated; o is any other role.
SYMBOLS = "xsuaoSUAO"
_NEXT_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_TARGET = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
Rope = tuple | str


def text_of(rope: Rope) -> str:
    """The initials of a rope, from left to right."""
    out, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            todo.extend((top[1], top[0]))
    return "".join(out)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def least(ways) -> tuple[int, Rope]:
    ways = list(ways)
    cost = min(c for c, _ in ways)
    ways = [r for c, r in ways if c == cost]
    return cost, ways[0] if len(ways) == 1 else min(map(text_of, ways))


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; a missing entry can't be reached."""
    out = {}
    for i, j in product(STATES, STATES):
        ways = [(a[i, k][0] + b[k, j][0], (a[i, k][1], b[k, j][1])) for k in STATES if (i, k) in a and (k, j) in b]
        if ways:
            out[i, j] = least(ways)
    return out


def _inserts() -> Matrix:
    """No, one or two inserted rows: more are never needed."""
    out = {(i, i): (0, "") for i in STATES}
    for i in STATES:
        j = _NEXT_INSERT[i]
        for n in (1, 2):
            out.setdefault((i, j), (n * INSERT_COST, INSERT * n))
            j = _NEXT_INSERT[j]
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before a row, and its own edit."""
    ways: dict[tuple[int, int], list] = {(i, i): [(DELETE_COST, DELETE)] for i in STATES}
    if symbol != "x":
        extra, role = TRUNCATED_COST * symbol.isupper(), symbol.lower()
        for i in STATES:
            ways.setdefault((i, _TARGET[i]), []).append((RELABEL_COST + extra, REROLE))
            if role == "s" and i == START:
                ways.setdefault((i, SYSTEM), []).append((extra, KEEP))
            elif (role, _TARGET[i]) in (("u", USER), ("a", ASSISTANT)):
                ways.setdefault((i, _TARGET[i]), []).append((extra, KEEP))
    return times(_inserts(), {at: least(w) for at, w in ways.items()})


def replacements(counts: list[tuple[str, int]], pairs: int = PAIRS) -> list[str]:
    """Of pairs of symbols with their counts, the most frequent, such that none overlaps another."""
    first, second, out = set(), set(), []
    for pair, n in sorted(counts, key=lambda c: (-c[1], c[0])):
        x, y = pair
        apart = x not in first | second if x == y else x not in second and y not in first
        if n > 1 and apart and len(out) < pairs:
            out.append(pair)
            first.add(x)
            second.add(y)
    return out


class Grammar:
    """Rules (pair, symbol) in the order in which they were made, and the matrix of each symbol."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrices: dict[str, Matrix] = {s: symbol_matrix(s) for s in SYMBOLS}

    def add(self, pair: str) -> str:
        symbol = chr(0x4E00 + len(self.rules))
        self.rules.append((pair, symbol))
        self.matrices[symbol] = times(self.matrices[pair[0]], self.matrices[pair[1]])
        return symbol

    def compress(self, sequence: str) -> str:
        for pair, symbol in self.rules:
            sequence = sequence.replace(pair, symbol)
        return sequence


def fit_grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> Grammar:
    """Re-Pair over sequences (column `symbols`), each round a count of pairs over all of them."""
    scratch, grammar = Scratch(sequences.sparkSession), Grammar()
    left = sequences.select("symbols").filter(F.length("symbols") > 1)
    for _ in range(rounds):
        left = scratch.written(left.distinct(), "sequences")
        both = F.transform(F.sequence(F.lit(1), F.length("symbols") - 1), lambda i: F.substring("symbols", i, F.lit(2)))
        # symbols, and so pairs, are bounded by the rounds
        counts = left.select(F.explode(both).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        chosen = replacements([(r["pair"], r["n"]) for r in counts.collect()], pairs)
        if not chosen:
            break
        new = F.col("symbols")
        for pair in chosen:
            new = F.replace(new, F.lit(pair), F.lit(grammar.add(pair)))
        left = left.select(new.alias("symbols")).filter(F.length("symbols") > 1)
    scratch.drop()
    return grammar


class Vector:
    """Cheapest ways from nothing to each state, over what has been read so far.

    `trail` has, for each step and state, the state before and the rope in between.
    `beyond[i, j]`: -1 if the way to i is the lesser one, 1 if that to j is, or the
    initials by which (the way to i, the way to j) go on where the other ends.
    """

    def __init__(self):
        self.costs, self.trail = {START: 0}, []
        self.beyond: dict[tuple[int, int], int | tuple[str, str]] = {(START, START): ("", "")}

    def _order(self, i: int, a: Rope, j: int, b: Rope):
        """As `beyond`, for the way to i and then a against the way to j and then b."""
        sofar = self.beyond[i, j]
        if isinstance(sofar, int):
            return sofar
        x, y = sofar[0] + text_of(a), sofar[1] + text_of(b)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return -1 if x < y else 1
        return x[n:], y[n:]

    def step(self, matrix: Matrix) -> None:
        costs, came = {}, {}
        for j in STATES:
            ways = [(self.costs[k] + matrix[k, j][0], k) for k in self.costs if (k, j) in matrix]
            if not ways:
                continue
            costs[j] = min(c for c, _ in ways)
            best, *rest = [k for c, k in ways if c == costs[j]]
            for k in rest:
                order = self._order(k, matrix[k, j][1], best, matrix[best, j][1])
                if order == -1 or (isinstance(order, tuple) and order[1]):  # lesser, or its beginning
                    best = k
            came[j] = best, matrix[best, j][1]
        self.beyond = {(i, j): self._order(*came[i], *came[j]) for i in came for j in came}
        self.costs = costs
        self.trail.append(came)

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the cheapest way to an end: nothing, or after an assistant."""
        self.step(_INSERTS)
        ends = [j for j in (START, ASSISTANT) if j in self.costs]
        best = min(self.costs[j] for j in ends)
        ends = [j for j in ends if self.costs[j] == best]
        state = ends[0]
        if len(ends) > 1:
            order = self.beyond[ends[0], ends[1]]
            state = ends[0] if order == -1 or (isinstance(order, tuple) and not order[0]) else ends[1]
        ropes = []
        for came in reversed(self.trail):
            state, rope = came[state]
            ropes.append(rope)
        return best, "".join(map(text_of, reversed(ropes)))


_INSERTS = _inserts()


def solve(grammar: Grammar, blocks: list[str]) -> tuple[int, str]:
    """Cost and audit of a conversation from the symbols of its blocks."""
    vector = Vector()
    for block in blocks:
        for symbol in grammar.compress(block):
            vector.step(grammar.matrices[symbol])
    return vector.finish()


def _columns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; nulls of the last two are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", space("role"), space("text"))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left when a checksum of conversation and turn, modulo 20, decides.

    0: gone, 1: without text, 2: without ends of sentences, 3: there twice, 4: the user's.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = _columns(rows).withColumn("k", F.crc32(named.cast("binary")) % 20).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def edits_of(audit: str, symbols: str):
    """(index of the row or None, place, edit, new role or None) of what an audit leaves of a conversation."""
    state, i, place = START, 0, 0
    for edit in audit:
        at = None if edit == INSERT else i
        i += at is not None
        if edit == DELETE:
            continue
        role = None
        if edit == KEEP:
            state = "sua".index(symbols[at].lower()) + SYSTEM
        else:
            state = _TARGET[state]
            role = "user" if state == USER else "assistant"
        yield at, place, edit, role
        place += 1


_FAULTS = ("blank", "duplicate", "truncated")
_KEY = ("conv_id", "turn", "role", "digest")


class Repair:
    """The cheapest repair of conversations (conv_id, turn, role, text): `report` and `rows`."""

    def __init__(self, conversations: DataFrame):
        self.scratch = Scratch(conversations.sparkSession)
        self.source = _columns(conversations).withColumn("digest", F.unhex(F.sha2("text", 256)))
        self.numbered = self._numbered()
        self.blocks = self._blocks()
        self.grammar = fit_grammar(self.blocks.select("symbols"))
        self.edits = self.scratch.written(self._edits(), "edits")

    def _numbered(self) -> DataFrame:
        """Rows without texts, with numbers in the order of conversations."""
        last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        order = [F.col(c).asc_nulls_first() for c in _KEY]
        rows = self.source.select(*_KEY, last.alias("last")).repartitionByRange(*order).sortWithinPartitions(*order)
        return self.scratch.written(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")

    def _blocks(self) -> DataFrame:
        """Faults counted, and symbols and initials as text, of up to `BLOCK` rows of a conversation from `pos` on."""
        blank = F.col("last") == ""
        firsts = self.numbered.filter(~blank).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
        rows = self.numbered.join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left")
        fault = F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
        initial = F.substring("role", 1, 1)
        rows = rows.withColumns({"fault": fault, "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o")})
        symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
        turns = F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("turns")
        found = rows.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(turns, *(F.count_if(F.col("fault") == f).alias(f) for f in _FAULTS))
        string = lambda c: F.array_join(F.transform("turns", lambda t: t[c]), "").alias(f"{c}s")
        return self.scratch.written(found.select("conv_id", F.col("turns")[0]["pos"].alias("pos"), string("symbol"), string("initial"), *_FAULTS), "blocks")

    def _edits(self) -> DataFrame:
        """One row a conversation, with its audit, and one for each row that stays or comes in, with its place."""
        grammar = self.grammar
        counted = [F.lit(0).cast("long").alias(c) for c in (*_FAULTS, "illegal", "cost")]
        schema = self.blocks.select("conv_id", *counted, F.lit("").alias("audit"), "pos", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), F.lit("").alias("new_role")).schema
        for field in schema.fields:
            field.nullable = True

        types = to_arrow_schema(schema).types

        def conversation(conv, blocks: list, memory: dict):
            symbols = "".join(b["symbols"] for b in blocks)
            initials = "".join(b["initials"] for b in blocks)
            if symbols not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[symbols] = solve(grammar, [b["symbols"] for b in blocks])
            cost, audit = memory[symbols]
            legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
            yield (conv, *(sum(b[f] for b in blocks) for f in _FAULTS), len(initials) - 1 - legal, cost, audit, None, None, None, None)
            at = [b["pos"] + i for b in blocks for i in range(len(b["symbols"]))] if len(blocks) > 1 else range(blocks[0]["pos"], blocks[0]["pos"] + len(symbols))
            for i, place, edit, role in edits_of(audit, symbols):
                yield (conv, *[None] * 6, None if i is None else at[i], place, edit, role)

        def run(batches):
            rows, memory = (row for batch in batches for row in batch.to_pylist()), {}
            found = (x for conv, own in groupby(rows, key=lambda r: r["conv_id"]) for x in conversation(conv, list(own), memory))
            while part := list(islice(found, 1 << 14)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=schema.names)

        rows = self.blocks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos")
        return rows.mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation with rows."""
        turns = self.numbered.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
        gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        found = self.edits.filter("audit IS NOT NULL").select(F.col("conv_id").alias("c"), *_FAULTS, "illegal", "cost", "audit")
        return gaps.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def rows(self) -> DataFrame:
        """conv_id, place (from 0), turn, role, text, edit: conversations as they are repaired; rows put in have no turn."""
        # a row is found by all that it says: of rows that say the same, one stays at most
        key = F.sha2(F.to_json(F.struct(*_KEY)), 256).alias("key")
        texts = self.source.select(key, "text").dropDuplicates(["key"])
        left = self.edits.filter("place IS NOT NULL").select("conv_id", "pos", "place", "edit", "new_role")
        old = left.filter("pos IS NOT NULL").drop("conv_id").join(self.numbered.select("pos", *_KEY), "pos")
        old = old.select(key, "conv_id", "place", "turn", F.coalesce("new_role", "role").alias("role"), "edit").join(texts, "key").drop("key")
        new = left.filter("pos IS NULL").select("conv_id", "place", F.lit(None).alias("turn"), F.col("new_role").alias("role"), "edit", F.lit("").alias("text"))
        return old.unionByName(new)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its rows (role:text, a line each, by place).

    A digest reads from the beginning to the end: a conversation's rows pass one
    task, sorted, one after the other, and none are kept.
    """
    schema = rows.select("conv_id", F.lit("").alias("sha256")).schema

    def run(batches):
        conv, own, done = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if own is None or c != conv:
                    if own is not None:
                        done.append((conv, own.hexdigest()))
                    conv, own = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    own.update(f"\n{role}:{text}".encode())
            if len(done) > 1 << 12:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (batch.schema.field("conv_id").type, pa.string()))], names=schema.names)
                done = []
        if own is not None:
            done.append((conv, own.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (batch.schema.field("conv_id").type, pa.string()))], names=schema.names)

    ordered = rows.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    return ordered.mapInArrow(run, schema)
