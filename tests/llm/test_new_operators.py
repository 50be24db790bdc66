"""Conversation repair, packing and resampling against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import conversations, packing, queries, resampling

TURNS = "conv_id bigint, turn bigint, role string, text string, place string, Audit int"
ODD_TURNS = [
    (1, None, "user", "first, without a turn."), (1, 2, None, None), (1, 5, "assistant", "an answer!"), (1, 5, "assistant", "an answer!"), (2, None, None, None), (3, 1, "user", ""), (3, 2, "tool", "x" * 300_000), (None, 1, "user", "nobody's."),
    (None, 2, "assistant", "nobody's"), (4, 9, "system", "be good."), (4, 10, "user", "é ß 你好?"), (4, 12, "assistant", " \t"), (5, 1, "assistant", "only"), (6, 1, "system", "only."), (7, 7, "User", "x."), (7, 8, "", "y."),
]


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """What the query should give for the rows of a conversation, by one plain pass over states and whole texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps, seen, faults, ways = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, set(), [], {"": (0, "", ())}

    def put(into, state, way):
        into[state] = min(into.get(state, way), way)

    def inserts(ways):
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                new = "assistant" if state == "u" else "user"
                put(ways, new[0], (cost + 2, audit + "I", (*lines, f"{new}:")))
        return ways

    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
        new: dict = {}
        for state, (cost, audit, lines) in inserts(dict(ways)).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if faults[-1] in ("", "truncated"):
                extra, fresh = faults[-1] == "truncated", "assistant" if state == "u" else "user"
                put(new, fresh[0], (cost + 2 + extra, audit + "R", (*lines, f"{fresh}:{text}")))
                if role[:1] == fresh[0] or (role[:1] == "s" and state == ""):
                    put(new, role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        ways = new
    ends = inserts(dict(ways))
    cost, audit, lines = min(ends[s] for s in ("", "a") if s in ends)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _given(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _checked(rows, got):
    by = damaged(rows)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == repaired(by.get(r["conv_id"], []))


def test_repairs(spark, sf_dir, tmp_path):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    _checked(rows, queries.op11_conversation_repair(spark, sf_dir).collect())
    rnd = random.Random(5)
    hot = [(99, i // 2, rnd.choice(["user", "assistant", "assistant", "system", "tool"]), rnd.choice(["yes.", "no", "", "maybe!", f"own {i}.", f"own {i}"])) for i in range(700)]
    rows = ODD_TURNS + hot
    _checked(rows, queries.op11_conversation_repair(spark, _given(spark, tmp_path, "conversations", [(*r, "clash", 7) for r in rows], TURNS)).collect())


def test_repair_of_nothing(spark, tmp_path):
    assert queries.op11_conversation_repair(spark, _given(spark, tmp_path, "conversations", [], TURNS)).count() == 0
    repair = conversations.Repair(spark.createDataFrame([(1, 1, "user", "a?", "x", 1), (1, 2, "user", "b?", "x", 1), (1, 3, "assistant", "c.", "x", 1)], TURNS))
    assert [(r.place, r.role, r.text, r.edit) for r in repair.rows().orderBy("place").collect()] == [(0, "user", "a?", "K"), (1, "assistant", "", "I"), (2, "user", "b?", "K"), (3, "assistant", "c.", "K")]
    assert [(r.cost, r.audit) for r in repair.report().collect()] == [(2, "KIKK")]


def test_blocks_and_grammars_change_nothing(spark):
    """Whatever a sequence is cut to and compressed by, cost and audit are those of a plain pass."""
    rnd = random.Random(11)
    plain = conversations.Grammar()
    for symbols in ("xsuaoSUAO", "o", "uo", "su", "xu", "UA"):
        grammar = conversations.Grammar()
        for _ in range(40):
            left = [grammar.compress("".join(rnd.choice(symbols) for _ in range(60))) for _ in range(3)]
            pairs = Counter(x[i : i + 2] for x in left for i in range(len(x) - 1))
            for pair in conversations.replacements(list(pairs.items()), 2):
                grammar.add(pair)
        for size in (0, 1, 2, 5, 17, 400):
            text = "".join(rnd.choice(symbols) for _ in range(size))
            cuts = sorted(rnd.sample(range(size + 1), min(3, size + 1)))
            blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, size])]
            rows = [(i, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "" if c == "x" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(text)]
            want = repaired(rows)
            assert conversations.solve(grammar, blocks) == conversations.solve(plain, [text]) == (want[5], want[6])


def test_grammar_is_fitted(spark):
    rows = spark.createDataFrame([("uaua" * 5,), ("suaua" * 3,), ("x",), ("",)], "symbols string")
    grammar = conversations.fit_grammar(rows)
    assert grammar.rules and len(grammar.compress("uaua" * 5)) < 6
    assert conversations.fit_grammar(rows.limit(0)).rules == []


def _pieces_fit(pieces, capacity):
    """Every id of every row lies in one piece; sequences are gapless. Returns the padding."""
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


ODD_DOCS = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "a b " * 9000), (6, "<|endoftext|> it's ΑΣ É"), (6, "same id"), (7, "same text"), (7, "same text"), (None, "x y z"), (None, None), (8, "é" * 70_000), (9, "\x00\x1c 12 !?"), (10, "don't " * 600)]


def test_packing_of_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    schema = "doc_id bigint, text string, LENGTH int, offset string, other int"
    docs = spark.createDataFrame([(*r, 1, "x", 3) for r in ODD_DOCS], schema).repartition(3)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    encoded = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in ODD_DOCS]
    for capacity in (64, 2048):
        packed = packing.pack(packing.tokenize(docs), capacity)
        assert set(packed.columns) == {"doc_id", "other", *packing.NEW}
        pieces = packed.collect()
        assert _pieces_fit(pieces, capacity) == 0
        # rows that share an id are told apart by their pieces: together they have the ids of all of them
        want, got = Counter(), Counter()
        for (doc_id, _), ids in zip(ODD_DOCS, encoded):
            want.update((doc_id, len(ids) // 4, i, ids[4 * i : 4 * i + 4]) for i in range(len(ids) // 4))
        for p in pieces:
            got.update((p.doc_id, p.doc_tokens, p.start + i, bytes(p.ids[4 * i : 4 * i + 4])) for i in range(p.length))
        assert got == want
    whole = packing.sequences(packed, 2048, pad=5).collect()
    assert sum(s.n_tokens for s in whole) == sum(len(x) // 4 for x in encoded) and all(len(s.ids) in (4 * s.n_tokens, 8192) for s in whole)
    assert packing.pack(packing.tokenize(docs.limit(0))).count() == 0


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(packing.default_tokenizer()), queries.op12_packing(spark, sf_dir).collect()
    assert _pieces_fit(pieces, 2048) == 0
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[d.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert len(pieces) < 1.3 * len(docs) + sum(p.length == 2048 for p in pieces)


@pytest.mark.parametrize("counts", [{1100: 1000}, {2047: 7}, {1: 5000}, {3: 1}, {1500: 1, 700: 2}, {}, {2047: 1, 1: 1}, {i: 1 + i % 3 for i in range(1, 2048)}])
def test_plans(counts):
    plan = packing.Plan(counts, 2048)
    pieces, spans = [], defaultdict(list)
    for length, n in counts.items():
        for ordinal in range(n):
            found = list(plan.pieces(length, ordinal))
            assert [s for s, *_ in found] == [sum(u for _, u, _, _ in found[:i]) for i in range(len(found))] and sum(u for _, u, _, _ in found) == length
            pieces += found
    for _, used, window, offset in pieces:
        spans[window].append((offset, used))
    total = sum(n * c for n, c in counts.items())
    sizes = [sum(u for _, u in s) for s in spans.values()]
    assert sum(sizes) == total and sorted(spans) == list(range(plan.sequences)) and sum(s != 2048 for s in sizes) == bin(total % 2048).count("1")
    assert all(sum(u for _, u in sorted(s)[:i]) == sorted(s)[i][0] for s in spans.values() for i in range(len(s)))


def test_fill_is_the_closest():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 60): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room, reached = rnd.randint(1, 120), {0}
        for n, c in counts.items():
            reached = {r + n * k for r in reached for k in range(c + 1)}
        got = packing.fill(counts, room)
        assert all(got[n] <= counts[n] for n in got) and sum(n * k for n, k in got.items()) == max(r for r in reached if r <= room)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _features(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _resampled(docs, target):
    rows = [(i, *_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for text in target:
        t.update(_features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    out = []
    for at, (i, words, f) in enumerate(rows):
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (n + 10_000) / ((s[x] + 1) * (m + 10_000)))) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def _found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_resampling(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert _found(queries.op13_importance_resampling(spark, sf_dir)) == _resampled(docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])


def test_resampling_of_odd_rows(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["Alpha", "bêta", "g9", "x" * 60, "δ", "it's"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "w" * 200_000), (1003, "a b c d e " * 20_000), (None, "same " * 30), (None, "q " * 25)]
    schema = "doc_id bigint, text string, SCORE int, weight string, n_words int, other int"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema).repartition(4)
    target = spark.createDataFrame([("alpha bêta",), (None,), ("g9 g9 g9",)], "text string")
    got = resampling.resample(docs, target)
    assert set(got.columns) == {"doc_id", "other", *resampling.NEW}
    assert _found(got) == _resampled(rows, ["alpha bêta", None, "g9 g9 g9"])
    assert resampling.resample(docs.limit(0), target).count() == 0 and resampling.resample(docs.limit(5), target.limit(0)).count() == 5
    # rows that are the same in all they say are drawn one by one
    same = spark.createDataFrame([(7, "one two " * 12)] * 100, "doc_id bigint, text string")
    assert sorted(r["rank"] or 0 for r in resampling.resample(same, target).collect()) == [0] * 95 + [1, 2, 3, 4, 5]


def test_quickselect(spark):
    keys = spark.range(500).select(F.struct((F.col("id") * 7919 % 500).alias("a"), F.col("id").alias("b")).alias("k"))
    for k in (1, 2, 250, 499, 500):
        last = resampling.quickselect(keys, "k", k, pivots=3)
        assert keys.filter(F.col("k") <= last).count() == k
    assert resampling.quickselect(keys, "k", 501) is None and resampling.quickselect(keys.limit(0), "k", 1) is None


def test_checksums():
    rnd = random.Random(9)
    words = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(60), 1000, 70_000]]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    crcs = resampling.span_crcs(data, ends - [len(w) for w in words], ends)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    lengths = np.array([len(w) for w in words])
    assert resampling.joined_crcs(crcs, crcs[::-1].copy(), lengths[::-1]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[::-1])]
