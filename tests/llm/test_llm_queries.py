"""The operators' queries against their SQL, and their edge cases on small tables."""

import base64
import hashlib
import itertools
import math
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, language_crf, licenses, line_dedup, mixing, ngram_join, oracles, quality_knn, quality_rules, queries, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, id int, rate string, items int"
LONG = "this is a long line that every one of them has"
WORDS = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\n ", None, None), (4, "x", "en", "a"), (5, f"{LONG}\nown five", "en", "b"), (6, f"  {LONG.upper()}\t\nown six", "en", "b"),
    (7, f"{LONG}\n{LONG}\nown seven", "en", "b"), (8, WORDS, "en", "a"), (8, WORDS, "en", "a"), (9, WORDS + " more", "en", "a"), (None, WORDS, "en", None), (None, "é ß 你好 " * 3, "de", "c"),
    (10, "w " * 70_000, "en", "a"), (11, "\x00\x7f###  $$$ %%% || <>", "en", "a"), (12, "one two three four", "fr", "a"), (13, "One, two; three FOUR!", "fr", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, la, s, len(t or ""), "clash", 7, "clash", 7) for i, t, la, s in ODD]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(name, spark, duck, same, sf_dir):
    same(queries.QUERIES[name](spark, sf_dir), duck, oracles.ORACLES[name])


def test_pipeline_oracle(spark, duck, same, sf_dir):
    same(corpus_pipeline.run(spark, sf_dir), duck, corpus_pipeline.ORACLE_SQL)


def test_native_license_scan_has_no_python(spark, sf_dir):
    plan = queries.op1_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_rules(spark, odd, empty):
    mit = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    rows = [(1, mit), (2, "foo | bar\nReleased under the MIT License."), (3, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (4, "the license of nothing"), (5, None), (6, "")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0", "CC-BY-NC-4.0"], 4: [], 5: [], 6: []}
    assert all(re.search(licenses.ANCHORS, s) for k, s in licenses.SENTENCES.items() if not s.startswith("under "))
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


@pytest.mark.parametrize("text, want", [
    ("This project is released under the MIT License.", ["MIT"]), ("Code licensed under the Apache-2.0 license.", ["Apache-2.0"]), ("This software is licensed under the MIT License (see LICENSE).", ["MIT"]),
    ("# SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", ["GPL-3.0-or-later"]), ("All content is available under the terms of the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("The library is dual licensed under the BSD 3-Clause License. See LICENSE for details.", ["BSD-3-Clause"]), ("Licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("We talked under the old bridge about a fishing license.", []), ("He was licensed under the old rules.", []), ("The MIT campus is large.", []),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", ["Apache-2.0"]),
])
def test_license_notices_in_other_words(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().licenses == want


def _lines(rows, least=3):
    """Brute force of the contract for line dedup."""
    strip = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    holders = {}
    ident = lambda i: -(1 << 63) if i is None else i
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(strip(line), set()).add(ident(i))
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= least}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(strip(x), ident(i)) == ident(i)]
        out.append((ident(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_edges(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == _lines(ODD)
    assert got.columns[:9] == odd.columns and line_dedup.dedup_lines(empty).count() == 0


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_lines_made_to_collide_modulo_powers_of_two(spark):
    """The two words agree under every polynomial hash modulo 2^64."""
    one, other = _thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, other), (3, other), (4, f"{one}\n{other}")], "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == _lines(rows)
    assert [r.n_dup_lines for r in quality_rules.ledger(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    bench = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    assert [r.n_hit for r in decontaminate.find_contamination(docs, bench).orderBy("doc_id").collect()] == [1, 0, 0, 1]
    assert {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_line_index_serves_any_number_of_documents(spark, monkeypatch):
    """Several shards, each copied, and a line that most documents have."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "PROBES", 8)
    line = lambda i: f"line {i} is of more than twenty characters"
    rows = [(i, "\n".join([line(0), *(line(j) for j in range(1, 100) if i % j == 0), f"own line of document {i}"])) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, line(0)), (None, f"{line(0)}\n{line(3)}")], "doc_id bigint, text string")
    for least in (2, 3, 10):
        got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, min_docs=least).collect())
        assert got == _lines([(r.doc_id, r.text) for r in docs.collect()], least)
    index, shards = line_dedup.line_index(docs.select(F.coalesce("doc_id", F.lit(line_dedup.NULL_ID)).alias("id"), "text"))
    assert shards > 3 and index.count() == shards and index.agg(F.max("copies")).first()[0] > 10


CLASHES = ["Rate", "COPY", "N_LINES", "N_words", "N_HIT", "Items", "Licenses", "__rate", "__source", "__text", "__id", "__kept", "__hits", "id", "Key", "mark", "c0", "Words", "failed_BITS"]


def test_columns_that_clash_in_any_case(spark):
    docs = spark.createDataFrame([(i, WORDS, "a", *range(len(CLASHES))) for i in range(3)], f"doc_id bigint, text string, source string, {', '.join(f'`{c}` int' for c in CLASHES)}")
    bench = spark.createDataFrame([(1, "word1 word2")], "item_id bigint, text string")
    results = [
        (mixing.mix(docs), ("rate", "copy", "shuffle_key")),
        (line_dedup.dedup_lines(docs), ("n_lines", "n_dropped")),
        (quality_rules.ledger(docs), (*quality_rules.MEASURES, "failed_bits")),
        (decontaminate.find_contamination(docs, bench), ("n_words", "n_hit", "items", "hit_spans")),
        (licenses.scan(docs), ("sentence_ids", "licenses", "n_known")),
    ]
    for got, new in results:
        assert got.count() >= 1
        assert set(got.columns) >= {c for c in CLASHES if c.lower() not in new} | set(new)
        assert all(r[c] == i for r in got.collect() for i, c in enumerate(CLASHES) if c.lower() not in new)


def test_perfect_hash():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 20_000).astype(np.uint64))
    index = line_dedup.PerfectHash.build(keys)
    assert sorted(index(keys)) == list(range(len(keys)))
    again = line_dedup.PerfectHash.load(*index.dump())
    assert (again(keys) == index(keys)).all()


def test_warc_round_trip(spark):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, "u3", "same"), (4, "u4", None), (7, "u7", ""), (None, "un", "same"), (8, "u\r\n8", "lone é"), (8, "u8", "lone é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")
    back = warc.record_bytes(warc.read_archive(spark, warc.write_archive(pages))).withColumn("refers_to", warc.referred_page("refers_to_record")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.page_id, bytes(r.payload)) for r in back), key=key) == sorted(((i, (h or "").encode()) for i, _, h in rows), key=key)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in back)
    assert kinds == [("1", "revisit", 5), ("3", "revisit", 5), ("4", "revisit", 7), ("5", "response", None), ("7", "response", None), ("8", "response", None), ("8", "response", None), ("None", "revisit", 5)]
    names = {r.header.split("\r\n")[2] for r in back}
    assert len(names) == len(rows)
    for r in back:
        payload = bytes(r.payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.stated_digest == "sha1:" + digest and r.payload_digest == digest and r.payload_bytes == len(payload)
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert body == payload + b"\r\n\r\n" and f"Content-Length: {len(payload)}".encode() in head and b"WARC-Type: response" in head
        assert (r.revisit is None) == (r.record_type == "response")
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_warc_addresses_cannot_pass_for_headers(spark):
    urls = ["http://x/?q=WARC-Refers-To: <urn:page:9>", "http://x/WARC-Type: revisit", "http://x/\u2028WARC-Refers-To: <urn:page:77:0>\u2028", "http://x/a b\r\nWARC-Type: revisit\r\n", "http://x/%20?a=b&c=d#e", "http://x/😀é"]
    pages = spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    back = {r.page_id: r for r in warc.read_archive(spark, warc.write_archive(pages)).collect()}
    quoted = lambda u: re.sub(r"[^!#-;=?-\[\]_a-z~]+", lambda m: urllib.parse.quote(m[0], safe=""), u)
    assert {i: r.url for i, r in back.items()} == {i: quoted(u) for i, u in enumerate(urls)}
    assert all(r.record_type == "response" and r.refers_to_record is None for r in back.values())
    assert back[4].url == urls[4]


def test_warc_small_payloads_are_not_shared(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archive(spark, warc.write_archive(pages, min_revisit_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def _rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_edges(odd, empty):
    entries = quality_rules.ledger(odd)
    rows = entries.withColumn("base", quality_rules.passes("base")).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted(_rules(t) for _, t, *_ in ODD)
    assert all(r.base == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words) for r in rows)
    assert quality_rules.ledger(empty).count() == 0
    for policy, names in quality_rules.POLICIES.items():
        left_out = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality_rules.ablations(entries, policy).collect()}
        mask = quality_rules.bits(names)
        masks = [r.failed_bits & mask for r in rows]
        assert left_out == {n: (sum(m & b > 0 for m in masks), sum(m == b for m in masks), sum(not m & ~b for m in masks)) for n in names for b in [quality_rules.bits((n,))]}


def _contamination(text, items, n=13):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        v = words_of(t)
        k = min(n, len(v))
        runs = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in runs:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), ",".join(sorted(found))


def test_decontamination_edges(spark, odd, empty):
    items = [("1", " ".join(f"word{i}" for i in range(20, 40))), ("2", "two three four"), ("3", "W"), ("4", None), ("5", ""), ("10", "word59"), ("11", " ".join(["w"] * 14)), ("12", "你好 é")]
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id bigint, text string")
    got = sorted((r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.find_contamination(odd, bench).collect())
    assert got == sorted(_contamination(t, items) for _, t, *_ in ODD)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("broadcast_hits", [1_000_000, 0])
def test_winnowing_finds_every_shared_span(spark, monkeypatch, broadcast_hits):
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", broadcast_hits)
    rng = np.random.RandomState(3)
    vocabulary = [f"v{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(str(i), say(rng.randint(1, 40))) for i in range(20)]
    docs = [(i, f"{say(rng.randint(0, 30))} {items[i % 20][1]} {say(rng.randint(0, 30))}") for i in range(60)]
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {i: _contamination(t, items) for i, t in docs}


def _poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_edges(odd, empty, spark):
    out = mixing.mix(odd, weights={"a": 3.0, "b": 1.0, "c": 0.0}, seed=4)
    got = Counter((r.doc_id, r.source) for r in out.collect())
    total, n = len(ODD), Counter(s for *_, s in ODD)
    want = Counter()
    for i, _, _, s in ODD:
        rate = {"a": 3.0, "b": 1.0}.get(s, 0.0) / 4 * total / n[s]
        u = (int(hashlib.md5(f"4|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[i, s] += _poisson(u, rate) if rate else 0
    assert +got == +want
    keys = [r.shuffle_key for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mix(empty).count() == 0 and out.columns.count("rate") == 1


def test_mixing_salted_join_is_the_same(odd, monkeypatch):
    rows = lambda: sorted((str(r.doc_id), r.copy, r.shuffle_key, r.source or "") for r in mixing.mix(odd).collect())
    few = rows()
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert rows() == few


def test_large_means(spark, monkeypatch):
    rates = spark.createDataFrame([("a", 800.0), ("b", 5000.0), (None, 0.0)], "source string, rate double")
    by = {r.source: r for r in mixing.poisson_tables(rates).collect()}
    assert abs(by["a"].table[800] - 0.5) < 0.02 and by["a"].table[-1] == pytest.approx(1, abs=1e-9) and by["a"].draws == 1
    assert by["b"].draws == 5 and len(by["b"].table) < 1500 and by[None].table == [1.0]
    # a mean of 40 as the sum of draws of means up to 8 is as spread as a Poisson number
    monkeypatch.setattr(mixing, "LARGEST_MEAN", 8)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    n = np.array([r.n for r in mixing.mix(docs, total=80_000).groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    assert abs(n.mean() - 40) < 0.6 and abs(n.var() - 40) < 4


def test_repeated_ids_do_not_stay_together(spark):
    docs = spark.createDataFrame([(7, f"text {i}", "a") for i in range(50)], "doc_id bigint, text string, source string")
    assert len({r.shuffle_key for r in mixing.mix(docs, total=200).collect()}) > 50


def _near(rows):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    links = Counter()
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.RandomState(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):  # near copies with one to three words changed, and copies of some
        w = list(base)
        for j in rng.randint(0, 120, rng.randint(1, 4)):
            w[j] = f"x{i}"
        rows += [(3 * i, " ".join(w))] + [(3 * i + 1, " ".join(w))] * (i % 3 == 0)
    rows += [(1000 + i, " ".join(f"r{rng.randint(500)}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A, b"), (2004, "a b c d e")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == _near(rows)


def test_equal_and_long_items_by_shuffled_joins(spark):
    """Many items of equal text and a long item, with no side of any join broadcast."""
    same, long = " ".join(f"s{i}" for i in range(20)), " ".join(f"l{i}" for i in range(612))
    bench = spark.createDataFrame([(i, same) for i in range(100)] + [(100, long)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, same), (2, long), (3, f"x {same} y {same}"), (4, "x")], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    every = sorted(str(i) for i in range(100))
    assert got == {1: (20, 20, every), 2: (612, 612, ["100"]), 3: (42, 40, every), 4: (1, 0, [])}


def test_near_duplicates_edges(odd, empty):
    got = ngram_join.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and ngram_join.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_links == by[2].n_links == by[3].n_links == 0
    assert by[12].class_id == by[13].class_id == 12 and by[8].class_id == by[9].class_id
    # rows without an id are documents by their texts
    assert sorted((r.class_id or 0, r.n_links) for r in rows if r.doc_id is None) == [(0, 0), (8, 2)]


def test_posterior_bound():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert len(least) == 8 and least == sorted(least) and least[-1] < 0.8 * 128
    # a Beta(m + 1, n - m + 1) posterior, integrated
    s = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip(range(16, 129, 16), least):
        for k, above in ((m, True), (m - 1, False)):
            if k >= 0:
                density = s**k * (1 - s) ** (n - k)
                assert (density[s >= 0.8].sum() / density.sum() >= 1e-6) == above


def test_pipeline_edges(spark, odd, tmp_path):
    bench = spark.createDataFrame([(1, "word1 word2")], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs0 in (docs, docs.limit(0)):
        rows = docs0
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns
        corpus_pipeline.mix_sources(spark, rows, str(tmp_path)).count()


def _kept(spark, docs):
    rows = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    return Counter((r.doc_id, r.text) for r in rows)


def test_pipeline_near_duplicates_by_row(spark):
    """Rows that share a doc_id, or have none, stay unless their texts are near-duplicates."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(50))
    rows = [(i, text(f"n{k}x")) for k, i in enumerate([None] * 5 + [7] * 5)]
    rows += [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("b")), (2, text("c")), (2, text("c"))]
    rows += [(4, ""), (4, ""), (None, ""), (None, ""), (5, None)]
    want = Counter(rows[:10] + [(1, text("a")), (2, text("b")), (2, text("c")), (4, ""), (None, ""), (None, ""), (5, None)])
    assert _kept(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == want


def test_pipeline_keeps_one_of_a_group_with_a_null_id(spark, odd):
    # of documents 5 and 6, eight n-grams of ten are shared
    gone = Counter([(8, WORDS), (9, WORDS + " more"), (None, WORDS), (13, "One, two; three FOUR!"), ODD[5][:2]])
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert _kept(spark, docs) == Counter((i, t) for i, t, *_ in ODD) - gone


def test_subsequence_kernel():
    def brute(s, t):
        total = 0.0
        for i in itertools.combinations(range(len(s)), toxicity.LENGTH):
            for j in itertools.combinations(range(len(t)), toxicity.LENGTH):
                if [s[a] for a in i] == [t[b] for b in j]:
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    pairs = [("idiot", "idiot"), ("i.d.iot", "idiot"), ("moron", "oron"), ("abcabc", "cba"), ("ab", "abc"), ("trash", "thrashing")]
    s, t = (toxicity._rows([p[i].encode() for p in pairs]) for i in (0, 1))
    assert np.allclose(toxicity.subsequence_kernel(s, t), [brute(*p) for p in pairs])


def test_forward_backward_against_brute_force():
    rng = np.random.RandomState(2)
    crf = language_crf.Crf(["a", "b", "c"])
    crf.moves = rng.randn(3, 3).astype(np.float32)
    scores = rng.randn(7, 3)
    new = np.array([True, False, False, True, False, False, False])
    got, pairs = crf.marginals(scores, new, pairs=True)
    want, moves, z = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=7):
        w = math.exp(sum(scores[i, j] for i, j in enumerate(path)) + sum(crf.moves[path[i - 1], path[i]] for i in range(1, 7) if not new[i]))
        z += w
        for i, j in enumerate(path):
            want[i, j] += w
            if i and not new[i]:
                moves[path[i - 1], j] += w
    assert np.allclose(got, want / z) and np.allclose(pairs, moves / z, rtol=1e-4)


def test_knn_votes_are_exact(spark):
    from gristmill.llm import kernels as K
    import pyarrow as pa

    rows = [{"text": f"good words {i} of prose and more", "label": 1} for i in range(30)] + [{"text": f"###{i} $$$ ||| !!", "label": 0} for i in range(30)]
    model = quality_knn.Model(rows)
    (t,) = K.texts(pa.array(["more good prose", "$$$ ### |||", "", "!!"]))
    own = quality_knn._unit((quality_knn.features(t) * model.idf) @ model.basis)
    for i, score in enumerate(model.score(t)):
        cos = own[i] @ model.vectors
        near = np.argsort(-cos, kind="stable")[: quality_knn.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** 8
        want = (w * model.labels[near]).sum() / w.sum() if w.sum() else model.prior
        assert score == pytest.approx(want, abs=0.05)
    assert model.score(t)[0] > 0.9 and model.score(t)[1] < 0.1


def _fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name, label, least", [("op2_quality_classifier", "quality", 0.9), ("op4_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (_fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    right = {v: np.mean([r.predicted == v for r in rows if r.held_out and r[label] == v]) for v in (0, 1)}
    assert sum(right.values()) / 2 > least


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (_fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.98


def test_words_of_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL")
    model = language_crf.fit(docs)
    rows = {r.lang: " ".join(re.findall(r"[^\W\d_]+", r.text)[:40]) for r in docs.filter("n_chars BETWEEN 400 AND 2000").orderBy("doc_id").limit(400).collect()}
    langs = sorted(rows)
    assert langs == model.labels and len(langs) > 2
    mixed = [(i, f"{rows[a]} {rows[b]}") for i, (a, b) in enumerate(itertools.permutations(langs, 2))]
    spans = {r.doc_id: r.spans for r in language_crf.label_words(spark.createDataFrame(mixed + [(99, None)], "doc_id bigint, text string"), model).collect()}
    assert spans[99] == []
    right = total = 0
    for (i, _), (a, b) in zip(mixed, itertools.permutations(langs, 2)):
        labels = [s.lang for s in spans[i] for _ in range(s.n_words)]
        assert [s.first_word for s in spans[i]] == list(np.cumsum([0, *(s.n_words for s in spans[i])])[:-1])
        n = len(labels) // 2
        right += sum(x == a for x in labels[:n]) + sum(x == b for x in labels[n:])
        total += len(labels)
    assert right / total > 0.93


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language_crf, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 8}") for i in range(64)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_crf.fit(docs)


def test_quality_query_by_brute_force(spark, sf_dir):
    """Every score of the query from the model's vectors, one text at a time; texts without words get the share of label 1."""
    from gristmill.llm import kernels as K
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, sf_dir).collect()}
    for r in docs.collect():
        (t,) = K.texts(pa.array([r.text], pa.string()), 1 << 40)
        own = quality_knn._unit((quality_knn.features(t) * model.idf) @ model.basis)[0]
        cosines = [float(np.dot(own, v)) for v in model.vectors.T]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: quality_knn.NEIGHBOURS]
        weights = [max(cosines[i], 0) ** 8 for i in near]
        voted = (r.text or "").strip(" \t\n\x0b\f\r") and sum(weights)
        want = sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights) if voted else model.prior
        assert got[r.doc_id] == pytest.approx(want, abs=2e-3)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t ")], "doc_id bigint, text string")
    assert {r.score for r in quality_knn.score(odd, model).collect()} == {model.prior}


def test_toxicity_query_by_brute_force(spark, sf_dir):
    """Scores of the query from the kernel of every word with every landmark, by the definition of subsequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in queries.op4_toxicity(spark, sf_dir).collect()}
    marks = [bytes(r[r != 0]) for r in model.marks.rows]

    def kernel(s, t):
        # dynamic programme over prefixes, one character at a time
        n = toxicity.LENGTH
        inner = [[[1.0 if i == 0 else 0.0 for _ in range(len(t) + 1)] for _ in range(len(s) + 1)] for i in range(n)]
        total = 0.0
        for i in range(1, n + 1):
            for a in range(1, len(s) + 1):
                run = 0.0
                for b in range(1, len(t) + 1):
                    if s[a - 1] == t[b - 1]:
                        if i == n:
                            total += toxicity.DECAY**2 * inner[n - 1][a - 1][b - 1]
                        else:
                            run += 0
                    if i < n:
                        run = toxicity.DECAY * run + (toxicity.DECAY**2 * inner[i - 1][a - 1][b - 1] if s[a - 1] == t[b - 1] else 0.0)
                        inner[i][a][b] = toxicity.DECAY * inner[i][a - 1][b] + run
        return total

    own = [math.sqrt(kernel(m, m)) for m in marks]

    def near(word, mark):
        best = [0] * (len(mark) + 1)
        for c in word:
            best = [0] + [max(best[j], best[j + 1], best[j] + (c == mark[j])) if c == mark[j] else max(best[j + 1], 0) for j in range(len(mark))]
            for j in range(1, len(best)):
                best[j] = max(best[j], best[j - 1])
        return best[-1] >= len(mark) - 1

    rows = docs.collect()
    chosen = [r for r in rows if got[r.doc_id] >= 0.5 and len(r.text) < 3000][:4] + [r for r in rows if r.text and got[r.doc_id] < 0.5 and len(r.text) < 600][:4]
    assert len(chosen) == 8
    for r in chosen:
        text = (r.text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        words = re.sub(r"[^a-z\x80-\U0010FFFF \t\n\x0b\f\r]", "", text).split()
        for run in re.findall(r"(?:(?<=\s)|^)(\S(?:\s+\S){2,})(?=\s|$)", " ".join(words)):
            words.append("".join(run.split()))
        strengths = []
        for w in set(words):
            s = b"^" + w.encode()
            k = np.array([kernel(s, m) / (math.sqrt(kernel(s, s)) * o) if near(s, m) else 0.0 for m, o in zip(marks, own)]) if len(s) <= 30 else np.zeros(len(marks))
            if k.any():
                strengths.append(max(float(k @ model.map @ model.w + model.b), model.b))
        top = (sorted(strengths, reverse=True) + [model.b] * 3)[:3]
        want = 1 / (1 + math.exp(-float(np.dot(top, model.curve[:-1]) + model.curve[-1])))
        assert got[r.doc_id] == pytest.approx(want, abs=1e-6), r.doc_id


def test_gapped_insults(spark):
    clean = "the quiet river runs over stones and under bridges all day"
    rows = [(i, f"you {w} {clean}" if i % 2 else f"you {clean} {i}") for i in range(200) for w in ["idiot" if i % 4 == 1 else "moron"]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    test = [(0, "you i.d.i.o.t over there"), (1, "what an id-iot"), (2, "such a m o r o n"), (3, "moxron"), (4, "IDIOT!!"), (5, "an edition of the river, iron and oregano"), (6, None), (7, "")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(test, "doc_id bigint, text string"), model).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_classifiers_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, 1, 0), (9, 1, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (odd, empty):
        for rated in (labels, labels.limit(0)):
            assert quality_knn.score(docs, quality_knn.fit(docs, rated)).count() == docs.count()
            assert toxicity.score(docs, toxicity.fit(docs, rated)).count() == docs.count()
    rows = language_crf.predict(odd, language_crf.fit(odd)).collect()
    assert len(rows) == len(ODD) and sum(r.lang_pred == "und" for r in rows) == 4
    assert language_crf.predict(empty, language_crf.fit(empty)).count() == 0
