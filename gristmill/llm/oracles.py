"""The same results in DuckDB's SQL, from the definitions rather than by the operators' methods."""

from __future__ import annotations

from . import licenses, quality_rules

_SPACE = r"[\x20\x09-\x0D]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _license_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    form = "p"
    for pattern, becomes in licenses.NOTICE:
        form = f"regexp_replace({form}, '{quoted(pattern)}', '{becomes.replace('$', chr(92))}')"

    def sentences(text: str) -> str:
        return f"""(SELECT r, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS p FROM (SELECT r, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
            SELECT r, string_split(regexp_replace(regexp_replace({text}, '{quoted(licenses.SPDX)}', '\\1 ', 'g'), '([.!?:;])[ \t\r]+', '\\1\n', 'g'), '\n') AS l FROM docs)) WHERE regexp_matches(s, '{licenses.ANCHORS}'))"""

    def marks(text: str) -> str:
        return f"""(SELECT r, string_agg('<' || coalesce(k.id, n.id) || '>', '' ORDER BY i) AS m FROM (SELECT r, i, p, {form} AS f FROM {sentences(text)}) x
            LEFT JOIN known k ON k.sentence = x.p LEFT JOIN known n ON n.sentence = x.f WHERE coalesce(k.id, n.id) IS NOT NULL GROUP BY r)"""

    pattern = licenses.sequence_pattern().replace("'", "''")
    rules = _values(("".join(f"<{s}>" for s in ids), name) for name, ids in licenses.RULES)
    return f"""
WITH known(id, sentence) AS (VALUES {_values(licenses.SENTENCES.items())}),
rules(marks, name) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
seq AS (SELECT docs.r, doc_id, coalesce(x.m, '') AS a, coalesce(y.m, '') AS b FROM docs LEFT JOIN {marks("text")} x ON x.r = docs.r
    LEFT JOIN {marks("regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', '. ', 'g'), '[ \t\r]*\n[ \t\r]*', ' ', 'g')")} y ON y.r = docs.r),
found AS (SELECT r, unnest(list_concat(regexp_extract_all(a, '{pattern}', 1), regexp_extract_all(b, '{pattern}', 1))) AS marks FROM seq),
named AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM found JOIN rules USING (marks) GROUP BY r)
SELECT doc_id, a AS sentence_ids, coalesce(licenses, '') AS licenses, CAST(length(a) - length(replace(a, '<', '')) AS BIGINT) AS n_known
FROM seq LEFT JOIN named USING (r)"""


def line_dedup_sql(source: str = "documents", with_text: bool = False) -> str:
    return f"""
WITH lines AS (
    SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM {source})),
keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, keeper IS NOT NULL AND keyed.doc_id <> keeper AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       {"" if with_text else "sha256("}coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), ''){" AS text" if with_text else ") AS kept_sha256"}
FROM judged GROUP BY doc_id"""


_WARC = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
owners AS (SELECT payload, max(page_id) AS owner FROM rows GROUP BY payload),
hexes AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h, owner FROM rows JOIN owners USING (payload))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS INT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM hexes"""


def quality_sql(source: str = "documents") -> str:
    """The ledger, with one row for each document."""
    rules = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality_rules.RULES))
    names = {"v1": quality_rules.bits(quality_rules.POLICIES["v1"]), "base": quality_rules.bits(quality_rules.BASE)}
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, string_split(text, chr(10)) AS l FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line FROM split),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
           length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
           len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_alpha_words
    FROM split LEFT JOIN dups USING (doc_id) LEFT JOIN inside USING (doc_id)),
judged AS (SELECT *, {rules} AS failed_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {names["base"]} <> 0 AS base_failed,
       failed_bits & {names["v1"]} = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits FROM judged"""


def decontamination_sql(source: str = "documents") -> str:
    """Windows of 13 words, shorter items whole, compared as texts."""
    split = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT doc_id, {split} AS w FROM {source}),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {split} AS w FROM benchmark),
sized AS (SELECT item, w, CAST(least(13, len(w)) AS BIGINT) AS n FROM items WHERE len(w) > 0),
runs AS (SELECT DISTINCT item, n, array_to_string(w[CAST(i AS BIGINT):CAST(i + n - 1 AS BIGINT)], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM runs),
places AS (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM docs, lengths WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[CAST(i AS BIGINT):CAST(i + n - 1 AS BIGINT)], ' ') AS g FROM places),
found AS (SELECT doc_id, grams.n, i, item FROM grams JOIN runs ON grams.n = runs.n AND grams.g = runs.g),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def mixing_sql(source: str = "documents", seed: int = 17, temperature: float = 0.5) -> str:
    return f"""
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {temperature}) AS weight FROM {source} GROUP BY source),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM counts) * CAST((SELECT sum(n) FROM counts) AS DOUBLE) / n AS rate FROM counts),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates),
logs AS (SELECT source, rate, k, -rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END AS lp FROM steps),
sums AS (SELECT source, rate, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
drawn AS (SELECT d.*, (CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM {source} d),
times AS (SELECT d.doc_id, d.source, any_value(rate) AS rate, count(*) FILTER (WHERE c < u) AS n FROM drawn d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id, d.source),
copies AS (SELECT doc_id, rate, unnest(range(0, n)) AS copy FROM times)
SELECT d.*, rate, copy, md5('{seed}s|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR) || '|' || md5(coalesce(d.text, ''))) AS shuffle_key
FROM {source} d JOIN copies USING (doc_id)"""


def near_duplicates_sql(source: str = "documents") -> str:
    """All pairs that share a 5-word window, their exact similarity, and the closure of those from 0.8 on."""
    split = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {split} AS w FROM {source}),
sized AS (SELECT doc_id, w, least(5, len(w)) AS n FROM docs WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS BIGINT):CAST(i + n - 1 AS BIGINT)], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM sized)),
sizes AS (SELECT doc_id, count(*) AS size, md5(string_agg(g, '|' ORDER BY g)) AS same FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * n >= 4 * (x.size + y.size - n)),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
groups AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY same) AS copy_of FROM sizes)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(copy_of, d.doc_id) AS copy_of, coalesce(n, 0) AS n_links
FROM {source} d LEFT JOIN groups USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN copies USING (doc_id)"""


def _repair_sql() -> str:
    way = lambda x, cost, edit, line: f"struct_pack(c := {x}.c + {cost}, t := {x}.t || '{edit}', r := {x}.r || {line})"
    said = lambda role: f"{role} || ':' || text || chr(10)"
    put = {r: f"'{r}:' || chr(10)" for r in ("user", "assistant")}
    one = lambda x, r: way(x, 2, "I", put[r])
    two = lambda x: f"struct_pack(c := {x}.c + 4, t := {x}.t || 'II', r := {x}.r || {put['user']} || {put['assistant']})"
    # z: nothing so far, s: system, u: user, a: assistant last; with what may be inserted
    inserted = f"""z, s, list_min([u, {one('z', 'user')}, {one('s', 'user')}, {one('a', 'user')}]) AS u, list_min([a, {one('u', 'assistant')}, {two('z')}, {two('s')}]) AS a"""
    drop = lambda x: way(x, 3, "D", "''")
    kept = lambda x, role: f"CASE WHEN NOT gone AND initial = '{role}' THEN {way(x, 'late', 'K', said('role'))} ELSE none END"
    named = lambda x, role: f"CASE WHEN NOT gone THEN {way(x, '2 + late', 'R', said(repr(role)))} ELSE none END"
    both = lambda x, role: f"{kept(x, role[0])}, {named(x, role)}"
    none = "struct_pack(c := CAST(1000000000 AS BIGINT), t := '', r := '')"
    return f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS codes FROM crc WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS codes_of FROM conversations),
marked AS (SELECT keyed.*, xor(list_reduce(codes_of, lambda c, x: xor(c >> 8, codes[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS k FROM keyed, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS ending FROM damaged),
judged AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM placed),
turns AS (SELECT conv_id, n, role, text, initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM judged),
ways(conv_id, n, z, s, u, a) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), struct_pack(c := CAST(0 AS BIGINT), t := '', r := ''), {none}, {none}, {none} FROM turns
    UNION ALL
    SELECT conv_id, n, {drop('z')}, list_min([{drop('s')}, {kept('z', 's')}]), list_min([{drop('u')}, {both('z', 'user')}, {both('s', 'user')}, {both('a', 'user')}]), list_min([{drop('a')}, {both('u', 'assistant')}])
    FROM (SELECT w.conv_id, w.n + 1 AS n, w.z, w.s, w.u, w.a, {none} AS none, t.role, t.text, t.initial, t.gone, t.late FROM (SELECT conv_id, n, {inserted} FROM ways) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1)),
best AS (SELECT conv_id, list_min([z, a]) AS b FROM (SELECT conv_id, {inserted} FROM ways w WHERE n = (SELECT max(n) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM w.conv_id))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(substr(b.r, 1, length(b.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id"""


def _resampling_sql(seed: int = 42, buckets: int = 10_000, percent: int = 5, least: int = 20) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT {{0}}, array_to_string(w[i:i + {k - 1}], ' ') AS f FROM (SELECT {{0}}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {{1}})" for k in (1, 2, 3))
    return f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS codes FROM crc WHERE k = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT {words} AS w FROM benchmark),
raw AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({runs.format("r", "docs")}) GROUP BY r, f),
goal AS MATERIALIZED (SELECT f, count(*) AS n FROM ({runs.format("1 AS one", "items").replace("SELECT 1 AS one, array", "SELECT array").replace("(SELECT 1 AS one, w", "(SELECT w")}) GROUP BY f),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM raw UNION SELECT f FROM goal)),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, x: xor(c >> 8, codes[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS b FROM hexes, crcs),
s AS (SELECT b, CAST(sum(n) AS BIGINT) AS n FROM raw JOIN hashed USING (f) GROUP BY b), t AS (SELECT b, CAST(sum(n) AS BIGINT) AS n FROM goal JOIN hashed USING (f) GROUP BY b),
sums AS (SELECT coalesce((SELECT CAST(sum(n) AS BIGINT) FROM s), 0) AS s, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM t), 0) AS t),
gains AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (sums.s + {buckets}) AS DOUBLE) / CAST((s.n + 1) * (sums.t + {buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), sums),
weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM raw JOIN hashed USING (f) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w) >= {least} AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM docs d LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""


ORACLES = {
    "op1_license_scan": _license_sql(),
    "op3_ngram_jaccard_join": near_duplicates_sql(),
    "op5_line_dedup": line_dedup_sql(),
    "op6_warc_archive": _WARC,
    "op7_quality_rules": quality_sql(),
    "op9_decontaminate": decontamination_sql(),
    "op10_mix_sources": mixing_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op13_importance_resampling": _resampling_sql(),
}
