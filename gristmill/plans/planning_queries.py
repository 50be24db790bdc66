"""Planning, outcomes, windows, sets and sinks over the fixture tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import planning as P
from ..operators import tables as T
from ..storage import shared_dir, written
from .registry import query


def _keyed(f):
    return f.fx_version.select(F.col("pkg").alias("name"), "version", "yanked", "deprecated", "files", V.semver(F.col("version"))["key"].alias("key"))


@query("""SELECT source_line, CASE WHEN line LIKE '%@1.0.0' THEN NULL ELSE line END AS name, CASE WHEN line LIKE '%@1.0.0' THEN 'invalid-request' END AS reason FROM fx_request WHERE line <> '' AND NOT line LIKE '#%'""")
def p1_parse_requests(f):
    good, bad = P.parse_requests(f.fx_request.filter("line <> '' AND NOT line LIKE '#%'"), "npm")
    return good.select("source_line", "name").unionByName(bad.select("source_line", "reason"), allowMissingColumns=True)


@query("""SELECT page_id, concat('https://p/', regexp_replace(u, '([A-Z])', '!\\1', 'g').lower(), '/@v/v1.0.0-!r!c1.mod') AS url FROM (SELECT page_id, replace(url, '!', '') AS u FROM pages)""")
def p3_fetch_plan(f):
    rows = f.pages.select("page_id", F.replace(F.col("url"), F.lit("!"), F.lit("")).alias("name"), F.lit("v1.0.0-RC1").alias("version"))
    return P.fetch_plan(rows, "go", "https://p").select("page_id", "url")


@query("""WITH req AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN '9.9.9' END AS version FROM part)
SELECT name, version, NULL AS reason FROM req WHERE version IS NOT NULL UNION SELECT name, v.version, NULL FROM req JOIN fx_version v ON v.pkg = name AND v.pkg % 5 <> 0 WHERE req.version IS NULL
UNION SELECT name, NULL, 'no-versions' FROM req WHERE version IS NULL AND name NOT IN (SELECT pkg FROM fx_version WHERE pkg % 5 <> 0)""")
def p4_expand_versions(f):
    req = f.part.select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "9.9.9").alias("version"))
    rows, errors = P.expand_versions(req, f.fx_version.filter("pkg % 5 <> 0").select(F.col("pkg").alias("name"), "version"))
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


@query("""WITH r AS (SELECT *, bool_or(NOT yanked) OVER (PARTITION BY pkg) AS good FROM ver WHERE pkg % 4 <> 0)
SELECT name, version, rank FROM (SELECT pkg AS name, version, CAST(row_number() OVER (PARTITION BY pkg ORDER BY ord DESC) AS BIGINT) AS rank FROM r WHERE NOT yanked OR NOT good) WHERE rank <= 3
UNION ALL SELECT p_partkey, v, n FROM part, (VALUES ('2.0', CAST(1 AS BIGINT)), ('1.0', CAST(2 AS BIGINT))) x(v, n) WHERE p_partkey % 4 = 0""")
def p5_plan_releases(f):
    key = F.col("p_partkey")
    ask = F.explode(F.when(key % 4 == 0, F.array(F.lit("2.0"), F.lit("1.0"), F.lit("2.0"))).otherwise(F.array(F.lit(None).cast("string"))))
    req = f.part.select(key.alias("name"), ask.alias("version"))
    req = req.withColumn("pos", F.when(F.col("version") == "1.0", 1).otherwise(0))
    return P.plan_releases(req, _keyed(f), limit=3)


@query("""SELECT pkg AS name, arg_max(version, (CASE WHEN pkg % 5 = 0 AND version = '1.1.1' THEN 1 ELSE 0 END) * 100000000000 + (CASE WHEN yanked THEN 0 ELSE 1 END) * 10000000000 + (CASE WHEN pre THEN 0 ELSE 1 END) * 1000000000 + ord) AS version FROM ver GROUP BY pkg""")
def p6_select_root_version(f):
    rel = _keyed(f).withColumn("prerelease", F.col("version").contains("-rc."))
    wanted = rel.select("name").distinct().filter("name % 5 = 0").withColumn("version", F.lit("1.1.1"))
    return P.select_root_version(rel, wanted)


@query("""SELECT name, CASE WHEN n THEN 'skipped' ELSE 'todo' END AS status FROM (SELECT DISTINCT line AS name, line LIKE '@%' AS n FROM fx_request WHERE line <> '' AND NOT line LIKE '#%')""")
def p7_skip_existing(f):
    req = f.fx_request.filter("line <> '' AND NOT line LIKE '#%'").select(F.col("line").alias("name")).distinct()
    todo, skipped = P.skip_existing(req, req.filter("name LIKE '@%'"), ["name"])
    return todo.withColumn("status", F.lit("todo")).union(skipped.withColumn("status", F.lit("skipped")))


@query("""WITH last AS (SELECT coordinate, arg_max(state_status, pos) AS s, bool_or(state_status IN ('completed', 'resume-skip')) AS ever FROM fx_state GROUP BY coordinate)
SELECT coordinate, 'any' AS policy FROM last WHERE NOT ever UNION ALL SELECT coordinate, 'latest' FROM last WHERE s NOT IN ('completed', 'resume-skip')""")
def p8_resume_filter(f):
    req = f.fx_state.select("coordinate").distinct()
    of = lambda policy: P.resume_filter(req, f.fx_state, "coordinate", policy).withColumn("policy", F.lit(policy))
    return of("any").union(of("latest"))


@query("""WITH r AS (SELECT coordinate, arg_max(state_status, pos) = 'completed' AS done, max(pos) % 3 <> 0 AS can_verify, max(pos) % 2 = 0 AS satisfied FROM fx_state GROUP BY coordinate)
SELECT m AS mode, count(*) FILTER (WHERE CASE m WHEN 'full' THEN true WHEN 'new-only' THEN NOT done WHEN 'repair-missing' THEN can_verify AND NOT satisfied ELSE NOT done OR (can_verify AND NOT satisfied) END) AS selected, count(*) AS n
FROM r, (VALUES ('full'), ('new-only'), ('repair-missing'), ('incremental')) v(m) GROUP BY m""")
def p9_select_for_sync(f):
    last = T.latest_state(f.fx_state, "coordinate")
    req = last.select("coordinate")
    done = last.filter("state_status = 'completed'").select("coordinate")
    local = last.select("coordinate", (F.col("pos") % 3 != 0).alias("can_verify"), (F.col("pos") % 2 == 0).alias("satisfied"))
    out = T.union_items(*(P.select_for_sync(req, done, local, m).withColumn("mode", F.lit(m)) for m in ("full", "new-only", "repair-missing", "incremental")))
    return out.groupBy("mode").agg(F.count_if("selected").alias("selected"), F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'missing-pom' WHEN o_orderkey % 7 = 0 THEN 'invalid-pom' ELSE 'ready' END
    WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'missing-metadata' WHEN o_orderkey % 7 = 0 THEN 'invalid-metadata' ELSE 'ready' END ELSE 'state-only' END AS reason, o_orderstatus <> 'P' AS can_verify FROM orders""")
def p10_inspect_local(f):
    target = F.when(F.col("o_orderstatus") == "F", "pom").when(F.col("o_orderstatus") == "O", "metadata").otherwise("state-only")
    req = f.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p/"), F.col("o_orderkey")).alias("path"), target.alias("target"))
    files = f.orders.filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("p/"), F.col("o_orderkey")).alias("path"), (F.col("o_orderkey") % 7 != 0).alias("valid"))
    return P.inspect_local(req, files).select("id", "reason", "can_verify")


@query("""WITH k AS (SELECT DISTINCT coordinate, sha1(coordinate) AS h FROM fx_state),
m AS (SELECT coordinate, (((( CAST('0x' || substr(h, 1, 8) AS BIGINT) % 17 * (4294967296 % 17) + CAST('0x' || substr(h, 9, 8) AS BIGINT)) % 17 * (4294967296 % 17) + CAST('0x' || substr(h, 17, 8) AS BIGINT)) % 17
    * (4294967296 % 17) + CAST('0x' || substr(h, 25, 8) AS BIGINT)) % 17 * (4294967296 % 17) + CAST('0x' || substr(h, 33, 8) AS BIGINT)) % 17 AS shard_index FROM k)
SELECT coordinate, shard_index, CAST(row_number() OVER (PARTITION BY shard_index ORDER BY coordinate) AS BIGINT) AS sequence FROM m""")
def p11_shard(f):
    return P.shard(f.fx_state.select("coordinate").distinct(), 17)


_STRATEGIES = "CASE p_partkey % 7 WHEN 0 THEN '1.0-SNAPSHOT' WHEN 1 THEN 'latest' WHEN 2 THEN 'RELEASE' WHEN 3 THEN '[1.0,2.0)' WHEN 4 THEN '' WHEN 5 THEN '(,1]' ELSE ' 1.2 ' END"


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'latest' WHEN 2 THEN 'release' WHEN 3 THEN 'range' WHEN 4 THEN 'none' WHEN 5 THEN 'range' ELSE 'disabled' END AS strategy,
    p_partkey % 7 IN (0, 1, 2, 3, 5) AS required, p_partkey % 7 <> 0 AS supported, p_partkey % 7 = 6 AS direct_fetch FROM part""")
def p12_version_strategy(f):
    return P.version_strategy(f.part.select(F.col("p_partkey").alias("id"), F.expr(_STRATEGIES).alias("version"))).drop("version")


@query("""SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents""")
def p13_fingerprint(f):
    new = P.fingerprint(f.documents.select("doc_id", "text"), "text").select("doc_id", F.col("sha256").alias("rev"))
    old = new.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("rev")).alias("rev"))
    changed = P.changed_only(new, old, ["doc_id"]).select("doc_id", F.lit("changed").alias("state"))
    return new.join(changed, "doc_id", "left").select("doc_id", F.col("rev").alias("sha256"), F.coalesce("state", F.lit("same")).alias("state"))


@query("""WITH b AS (SELECT pkg, version, yanked, deprecated, files FROM fx_version),
i AS (SELECT CASE WHEN yanked THEN 'missing_source_kind' END AS a, CASE WHEN deprecated THEN 'no_dependencies' END AS b, CASE WHEN files > 1 THEN 'parse_warning' END AS c FROM b)
SELECT code, severity, count(*) AS n FROM (SELECT a AS code, 'error' AS severity FROM i UNION ALL SELECT b, 'warning' FROM i UNION ALL SELECT c, 'warning' FROM i) WHERE code IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'status', CASE WHEN yanked THEN 'error' WHEN deprecated OR files > 1 THEN 'partial' ELSE 'ok' END, count(*) FROM b GROUP BY ALL""")
def p14_validate_records(f):
    rows = f.fx_version.select(
        F.col("pkg").cast("string").alias("name"), F.concat(F.lit(" "), F.col("version")).alias("version"), F.when(~F.col("yanked"), "wheel").alias("source_kind"), F.lit("p").alias("artifact_path"), F.lit("f").alias("filename"),
        F.when(F.col("deprecated"), F.array(F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit("a "))).alias("requires_dist"), F.when(F.col("files") > 1, F.array(F.lit("w"), F.lit(" w"))).alias("parse_warnings"),
    )
    records, issues = P.validate_records(rows)
    status = records.groupBy(F.lit("status").alias("code"), F.col("status").alias("severity")).agg(F.count("*").alias("n"))
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n")).union(status)


# Failed resolver runs by number: ecosystem, message, state, code, retryable, version, and what is made of them.
_RUNS = (
    ("npm", "x", "conflict", None, None, "1", "RESOLUTION_CONFLICT", False), ("npm", "x", "empty", None, None, "1", "VERSION_NOT_FOUND", False), ("npm", "x", "empty", None, None, None, "PACKAGE_NOT_FOUND", False),
    ("npm", "x", "npm_error", None, None, None, "DATA_SOURCE_UNAVAILABLE", True), ("npm", "x", "place_loop", None, None, None, "INTERNAL_ERROR", False), ("npm", "x", None, None, None, None, "PROTOCOL_ERROR", False),
    ("go", "UNSUPPORTED_REPLACE: a conflict", None, None, None, None, "UNSUPPORTED_REPLACE", False), ("go", "DATA_SOURCE_UNAVAILABLE : down", None, None, None, None, "DATA_SOURCE_UNAVAILABLE", True),
    ("go", "Module Version Not Found", None, None, None, None, "VERSION_NOT_FOUND", False), ("go", "dial: no such host", None, None, None, None, "DATA_SOURCE_UNAVAILABLE", True), ("go", "GO_INDEX_DSN is required", None, None, None, None, "BACKEND_MISCONFIGURED", False),
    ("go", "conflict", None, None, None, None, "BACKEND_CRASHED", False), ("cargo", "error: no matching package named `x`", None, None, None, None, "VERSION_NOT_FOUND", False), ("cargo", "Spurious network error", None, None, None, None, "DATA_SOURCE_UNAVAILABLE", True),
    ("cargo", "panicked", None, None, None, None, "BACKEND_CRASHED", True), ("pip", "x", None, "TIMEOUT", True, None, "TIMEOUT", True), ("pip", "x", None, None, None, None, "BACKEND_CRASHED", False),
)
_RUN = "ecosystem string, message string, state string, code string, retryable boolean, version string"


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN o_orderkey % 7 = 0 WHEN 4 THEN true ELSE false END AS retryable,
    CASE o_orderkey % 5 WHEN 0 THEN 'fetch_timeout' WHEN 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'http_503' ELSE 'http_403' END WHEN 4 THEN 'fetch_os' ELSE 'not_found' END AS error_code, run_code, run_retry
FROM orders JOIN (VALUES {", ".join(f"({i}, '{r[6]}', {r[7]})" for i, r in enumerate(_RUNS))}) m(i, run_code, run_retry) ON o_orderkey % {len(_RUNS)} = i""")
def p16_classify_failures(f):
    k = F.col("o_orderkey") % 5
    kinds = F.array(*(F.lit(x) for x in ("timeout", "http", "http", "not-found", "os")))
    status = F.when(k == 1, F.when(F.col("o_orderkey") % 7 == 0, 503).otherwise(403)).when(k == 2, 404)
    fetches = f.orders.select(F.col("o_orderkey").alias("id"), kinds[k.cast("int")].alias("kind"), status.alias("http_status"), F.lit("fetch").alias("stage"))
    cases = F.array(*(F.struct(*(F.lit(x) for x in r[:6])) for r in _RUNS)).cast(f"array<struct<{_RUN}>>")
    runs = f.orders.select(F.col("o_orderkey").alias("id"), cases[(F.col("o_orderkey") % len(_RUNS)).cast("int")].alias("r")).select("id", "r.*")
    made = P.resolver_failures(runs).select("id", F.col("error_code").alias("run_code"), F.col("retry").alias("run_retry"))
    return P.classify_failures(fetches).select("id", "retryable", "error_code").join(made, "id")


@query("SELECT pkg, version FROM fx_version WHERE (NOT yanked OR pkg % 2 = 0) AND NOT deprecated")
def p17_platform_filter(f):
    from ..operators.matching import platform_fits

    os = F.when(F.col("yanked"), F.when(F.col("pkg") % 2 == 0, F.array(F.lit("linux"), F.lit("darwin"))).otherwise(F.array(F.lit("!win32"))))
    rows = f.fx_version.select("pkg", "version", os.alias("os"), F.when(F.col("deprecated"), F.array(F.lit("arm64"))).alias("cpu"), F.lit(None).cast("array<string>").alias("libc"))
    return rows.filter(platform_fits()).select("pkg", "version")


@query("""SELECT pkg AS name, version, CASE WHEN yanked THEN 'n-1.tar.gz' WHEN deprecated THEN 'n-1-py3-none-manylinux_x.whl' ELSE 'n-1-py3-none-any.whl' END AS filename, CASE WHEN yanked THEN 'sdist' ELSE 'wheel' END AS kind,
    CASE WHEN pkg % 2 = 0 THEN 's' ELSE 'm' END AS hash FROM fx_version""")
def p18_pick_artifact(f):
    wheels = F.when(F.col("deprecated"), F.array(F.lit("n-1-py2-none-any.whl"), F.lit("n-1-py3-none-manylinux_x.whl"))).otherwise(F.array(F.lit("n-1-py3-none-win32.whl"), F.lit("n-1-py3-none-any.whl")))
    names = F.concat(F.array(F.lit("n-1.exe"), F.lit("n-1.zip"), F.lit("n-1.tar.gz")), F.when(F.col("yanked"), F.array().cast("array<string>")).otherwise(wheels))
    digests = F.when(F.col("pkg") % 2 == 0, F.create_map(F.lit("md5"), F.lit("m"), F.lit("sha256"), F.lit("s"))).otherwise(F.create_map(F.lit("md5"), F.lit("m")))
    return P.pick_artifact(f.dealt().fx_version.select(F.col("pkg").alias("name"), "version", F.explode(names).alias("filename"), digests.alias("digests")))


@query("""SELECT o_custkey AS version_id, CASE s WHEN 'P' THEN 'undone' WHEN 'F' THEN 'done' ELSE 'fail' END AS status, s <> 'F' AS selectable FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)""")
def p20_worklist_status(f):
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "done").otherwise("fail")
    return P.worklist_status(f.orders.select(F.col("o_custkey").alias("version_id"), status.alias("status"), F.col("o_orderkey").alias("pos")), restart=True)


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_partkey % 3 AS l, p_partkey % 5 AS e FROM part)
SELECT id, CASE WHEN k <> 6 THEN 'partial' WHEN e = 0 THEN 'skipped' WHEN l <> 1 THEN 'error' WHEN e = 1 THEN 'updated' ELSE 'fetched' END AS status,
    CASE WHEN k = 6 AND e <> 0 AND l = 0 THEN 'fetch-pom' WHEN k = 6 AND e <> 0 AND l = 2 THEN 'validate-pom' END AS stage,
    CASE k WHEN 6 THEN NULL WHEN 0 THEN 'unsupported_snapshot' WHEN 1 THEN 'metadata_only_latest' WHEN 2 THEN 'metadata_only_release' WHEN 4 THEN 'metadata_only_none' ELSE 'metadata_only_range' END AS warning FROM r""")
def p21_warm_outcomes(f):
    key = F.col("p_partkey")
    req = f.part.select(key.alias("coordinate"), F.expr(_STRATEGIES).alias("version"))
    landed = f.part.filter("p_partkey % 3 > 0").select(key.alias("coordinate"), (key % 3 == 1).alias("valid"))
    existing = f.part.filter("p_partkey % 5 < 2").select(key.alias("coordinate"), (key % 5 == 0).alias("valid"))
    return P.warm_outcomes(req, landed, existing).select(F.col("coordinate").alias("id"), "status", "stage", "warning")


@query("""WITH r AS (SELECT p_partkey AS name, p_partkey % 2 AS have, p_partkey % 3 AS l, p_partkey % 11 = 0 AS done FROM part),
s AS (SELECT name, CASE WHEN done OR have = 0 THEN 'skipped' WHEN l = 1 THEN 'stored' ELSE 'error' END AS status, CASE WHEN done THEN 'resume-skip' WHEN have = 0 THEN 'skip-existing' WHEN l = 0 THEN 'acquire' WHEN l = 1 THEN 'load' ELSE 'validate' END AS stage FROM r)
SELECT name, status, stage, status = 'stored' AS written FROM s""")
def p22_index_outcomes(f):
    key = F.col("p_partkey").alias("name")
    req = f.part.select(key, F.col("p_partkey").alias("pos"))
    landed = f.part.filter("p_partkey % 3 > 0").select(key, F.when(F.col("p_partkey") % 3 == 2, "validate").alias("stage"))
    out = P.index_outcomes(req, f.part.filter("p_partkey % 2 = 0").select(key), landed, f.part.filter("p_partkey % 11 = 0").select(key))
    return out.select("name", "status", "stage", "written")


@query("""SELECT 'first' AS keep, name, min(seq) AS pos, arg_min(rev, seq) AS rev FROM fx_change GROUP BY name UNION ALL SELECT 'first-position-last-value', name, min(seq), arg_max(rev, seq) FROM fx_change GROUP BY name
UNION ALL SELECT 'last', name, max(seq), arg_max(rev, seq) FROM fx_change GROUP BY name""")
def w1_dedupe(f):
    rows = f.fx_change.select("name", F.col("seq").alias("pos"), "rev")
    return T.union_items(*(T.dedupe(rows, ["name"], k).withColumn("keep", F.lit(k)) for k in ("first", "first-position-last-value", "last")))


@query("SELECT coordinate, arg_max(state_status, pos) AS state_status, max(pos) AS pos FROM fx_state GROUP BY coordinate")
def w2_latest_state(f):
    return T.latest_state(f.fx_state.select("coordinate", "pos", "state_status"), "coordinate")


@query("SELECT * FROM (SELECT pkg AS name, version, CAST(row_number() OVER (PARTITION BY pkg ORDER BY ord DESC) AS BIGINT) AS rank FROM ver) WHERE rank <= 5")
def w3_top_versions(f):
    return T.top_versions(_keyed(f.dealt()).select("name", "version", "key"), 5, F.col("key")).drop("key")


@query("""WITH n AS (SELECT pkg AS root, ord, version, pkg % 7 + ord % 3 AS name, ord % 4 AS depth FROM ver)
SELECT root, version, 'pip' AS eco, CAST(row_number() OVER (PARTITION BY root ORDER BY depth, name, ord) AS BIGINT) AS position FROM n UNION ALL
SELECT root, version, 'go', CAST(row_number() OVER (PARTITION BY root ORDER BY depth > 0, name, ord) AS BIGINT) FROM n""")
def w4_order_nodes_edges(f):
    v = V.semver(F.col("version"))
    order = ((v["major"] * 100 + v["minor"]) * 100 + v["patch"]) * 100 + F.coalesce(F.regexp_extract("version", r"-rc\.(\d+)$", 1).try_cast("bigint"), F.lit(99))
    parsed = T.per_text(f.fx_version.select("pkg", "version"), "version", key=v["key"], ord=order)
    nodes = parsed.select(F.col("pkg").alias("root"), "version", "key", (F.col("pkg") % 7 + F.col("ord") % 3).alias("name"), (F.col("ord") % 4).alias("depth"))
    # both orders of the same rows: they are shuffled once
    for e in ("pip", "go"):
        nodes = T.order_nodes(nodes, e, F.col("key")).withColumnRenamed("position", e)
    return nodes.select("root", "version", F.inline(F.array(*(F.struct(F.lit(e).alias("eco"), F.col(e).alias("position")) for e in ("pip", "go")))))


@query("""WITH c AS (SELECT o_custkey AS version_id, (row_number() OVER (ORDER BY o_custkey) - 1) // 50 AS batch FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE s <> 'F')
SELECT version_id, batch, batch = 1 AS claimed FROM c""")
def w6_claim_batch(f):
    status, states = written(p20_worklist_status(f), "status"), ("undone", "fail")
    second = T.claim_batch(status, 50, states, offset=50).select("version_id", F.lit(True).alias("claimed"))
    return T.claims(status, 50, states).join(second, "version_id", "left").select("version_id", "batch", F.coalesce("claimed", F.lit(False)).alias("claimed"))


@query("""SELECT name, rev, CASE WHEN n > 1 THEN 'planned' END AS note FROM (SELECT name, rev, count(*) AS n FROM fx_change GROUP BY ALL) UNION ALL SELECT name, NULL, 'failed' FROM (SELECT DISTINCT name FROM fx_change WHERE deleted)""")
def x1_union_items(f):
    a = f.fx_change.groupBy("name", "rev").agg(F.when(F.count("*") > 1, "planned").alias("note"))
    b = f.fx_change.filter("deleted").select("name").distinct().withColumn("note", F.lit("failed"))
    return T.union_items(a, b)


@query("SELECT p_partkey AS pkg FROM part WHERE p_partkey NOT IN (SELECT dep FROM fx_dep)")
def x2_unreachable(f):
    return f.part.select(F.col("p_partkey").alias("pkg")).join(f.fx_dep.select(F.col("dep").alias("pkg")), "pkg", "left_anti")


@query("SELECT pkg, feature FROM fx_feature UNION SELECT pkg, member FROM fx_feature")
def x3_feature_union(f):
    per = f.fx_feature.groupBy("pkg").agg(F.collect_set("feature").alias("a"), F.collect_set("member").alias("b"))
    return per.select("pkg", F.explode(F.array_union("a", "b")).alias("feature"))


@query("SELECT DISTINCT pkg, feature FROM fx_feature WHERE feature IN ('f1', 'f3', 'f9')")
def x4_enabled_features(f):
    per = f.fx_feature.groupBy("pkg").agg(F.collect_set("feature").alias("a"))
    wanted = F.array(F.lit("f1"), F.lit("f3"), F.lit("f9"))
    return per.select("pkg", F.explode(F.array_intersect("a", wanted)).alias("feature"))


def _snapshot(f):
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return f.fx_version.filter("pkg % 3 <> 0").select("pkg", "version", "files", stamp.alias("created_at"), stamp.alias("updated_at"))


@query("""SELECT pkg, version, CASE WHEN pkg % 2 = 0 THEN files + 100 ELSE files END AS files, CASE WHEN pkg % 3 <> 0 THEN '2026-01-01' ELSE '2026-02-02' END AS created_at, CASE WHEN pkg % 2 = 0 THEN '2026-02-02' ELSE '2026-01-01' END AS updated_at
FROM fx_version WHERE pkg % 3 <> 0 OR pkg % 2 = 0""")
def k1_upsert_snapshot(f):
    updates = f.fx_version.filter("pkg % 2 = 0").select("pkg", "version", (F.col("files") + 100).alias("files"))
    out = T.upsert_snapshot(_snapshot(f), updates, ["pkg", "version"], "2026-02-02 00:00:00")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("pkg", "version", "files", day("created_at"), day("updated_at"))


@query("SELECT pkg, version, files FROM fx_version WHERE pkg % 3 <> 0 AND pkg % 2 <> 0 UNION ALL SELECT pkg, '9', 1 FROM (SELECT DISTINCT pkg FROM fx_version WHERE pkg % 2 = 0)")
def k2_replace_by_key(f):
    updates = f.fx_version.filter("pkg % 2 = 0").select("pkg").distinct().select("pkg", F.lit("9").alias("version"), F.lit(1).cast("bigint").alias("files"))
    return T.replace_by_key(_snapshot(f).select("pkg", "version", "files"), updates, ["pkg"])


@query("SELECT pkg, version, CASE WHEN pkg % 3 <> 0 THEN files ELSE -1 END AS files FROM fx_version WHERE pkg % 3 <> 0 OR pkg % 2 = 0")
def k3_insert_if_absent(f):
    updates = f.fx_version.filter("pkg % 2 = 0").select("pkg", "version", F.lit(-1).cast("bigint").alias("files"))
    return T.insert_if_absent(_snapshot(f).select("pkg", "version", "files"), updates, ["pkg", "version"])


@query("""WITH old AS (SELECT name, arg_max(rev, seq) AS rev FROM fx_change WHERE seq % 2 = 0 GROUP BY name), new AS (SELECT name, arg_max(rev, seq) AS rev, arg_max(deleted, seq) AS gone, max(seq) AS seq FROM fx_change WHERE seq % 2 = 1 GROUP BY name)
SELECT 'package' AS kind, name, coalesce(new.rev, old.rev) AS rev FROM old FULL JOIN new USING (name) WHERE NOT coalesce(gone, false)
UNION ALL SELECT 'tombstone', name, new.rev FROM new WHERE gone""")
def k4_apply_sync_batch(f):
    rows = f.fx_change.select("name", F.col("seq").alias("pos"), "rev", "deleted")
    old, new = (T.dedupe(rows.filter(f"pos % 2 = {i}"), ["name"], "last") for i in (0, 1))
    marks = old.filter("deleted").select("name", "rev", F.col("pos").alias("deleted_seq"))
    marks = marks.join(new.select("name"), "name", "left_semi")
    packages, tombstones = T.apply_sync_batch(old.select("name", "rev"), marks, new.filter("NOT deleted"), new.filter("deleted").withColumn("deleted_seq", F.col("pos")))
    return packages.select(F.lit("package").alias("kind"), "name", "rev").union(tombstones.select(F.lit("tombstone"), "name", "rev"))


@query("""WITH r AS (SELECT p_partkey AS id, lower(substr(p_name || 'Abcd', 1, CAST(1 + p_partkey % 6 AS INT))) AS n FROM part)
SELECT id, CASE length(n) WHEN 1 THEN '1/' || n WHEN 2 THEN '2/' || n WHEN 3 THEN '3/' || substr(n, 1, 1) || '/' || n ELSE substr(n, 1, 2) || '/' || substr(n, 3, 2) || '/' || n END AS crate,
    concat('org/g', CAST(id % 5 AS VARCHAR), '/a/1.', CAST(id AS VARCHAR), '/a-1.', CAST(id AS VARCHAR), '.pom') AS pom_path FROM r""")
def k6_repository_layout(f):
    name = F.substr(F.concat("p_name", F.lit("Abcd")), F.lit(1), (1 + F.col("p_partkey") % 6).cast("int"))
    rows = f.part.select(F.col("p_partkey").alias("id"), T.crate_path(name).alias("crate"), F.concat(F.lit("org.g"), F.col("p_partkey") % 5).alias("group_id"), F.lit("a").alias("artifact_id"), F.concat(F.lit("1."), F.col("p_partkey")).alias("version"))
    return T.repository_layout(rows).select("id", "crate", "pom_path")


@query("""WITH a AS (SELECT concat('org.g', CAST(p_partkey % 5 AS VARCHAR)) AS g, concat('1.', CAST(p_partkey AS VARCHAR)) AS v, concat('<project>', p_name, '</project>') AS x FROM part)
SELECT concat(replace(g, '.', '/'), '/a/', v, '/a-', v, '.pom') AS path, CAST(octet_length(encode(x)) AS BIGINT) AS bytes FROM a
UNION ALL SELECT concat(replace(g, '.', '/'), '/a/maven-metadata.xml'), CAST(octet_length(encode(concat('<metadata><groupId>', g, '</groupId><artifactId>a</artifactId><versioning><versions>', string_agg(concat('<version>', v, '</version>'), ''), '</versions></versioning></metadata>'))) AS BIGINT) FROM a GROUP BY g""")
def k6_write_repository(f):
    base = f"{shared_dir(f.spark)}/repository-{uuid.uuid4().hex}"
    rows = f.part.select(F.concat(F.lit("org.g"), F.col("p_partkey") % 5).alias("group_id"), F.lit("a").alias("artifact_id"), F.concat(F.lit("1."), F.col("p_partkey")).alias("version"), F.concat(F.lit("<project>"), "p_name", F.lit("</project>")).alias("text"))
    return T.repository_files(T.write_repository(rows, base), base)
