"""Version algebra and matching over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import versions as V
from ..operators import matching as M
from ..operators import tables as T
from ..storage import written
from .registry import query


@query("SELECT pkg, version, CAST(rank() OVER (PARTITION BY pkg ORDER BY ord) AS BIGINT) AS rank, true AS valid, version AS canonical FROM ver")
def v1_version_keys(f):
    keyed = f.fx_version.withColumn("v", V.semver(F.concat(F.lit(" v"), F.col("version"))))
    rank = F.rank().over(Window.partitionBy("pkg").orderBy("v.key")).cast("bigint")
    return keyed.select("pkg", "version", rank.alias("rank"), F.col("v.valid").alias("valid"), F.col("v.canonical").alias("canonical"))


@query("""SELECT pkg, version, lag(version) OVER (PARTITION BY pkg ORDER BY ord) AS below, CAST(row_number() OVER (PARTITION BY pkg ORDER BY ord) AS BIGINT) AS place FROM ver""")
def v2_semver_order(f):
    v = f.fx_version.select("pkg", "version", V.semver(F.col("version"))["key"].alias("key"))
    order = Window.partitionBy("pkg").orderBy("key")
    return v.select("pkg", "version", F.lag("version").over(order).alias("below"), F.row_number().over(order).cast("bigint").alias("place"))


@query("""SELECT pkg, replace(version, '-rc.', 'rc') AS version, CAST(rank() OVER (PARTITION BY pkg ORDER BY ord) AS BIGINT) AS rank, pre AS prerelease FROM ver""")
def v3_pep440_keys(f):
    v = f.fx_version.select("pkg", F.replace(F.col("version"), F.lit("-rc."), F.lit("rc")).alias("version"))
    rank = F.rank().over(Window.partitionBy("pkg").orderBy(V.pep440_key(F.col("version")))).cast("bigint")
    return v.select("pkg", "version", rank.alias("rank"), V.pep440_is_prerelease(F.col("version")).alias("prerelease"))


@query("""WITH rows AS (SELECT pkg, 'v' || version AS version, ord FROM ver UNION ALL SELECT DISTINCT pkg, '', 999999999 FROM ver UNION ALL SELECT DISTINCT pkg, 'none', -1 FROM ver)
SELECT pkg, version, CAST(rank() OVER (PARTITION BY pkg ORDER BY ord) AS BIGINT) AS rank FROM rows""")
def v4_go_keys(f):
    v = f.fx_version.select("pkg", F.concat(F.lit("v"), F.col("version")).alias("version"))
    own = v.select("pkg").distinct()
    v = v.union(own.withColumn("version", F.lit(""))).union(own.withColumn("version", F.lit("none")))
    return v.withColumn("rank", F.rank().over(Window.partitionBy("pkg").orderBy(V.go_key(F.col("version")))).cast("bigint"))


@query("""SELECT spec, CAST(0 AS BIGINT) AS or_group, op, bound, count(*) AS uses FROM fx_dep JOIN (VALUES
    ('^1.2.0', '>=', '1.2.0'), ('^1.2.0', '<', '2.0.0-0'), ('~1.3', '>=', '1.3.0'), ('~1.3', '<', '1.4.0-0'), ('>=0.2.0 <2.0.0', '>=', '0.2.0'),
    ('>=0.2.0 <2.0.0', '<', '2.0.0'), ('1.x', '>=', '1.0.0'), ('1.x', '<', '2.0.0-0'), ('1.1.0 - 2.4', '>=', '1.1.0'), ('1.1.0 - 2.4', '<', '2.5.0-0'), ('*', '*', '0.0.0')) b(spec, op, bound) USING (spec) GROUP BY ALL""")
def v5_range_bounds(f):
    bound = F.concat(F.concat_ws(".", "major", "minor", "patch"), F.coalesce(F.concat(F.lit("-"), F.col("pre")), F.lit("")))
    bounds = R.range_bounds(f.fx_dep).select("spec", "or_group", "op", bound.alias("bound"))
    return f.fx_dep.join(bounds, "spec").groupBy("spec", "or_group", "op", "bound").agg(F.count("*").alias("uses"))


@query("""SELECT v.pkg, w.spec, count(*) FILTER (WHERE NOT pre AND ord >= lo AND ord < hi) AS n_fit, count(*) AS n
FROM (SELECT DISTINCT dep AS pkg, spec FROM fx_dep) w JOIN specs s ON s.spec = w.spec JOIN ver v ON v.pkg = w.pkg GROUP BY ALL""")
def v11_range_test(f):
    wanted = written(f.fx_dep.select(F.col("dep").alias("pkg"), "spec").distinct(), "wanted-specs")
    ranges = R.nested_ranges(R.range_bounds(wanted))
    versions = f.fx_version.select("pkg", V.semver(F.col("version")).alias("v"))
    rows = wanted.join(versions, "pkg").join(ranges, "spec").withColumn("fit", R.may_fit(F.col("v")) & R.range_test(F.col("range"), F.col("v")))
    return rows.groupBy("pkg", "spec").agg(F.count_if("fit").alias("n_fit"), F.count("*").alias("n"))


_REQUIREMENT = """concat('Dep_', CAST(dep AS STRING), CASE WHEN pkg % 4 = 0 THEN '[B_b, a]' ELSE '' END, CASE pkg % 3 WHEN 0 THEN ' >=0.2, <2.0' WHEN 1 THEN ' (==1.2.*)' ELSE '' END,
    CASE kind WHEN 'optional' THEN "; extra == 'x'" WHEN 'peer' THEN "; python_version < '3.0'" ELSE '' END)"""
_REQUIREMENT_SQL = _REQUIREMENT.replace("STRING", "VARCHAR").replace("\"; extra == 'x'\"", "'; extra == ''x'''").replace("\"; python_version < '3.0'\"", "'; python_version < ''3.0'''")


@query("""SELECT pkg, concat('dep-', CAST(dep AS VARCHAR)) AS name, concat('dep-', CAST(dep AS VARCHAR), CASE WHEN pkg % 4 = 0 THEN '[a,b-b]' ELSE '' END) AS identity,
    CASE pkg % 3 WHEN 0 THEN '>=0.2,<2.0' WHEN 1 THEN '==1.2.*' ELSE '' END AS specifiers, CASE kind WHEN 'optional' THEN 'extra == ''x''' WHEN 'peer' THEN 'python_version < ''3.0''' END AS marker FROM fx_dep""")
def v12_parse_requirements(f):
    lines = f.fx_dep.select("pkg", F.concat(F.expr(_REQUIREMENT), F.lit("  # note")).alias("requirement"))
    comments = f.fx_dep.select("pkg", F.lit("# only a comment").alias("requirement"))
    out = M.parse_requirements(lines.union(comments))
    joined = F.array_join(F.transform("specifiers", lambda s: F.concat(s["op"], s["version"])), ",")
    return out.select("pkg", "name", "identity", joined.alias("specifiers"), "marker")


# Markers by number: text, and when they hold for the extra x and for none (3.12 on linux).
_MARKERS = (
    ("extra == 'x'", True, False), ("python_version < '3.0'", False, False), ("(extra == 'x' or python_version < '3') and python_version < '2'", False, False), ("sys_platform == 'win32'", False, False),
    ("os_name == 'nt' and python_version > '3'", False, False), ("'3.8' > python_version", False, False), ("python_version in '2.7 3.3'", False, False), ("sys_platform != \"win32\" and extra != 'x'", False, True),
    ("python_version >= '3.8' and (os_name == 'nt' or platform_system == 'Linux')", True, True), ("extra == 'y' or 'x' == extra", True, False), ("(os_name == 'nt'", False, False),
)


@query(f"""SELECT pkg, dep, pkg % 2 = 0 AS with_x FROM fx_dep JOIN (VALUES {", ".join(f"({i}, {x}, {none})" for i, (_, x, none) in enumerate(_MARKERS))}, ({len(_MARKERS)}, true, true)) m(i, for_x, for_none) ON (pkg * 2 + dep) % {len(_MARKERS) + 1} = i
WHERE CASE WHEN pkg % 2 = 0 THEN for_x ELSE for_none END""")
def v13_marker_filter(f):
    texts = F.array(*(F.lit(m) for m, _, _ in _MARKERS), F.lit(None).cast("string"))
    rows = f.fx_dep.select("pkg", "dep", (F.col("pkg") % 2 == 0).alias("with_x"), texts[((F.col("pkg") * 2 + F.col("dep")) % (len(_MARKERS) + 1)).cast("int")].alias("marker"))
    extras = F.when(F.col("with_x"), F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    return M.marker_filter(rows, "3.12", extras).select("pkg", "dep", "with_x")


# Specifiers, and what they allow of the fixture's versions: ord of versions, all but its last two digits is the release.
_SPECIFIERS = (
    ([(">=", "0.2"), ("<", "2.0")], "NOT pre AND r >= 200 AND r < 20000"), ([], "NOT pre OR NOT stable"), ([("==", "1.*")], "NOT pre AND r // 10000 = 1"), ([("==", "1.0.*")], "NOT pre AND r // 100 = 100"),
    ([("!=", "1.1.*"), (">=", "1")], "NOT pre AND r // 100 <> 101 AND r >= 10000"), ([("~=", "1.2")], "NOT pre AND r >= 10200 AND r < 20000"), ([("~=", "1.2.3")], "NOT pre AND r >= 10203 AND r < 10300"),
    ([("==", "1.2.0")], "NOT pre AND r = 10200"), ([("!=", "2")], "NOT pre AND r <> 20000"), ([(">", "1.3")], "NOT pre AND r > 10300"), ([(">=", "1.0rc1"), ("<", "1.2.3")], "r >= 10000 AND r < 10203"), ([("<", "1.2.3rc2")], "ord < 1020302"),
)
_CASES = " ".join(f"WHEN {i} THEN {test}" for i, (_, test) in enumerate(_SPECIFIERS))


@query(f"""WITH fit AS (SELECT pkg AS name, version, ord, ord // 100 AS r, pre, bool_or(NOT pre) OVER (PARTITION BY pkg, s) AS stable, CAST(s AS BIGINT) AS s FROM ver, range({len(_SPECIFIERS)}) t(s))
SELECT name, s AS spec, count(*) AS n FROM fit WHERE CASE s {_CASES} END GROUP BY ALL""")
def v14_specifier_match(f):
    v = f.fx_version.select(F.col("pkg").alias("name"), F.replace(F.col("version"), F.lit("-rc."), F.lit("rc")).alias("version"))
    s = "array<struct<op: string, version: string>>"
    own = [F.array(*(F.struct(F.lit(op), F.lit(x)) for op, x in specs)).cast(s) if specs else F.array().cast(s) for specs, _ in _SPECIFIERS]
    pairs = v.select("name", "version", F.posexplode(F.array(*own)).alias("spec", "specifiers"))
    return M.specifier_match(pairs).groupBy("name", F.col("spec").cast("bigint").alias("spec")).agg(F.count("*").alias("n"))


_BEST = """latest AS (SELECT t.pkg, t.version, ord, pre FROM fx_tag t JOIN ver v ON v.pkg = t.pkg AND v.version = t.version),
wanted AS (SELECT DISTINCT dep AS pkg, spec FROM fx_dep),
best AS (SELECT w.pkg, w.spec, max_by(v.version, CASE WHEN deprecated THEN 0 ELSE 1000000000 END + ord) AS version FROM wanted w JOIN specs s ON w.spec = s.spec JOIN ver v ON v.pkg = w.pkg WHERE NOT v.pre AND v.ord >= lo AND v.ord < hi GROUP BY w.pkg, w.spec),
matched AS (SELECT w.pkg, w.spec, CASE WHEN NOT l.pre AND l.ord >= lo AND l.ord < hi THEN l.version ELSE b.version END AS version,
    CASE WHEN NOT l.pre AND l.ord >= lo AND l.ord < hi THEN 'latest' WHEN b.version IS NOT NULL THEN 'range' END AS via
    FROM wanted w JOIN specs s ON w.spec = s.spec LEFT JOIN latest l ON l.pkg = w.pkg LEFT JOIN best b ON b.pkg = w.pkg AND b.spec = w.spec)"""


# Versions that don't fit the platform are picked all the same, and leave the spec unresolved.
_FITTED = f"""{_BEST}, fitted AS (SELECT m.pkg, m.spec, CASE WHEN NOT v.yanked THEN m.version END AS version, CASE WHEN v.yanked THEN 'incompatible' ELSE m.via END AS via
    FROM matched m LEFT JOIN fx_version v ON v.pkg = m.pkg AND v.version = m.version)"""


def for_platform(f):
    """Versions with the platforms they are for; yanked ones are made to be for others alone."""
    os = F.when(F.col("yanked"), F.array(F.lit("win32"), F.lit("!linux")))
    return f.fx_version.withColumns({"os": os, "cpu": F.array(F.lit("arm64"), F.lit("x64")), "libc": F.lit(None).cast("array<string>")})


@query(f"""WITH {_FITTED} SELECT pkg, spec, pkg AS target, version, via FROM fitted UNION ALL SELECT pkg + 1000000, concat('npm:', CAST(pkg AS VARCHAR), '@', spec), pkg, version, via FROM fitted""")
def j1_best_match_npm(f):
    wanted = f.fx_dep.select(F.col("dep").alias("pkg"), "spec")
    alias = wanted.select(F.col("pkg") + 1000000, F.concat(F.lit("npm:"), "pkg", F.lit("@"), "spec"))
    return M.best_match_npm(wanted.union(alias), for_platform(f), f.fx_tag, M.platform_fits())


@query("""WITH req AS (SELECT DISTINCT pkg AS root, dep AS name, CASE pkg % 2 WHEN 0 THEN 20000 ELSE 1000000 END AS lo FROM fx_dep),
fit AS (SELECT root, name, version, ord FROM req JOIN ver ON ver.pkg = name WHERE NOT yanked AND NOT pre AND NOT (pkg % 3 = 0 AND deprecated) AND ord // 100 * 100 >= lo AND ord // 100 < 20000)
SELECT root, name, version, CAST(row_number() OVER (PARTITION BY root, name ORDER BY ord DESC) AS BIGINT) AS rank FROM fit""")
def j2_candidates_pip(f):
    s = "array<struct<op: string, version: string>>"
    low = F.when(F.col("pkg") % 2 == 0, "0.2").otherwise("1")
    first = F.array(F.struct(F.lit(">=").alias("op"), low.alias("version"))).cast(s)
    second = F.array(F.struct(F.lit("<").alias("op"), F.lit("2").alias("version"))).cast(s)
    needs = f.fx_dep.select(F.col("pkg").alias("root"), F.col("dep").alias("name"), F.explode(F.array(first, second)).alias("specifiers"))
    versions = f.fx_version.select(F.col("pkg").alias("name"), F.replace(F.col("version"), F.lit("-rc."), F.lit("rc")).alias("version"), "yanked")
    # a third of the packages have no metadata of deprecated versions
    known = f.fx_version.filter("NOT (pkg % 3 = 0 AND deprecated)").select(F.col("pkg").alias("name"), F.replace(F.col("version"), F.lit("-rc."), F.lit("rc")).alias("version"))
    return M.candidates_pip(needs, versions, known)


@query("""WITH chosen AS (SELECT pkg, max_by(version, ord) AS version FROM ver WHERE pkg % 5 <> 0 GROUP BY pkg)
SELECT d.pkg AS src, d.dep AS name, d.spec, d.kind, c.version, CASE WHEN c.version IS NULL THEN kind = 'optional' ELSE NOT pre AND ord >= lo AND ord < hi END AS valid,
    CASE WHEN c.version IS NULL THEN true ELSE NOT (NOT pre AND ord >= lo AND ord < hi) END AS problem
FROM fx_dep d JOIN specs s ON s.spec = d.spec LEFT JOIN chosen c ON c.pkg = d.dep LEFT JOIN ver v ON v.pkg = c.pkg AND v.version = c.version""")
def j3_check_edges(f):
    chosen = f.fx_version.filter("pkg % 5 <> 0").groupBy(F.col("pkg").alias("name")).agg(F.max_by("version", V.semver(F.col("version"))["key"]).alias("version"))
    edges = f.fx_dep.select(F.col("pkg").alias("src"), F.col("dep").alias("name"), "spec", "kind")
    return M.check_edges(edges, chosen).select("src", "name", "spec", "kind", "version", "valid", "problem")


@query("""WITH ids AS (SELECT pkg, version, min(pkg * 1000 + ord) AS version_id FROM ver WHERE pkg % 7 <> 0 GROUP BY ALL)
SELECT v.pkg AS name, v.version AS num, version_id, version_id IS NULL AS error FROM fx_version v LEFT JOIN ids ON ids.pkg = v.pkg AND ids.version = v.version""")
def j4_attach_ids(f):
    v = V.semver(F.col("version"))
    order = ((v["major"] * 100 + v["minor"]) * 100 + v["patch"]) * 100 + F.coalesce(F.regexp_extract("version", r"-rc\.(\d+)$", 1).try_cast("bigint"), F.lit(99))
    rows = T.per_text(f.fx_version.select("pkg", "version"), "version", ord=order)
    ids = rows.filter("pkg % 7 <> 0").select(F.col("pkg").alias("name"), F.col("version").alias("num"), (F.col("pkg") * 1000 + F.col("ord")).alias("version_id"))
    # each id and the one after it, of rows that are grouped once
    ids = ids.select("name", "num", F.explode(F.array(F.col("version_id"), F.col("version_id") + 1)).alias("version_id"))
    out = M.attach_ids(rows.select(F.col("pkg").alias("name"), F.col("version").alias("num")), ids)
    return out.withColumn("error", F.col("version_id").isNull())


@query("""SELECT DISTINCT pkg AS version_id FROM fx_dep WHERE kind <> 'peer' AND pkg NOT IN (SELECT pkg FROM fx_version WHERE yanked AND version LIKE '0.1%') AND pkg % 11 <> 3 AND pkg % 13 <> 5""")
def j5_build_worklist(f):
    deps = f.fx_dep.select(F.col("pkg").alias("version_id"), F.when(F.col("kind") == "peer", 2).otherwise(0).alias("kind"))
    yanked = f.fx_version.filter("yanked AND version LIKE '0.1%'").select(F.col("pkg").alias("version_id"))
    ids = f.fx_dep.select(F.col("pkg").alias("version_id"))
    return M.build_worklist(deps, yanked, ids.filter("version_id % 11 = 3"), ids.filter("version_id % 13 = 5"))


@query("""SELECT pkg AS path, version, CASE WHEN pkg % 4 = 0 AND version LIKE '1.%' THEN pkg + 1000000 WHEN pkg % 3 = 0 THEN CASE WHEN pkg % 9 = 0 THEN NULL ELSE pkg + 2000000 END ELSE pkg END AS to_path,
    CASE WHEN pkg % 4 = 0 AND version LIKE '1.%' THEN '9.9.9' WHEN pkg % 3 = 0 THEN CASE WHEN pkg % 9 = 0 THEN NULL ELSE '8.8.8' END ELSE version END AS to_version,
    CASE WHEN pkg % 4 = 0 AND version LIKE '1.%' THEN 'replaced' WHEN pkg % 9 = 0 THEN 'UNSUPPORTED_REPLACE' WHEN pkg % 3 = 0 THEN 'replaced' ELSE 'kept' END AS status FROM fx_version""")
def j6_apply_replaces(f):
    mods = f.fx_version.select(F.col("pkg").alias("path"), "version")
    exact = mods.filter("path % 4 = 0 AND version LIKE '1.%'").select("path", "version", (F.col("path") + 1000000).alias("new_path"), F.lit("9.9.9").alias("new_version"))
    wild = mods.filter("path % 3 = 0").select("path").distinct()
    wild = wild.select("path", F.lit("").alias("version"), (F.col("path") + 2000000).alias("new_path"), F.when(F.col("path") % 9 == 0, "").otherwise("8.8.8").alias("new_version"))
    return M.apply_replaces(mods, exact.union(wild))


@query("SELECT pkg AS path, version FROM fx_version WHERE NOT (yanked AND deprecated)")
def j7_apply_excludes(f):
    mods = f.fx_version.select(F.col("pkg").alias("path"), "version", "yanked", "deprecated")
    return M.apply_excludes(mods.select("path", "version"), mods.filter("yanked AND deprecated"))


@query("""SELECT DISTINCT pkg // 10 AS src, dep // 10 AS dst, string_agg(DISTINCT spec, ' || ' ORDER BY spec) AS "constraint" FROM fx_dep GROUP BY ALL""")
def j8_edge_constraints(f):
    rows = f.fx_dep.select(F.expr("pkg div 10").alias("src"), F.expr("dep div 10").alias("dst"), F.col("spec").alias("requirement"))
    return M.edge_constraints(rows.select("src", "dst").distinct(), rows)


@query("""SELECT pkg AS root, dep AS ga, CAST(dep % 4 AS BIGINT) AS depth, CASE WHEN dep % 4 >= 2 AND dep % 3 = 0 THEN 'managed' ELSE spec END AS version FROM fx_dep""")
def j9_managed_override(f):
    deps = f.fx_dep.select(F.col("pkg").alias("root"), F.col("dep").alias("ga"), F.col("spec").alias("version"), (F.col("dep") % 4).alias("depth"))
    managed = deps.filter("ga % 3 = 0").select("root", "ga", F.lit("managed").alias("managed")).distinct()
    return M.managed_override(deps, managed).select("root", "ga", "depth", "version")


@query("SELECT DISTINCT name FROM fx_change WHERE name NOT IN (SELECT name FROM fx_change WHERE deleted AND seq % 5 = 0)")
def j10_active_packages(f):
    names = f.fx_change.select("name").distinct()
    return M.active_packages(names, f.fx_change.filter("deleted AND seq % 5 = 0"))
