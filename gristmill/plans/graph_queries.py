"""Graphs of all packages at once, and the tables and figures made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import graphs as G
from ..operators import reports as R
from ..operators import tables as T
from .registry import query
from ..operators.matching import platform_fits
from .version_queries import _FITTED, for_platform

_EDGES = "edges AS (SELECT DISTINCT pkg AS src, dep AS dst FROM fx_dep)"
_REACH = f"{_EDGES}, reach(root, node, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION SELECT r.root, e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node)"
_DEPTHS = f"{_REACH}, depths AS (SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node)"


def _edges(f):
    return f.fx_dep.select(F.col("pkg").alias("src"), F.col("dep").alias("dst")).distinct()


def _roots(f):
    return f.part.select(F.col("p_partkey").alias("root"))


_GO = """req AS (SELECT pkg AS path, concat('v1.', CAST(i AS VARCHAR), '.0') AS version, dep, concat('v1.', CAST(pkg % 5 AS VARCHAR), '.0') AS dep_version FROM fx_dep, range(5) t(i)),
ex(root, path, version) AS (SELECT p_partkey, p_partkey, 'v1.0.0' FROM part UNION SELECT ex.root, r.dep, r.dep_version FROM ex JOIN req r ON r.path = ex.path AND r.version = ex.version
    WHERE r.dep <> ex.root AND NOT (LAZY AND ex.path = ex.root AND ex.root % 3 = 0 AND r.dep % 3 = 0)),
loaded AS (SELECT * FROM ex UNION SELECT p_partkey, r.dep, r.dep_version FROM part JOIN req r ON r.path = p_partkey AND r.version = 'v1.0.0'),
go_edges AS (SELECT DISTINCT l.root, r.* FROM loaded l JOIN req r ON r.path = l.path AND r.version = l.version WHERE r.dep <> l.root),
go_nodes AS (SELECT p_partkey AS root, p_partkey AS path, 'v1.0.0' AS version FROM part UNION SELECT root, dep, dep_version FROM go_edges)"""


def _go(f, minor):
    of = lambda x: F.concat(F.lit("v1."), x, F.lit(".0"))
    req = f.fx_dep.select(F.col("pkg").alias("path"), F.explode(F.array(*(F.lit(f"v1.{i}.0") for i in range(5)))).alias("version"), "dep", of(F.col("pkg") % 5).alias("dep_version"))
    paths = req.select("path", "version").union(req.select("dep", "dep_version")).union(f.part.select("p_partkey", F.lit("v1.0.0"))).distinct()
    return G.requirement_graph_go(req, paths.withColumn("minor", minor), _roots(f).withColumn("version", F.lit("v1.0.0")))


@query(f"WITH RECURSIVE {_GO.replace('LAZY', 'false')} SELECT 'node' AS kind, root, path, version, NULL AS dep, NULL AS dep_version FROM go_nodes UNION ALL SELECT 'edge', root, path, version, dep, dep_version FROM go_edges", recursive=True)
def g1_requirement_graph_go(f):
    nodes, edges = _go(f, F.lit(16))
    return T.union_items(nodes.withColumn("kind", F.lit("node")), edges.withColumn("kind", F.lit("edge"))).select("kind", "root", "path", "version", "dep", "dep_version")


@query(f"WITH RECURSIVE {_GO.replace('LAZY', 'true')} SELECT root, path, version FROM go_nodes", recursive=True)
def g2_lazy_pruning(f):
    return _go(f, F.when(F.col("path") % 3 == 0, 17).otherwise(16))[0]


@query(f"WITH RECURSIVE {_GO.replace('LAZY', 'false')} SELECT root, path, max(version) AS version, CAST(row_number() OVER (PARTITION BY root ORDER BY path <> root, path) AS BIGINT) AS position FROM go_nodes GROUP BY root, path", recursive=True)
def g3_build_list_go(f):
    return G.build_list_go(_go(f, F.lit(16))[0], V.go_key(F.col("version")))


@query(f"WITH RECURSIVE {_DEPTHS} SELECT * FROM depths", recursive=True)
def g4_min_depth(f):
    return G.min_depth(_edges(f), _roots(f))


@query(f"WITH RECURSIVE {_REACH} SELECT root AS version_from, node AS version_to, depth AS dep_level FROM reach WHERE depth > 0", recursive=True)
def g5_flat_closure(f):
    return G.closure(_edges(f), _roots(f))


@query(f"WITH RECURSIVE {_REACH} SELECT DISTINCT r.root AS version_from, e.dst AS version_to, r.node AS version_parent, r.depth + 1 AS dep_level FROM reach r JOIN edges e ON e.src = r.node", recursive=True)
def g6_complete_closure(f):
    return G.closure(_edges(f), _roots(f), parents=True)


@query(f"WITH RECURSIVE {_EDGES}, alive(n) AS (SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT dst FROM alive JOIN edges ON src = n) SELECT src, dst FROM edges WHERE src IN (SELECT n FROM alive)", recursive=True)
def g7_prune_orphans(f):
    return G.prune_orphans(_edges(f), f.part.filter("p_size < 10").select(F.col("p_partkey").alias("root")))


def _features(f):
    return f.fx_feature.select("pkg", "feature", "member")


@query("""SELECT d.pkg, CAST(d.dep AS VARCHAR) AS dep FROM (SELECT DISTINCT pkg, dep FROM fx_dep) d WHERE NOT EXISTS (SELECT 1 FROM fx_feature x WHERE x.pkg = d.pkg AND x.member LIKE CAST(d.dep AS VARCHAR) || '?/%')
    OR EXISTS (SELECT 1 FROM fx_feature x WHERE x.pkg = d.pkg AND x.member = 'dep:' || CAST(d.dep AS VARCHAR)) OR d.dep % 5 = 0""")
def g8_drop_weak_feature_edges(f):
    edges = f.fx_dep.select("pkg", F.col("dep").cast("string").alias("dep")).distinct()
    return G.drop_weak_feature_edges(edges, _features(f), edges.filter("CAST(dep AS BIGINT) % 5 = 0").withColumnRenamed("dep", "feature"))


@query("""WITH all_of AS (SELECT pkg, feature FROM fx_feature UNION SELECT d.pkg, CAST(d.dep AS VARCHAR) FROM fx_dep d WHERE kind = 'optional' AND NOT EXISTS (SELECT 1 FROM fx_feature x WHERE x.pkg = d.pkg AND x.member = 'dep:' || CAST(d.dep AS VARCHAR)))
SELECT pkg, string_agg(feature, ',' ORDER BY feature) AS features FROM all_of GROUP BY pkg""")
def g9_root_features(f):
    deps = f.fx_dep.select("pkg", F.col("dep").cast("string").alias("dep"), (F.col("kind") == "optional").alias("optional"))
    return G.root_features(_features(f), deps).select("pkg", F.array_join("features", ",").alias("features"))


_CLOSURE = f"""{_FITTED}, resolved AS (SELECT DISTINCT d.pkg, d.version AS pkg_version, d.dep, d.spec, m.version FROM fx_vdep d LEFT JOIN fitted m ON m.pkg = d.dep AND m.spec = d.spec),
walk(root, pkg, pkg_version, level) AS (SELECT pkg, pkg, version, CAST(1 AS BIGINT) FROM fx_tag UNION SELECT w.root, r.dep, r.version, w.level + 1 FROM walk w JOIN resolved r ON r.pkg = w.pkg AND r.pkg_version = w.pkg_version WHERE r.version IS NOT NULL),
firsts AS (SELECT root, pkg, pkg_version, min(level) AS level FROM walk GROUP BY ALL),
closed AS (SELECT f.root, r.pkg, r.pkg_version, r.dep, r.spec, r.version, f.level FROM firsts f JOIN resolved r ON r.pkg = f.pkg AND r.pkg_version = f.pkg_version)"""


def _closed(f):
    """Each package's latest version and what it depends on; packages without versions have none."""
    roots = f.part.select(F.col("p_partkey").alias("root")).join(f.fx_tag.select(F.col("pkg").alias("root"), "version"), "root", "left")
    return G.highest_match_closure(roots, f.fx_vdep, for_platform(f), f.fx_tag, "npm", platform_fits())


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT root, pkg, pkg_version, dep, spec, version, level, version IS NOT NULL AND (SELECT count(*) FROM firsts o WHERE o.root = c.root AND o.pkg = c.dep) > 1 AS conflict, 'ok' AS state FROM closed c
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 0, false, 'empty' FROM part WHERE p_partkey NOT IN (SELECT pkg FROM fx_tag)""", recursive=True)
def g10_highest_match_closure(f):
    edges, conflicts, states = _closed(f)
    marks = conflicts.select("root", F.col("pkg").alias("dep"), F.lit(True).alias("c"))
    many = F.coalesce("c", F.lit(False)) & F.col("version").isNotNull()
    rows = edges.join(marks, ["root", "dep"], "left").select("root", "pkg", "pkg_version", "dep", "spec", "version", "level", many.alias("conflict")).join(states, "root")
    none = states.filter("state = 'empty'").select("root", "state", F.lit(0).cast("bigint").alias("level"), F.lit(False).alias("conflict"))
    return rows.unionByName(none, allowMissingColumns=True)


_KINDS = "kinds AS (SELECT DISTINCT pkg AS src, dep AS dst, kind FROM fx_dep)"


@query(f"""WITH RECURSIVE {_KINDS}, paths(root, node, path, depth) AS (SELECT p_partkey, p_partkey, '', CAST(0 AS BIGINT) FROM part
    UNION SELECT p.root, k.dst, p.path || '/' || CAST(k.dst AS VARCHAR), p.depth + 1 FROM paths p JOIN kinds k ON k.src = p.node),
least AS (SELECT root, node, min(depth) AS depth, arg_min(path, lpad(CAST(depth AS VARCHAR), 4, '0') || path) AS path FROM paths GROUP BY ALL),
visits AS (SELECT l.root, k.src, k.dst, k.kind, l.depth + 1 AS level, row_number() OVER (PARTITION BY l.root, k.dst ORDER BY l.depth, l.path) AS nth FROM least l JOIN kinds k ON k.src = l.node)
SELECT root, src, dst, kind, level, nth > 1 AS deduped, kind = 'peer' AS peer, src % 5 = 0 AS alias FROM visits""", recursive=True)
def g11_dedupe_tree_edges(f):
    edges = f.fx_dep.select(F.col("pkg").alias("src"), F.col("dep").alias("dst"), "kind").distinct()
    return G.dedupe_tree_edges(edges.withColumn("alias_target", F.when(F.col("src") % 5 == 0, F.col("dst").cast("string"))), _roots(f))


@query("""WITH t AS (SELECT l_orderkey AS root, l_suppkey % 3 AS ga, concat('1.', CAST(l_partkey AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR)) AS version, l_linenumber % 3 AS depth, concat(CAST(l_linenumber AS VARCHAR), '/', CAST(l_partkey AS VARCHAR), '/', CAST(l_suppkey AS VARCHAR), '/', CAST(l_quantity AS INT)) AS path FROM lineitem)
SELECT root, ga, version, row_number() OVER w = 1 AS selected, first(version) OVER w AS winner FROM t WINDOW w AS (PARTITION BY root, ga ORDER BY depth, path)""")
def g12_mediate_nearest(f):
    version = F.concat(F.lit("1."), F.col("l_partkey"), F.lit("."), F.col("l_linenumber"))
    tree = f.lineitem.select(F.col("l_orderkey").alias("root"), (F.col("l_suppkey") % 3).alias("ga"), version.alias("version"), (F.col("l_linenumber") % 3).alias("depth"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("path"))
    return G.mediate_nearest(tree).select("root", "ga", "version", "selected", "winner")


@query(f"""WITH RECURSIVE {_DEPTHS}, outside(node, dep) AS (SELECT d.root, d.node FROM depths d JOIN edges e ON e.dst = d.node WHERE d.root <> d.node AND NOT EXISTS (SELECT 1 FROM depths x WHERE x.root = d.root AND x.node = e.src)
    UNION SELECT o.node, e.dst FROM outside o JOIN edges e ON e.src = o.dep WHERE e.dst <> o.node)
SELECT root AS node, node AS dep FROM depths d WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.node = d.root AND o.dep = d.node)""", recursive=True)
def g13_exclusive_dependencies(f):
    return G.exclusive_dependencies(_edges(f), f.part.select(F.col("p_partkey").alias("node")))


# Edges from every fifth package count as from the target's own dependency set.
@query("""WITH placed AS (SELECT pkg AS node, min(version) AS version FROM fx_version GROUP BY pkg), cand AS (SELECT pkg AS node, max(version) AS candidate FROM fx_version GROUP BY pkg),
r AS (SELECT p.node, p.version, c.candidate, v.ord >= u.ord AS newer, bool_and(d.spec IS NULL OR d.pkg % 5 = 0 OR (NOT v.pre AND v.ord >= s.lo AND v.ord < s.hi)) AS replaceable, count(d.spec) AS n FROM placed p JOIN cand c USING (node)
    JOIN ver v ON v.pkg = p.node AND v.version = c.candidate JOIN ver u ON u.pkg = p.node AND u.version = p.version LEFT JOIN fx_dep d ON d.dep = p.node LEFT JOIN specs s ON s.spec = d.spec GROUP BY ALL)
SELECT node, version, candidate, replaceable, n = 0 OR candidate = version OR (replaceable AND newer) AS dedupable FROM r""")
def g14_replaceable(f):
    per = f.fx_version.groupBy(F.col("pkg").alias("name")).agg(F.min("version").alias("version"), F.max("version").alias("candidate"))
    placed = per.select(F.col("name").alias("node"), "name", "version")
    incoming = f.fx_dep.select(F.col("dep").alias("node"), F.col("pkg").alias("src"), "spec")
    own = incoming.filter("src % 5 = 0").select("node", F.col("src").alias("dep"))
    return G.replaceable(placed, incoming, per.select("name", "candidate"), own).select("node", "version", "candidate", "replaceable", "dedupable")


@query(f"""WITH RECURSIVE {_CLOSURE}, p AS (SELECT root, dep, version, min(level * 1000000000 + pkg) AS f, count(*) AS uses FROM closed WHERE version IS NOT NULL GROUP BY ALL),
t AS (SELECT root, dep, arg_min(version, lpad(CAST(f AS VARCHAR), 14, '0') || version) AS top, count(*) - 1 AS nested_versions, CAST(sum(uses) AS BIGINT) AS uses FROM p GROUP BY root, dep),
peers AS (SELECT DISTINCT pkg, version AS pkg_version, dep, spec FROM fx_vdep WHERE kind = 'peer'),
broken AS (SELECT c.root, c.dep, count(*) AS n FROM closed c JOIN peers x ON x.pkg = c.pkg AND x.pkg_version = c.pkg_version AND x.dep = c.dep AND x.spec = c.spec LEFT JOIN t ON t.root = c.root AND t.dep = c.dep
    LEFT JOIN ver v ON v.pkg = t.dep AND v.version = t.top JOIN specs s ON s.spec = c.spec WHERE t.top IS NULL OR NOT (NOT v.pre AND v.ord >= lo AND v.ord < hi) GROUP BY ALL)
SELECT root, dep, top, nested_versions, uses, n AS peer_conflicts FROM t FULL JOIN broken USING (root, dep)""", recursive=True)
def g15_hoist_report(f):
    top, broken = G.hoist_report(_closed(f)[0], f.fx_vdep.filter("kind = 'peer'").select("pkg", F.col("version").alias("pkg_version"), "dep", "spec"))
    return top.join(broken.groupBy("root", "dep").agg(F.count("*").alias("peer_conflicts")), ["root", "dep"], "full_outer")


# The edge 1 -> 7 closes short cycles; a ring of 20 nodes below zero, one for each of the first parts, is a long one.
@query(f"""WITH RECURSIVE {_EDGES}, looped AS (SELECT * FROM edges UNION SELECT 1, 7 UNION SELECT -1 - p_partkey, -1 - (p_partkey + 1) % 20 FROM part WHERE p_partkey < 20),
r(a, b, n) AS (SELECT src, dst, CAST(1 AS BIGINT) FROM looped UNION SELECT r.a, l.dst, r.n + 1 FROM r JOIN looped l ON l.src = r.b WHERE r.n < 24)
SELECT a AS node, min(n) AS length FROM r WHERE a = b GROUP BY a""", recursive=True)
def g16_cycle_report(f):
    key = F.col("p_partkey")
    ring = f.part.filter("p_partkey < 20").select((-1 - key).alias("src"), (-1 - (key + 1) % 20).alias("dst"))
    loop = f.part.filter("p_partkey = 1").select(key.alias("src"), (key + 6).alias("dst"))
    return G.cycle_report(_edges(f).union(loop).union(ring))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT pkg AS src, dep AS dst, kind, spec <> '*' AS valid FROM fx_dep), p AS (SELECT DISTINCT src, dst FROM k WHERE kind = 'peer' AND valid), b AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
r(n, m) AS (SELECT src, src FROM b UNION SELECT r.n, b.dst FROM r JOIN b ON b.src = r.m), g AS (SELECT n AS node, min(m) AS grp FROM r GROUP BY n),
e AS (SELECT DISTINCT src, dst FROM k WHERE kind <> 'peer' AND valid AND dst IN (SELECT node FROM g)),
w(a, n) AS (SELECT DISTINCT dst, dst FROM e UNION SELECT w.a, p.dst FROM w JOIN p ON p.src = w.n), c AS (SELECT w.n AS node, count(*) AS entering FROM w JOIN e ON e.dst = w.a GROUP BY w.n)
SELECT node, g.grp AS "group", coalesce(entering, 0) AS entering FROM g LEFT JOIN c USING (node)""", recursive=True)
def g17_peer_groups(f):
    edges = f.fx_dep.select(F.col("pkg").alias("src"), F.col("dep").alias("dst"), "kind", (F.col("spec") != "*").alias("valid")).distinct()
    members, entries = G.peer_groups(edges)
    return members.join(entries.groupBy("node").agg(F.count("*").alias("entering")), "node", "left").na.fill(0, ["entering"])


@query("""WITH RECURSIVE up(gav, place, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT gav, place // 2, d + 1 FROM up WHERE place > 0), k AS (SELECT gav, min(place) FILTER (WHERE d = m) AS k FROM (SELECT *, min(d) FILTER (WHERE place % 4 = 0) OVER (PARTITION BY gav) AS m FROM up) GROUP BY gav)
SELECT gav, 'k' AS key, concat('k', CAST(k AS VARCHAR)) AS value FROM k UNION ALL SELECT gav, 'full', concat('x-k', CAST(k AS VARCHAR), '-${none}') FROM k""", recursive=True)
def g18_effective_poms(f):
    key = F.col("p_partkey")
    poms = f.part.select(key.alias("gav"), F.when(key > 0, F.floor(key / 2)).alias("parent"))
    props = f.part.filter("p_partkey % 4 = 0").select(key.alias("gav"), F.lit("k").alias("key"), F.concat(F.lit("k"), key).alias("value"))
    base = f.part.filter("p_partkey = 0").select(key.alias("gav"), F.lit("full").alias("key"), F.lit("x-${k}-${none}").alias("value"))
    return G.effective_poms(poms, props.union(base))


def _tree(f):
    depths = G.min_depth(_edges(f), _roots(f))
    nodes = R.node_table(depths.select("root", F.col("node").alias("name"), F.lit("1").alias("version"), "depth"), "pip")
    edges = depths.select("root", F.col("node").alias("src"), F.col("depth").alias("parent_depth")).join(f.fx_dep.select(F.col("pkg").alias("src"), F.col("dep").alias("dst"), F.col("spec").alias("constraint")), "src")
    return depths, nodes, edges.select("root", "src", "dst", "constraint", "parent_depth")


@query(f"WITH RECURSIVE {_DEPTHS} SELECT root, concat('pip:', CAST(node AS VARCHAR), '@1') AS id, node AS name, '1' AS version, CASE WHEN depth = 0 THEN 'root' ELSE 'runtime' END AS scope, '{{}}' AS attributes FROM depths", recursive=True)
def r1_node_table(f):
    return _tree(f)[1]


_RELATIONS = f"{_DEPTHS}, tree AS (SELECT DISTINCT d.root, x.pkg AS src, x.dep AS dst, x.spec, d.depth AS pd FROM depths d JOIN fx_dep x ON x.pkg = d.node)"


@query(f"""WITH RECURSIVE {_RELATIONS} SELECT e, t.root, src, dst, spec AS "constraint", CASE WHEN (e = 'cargo' AND src = t.root) OR (e = 'pip' AND c.depth = 1) OR (e = 'npm' AND pd = 0) THEN 'direct' ELSE 'transitive' END AS relation, pd + 1 AS depth
FROM tree t JOIN depths c ON c.root = t.root AND c.node = t.dst, (VALUES ('cargo'), ('pip'), ('npm')) v(e)""", recursive=True)
def r2_edge_table(f):
    depths, _, edges = _tree(f)
    return R.edge_table(edges, depths, "cargo", "pip", "npm")


@query(f"""WITH RECURSIVE {_DEPTHS} SELECT root, count(*) AS node_count, count(*) FILTER (WHERE depth = 1) AS direct_nodes FROM depths GROUP BY root""", recursive=True)
def r3_graph_document(f):
    depths, nodes, edges = _tree(f)
    docs = R.graph_document(nodes, R.edge_table(edges, depths, "pip"))
    # read once for both counts, and no more of it than they need
    d = F.from_json("document", "struct<nodes: array<struct<scope: string>>, edges: array<struct<dst: bigint, relation: string>>>")
    read = docs.select("root", d.alias("d")).select("root", F.col("d.nodes").alias("nodes"), F.col("d.edges").alias("edges"))
    direct = F.size(F.array_distinct(F.transform(F.filter("edges", lambda e: e["relation"] == "direct"), lambda e: e["dst"])))
    return read.select("root", F.size("nodes").cast("bigint").alias("node_count"), direct.cast("bigint").alias("direct_nodes"))


@query(f"""WITH RECURSIVE {_RELATIONS}, n AS (SELECT root, count(*) AS node_count FROM depths GROUP BY root), e AS (SELECT t.root, count(*) AS edge_count, count(*) FILTER (WHERE c.depth = 1) AS direct_dependency_count FROM tree t JOIN depths c ON c.root = t.root AND c.node = t.dst GROUP BY t.root)
SELECT root, node_count, node_count AS entry_count, coalesce(edge_count, 0) AS edge_count, coalesce(direct_dependency_count, 0) AS direct_dependency_count FROM n LEFT JOIN e USING (root)""", recursive=True)
def a1_graph_metrics(f):
    depths, nodes, edges = _tree(f)
    return R.graph_metrics(nodes, R.edge_table(edges, depths, "pip"))


@query("SELECT count(*) AS versions, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dependencies FROM (SELECT pkg, count(*) AS n FROM fx_dep WHERE pkg NOT IN (SELECT pkg FROM fx_dep WHERE kind = 'peer') GROUP BY pkg)")
def a2_dependency_totals(f):
    return R.dependency_totals(f.fx_dep.select(F.col("pkg").alias("root")), f.fx_dep.filter("kind = 'peer'").select(F.col("pkg").alias("root")))


def _items(f):
    status = F.when(F.col("o_orderstatus") == "F", "stored").when(F.col("o_orderstatus") == "O", "error").otherwise("deleted")
    return f.orders.select((F.col("o_custkey") % 400).alias("run"), F.col("o_orderkey").alias("item"), status.alias("status"), (F.col("o_orderkey") % 3).alias("warnings"))


_ITEMS = "items AS (SELECT o_custkey % 400 AS run, o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'stored' WHEN 'O' THEN 'error' ELSE 'deleted' END AS status, o_orderkey % 3 AS warnings FROM orders)"
_STATUS = f"{_ITEMS}, c AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'stored') AS s, count(*) FILTER (WHERE status = 'deleted') AS d FROM items GROUP BY run)"


@query(f"""WITH {_STATUS} SELECT p AS policy, run, errors, total, CASE WHEN errors = 0 THEN 'ok' WHEN (p = 'build' AND s > 0) OR (p = 'sync' AND s + d > 0) OR (p = 'maven' AND errors < total) THEN 'partial' ELSE 'error' END AS run_status FROM c, (VALUES ('build'), ('sync'), ('pip'), ('maven'), ('index')) v(p)""")
def a3_run_status(f):
    return T.union_items(*(R.run_status(_items(f), p, ["run"]).withColumn("policy", F.lit(p)) for p in ("build", "sync", "pip", "maven", "index")))


@query(f"WITH {_ITEMS} SELECT run, count(*) FILTER (WHERE status = 'stored') AS stored, count(*) FILTER (WHERE status = 'error') AS error, count(*) AS total, CAST(sum(warnings) AS BIGINT) AS warnings FROM items GROUP BY run")
def a4_status_counts(f):
    return R.status_counts(_items(f), ["run"], ("stored", "error"))


@query("SELECT dep AS id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS extras, CASE WHEN bool_or(pkg % 9 = 0) THEN 'root' ELSE 'runtime' END AS scope FROM fx_dep GROUP BY dep")
def a5_merge_nodes(f):
    rows = f.fx_dep.select(F.col("dep").alias("id"), F.array("kind").alias("extras"), F.when(F.col("pkg") % 9 == 0, "root").otherwise("runtime").alias("scope"))
    return R.merge_nodes(rows).select("id", F.array_join("extras", ",").alias("extras"), "scope")


@query("""SELECT l_orderkey AS root, concat('@s/', CAST(l_partkey % 3 AS VARCHAR)) AS name, l_returnflag AS version, count(DISTINCT l_linenumber) AS n_paths FROM lineitem GROUP BY ALL UNION ALL SELECT o_orderkey, '', 'r', 1 FROM orders""")
def a6_install_paths(f):
    path = F.concat(F.lit("node_modules/p"), F.col("l_linenumber"), F.lit("/node_modules/@s/"), F.col("l_partkey") % 3)
    rows = f.lineitem.select(F.col("l_orderkey").alias("root"), path.alias("path"), F.col("l_returnflag").alias("version"))
    rows = rows.union(f.orders.select("o_orderkey", F.lit("."), F.lit("r")))
    return R.install_paths(rows).select("root", "name", "version", F.size("paths").cast("bigint").alias("n_paths"))


@query("SELECT pkg, bool_and(yanked) AS yanked FROM fx_version GROUP BY pkg")
def a7_yanked_rollup(f):
    return R.yanked_rollup(f.fx_version.select("pkg", F.when(F.col("yanked"), True).alias("yanked")), ["pkg"])


@query("""WITH b AS (SELECT CAST(0 AS BIGINT) AS run, seq // 100 AS batch_id, count(*) AS processed, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE NOT deleted) AS updated FROM fx_change GROUP BY ALL)
SELECT run, batch_id, CAST(sum(processed) OVER w AS BIGINT) AS processed, CAST(sum(updated) OVER w AS BIGINT) AS updated, CAST(sum(deleted) OVER w AS BIGINT) AS deleted FROM b WINDOW w AS (PARTITION BY run ORDER BY batch_id)""")
def a8_follow_totals(f):
    batches = f.fx_change.groupBy(F.lit(0).cast("bigint").alias("run"), F.expr("seq div 100").alias("batch_id")).agg(F.count("*").alias("processed"), F.count_if(~F.col("deleted")).alias("updated"), F.count_if("deleted").alias("deleted"))
    return R.follow_totals(batches, "run")


@query(f"WITH {_STATUS} SELECT run, item, status, warnings, errors, total, CASE WHEN errors = 0 THEN 'ok' WHEN s + d > 0 THEN 'partial' ELSE 'error' END AS run_status FROM items JOIN c USING (run)")
def r5_run_report(f):
    return R.run_report(_items(f), "sync", ["run"])
