"""Walks without caps, and what a closure follows."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import versions as V
from gristmill.operators import graphs as G
from gristmill.operators import matching as M
from gristmill.sources import documents as D


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_deep_chain(spark):
    edges = _edges(spark, [(i, i + 1) for i in range(80)])
    roots = spark.createDataFrame([(0,)], "root bigint")
    got = sorted((r.version_to, r.dep_level) for r in G.closure(edges, roots).collect())
    assert got == [(i, i) for i in range(1, 81)]
    assert {(r.node, r.depth) for r in G.min_depth(edges, roots).collect()} == {(i, i) for i in range(81)}


def test_closure_on_a_cycle(spark, monkeypatch):
    monkeypatch.setattr(G, "LOOK_FOR_CYCLES", 8)
    # 10 to 12 without cycles: all levels; 0, 1, 2 in a ring, 3 behind it, 20 alone with a loop
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 4), (10, 11), (11, 12), (10, 12), (10, 13), (13, 0), (20, 20), (13, 12)]
    edges, roots = _edges(spark, pairs), spark.createDataFrame([(0,), (10,), (20,), (3,)], "root bigint")
    got = sorted((r.version_from, r.version_to, r.dep_level) for r in G.closure(edges, roots).collect())
    assert got == [(0, 0, 3), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 1), (3, 4, 1), (10, 0, 2), (10, 1, 3), (10, 2, 4), (10, 3, 5), (10, 4, 3), (10, 11, 1), (10, 12, 1), (10, 12, 2), (10, 13, 1), (20, 20, 1)]
    parents = {(r.version_from, r.version_to, r.version_parent, r.dep_level) for r in G.closure(edges, roots, parents=True).collect()}
    assert {p[:2] + p[3:] for p in parents} == set(got) and {p for p in parents if p[:2] == (10, 12)} == {(10, 12, 10, 1), (10, 12, 11, 2), (10, 12, 13, 2)}
    assert G.closure(edges, roots.filter("root = 0"), max_level=5).filter("version_to = 0").count() == 1


def test_strong_components(spark):
    import random

    rnd = random.Random(7)
    pairs = {(rnd.randrange(24), rnd.randrange(24)) for _ in range(32)}
    reach = {a: {a} for a in range(24)}
    for _ in range(24):
        for a, b in pairs:
            for own in reach.values():
                if a in own:
                    own.add(b)
    on_cycle = {a for a in reach if any(a in reach[b] for x, b in pairs if x == a)}
    want = {a: min(b for b in reach if b in reach[a] and a in reach[b]) for a in on_cycle}
    assert {r.node: r.component for r in G.strong_components(_edges(spark, sorted(pairs))).collect()} == want
    assert G.strong_components(_edges(spark, [(1, 2), (2, 3)])).isEmpty()


def test_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    edges = _edges(spark, ring + [(100, 0), (5, 200), (200, 201), (300, 301), (301, 300), (301, 301)])
    assert {r.node: r.length for r in G.cycle_report(edges).collect()} == {i: 40 for i in range(40)} | {300: 2, 301: 1}


def test_peer_groups(spark):
    rows = [(i, i + 1, "peer", True) for i in range(13)] + [(50, 3, "dependency", True), (51, 3, "dependency", False), (20, 21, "peer", False), (52, 13, "dependency", True)]
    members, entries = G.peer_groups(spark.createDataFrame(rows, "src bigint, dst bigint, kind string, valid boolean"))
    assert {(r.node, r.group) for r in members.collect()} == {(i, 0) for i in range(14)}
    got = {(r.src, r.dst, r.node) for r in entries.collect()}
    assert got == {(50, 3, i) for i in range(3, 14)} | {(52, 13, 13)}


def test_poms(spark):
    poms = spark.createDataFrame([(f"p{i}", f"p{i - 1}" if i else None) for i in range(42)], "gav string, parent string")
    props = [("p0", "k", "v"), ("p0", "chain0", "end"), *(("p0", f"chain{i}", f"<${{chain{i - 1}}}>") for i in range(1, 9)), ("p0", "self", "a${self}${self}"), ("p0", "x", "${y}"), ("p0", "y", "${x}"), ("p41", "k", "own"), ("p0", "uses", "${k}-${none}"), ("p0", "long", "x" * 70_000 + "${k}"), ("p0", "longer", "${long}${long}"), ("p0", "needs", "${k}${x}")]
    got = {(r.gav, r.key): r.value for r in G.effective_poms(poms, spark.createDataFrame(props, "gav string, key string, value string")).collect()}
    assert sum(k == "k" for _, k in got) == 42 and got["p41", "uses"] == "own-${none}" and got["p40", "uses"] == "v-${none}"
    assert got["p7", "chain8"] == "<" * 8 + "end" + ">" * 8
    assert got["p0", "self"] == "a${self}${self}" and got["p0", "x"] == "${y}"
    assert got["p3", "long"] == "x" * 70_000 + "v" and got["p41", "longer"] == ("x" * 70_000 + "own") * 2 and got["p0", "needs"] == "${k}${x}"
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "gav string, parent string")
    with pytest.raises(Exception, match="its own parent"):
        G.effective_poms(loop, spark.createDataFrame(props, "gav string, key string, value string"))


def test_tree_edges_in_the_order_of_names(spark):
    names = ["Zeta", "alpha", "_x", "@s/b", "9lives", "alphabet", "Alpha", "x" * 30 + "1", "x" * 30 + "2"]
    rows = [("r", n, "dependency", n) for n in names] + [(n, "shared", "dependency", "shared") for n in names]
    rows = [(*r, True) for r in rows] + [("r", "bad", "dependency", "bad", False)]
    tree = G.dedupe_tree_edges(spark.createDataFrame(rows, "src string, dst string, kind string, name string, valid boolean"), spark.createDataFrame([("r",)], "root string")).collect()
    assert [r.src for r in tree if r.dst == "shared" and not r.deduped] == ["_x"] and len(tree) == 18
    keyed = spark.createDataFrame([(n,) for n in names], "n string").orderBy(G.collation_key(F.col("n"))).collect()
    assert [r.n for r in keyed] == ["_x", "@s/b", "9lives", "alpha", "alphabet", "Alpha", "x" * 30 + "1", "x" * 30 + "2", "Zeta"]


def _tree(edges, roots, up=None):
    """Trees of edges (src, dst, kind) as the reference walks them: (root, src, dst, kind, level, deduped)."""
    found = []
    for root in roots:
        seen, queue = {root: 0}, [root]
        for node in queue:
            for src, dst, kind in sorted((e for e in edges if e[0] == node), key=lambda e: (str(e[1]), e[2])):
                found.append((root, src, dst, kind, seen[src] + 1, dst in seen))
                if dst not in seen:
                    seen[dst] = seen[src] + 1
                    queue.append(dst)
    return sorted(found)


@pytest.mark.parametrize("hashed, broadcast, places", [(1 << 20, 200_000, 1 << 63), (0, 0, 1 << 63), (1 << 20, 0, 40)])
def test_trees_of_graphs_with_cycles(spark, monkeypatch, hashed, broadcast, places):
    import random

    monkeypatch.setattr(G, "HASHED_ROWS", hashed)
    monkeypatch.setattr(G, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(G, "MOST_PLACES", places)
    rnd = random.Random(5)
    pairs = {(rnd.randrange(10, 50), rnd.randrange(10, 50), rnd.choice(["peer", "runtime"])) for _ in range(90)} | {(i, i + 1, "runtime") for i in range(50, 60)} | {(50, 50, "peer")}
    roots = [*range(10, 60, 3), 99]
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint, kind string")
    got = G.dedupe_tree_edges(edges, spark.createDataFrame([(r,) for r in roots + roots[:2]], "root bigint"))
    assert sorted((r.root, r.src, r.dst, r.kind, r.level, r.deduped) for r in got.collect()) == _tree(pairs, roots)
    assert not spark.catalog.listTables()
    assert G.dedupe_tree_edges(edges.limit(0), got.select("root")).isEmpty() and G.dedupe_tree_edges(edges, got.select("root").limit(0)).isEmpty()


def test_known_nodes_of_trees_stay_where_they_are(spark, monkeypatch):
    # what a level looks up is read in the buckets that it is in: of a later level only its own rows are shuffled
    from gristmill import storage

    plans, write = [], storage.Dealt.add

    def add(self, df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, *more)

    monkeypatch.setattr(storage.Dealt, "add", add)
    edges = _edges(spark, [(i, i // d) for i in range(64) for d in (2, 3) if i >= d]).withColumn("kind", F.lit("runtime"))
    G.dedupe_tree_edges(edges, edges.select(F.col("src").alias("root"))).count()
    assert len(plans) > 3 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)
    assert all("Bucketed: true" in p or "bucketed" in p.lower() for p in plans[1:])


def _closed(spark, deps, versions, root, ecosystem, **more):
    deps = spark.createDataFrame(deps, "pkg string, version string, dep string, spec string")
    versions = spark.createDataFrame(versions, "pkg string, version string, deprecated boolean, yanked boolean")
    tags = versions.limit(0).select("pkg", F.lit("latest").alias("tag"), "version")
    edges, conflicts, states = G.highest_match_closure(spark.createDataFrame(root, "root string, version string"), deps, versions, tags, ecosystem, **more)
    found = {(r.root, r.pkg, r.pkg_version, r.dep, r.version, r.level) for r in edges.collect()}
    return found, {(r.root, r.pkg): r.versions for r in conflicts.collect()}, {r.root: r.state for r in states.collect()}


def test_closure_follows_the_chosen_version(spark):
    versions = [("a", "1.0.0"), ("b", "1.0.0"), ("b", "1.5.0"), ("b", "2.0.0"), ("c", "1.0.0"), ("d", "1.0.0")]
    versions = [(*v, False, False) for v in versions]
    deps = [("a", "1.0.0", "b", "^1.0.0"), ("b", "1.0.0", "d", "*"), ("b", "1.5.0", "c", "*"), ("b", "2.0.0", "a", "*"), ("c", "1.0.0", "z", "*"), ("a", "1.0.0", "alias", "npm:d@1.x")]
    found, _, states = _closed(spark, deps, versions, [("a", "1.0.0"), ("q", "1.0.0")], "npm")
    assert found == {("a", "a", "1.0.0", "b", "1.5.0", 1), ("a", "a", "1.0.0", "alias", "1.0.0", 1), ("a", "b", "1.5.0", "c", "1.0.0", 2), ("a", "c", "1.0.0", "z", None, 3)}
    assert states == {"a": "ok", "q": "empty"}
    _, _, states = _closed(spark, deps, versions, [("a", "1.0.0")], "npm", max_level=1)
    assert states == {"a": "limit"}


@pytest.mark.parametrize("ecosystem, spec, other, picked, state", [("pip", ">=1,<2", "==2.0.0", {None}, "conflict"), ("cargo", "1", "=2.0.0", {"1.5.0", "2.0.0"}, "ok"), ("go", "1.0.0", "2.0.0", {"1.0.0", "2.0.0"}, "ok")])
def test_closure_by_ecosystem(spark, ecosystem, spec, other, picked, state):
    versions = [("a", "1.0.0", False, False), ("b", "1.0.0", False, False), ("b", "1.5.0", False, False), ("b", "1.9.0", False, True), ("b", "2.0.0", False, False), ("c", "1.0.0", False, False)]
    deps = [("a", "1.0.0", "b", spec), ("a", "1.0.0", "c", "1.0.0" if ecosystem == "go" else "==1.0.0" if ecosystem == "pip" else "1"), ("c", "1.0.0", "b", other)]
    found, conflicts, states = _closed(spark, deps, versions, [("a", "1.0.0")], ecosystem)
    assert {r[4] for r in found if r[3] == "b"} == picked and set(conflicts) == {("a", "b")} and states == {"a": state}


def test_platform_is_asked_after_the_pick(spark):
    versions = spark.createDataFrame([("a", "1.2.0", ["win32"]), ("a", "1.1.0", None)], "pkg string, version string, os array<string>").withColumns({c: F.lit(None).cast("array<string>") for c in ("cpu", "libc")}).withColumn("deprecated", F.lit(False))
    wanted = spark.createDataFrame([("a", "^1.0.0"), ("a", "latest"), ("x", "npm:a@~1.1.0"), ("x", "npm:a@1"), ("x", "npm:a")], "pkg string, spec string")
    for tags in ([], [("a", "latest", "1.2.0")]):
        found = M.best_match_npm(wanted, versions, spark.createDataFrame(tags, "pkg string, tag string, version string"), M.platform_fits())
        got = {(r.pkg, r.spec): (r.version, r.via) for r in found.collect()}
        assert got["a", "^1.0.0"] == (None, "incompatible") and got["x", "npm:a@1"] == (None, "incompatible")
        assert got["x", "npm:a@~1.1.0"] == ("1.1.0", "range") and got["x", "npm:a"][0] is None
        assert got["a", "latest"] == ((None, "incompatible") if tags else (None, None))


def test_pyproject(spark):
    text = """[project]
dependencies = 'xyz'
optional-dependencies = ['no']
[tool.poetry.dependencies]
python = "^3.8"
a = "^1.2"
b = 3
c = ["1", "2"]
d = "1"
e = "*"
f = "1.2.*"
g = {version = "2", optional = true}
h = {git = "x"}
i = {version = "~1.1", optional = true}
[tool.poetry.extras]
one = ["g"]
two = ["g"]
three = "g"
"""
    assert D.pyproject_requirements(text) == ["a~=1.2", "d==1.0", "e", "f==1.2.", "g==2.0; extra == 'one'", "g==2.0; extra == 'two'", "i~1.1"]
    for junk in ("project = 3", "[tool]\npoetry = 1", "= 3", "[project]\noptional-dependencies = 3\ndependencies = [1, 'x']", "[tool.poetry]\ndependencies = []\nextras = 1", None):
        assert D.pyproject_requirements(junk) in ([], ["x"])


def test_files_by_path(spark, tmp_path):
    import gzip

    (tmp_path / "a.json").write_text('{"defaults": {"version": "1"}, "items": [{"groupId": "g", "artifactId": "a"}]}')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'"g:b:2"\n{"gav": "g:c:3"}\n'))
    (tmp_path / "c.txt").write_text("# x\ng:d:4\n")
    got = sorted((r.artifact_id, r.version, r.source_line) for r in D.read_inventory_files(spark, str(tmp_path)).collect())
    assert got == [("a", "1", 1), ("b", "2", 1), ("c", "3", 2), ("d", "4", 2)]


def test_large_steps_are_not_broadcast(spark, monkeypatch):
    """A table of a loop that has many rows may be small as files: the count decides."""
    from gristmill import storage

    monkeypatch.setattr(storage, "BROADCAST_ROWS", 100)
    large, small = (storage.written(spark.range(n).withColumn("x", F.lit("same")), "counted") for n in (101, 100))
    parts = storage.Parts(spark, "counted")
    for _ in range(2):
        parts.add(small, F.col("id") < 0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = spark.range(1000).filter("id % 2 = 0")
    for df, broadcast in ((large, False), (small, True), (parts.rows(), False)):
        assert ("BroadcastHashJoin" in plan(other.join(df, "id", "left_anti"))) is broadcast
        assert ("Broadcast" in plan(other.repartition(2, "id").join(df.select("id").filter("id > 1"), "id"))) is broadcast or broadcast


def test_depths_of_all_nodes_and_of_few(spark):
    import random

    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(12)] + [(12, 3), (40, 41), (41, 40), (50, 50)] + [(rnd.randrange(12), rnd.randrange(40, 60)) for _ in range(8)]
    nodes = sorted({n for p in pairs for n in p})

    def depths(root):
        seen, front = {root: 0}, [root]
        while front:
            front = list(dict.fromkeys(d for f in front for s, d in pairs if s == f and d not in seen))
            seen.update({d: max(seen.values()) + 1 for d in front})
        return {(root, n, d) for n, d in seen.items()}

    edges = spark.createDataFrame(pairs, "src long, dst long")
    for roots in (nodes, [0, 40]):
        got = G.min_depth(edges, spark.createDataFrame([(r,) for r in roots], "root long")).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == {t for r in roots for t in depths(r)}


def test_edges_of_a_root_are_shuffled_once(spark):
    from gristmill.operators import reports as R

    edges = spark.createDataFrame([(1, 1, 2, "a"), (1, 1, 2, "a"), (1, 2, 3, "b"), (1, 1, 3, "c"), (1, 2, 2, "x"), (1, 3, 4, "d")], "root long, src long, dst long, constraint string")
    depths = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)], "root long, node long, depth long")
    got = {(r.e, r.src, r.dst): (r.relation[0], r.depth) for r in R.edge_table(edges, depths, "cargo", "pip", "npm").collect()}
    assert got == {(e, *p): (x, d) for p, d, kinds in (((1, 2), 1, "ddd"), ((1, 3), 1, "ddd"), ((2, 3), 2, "tdt"), ((3, 4), 2, "ttt")) for e, x in zip(("cargo", "pip", "npm"), kinds)}
    assert "e" not in R.edge_table(edges, depths, "cargo").columns
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = edges.join(depths.select("root", F.col("node").alias("src"), F.col("depth").alias("parent_depth")).hint("broadcast"), ["root", "src"])
        counts = R.edge_table(known, depths, "pip").groupBy("root").agg(F.count_if(F.col("relation") == "direct").alias("n"))
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # edges, and direct dependencies


def _many(monkeypatch, heights=64):
    """What nodes reach goes by height, in graphs of any size."""
    monkeypatch.setattr(G, "MANY_EDGES", 0)
    monkeypatch.setattr(G, "MOST_HEIGHTS", heights)
    monkeypatch.setattr(G, "_low", lambda counts: 0)


@pytest.mark.parametrize("heights", [64, 3])
def test_depths_by_height(spark, monkeypatch, heights):
    import random

    rnd = random.Random(11)
    # ways down without cycles, a ring that some lead to, and a node alone
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(1, 40), rnd.randrange(40)) for _ in range(70)) if a > b} | {(50, 51), (51, 50), (30, 50), (52, 30), (51, 3)})
    nodes = sorted({n for p in pairs for n in p} | {99})
    edges, roots = _edges(spark, pairs), spark.createDataFrame([(r,) for r in nodes], "root bigint")
    want = sorted(map(tuple, G.min_depth(edges, roots).collect()))
    _many(monkeypatch, heights)
    assert sorted(map(tuple, G.min_depth(edges, roots).collect())) == want and {t[0] for t in want} == set(nodes)
    some = [r for r in nodes if r % 4]
    assert sorted(map(tuple, G.min_depth(edges, roots.filter("root % 4 > 0")).collect())) == [t for t in want if t[0] in some]


def test_what_is_reached_is_shuffled_once_a_height(spark, monkeypatch):
    _many(monkeypatch)
    plans, add = [], G.Dealt.add
    monkeypatch.setattr(G.Dealt, "add", lambda self, df, apart: plans.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df, apart))
    edges = _edges(spark, [(i, i // d) for i in range(2, 40) for d in (2, 3) if i >= d])
    depths = G.min_depth(edges, spark.range(1, 40).select(F.col("id").alias("root")))
    # a level: its nodes by name, its edges by target, and their union by root; what lies below is read in its buckets
    assert len(plans) == 6 and all(p.count("FileScan parquet spark_catalog") == 1 and "Bucketed: true" in p for p in plans[1:])
    # grouped by root, it isn't shuffled again
    assert "Exchange hashpartitioning" not in depths.groupBy("root").count()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("more_left", [True, False])
def test_exclusive_dependencies_from_the_smaller_side(spark, monkeypatch, more_left):
    import random

    rnd = random.Random(3 + more_left)
    # chains that one edge from outside breaks, and a ring
    pairs = {(i, i + 1) for i in range(12)} | {(20, 21), (21, 22), (22, 20), (22, 5 if more_left else 23)} | {(rnd.randrange(8), rnd.randrange(8, 16)) for _ in range(8)} | ({(30, 11)} if more_left else {(30 + i, i) for i in range(12)})
    reach = lambda r: (lambda grow: grow(grow, {r}))(lambda grow, s: s if (t := s | {d for a, d in pairs if a in s}) == s else grow(grow, t))
    want = set()
    for r in sorted({n for p in pairs for n in p}):
        own = reach(r)
        while out := {d for a, d in pairs if d in own and d != r and a not in own}:
            own -= out
        want |= {(r, d) for d in own}
    nodes = spark.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p})], "node bigint")
    joined, by = [], G.Parts.replace
    monkeypatch.setattr(G.Parts, "replace", lambda self, df: joined.append(self.base.rsplit("/", 1)[1].rsplit("-", 1)[0]) or by(self, df))
    got = list(map(tuple, G.exclusive_dependencies(_edges(spark, sorted(pairs)), nodes).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert "exclusive" in joined


@pytest.mark.parametrize("heights", [64, 3])
def test_modules_by_height(spark, monkeypatch, heights):
    import random

    rnd = random.Random(heights)
    of = lambda p: f"v1.{rnd.randrange(3)}.0"
    # ways down, where some versions of a path require the same; a ring of paths, and roots that lead to it; 90 requires nothing, and nothing requires 91
    rows = {(p, f"v1.{v}.0", d, of(d)) for p in range(1, 30) for d in {rnd.randrange(p) for _ in range(2)} for v in range(rnd.randrange(1, 4))}
    rows |= {(p, f"v1.{v}.0", p // 2, "v1.0.0") for p in range(2, 30) for v in range(3)} | {(40, "v1.0.0", 41, "v1.1.0"), (41, "v1.1.0", 40, "v1.2.0"), (40, "v1.2.0", 7, "v1.0.0"), (42, "v1.0.0", 40, "v1.0.0"), (42, "v1.0.0", 90, "v1.0.0")}
    requires = spark.createDataFrame(sorted(rows), "path bigint, version string, dep bigint, dep_version string")
    named = sorted({r[:2] for r in rows} | {r[2:] for r in rows} | {(91, "v1.0.0")})
    versions = spark.createDataFrame([(p, v, 17 if p % 3 == 0 or p == 7 else 16) for p, v in named], "path bigint, version string, minor int")
    roots = spark.createDataFrame(sorted({p: (p, v) for p, v in named if p != 41 or v == "v1.1.0"}.values()) + [(95, "v1.0.0"), (9, "v1.0.0")], "root bigint, version string")
    want = [sorted(map(tuple, df.collect())) for df in G.requirement_graph_go(requires, versions, roots)]
    best = sorted(map(tuple, G.build_list_go(spark.createDataFrame(want[0], "root bigint, path bigint, version string"), V.go_key(F.col("version"))).collect()))
    _many(monkeypatch, heights)
    nodes, edges = G.requirement_graph_go(requires, versions, roots)
    assert [sorted(map(tuple, df.collect())) for df in (nodes, edges)] == want and len(want[1]) > 300
    built = G.build_list_go(nodes, V.go_key(F.col("version")))
    assert sorted(map(tuple, built.collect())) == best
    # versions are parsed once for each text, and edges need no distinct
    assert "regexp_" not in built._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in edges.filter("root < 30").select("root")._jdf.queryExecution().optimizedPlan().toString() or heights < 64
