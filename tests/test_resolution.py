"""Joint resolution against a resolver library and rules by hand; the mediated walk."""

import random

import pytest
from packaging.specifiers import SpecifierSet
from packaging.version import Version
from pyspark.sql import functions as F

from gristmill.operators import graphs as G
from gristmill.operators import resolution as R

DEPS = "pkg string, version string, dep string, spec string"
VERSIONS = "pkg string, version string, yanked boolean"


def _resolved(spark, roots, deps, versions, ecosystem="pip"):
    found = R.resolve(spark.createDataFrame(roots, "root string, version string"), spark.createDataFrame(deps, DEPS), spark.createDataFrame([(*v, False)[:3] for v in versions], VERSIONS), ecosystem)
    chosen, edges, clash = ([r.asDict() for r in df.collect()] for df in found)
    out: dict = {}
    for r in chosen:
        out.setdefault(r["root"], {}).setdefault(r["pkg"], []).append(r["version"])
    return out, edges, {(r["root"], r["pkg"]): r["versions"] for r in clash}


def test_requirements_are_met_together(spark):
    versions = [(p, "1") for p in "rxyqbczs"] + [("a", "1.0"), ("a", "1.5"), ("a", "2.0"), ("p", "1"), ("p", "2"), ("k", "1"), ("k", "2")]
    deps = [
        ("r", "1", "x", ""), ("r", "1", "y", ""), ("x", "1", "a", ">=1.0"), ("y", "1", "a", "<2.0"), ("a", "2.0", "z", ""), ("r", "1", "gone", ""),
        # p 2 brings b, which doesn't suit p 2; b and c then only need each other
        ("q", "1", "p", ""), ("p", "2", "b", ""), ("b", "1", "p", "<2"), ("b", "1", "c", ""), ("c", "1", "b", ""),
        # nothing suits both; k 2 can be given up for k 1
        ("s", "1", "x", "==1"), ("s", "1", "a", ">=2"), ("s", "1", "k", ""), ("k", "2", "a", "<2"), ("k", "1", "a", ">1"),
        ("z", "1", "a", "==2.0"), ("z", "1", "y", ""),
    ]
    out, edges, clash = _resolved(spark, [("r", "1"), ("q", "1"), ("s", "1"), ("z", "1"), ("none", "1")], deps, versions)
    assert out["r"] == {"r": ["1"], "x": ["1"], "y": ["1"], "a": ["1.5"]} and out["q"] == {"q": ["1"], "p": ["1"]}
    assert out["s"] == {"s": ["1"], "x": ["1"], "a": ["2.0"], "k": ["1"]}
    assert out["z"] == {"z": ["1"], "y": ["1"]} and clash == {("z", "a"): ["1.5", "2.0"]} and "none" not in out
    assert [e["version"] for e in edges if e["root"] == "r" and e["dep"] in ("a", "gone")] in ([v, *w] for v, w in (("1.5", ["1.5", None]), ("1.5", [None, "1.5"]), (None, ["1.5", "1.5"])))
    assert {e["level"] for e in edges if e["root"] == "r" and e["dep"] == "a"} == {2}


def test_states_of_pip(spark):
    versions = spark.createDataFrame([("r", "1", False), ("x", "1", False), ("y", "1", False), ("a", "1.0", False), ("a", "1.5", False), ("a", "2.0", False)], VERSIONS)
    deps = spark.createDataFrame([("r", "1", "x", ""), ("r", "1", "y", ""), ("x", "1", "a", ">=1.0"), ("y", "1", "a", "<2.0")], DEPS)
    roots = spark.createDataFrame([("r", "1"), ("q", "1")], "root string, version string")
    edges, conflicts, states = G.highest_match_closure(roots, deps, versions, ecosystem="pip")
    assert {r.version for r in edges.filter("dep = 'a'").collect()} == {"1.5"} and conflicts.isEmpty()
    assert {r.root: r.state for r in states.collect()} == {"r": "ok", "q": "empty"}
    edges, _, states = G.highest_match_closure(roots, deps, versions, ecosystem="pip", max_level=1)
    assert {r.root: r.state for r in states.collect()} == {"r": "limit", "q": "empty"} and {r.level for r in edges.collect()} == {1}


def test_rounds_go_on_without_settled_roots(spark, monkeypatch):
    rounds, required = [], R._Resolution.required
    monkeypatch.setattr(R._Resolution, "required", lambda job, state: rounds.append({r.root for r in state.select("root").distinct().collect()}) or required(job, state))
    out, _, clash = _resolved(spark, [("a", "1"), ("r", "1")], [("r", "1", "b", ""), ("b", "1", "c", "")], [(p, "1") for p in "rabc"])
    assert out == {"a": {"a": ["1"]}, "r": {p: ["1"] for p in "rbc"}} and not clash
    assert rounds == [{"a", "r"}, {"r"}, {"r"}]


def test_cargo_shares_compatible_versions(spark):
    versions = [(p, "1.0.0") for p in "rxy"] + [("a", v) for v in ("0.2.9", "0.3.1", "1.2.0", "1.3.5", "1.9.0", "2.1.0")]
    deps = [("r", "1.0.0", "x", "1"), ("r", "1.0.0", "y", "1"), ("x", "1.0.0", "a", "1.2"), ("y", "1.0.0", "a", "~1.3"), ("r", "1.0.0", "a", "2"), ("y", "1.0.0", "b", "1")]
    out, edges, clash = _resolved(spark, [("r", "1.0.0")], deps, versions, "cargo")
    assert sorted(out["r"]["a"]) == ["1.3.5", "2.1.0"] and not clash
    assert {(e["pkg"], e["version"]) for e in edges if e["dep"] == "a"} == {("x", "1.3.5"), ("y", "1.3.5"), ("r", "2.1.0")}


def test_against_a_resolver_library(spark):
    resolvelib = pytest.importorskip("pip._vendor.resolvelib")
    rnd = random.Random(1)
    specs = ["", ">=1.1", "<2.0", ">=1.0,<2.0", "<1.5", "!=2.0", ">=1.5", "==1.0"]
    roots, versions, deps = [], [], {}
    for u in range(40):
        names, root = [f"u{u}n{i}" for i in range(6)], f"u{u}r"
        roots.append((root, "1.0"))
        versions.append((root, "1.0"))
        deps.update({(root, "1.0", n): rnd.choice(specs) for n in rnd.sample(names, 3)})
        for n in names:
            for v in ("1.0", "1.5", "2.0"):
                if rnd.random() < 0.85 or v == "1.0":
                    versions.append((n, v))
                    deps.update({(n, v, m): rnd.choice(specs) for m in rnd.sample(names, rnd.choice([0, 0, 1, 1, 2])) if m != n})
    have: dict = {}
    for n, v in versions:
        have.setdefault(n, []).append(v)
    asks: dict = {}
    for (n, v, m), s in deps.items():
        if any(SpecifierSet(s).contains(x) for x in have[m]):
            asks.setdefault((n, v), []).append((m, s))

    class Provider(resolvelib.AbstractProvider):
        def identify(self, requirement_or_candidate):
            return requirement_or_candidate[0]

        def get_preference(self, identifier, resolutions, candidates, information, backtrack_causes):
            return identifier

        def find_matches(self, identifier, requirements, incompatibilities):
            asked, bad = list(requirements[identifier]), {c[1] for c in incompatibilities[identifier]}
            fits = [v for v in have.get(identifier, []) if v not in bad and all(SpecifierSet(r[1]).contains(v) for r in asked)]
            return [(identifier, v, "candidate") for v in sorted(fits, key=Version, reverse=True)]

        def is_satisfied_by(self, requirement, candidate):
            return SpecifierSet(requirement[1]).contains(candidate[1])

        def get_dependencies(self, candidate):
            return asks.get(candidate[:2], [])

    out, _, clash = _resolved(spark, roots, [(*k, s) for k, s in deps.items()], versions)
    same = solvable = 0
    for root, _ in roots:
        try:
            want = {n: c[1] for n, c in resolvelib.Resolver(Provider(), resolvelib.BaseReporter()).resolve([(root, "==1.0")], max_rounds=500).mapping.items()}
        except resolvelib.ResolutionImpossible:
            want = None
        got = {n: v for n, (v,) in out[root].items()}
        solvable += want is not None
        same += got == want
        if not any(r == root for r, _ in clash):  # whatever is chosen suits all that ask
            assert want is not None and all(m in got and SpecifierSet(s).contains(got[m]) for n, v in got.items() for m, s in asks.get((n, v), []))
    assert same >= 0.9 * solvable and solvable > 20


def test_mediation_prunes_what_loses(spark):
    # b 2 is nearer than b 1, whose child must not occur; c is managed from depth 2 on, the root's own declaration isn't
    deps = [("r", "1", "a", "1", 1), ("r", "1", "b", "2", 2), ("a", "1", "b", "1", 1), ("a", "1", "c", "1", 2), ("a", "1", "d", "1", 3), ("b", "1", "lost", "1", 1), ("b", "2", "d", "2", 1), ("c", "9", "e", "1", 1), ("c", "1", "f", "1", 1), ("d", "1", "r", "5", 1), ("d", "2", "lost", "1", 1)]
    deps = spark.createDataFrame([(*d, None, d[2] == "f") for d in deps] + [("a", "1", "t", "1", 4, "test", False), ("r", "1", "u", "1", 3, "test", False)], "ga string, version string, dep string, dep_version string, pos int, scope string, optional boolean")
    managed = spark.createDataFrame([("r", "c", "9"), ("r", "a", "7")], "root string, ga string, version string")
    tree = R.mediated_closure(spark.createDataFrame([("r", "1")], "root string, version string"), deps, managed).collect()
    got = {(t.ga, t.version, t.depth, t.parent, t.selected) for t in tree}
    assert got == {("r", "1", 0, None, True), ("a", "1", 1, "r", True), ("b", "2", 1, "r", True), ("u", "1", 1, "r", True), ("b", "1", 2, "a", False), ("c", "9", 2, "a", True), ("d", "1", 2, "a", True), ("d", "2", 2, "b", False), ("e", "1", 3, "c", True), ("r", "5", 3, "d", False)}
    filled = R.fill_versions(deps.limit(1).withColumn("dep_version", F.lit("${v}.${w}")), spark.createDataFrame([("r:1", "v", "3")], "gav string, key string, value string")).first()
    assert filled.dep_version == "3.${w}"


def test_walk_follows_only_versions_that_are_named(spark, monkeypatch):
    from gristmill.operators import resolution

    kept, real = {}, resolution.written
    monkeypatch.setattr(resolution, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    deps = [("a", "1", "b", "1", 1)] + [("b", str(i), "c", "1", 1) for i in range(1, 40)] + [("d", "1", "c", "1", 1)]
    roots = spark.createDataFrame([("a", "1")], "root string, version string")
    managed = spark.createDataFrame([("a", "c", "7"), ("a", "b", "9")], "root string, ga string, version string")
    tree = resolution.mediated_closure(roots, spark.createDataFrame(deps, "ga string, version string, dep string, dep_version string, pos int"), managed)
    assert sorted((r["depth"], r["ga"], r["version"]) for r in tree.collect()) == [(0, "a", "1"), (1, "b", "1"), (2, "c", "7")]
    # of 39 versions of b, the declared one and the managed one
    assert kept["declared"].count() == 3


def test_closure_keeps_only_versions_that_are_come_to(spark, monkeypatch):
    from gristmill.operators import graphs

    kept, real = {}, graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    versions = spark.createDataFrame([(p, f"1.0.{i}", False) for p in "abc" for i in range(40)], "pkg string, version string, deprecated boolean")
    deps = spark.createDataFrame([(p, f"1.0.{i}", d, "^1.0.0") for p, d in ("ab", "bc") for i in range(40)], "pkg string, version string, dep string, spec string")
    tags = spark.createDataFrame([(p, "latest", "1.0.39") for p in "abc"], "pkg string, tag string, version string")
    edges = graphs.highest_match_closure(spark.createDataFrame([("a", "1.0.5")], "root string, version string"), deps, versions, tags)[0]
    assert sorted((r["pkg"], r["pkg_version"], r["dep"], r["version"], r["level"]) for r in edges.collect()) == [("a", "1.0.5", "b", "1.0.39", 1), ("b", "1.0.39", "c", "1.0.39", 2)]
    assert kept["resolved-dependencies"].count() == 2
