"""Version keys and ranges, by cases of the public semver documentation."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import ranges as R
from gristmill.functions import versions as V
from gristmill.operators import matching as M

FITS = [
    ("1.0.0 - 2.0.0", "1.2.3"), ("^1.2.3+build", "1.2.3"), ("1.2.3 - 2.4", "2.4.9"), ("1.2 - 3", "3.9.9"), ("*", "1.2.3"), ("", "1.0.0"), (">=1.0.0", "1.1.0"),
    ("> 1.0.0", "1.0.1"), ("<=2.0.0", "0.2.9"), ("0.1.20 || 1.2.4", "1.2.4"), (">=0.2.3 || <0.0.1", "0.0.0"), ("2.x.x", "2.1.3"), ("1.2.x || 2.x", "1.2.3"),
    ("x", "1.2.3"), ("~2.4", "2.4.5"), ("~>3.2.1", "3.2.2"), ("~1", "1.2.3"), (">=1", "1.0.0"), ("<1.2", "1.1.1"), ("~v0.5.4-pre", "0.5.5"), ("=0.7.x", "0.7.2"), ("<=0.7.x", "0.7.9"),
    ("~1.2.1 >=1.2.3", "1.2.3"), ("^1.2", "1.4.2"), ("^0.1.2", "0.1.2"), ("^0.0.1", "0.0.1"), ("^1.2.3-alpha", "1.2.3-pre"), (">1", "2.0.0"), ("^1.2.0-alpha", "1.2.0-pre"), ("^0", "0.9.1"), ("^0.x", "0.5.0"),
]
FAILS = [
    ("1.0.0 - 2.0.0", "2.2.3"), ("1.2.3+asdf - 2.4.3+asdf", "2.4.4"), ("^1.2.3", "2.0.0-alpha"), ("1.2.3 - 2.4", "2.5.0"), ("1", "1.0.0beta"), ("<1", "1.0.0beta"), (">1.2", "1.2.8"), ("^0.0.1", "0.0.2"),
    ("~1.2.2", "1.3.0"), ("^1.2.3", "1.2.2"), (">*", "9.9.9"), ("<1.x", "1.0.0-0"), ("*", "1.2.3-rc.1"), ("^1.2.3-alpha", "1.2.4-pre"), ("2 - 3", "1.9.9"), ("<=1.2", "1.3.0-0"), (">=1.2.3-rc.2", "1.2.3-rc.1"), ("bad range!", "1.0.0"),
]


def test_ranges(spark):
    cases = [(i, s, v, True) for i, (s, v) in enumerate(FITS)] + [(100 + i, s, v, False) for i, (s, v) in enumerate(FAILS)]
    df = spark.createDataFrame(cases, "i int, spec string, version string, want boolean")
    nested = R.nested_ranges(R.range_bounds(df))
    out = df.join(nested, "spec", "left").withColumn("got", F.coalesce(R.range_test(F.col("range"), V.semver(F.col("version"))), F.lit(False)))
    wrong = [(r.spec, r.version, r.want) for r in out.filter("got <> want").collect()]
    assert not wrong


@pytest.mark.parametrize(
    "key, ordered",
    [
        (lambda c: V.semver(c)["key"], ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-0", "1.0.1", "2.0.0", "10.0.0"]),
        (V.pep440_key, ["not a version", "1.dev0", "1.0.dev456", "1.0a1", "1.0a2.dev456", "1.0a2", "1.0b1.dev456", "1.0b2", "1.0b2.post345", "1.0rc1", "1.0", "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0.post456.dev34", "1.0.post456", "1.0.15", "1.1.dev1", "1!0.1"]),
        (V.go_key, ["none", "v1.0.0-rc.1", "v1.0.0", "v1.10.0", ""]),
    ],
)
def test_orders(spark, key, ordered):
    df = spark.createDataFrame(list(enumerate(ordered)), "i int, v string")
    got = [r.v for r in df.orderBy(key(F.col("v"))).collect()]
    assert got == ordered


def test_semver_is_loose_and_bounded(spark):
    rows = [("v1.2.3",), (" =1.2.3-b+x",), ("1.0.0alpha1",), ("1.2",), ("9007199254740992.0.0",), ("12345678901234567.0.0",), (None,), ("",)]
    out = [tuple(r) for r in spark.createDataFrame(rows, "v string").select(V.semver(F.col("v")).alias("s")).select("s.valid", "s.canonical").collect()]
    assert out == [(True, "1.2.3"), (True, "1.2.3-b"), (True, "1.0.0-alpha1"), *[(False, None)] * 5]


def test_bounds(spark):
    specs = ["^1.2.3-beta.2", "~1", "1.2 - 3.4", ">=0.0.0", "^0.0.x", ">* || 1.0.0", ">*", "junk", "1.0.0 junk 1.0.0"]
    rows = R.range_bounds(spark.createDataFrame([(s,) for s in specs], "spec string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.spec, set()).add(f"{r.op}{r.major}.{r.minor}.{r.patch}" + (f"-{r.pre}" if r.pre else ""))
    assert got == {
        "^1.2.3-beta.2": {">=1.2.3-beta.2", "<2.0.0-0"}, "~1": {">=1.0.0", "<2.0.0-0"}, "1.2 - 3.4": {">=1.2.0", "<3.5.0-0"}, ">=0.0.0": {"*0.0.0"},
        "^0.0.x": {"<0.1.0-0"}, ">* || 1.0.0": {"=1.0.0"}, ">*": {"<0.0.0-0"}, "1.0.0 junk 1.0.0": {"=1.0.0"},
    }


def test_best_in_ranges_is_the_best_of_those_that_fit(spark):
    import random

    from pyspark.sql import functions as F

    from gristmill.functions import versions as V
    from gristmill.functions.ranges import nested_ranges, range_bounds, range_test
    from gristmill.operators import matching as M

    rnd = random.Random(3)
    number = lambda: f"{rnd.randrange(3)}.{rnd.randrange(3)}.{rnd.randrange(3)}" + rnd.choice(["", "", "", "-0", "-rc.1", "-rc.2", "-alpha"])
    versions = [(p, v, rnd.random() < 0.3) for p in "abcd" for v in {number() for _ in range(rnd.choice([1, 5, 30]))}]
    one = lambda: rnd.choice(["^", "~", ">=", "<", "<=", ">", "="]) + number()
    texts = {" ".join(one() for _ in range(rnd.randint(1, 3))) for _ in range(60)} | {f"{one()} || {one()}" for _ in range(30)} | {"*", "1.x", "x || 1", "1.0 - 2.0.0-rc.2", "<0.0.0", "2.0.0 - 1", ">=1.1.1-rc.1 <1.1.1", "^0.0.1-alpha"}
    specs = spark.createDataFrame([(p, t) for p in "abcde" for t in sorted(texts)], "pkg string, spec string")
    ranges = nested_ranges(range_bounds(specs)).select("spec", "range")
    parsed = spark.createDataFrame(versions, "pkg string, version string, deprecated boolean").withColumn("v", V.semver(F.col("version")))
    rows = specs.join(ranges, "spec")
    got = {(r.pkg, r.spec): r.best for r in M.best_in_ranges(rows, parsed).collect()}
    fits = rows.join(parsed, "pkg").filter(range_test(F.col("range"), F.col("v"))).groupBy("pkg", "spec").agg(F.max_by("version", F.struct(~F.col("deprecated"), F.col("v.key"))).alias("best"))
    want = {(r.pkg, r.spec): r.best for r in fits.collect()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {} and len(got) > 40


def test_specifiers_meet_a_version_once(spark):
    from gristmill.operators import matching as M

    s = "name string, specifiers array<struct<op: string, version: string>>, version string"
    one, rc = [(">=", "1")], [(">=", "1.0rc1")]
    rows = [("a", one, "1.0"), ("a", one, "1.0"), ("b", one, "1.0"), ("b", one, "1.1rc1"), ("b", rc, "1.1rc1"), ("a", [], "1.0"), ("a", [], "2.0rc1"), ("c", [], "2.0rc1"), ("d", [], None), ("d", one, None), ("d", one, "junk"), ("e", None, "1.0")]
    out = M.specifier_match(spark.createDataFrame(rows, s))
    got = sorted((r.name, str([tuple(x) for x in r.specifiers]), str(r.version)) for r in out.collect())
    assert got == sorted((n, str(sp), str(v)) for n, sp, v in [rows[0], rows[1], rows[2], rows[4], rows[5], rows[7], rows[8]])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("specifiers" not in line.split("], [")[1] for line in plan.splitlines() if " Window [" in line)


def test_specifiers_are_compared_after_the_distinct(spark, monkeypatch):
    from gristmill.operators import matching as M

    plans, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    rows = [(n, [(">=", "1")], v) for n in "abc" for v in ("1.0", "0.9")]
    out = M.specifier_match(spark.createDataFrame(rows, "name string, specifiers array<struct<op: string, version: string>>, version string"))
    assert sorted(r.name + r.version for r in out.collect()) == ["a1.0", "b1.0", "c1.0"]
    # no plan that parses a version has the distinct, below which its filter would go
    assert any("regexp_" in p for p in plans) and not any("regexp_" in p and "Aggregate" in p for p in plans)


def test_candidates_compare_each_case_once(spark):
    s = "array<struct<op: string, version: string>>"
    needs = spark.createDataFrame([(r, "a", [(">=", "1")]) for r in range(50)] + [(r, "a", []) for r in range(25)] + [(99, "b", [])], f"root int, name string, specifiers {s}")
    versions = spark.createDataFrame([("a", "1.0", False), ("a", "2.0rc1", False), ("a", "1.5", True), ("a", "0.9", False), ("b", "1rc1", False)], "name string, version string, yanked boolean")
    out = M.candidates_pip(needs, versions, versions.filter("version <> '9'").unionByName(versions))
    # what is compared is read from a written table of distinct cases: no version is matched for each root again
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_" not in plan
    assert sorted(map(tuple, out.collect())) == [(r, "a", "1.0", 1) for r in range(50)] + [(99, "b", "1rc1", 1)]
