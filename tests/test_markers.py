"""Specifiers and markers against the packaging library, pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import markers as MK
from gristmill.operators import matching as M

specifiers = pytest.importorskip("packaging.specifiers")
markers = pytest.importorskip("packaging.markers")

VERSIONS = (
    "1 1.0 1.0.0 1.0.1 1.1 1.10 2 2.0.0 2.0.dev1 1.0rc1 1.0a1 1.0b2.dev3 1.0.post1 1.0.post1.dev2 1.0+loc 1.0+loc.2 1!1.0 1.2.3 1.2.0 0.9 1.0.0.0.1 "
    "2020.12.31 1.0.dev0 3.12 3.8 10.0 1.0-1 v1.0 1.0.RC1 99999999999999999999999.1"
).split()
ATOMS = (
    "python_version >= '3.8'|python_version < '3'|'3.8' > python_version|python_version in '2.7 3.3'|python_version not in '2.7, 3.12'|sys_platform == 'win32'|sys_platform != 'win32'|os_name == 'nt'|os_name=='posix'|"
    "extra == 'x'|extra == 'X_y'|'x' == extra|extra != 'x'|platform_machine in 'x86_64 arm'|'linux' in sys_platform|platform_system == \"Linux\"|python_full_version >= '3.12.0rc1'|python_version == '3.*'|python_version ~= '3.10'|"
    "implementation_name == 'cpython'|os.name == 'posix'|platform_release >= '5'|extra in 'x y'|python_version > 'abc'|sys_platform < 'z'|sys_platform >= 'linux'|'x' in extra"
).split("|")
ODD = (
    "(extra == 'x' or python_version < '3') and python_version < '2'||extra ==|(os_name == 'nt'|os_name == 'nt')|'a' == 'b'|os_name == 'nt' and|and os_name == 'nt'|os_name == 'nt' os_name == 'nt'|()|foo == 'x'|((extra == 'x'))|os_name == sys_platform"
).split("|")


def test_specifiers(spark):
    pairs = [(o, v) for o in ("==", "!=", "<=", ">=", "<", ">", "~=", "===") for v in VERSIONS]
    pairs += [(o, v + ".*") for o in ("==", "!=") for v in ("1", "1.0", "1.0.0", "2.0", "1!1", "1.2", "v1", "0")]
    rows = []
    for o, v in pairs:
        try:
            s = specifiers.Specifier(o + v)
        except specifiers.InvalidSpecifier:
            rows.append((o, v, VERSIONS[0], None))
        else:
            rows += [(o, v, w, s.contains(w, prereleases=True)) for w in VERSIONS]
    df = spark.createDataFrame(rows, "op string, v string, w string, want boolean")
    s = F.struct("op", F.col("v").alias("version"))
    got = F.when(MK.valid_specifier(F.col("op"), F.col("v")), MK.specifier_holds(s, F.col("w")))
    assert len(rows) > 7000 and df.filter(~F.col("want").eqNullSafe(got)).collect() == []


def _random_marker(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(ATOMS)
    text = rng.choice([" and ", " or "]).join(_random_marker(rng, depth - 1) for _ in range(rng.randint(2, 3)))
    return f"({text})" if rng.random() < 0.5 else text


def _kept(text, extras):
    if not text.strip():
        return True
    try:
        marker = markers.Marker(text)
    except markers.InvalidMarker:
        return False
    out = False
    for extra in extras or ["__none__"]:
        try:
            out = out or marker.evaluate({**markers.default_environment(), **MK.ENVIRONMENT, "extra": extra})
        except Exception:  # comparisons that have no meaning
            pass
    return out


def test_markers(spark):
    rng = random.Random(1)
    texts = ATOMS + ODD + [_random_marker(rng, 3) for _ in range(200)]
    rows = [(i, m, extras) for i, m in enumerate(texts) for extras in ([], ["x"], ["a", "X-Y"])]
    df = spark.createDataFrame(rows, "i int, marker string, wanted array<string>")
    got = {(r.i, tuple(r.wanted)) for r in M.marker_filter(df, None, F.col("wanted")).collect()}
    assert [r for r in rows if ((r[0], tuple(r[2])) in got) != _kept(r[1], r[2])] == []


def test_prereleases(spark):
    s = "array<struct<op: string, version: string>>"
    rows = [(n, v) for n in ("a", "b") for v in ("1.0rc1", "1.0.dev2")] + [("a", "0.9")]
    pairs = spark.createDataFrame(rows, "name string, version string")

    def match(*specs):
        return sorted((r.name, r.version) for r in M.specifier_match(pairs.withColumn("specifiers", F.array(*(F.struct(F.lit(o).alias("op"), F.lit(v).alias("version")) for o, v in specs)).cast(s))).collect())

    assert match() == [("a", "0.9"), ("b", "1.0.dev2"), ("b", "1.0rc1")]
    assert match((">=", "0.1")) == [("a", "0.9")] and match(("!=", "0.1rc1")) == [("a", "0.9")]
    assert match((">=", "0.1rc1")) == sorted(rows)
