"""Joins of requirements with versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from ..functions.markers import compile_marker, marker_holds, specifier_holds
from ..functions.ranges import nested_ranges, range_bounds, range_test
from ..storage import written


#: A spec that names another package: npm:name@range, split at the last @.
ALIAS = r"^npm:(.*)@([^@]*)$"


def best_in_ranges(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows (pkg, spec, range), versions (pkg, version, deprecated, v: parsed): pkg, spec, best: the version in range that is best by (not deprecated, version).

    An alternative allows the releases between its highest lower and its lowest upper
    bound. Upper bounds stand among the versions of their package in order, and see
    the last version, and the last that isn't deprecated, before them: no spec meets
    each version. Prereleases are only allowed where a comparator names one of the
    same major.minor.patch, and are joined by these.
    """
    alternatives = rows.select("pkg", "spec", F.explode("range").alias("a"))
    at = lambda c, tie: F.struct(F.lit(0).alias("open"), c["key"].alias("key"), tie.alias("tie"))
    sides = lambda ops, closed: F.transform(F.filter("a", lambda c: c["op"].isin(*ops)), lambda c: at(c, F.when(c["op"].isin(*closed), 2).otherwise(0)))
    everything = F.struct(F.lit(1).alias("open"), F.array().cast("array<string>").alias("key"), F.lit(0).alias("tie"))
    asked = alternatives.select("pkg", "spec", F.array_max(sides((">=", ">", "="), (">",))).alias("low"), F.coalesce(F.array_min(sides(("<", "<=", "="), ("<=", "="))), everything).alias("place"))
    place = F.struct(F.lit(0).alias("open"), F.col("v.key").alias("key"), F.lit(1).alias("tie"))
    known = versions.filter("v.pre IS NULL").select("pkg", place.alias("place"), F.struct(place.alias("place"), "version").alias("last"), "deprecated")
    known = known.withColumn("live", F.when(~F.col("deprecated"), F.col("last"))).drop("deprecated")
    sofar = Window.partitionBy("pkg").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seen = known.unionByName(asked, allowMissingColumns=True).withColumns({c: F.last(c, True).over(sofar) for c in ("last", "live")}).filter("spec IS NOT NULL")
    inside = lambda c: F.col(c).isNotNull() & F.coalesce(F.col(f"{c}.place") > F.col("low"), F.lit(True))
    chosen = lambda c, live: F.struct(F.lit(live).alias("live"), F.col(f"{c}.place.key").alias("key"), F.col(f"{c}.version").alias("version"))
    found = seen.select("pkg", "spec", F.when(inside("live"), chosen("live", True)).when(inside("last"), chosen("last", False)).alias("best"))
    # nothing comes before a prerelease of 0, which only ends ranges
    names = alternatives.select("pkg", "spec", "a", F.explode(F.filter("a", lambda c: c["pre"].isNotNull() & ~((c["op"] == "<") & (c["pre"] == "0")))).alias("c"))
    number = ("major", "minor", "patch")
    early = versions.filter("v.pre IS NOT NULL").select("pkg", "version", "deprecated", "v", *(F.col(f"v.{x}").alias(x) for x in number))
    named = names.select("pkg", "spec", "a", *(F.col(f"c.{x}").alias(x) for x in number)).distinct().join(early, ["pkg", *number]).filter(range_test(F.array("a"), F.col("v")))
    named = named.select("pkg", "spec", F.struct((~F.col("deprecated")).alias("live"), F.col("v.key").alias("key"), "version").alias("best"))
    return found.filter("best IS NOT NULL").unionByName(named).groupBy("pkg", "spec").agg(F.max("best").alias("best")).select("pkg", "spec", F.col("best.version").alias("best"))


def best_match_npm(wanted: DataFrame, versions: DataFrame, tags: DataFrame, compatible: Column | None = None) -> DataFrame:
    """pkg, spec, target, version, via for each distinct (pkg, spec); version null where nothing fits.

    A spec that is a tag means its version. Otherwise the tagged `latest` wins if
    it fits, and else the best by (not deprecated, version). Two passes: only what
    tags leave open meets the versions of its package. An alias is looked up as
    the package and spec that it names, `target`. `compatible` is a condition on a
    version (its platform, say) that is asked once it is picked: if it doesn't
    hold, or the version isn't there, the spec has none, and `via` is incompatible.
    """
    names = wanted.select("pkg", "spec").distinct()
    alias = F.col("spec").startswith("npm:") if dict(wanted.dtypes)["spec"] == "string" else F.lit(False)
    real = F.regexp_extract("spec", ALIAS, 1).try_cast(wanted.schema["pkg"].dataType)
    names = names.withColumns({"target": F.when(alias, real).otherwise(F.col("pkg")), "need": F.when(alias, F.regexp_extract("spec", ALIAS, 2)).otherwise(F.col("spec"))})
    distinct = names.select(F.col("target").alias("pkg"), F.col("need").alias("spec")).distinct()
    ranges = written(nested_ranges(range_bounds(distinct)), "ranges")
    by_tag = tags.select("pkg", F.col("tag").alias("spec"), F.col("version").alias("tagged"))
    latest = tags.filter("tag = 'latest'").select("pkg", F.col("version").alias("latest"))
    rows = distinct.join(by_tag, ["pkg", "spec"], "left").join(latest, "pkg", "left").join(ranges, "spec", "left")
    fits_latest = range_test(F.col("range"), V.semver(F.col("latest")))
    rows = rows.withColumn("early", F.when(F.col("tagged").isNotNull(), F.col("tagged")).when(fits_latest, F.col("latest")))
    rows = rows.withColumn("via", F.when(F.col("tagged").isNotNull(), "tag").when(F.col("early").isNotNull(), "latest"))
    rows = written(rows.select("pkg", "spec", "early", "via", "range"), "wanted-specs")
    open_rows = rows.filter("early IS NULL AND range IS NOT NULL").select("pkg", "spec", "range")
    # a version is parsed once, however many specs of its package are open
    parsed = versions.join(open_rows.select("pkg").distinct(), "pkg", "left_semi").select("pkg", "version", F.coalesce("deprecated", F.lit(False)).alias("deprecated"), V.semver(F.col("version")).alias("v"))
    best = best_in_ranges(open_rows.select("pkg", "spec", "range"), parsed.filter("v.valid"))
    out = rows.join(best, ["pkg", "spec"], "left")
    out = out.select("pkg", "spec", F.coalesce("early", "best").alias("version"), F.coalesce("via", F.when(F.col("best").isNotNull(), "range")).alias("via"))
    if compatible is not None:
        ok = versions.select("pkg", "version", compatible.alias("ok"))
        kept = F.coalesce("ok", F.lit(False))
        out = out.join(ok, ["pkg", "version"], "left")
        out = out.select("pkg", "spec", F.when(kept, F.col("version")).alias("version"), F.when(F.col("version").isNull() | kept, F.col("via")).otherwise("incompatible").alias("via"))
    out = out.withColumnsRenamed({"pkg": "target", "spec": "need"})
    return names.join(out, ["target", "need"], "left").select("pkg", "spec", "target", "version", "via")


def platform_fits(os: str = "linux", cpu: str = "x64", libc: str = "glibc") -> Column:
    """A list that is absent allows all; negations are not understood, such rows fail."""
    ok = lambda c, x: F.col(c).isNull() | F.array_contains(c, x)
    return ok("os", os) & ok("cpu", cpu) & ok("libc", libc)


#: One specifier of a Python requirement: operator and version.
SPECIFIER = r"(===|==|~=|!=|<=|>=|<|>)\s*([^\s,;)]+)"


def parse_requirements(rows: DataFrame, column: str = "requirement") -> DataFrame:
    """Adds name, identity (name[extras]), specifiers and marker; comments and invalid lines go."""
    text = F.trim(F.regexp_replace(F.col(column), r"(^|\s)#.*$", ""))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*(?:\(([^)]*)\)|([^;@]*))?\s*(?:;\s*(.*))?$"
    out = rows.withColumn("__t", text).filter(F.col("__t").rlike(pattern))
    name = V.canonical_name(F.regexp_extract("__t", pattern, 1))
    extras = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.regexp_extract("__t", pattern, 2), ","), lambda x: V.canonical_name(F.trim(x))), lambda x: x != "")))
    spec = F.concat(F.regexp_extract("__t", pattern, 3), F.regexp_extract("__t", pattern, 4))
    pieces = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    out = out.filter(F.forall(pieces, lambda x: x.rlike(f"^{SPECIFIER}$")))
    specifiers = F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, SPECIFIER, 1).alias("op"), F.regexp_extract(x, SPECIFIER, 2).alias("version")))
    identity = F.when(F.size(extras) > 0, F.concat(name, F.lit("["), F.array_join(extras, ","), F.lit("]"))).otherwise(name)
    return out.withColumns({"name": name, "identity": identity, "specifiers": specifiers, "marker": F.nullif(F.regexp_extract("__t", pattern, 5), F.lit(""))}).drop("__t")


def names_prerelease(specifiers: Column) -> Column:
    """Whether one of the specifiers, but for !=, has a prerelease as its version."""
    return F.exists(specifiers, lambda s: (s["op"] != "!=") & V.pep440_is_prerelease(s["version"]))


def specifier_match(pairs: DataFrame) -> DataFrame:
    """pairs (name, specifiers, version): the rows that match.

    Prereleases match only where a specifier names one; a requirement without
    specifiers takes them where its name has no stable version. Specifiers and a
    version are compared once, however many names they are asked for.
    """
    # written before they are compared: a filter would be pushed below the distinct, to each row
    cases = written(pairs.select("specifiers", "version").distinct(), "specifier-pairs").filter(F.forall("specifiers", lambda s: specifier_holds(s, F.col("version"))))
    none, pre = F.size("specifiers") == 0, V.pep440_is_prerelease(F.col("version"))
    cases = cases.withColumn("__pre", pre).filter(none | ~F.col("__pre") | names_prerelease(F.col("specifiers"))).withColumnsRenamed({"specifiers": "__s", "version": "__v"})
    cases = written(cases, "specifier-cases")  # few: then they are broadcast, and pairs aren't shuffled
    fits = pairs.join(cases, F.col("specifiers").eqNullSafe(F.col("__s")) & F.col("version").eqNullSafe(F.col("__v")))
    # only where a requirement has no specifiers a name's other versions count
    stable = F.max(~F.col("__pre")).over(Window.partitionBy("name"))
    bare = fits.filter(none).withColumn("__stable", stable).filter(~F.col("__pre") | ~F.col("__stable"))
    return bare.select(*pairs.columns).union(fits.filter(~none).select(*pairs.columns))


def candidates_pip(requirements: DataFrame, versions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """requirements (root, name, specifiers), versions (name, version, yanked): root, name, version, rank.

    A candidate meets all requirements of the root on the name, each with its own
    rule for prereleases, and has a row in metadata (name, version), if given.
    Yanked versions count only where some requirement pins with ==. Newest first.
    A set of requirements and a version are compared once, however many roots and
    names they are asked for.
    """
    per_root = requirements.groupBy("root", "name").agg(F.array_sort(F.collect_set("specifiers")).alias("needs"))
    held = versions.select("name", "version", F.coalesce("yanked", F.lit(False)).alias("yanked"))
    held = held.withColumn("known", F.lit(True)) if metadata is None else held.join(metadata.select("name", "version").distinct().withColumn("known", F.lit(True)), ["name", "version"], "left")
    joined = written(per_root.join(held, "name"), "wanted-versions")
    pre = V.pep440_is_prerelease(F.col("version"))
    meets = lambda need: F.forall(need, lambda s: specifier_holds(s, F.col("version"))) & ((F.size(need) == 0) | ~F.col("pre") | names_prerelease(need))
    # written before they are compared: a filter would be pushed below the distinct, to each row
    cases = written(joined.select("needs", "version").distinct(), "candidate-pairs").withColumn("pre", pre).filter(F.forall("needs", meets))
    bare, pinned = F.exists("needs", lambda need: F.size(need) == 0), F.exists("needs", lambda need: F.exists(need, lambda s: s["op"] == "=="))
    cases = cases.select(F.col("needs").alias("__n"), F.col("version").alias("__v"), "pre", V.pep440_key(F.col("version")).alias("key"), bare.alias("bare"), pinned.alias("pinned"))
    cases = written(cases, "candidate-cases")  # few: then they are broadcast
    fits = joined.join(cases, F.col("needs").eqNullSafe(F.col("__n")) & F.col("version").eqNullSafe(F.col("__v"))).select("root", "name", "version", "yanked", "known", "pre", "key", "bare", "pinned")
    order = Window.partitionBy("root", "name").orderBy(F.col("key").desc())
    # over the same order, so that rows are sorted once
    stable = F.max(~F.col("pre")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fits = fits.withColumn("stable", stable).filter((~F.col("pre") | ~F.col("stable") | ~F.col("bare")) & (~F.col("yanked") | F.col("pinned")) & F.col("known"))
    return fits.select("root", "name", "version", F.row_number().over(order).cast("bigint").alias("rank"))


#: Stands for the extra where none is asked for.
NO_EXTRA = "\x00"


def marker_filter(deps: DataFrame, python_version: str | None = None, extras: Column | None = None, marker: str = "marker", environment: dict[str, str] | None = None) -> DataFrame:
    """Dependencies without a marker, or whose marker holds for one of the extras (for no extra, where none is asked for).

    Each distinct marker is parsed, and compared with the environment, once; a
    malformed one drops its dependencies. `python_version` (3.12, say) goes before
    the environment's.
    """
    env = dict(environment or {})
    if python_version:
        env["python_version"] = python_version
    wanted = F.transform(extras, V.canonical_name) if extras is not None else F.array().cast("array<string>")
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit(NO_EXTRA)))
    rows = deps.withColumns({"__extras": wanted, "__marker": F.nullif(F.trim(marker), F.lit(""))})
    parsed = rows.select("__marker").filter("__marker IS NOT NULL").distinct().withColumn("__tokens", compile_marker(F.col("__marker"), env))
    holds = F.coalesce(F.exists("__extras", lambda e: marker_holds(F.col("__tokens"), e)), F.lit(False))
    return rows.join(parsed, "__marker", "left").filter(F.col("__marker").isNull() | holds).select(*deps.columns)


def check_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """edges (src, name, spec, kind), selected (name, version): adds version, valid and problem.

    A spec that is no range fits any node of the name. A missing target is valid
    only if optional; it is a problem unless peer and optional ('peerOptional').
    """
    ranges = nested_ranges(range_bounds(edges))
    rows = edges.join(selected, "name", "left").join(ranges, "spec", "left")
    present = F.col("version").isNotNull()
    fits = F.col("range").isNull() | range_test(F.col("range"), V.semver(F.col("version")))
    valid = F.when(present, fits).otherwise(F.col("kind").isin("optional", "peerOptional"))
    problem = F.when(present, ~fits).otherwise(F.col("kind") != "peerOptional")
    return rows.withColumns({"valid": valid, "problem": problem}).drop("range", "low", "high", "pre")


def attach_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (name, num) with version_id of ids (name, num, version_id), the first where several; null is an error."""
    first = ids.groupBy("name", "num").agg(F.min("version_id").alias("version_id"))
    return rows.join(first, ["name", "num"], "left")


def build_worklist(deps: DataFrame, *without: DataFrame, dev: int = 2) -> DataFrame:
    """Ids of versions with a dependency that isn't for development, less those in any of the other tables."""
    out = deps.filter(F.col("kind") != dev).select("version_id").distinct()
    for other in without:
        out = out.join(other.select("version_id"), "version_id", "left_anti")
    return out


def apply_replaces(mods: DataFrame, replaces: DataFrame) -> DataFrame:
    """mods (path, version), replaces (path, version or '', new_path, new_version): adds to_path, to_version and status.

    A rule for the exact version wins over one for all versions of a path. A
    target without a version, a local folder, is not supported.
    """
    exact = replaces.filter("version <> ''").select("path", "version", F.struct("new_path", "new_version").alias("e"))
    wild = replaces.filter("version = ''").select("path", F.struct("new_path", "new_version").alias("w"))
    rule = F.coalesce("e", "w")
    rows = mods.join(exact, ["path", "version"], "left").join(wild, "path", "left").withColumn("rule", rule)
    broken = F.col("rule").isNotNull() & (F.coalesce(F.col("rule.new_version"), F.lit("")) == "")
    return rows.select(
        *(F.col(c) for c in mods.columns),
        F.when(broken, None).otherwise(F.coalesce("rule.new_path", "path")).alias("to_path"),
        F.when(broken, None).otherwise(F.coalesce("rule.new_version", "version")).alias("to_version"),
        F.when(broken, "UNSUPPORTED_REPLACE").when(F.col("rule").isNotNull(), "replaced").otherwise("kept").alias("status"),
    )


def apply_excludes(requires: DataFrame, excludes: DataFrame) -> DataFrame:
    return requires.join(excludes.select("path", "version"), ["path", "version"], "left_anti")


def edge_constraints(edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """edges (src, dst) with all requirement texts of src on dst, distinct and sorted, joined by ' || '."""
    texts = requirements.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("requirement")), " || ").alias("constraint"))
    return edges.join(texts, ["src", "dst"], "left")


def managed_override(deps: DataFrame, managed: DataFrame) -> DataFrame:
    """deps (root, ga, version, depth): from depth 2 on, managed versions (root, ga, managed) take over."""
    rows = deps.join(managed, ["root", "ga"], "left")
    return rows.withColumn("version", F.when(F.col("depth") >= 2, F.coalesce("managed", "version")).otherwise(F.col("version"))).drop("managed")


def active_packages(packages: DataFrame, tombstones: DataFrame, key: str = "name") -> DataFrame:
    return packages.join(tombstones.select(key), key, "left_anti")
