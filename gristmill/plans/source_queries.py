"""Sources by render-then-parse: documents are rendered from the fixture tables, read, and compared with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import documents as D
from .registry import query


def _named(column):
    return F.concat(F.lit("pkg-"), column.cast("string"))


@query("""SELECT line AS key, concat('list-', lpad(CAST(min(source_line // 500) AS VARCHAR), 9, '0')) AS source_path, arg_min(n, source_line) AS source_line
FROM (SELECT *, row_number() OVER (PARTITION BY source_line // 500 ORDER BY source_line) AS n FROM fx_request) WHERE line <> '' AND NOT line LIKE '#%' GROUP BY line""")
def s1_read_spec_list(f):
    path = F.concat(F.lit("list-"), F.lpad(F.expr("source_line div 500").cast("string"), 9, "0"))
    lists = f.fx_request.groupBy(path.alias("source_path")).agg(F.array_sort(F.collect_list(F.struct("source_line", "line"))).alias("l"))
    return D.read_spec_list(lists.select("source_path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")))


@query("""SELECT concat('g', CAST(c_nationkey AS VARCHAR)) AS group_id, concat('a', CAST(c_custkey AS VARCHAR)) AS artifact_id,
    CASE WHEN c_custkey % 3 = 0 THEN '2.0' ELSE concat('1.', CAST(c_custkey % 4 AS VARCHAR)) END AS version, CASE WHEN c_custkey % 3 < 2 THEN 'jar' END AS extension, CAST(CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS source_line FROM customer""")
def s2_read_inventory(f):
    g, a, v = F.concat(F.lit("g"), F.col("c_nationkey")), F.concat(F.lit("a"), F.col("c_custkey")), F.concat(F.lit("1."), F.col("c_custkey") % 4)
    obj = F.to_json(F.struct(g.alias("groupId"), a.alias("artifact_id")))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"defaults": {"version": "2.0", "extension": "jar"}, "items": ['), obj, F.lit("]}")))
    text = text.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"defaults": {"extension": "jar"}, "gavs": ["# none", "'), F.concat_ws(":", g, a, v), F.lit('"]}')))
    text = text.otherwise(F.concat(F.lit('["'), F.concat_ws(":", g, a, v), F.lit('"]')))
    files = f.customer.select(F.col("c_custkey").cast("string").alias("source_path"), text.alias("text"))
    return D.read_inventory(files).drop("source_path")


@query("""SELECT concat('pkg-', CAST(pkg AS VARCHAR)) AS name, '1.0.0' AS version, CASE kind WHEN 'runtime' THEN 'dependency' WHEN 'peer' THEN CASE WHEN pkg % 2 = 0 THEN 'peerOptional' ELSE 'peer' END ELSE kind END AS kind,
    concat('pkg-', CAST(dep AS VARCHAR)) AS dep, spec FROM (SELECT DISTINCT * FROM fx_dep)""")
def s3_read_packuments(f):
    deps = f.fx_dep.distinct().groupBy("pkg", "kind").agg(F.map_from_entries(F.collect_list(F.struct(_named(F.col("dep")), F.col("spec")))).alias("m"))
    of = lambda kind: F.any_value(F.when(F.col("kind") == kind, F.col("m")), True)
    per = deps.groupBy("pkg").agg(of("runtime").alias("r"), of("optional").alias("o"), of("peer").alias("p"))
    meta = F.when(F.col("pkg") % 2 == 0, F.transform_values("p", lambda k, v: F.struct(F.lit(True).alias("optional"))))
    # optional dependencies are listed among the plain ones too, as registries do
    body = F.struct(F.coalesce("r", "o").alias("dependencies"), F.col("o").alias("optionalDependencies"), F.col("p").alias("peerDependencies"), meta.alias("peerDependenciesMeta"))
    doc = F.to_json(F.struct(F.create_map(F.lit("1.0.0"), body).alias("versions"), F.lit("1-a").alias("_rev")))
    return D.read_packuments(per.select(_named(F.col("pkg")).alias("name"), doc.alias("doc")))["deps"].select("name", "version", "kind", "dep", "spec")


@query("SELECT concat('pkg-', CAST(pkg AS VARCHAR)) AS name, version, yanked, files AS n_files, '>=3.8' AS requires_python FROM fx_version")
def s4_read_project_json(f):
    file = F.struct(F.lit("f").alias("filename"), F.col("yanked"))
    files = F.array_repeat(file, F.col("files").cast("int"))
    per = f.fx_version.groupBy("pkg").agg(F.map_from_entries(F.collect_list(F.struct("version", files))).alias("releases"))
    doc = F.to_json(F.struct(F.struct(F.lit(">=3.8").alias("requires_python")).alias("info"), "releases"))
    return D.read_project_json(per.select(F.concat(F.lit("Pkg_"), F.col("pkg")).alias("name"), doc.alias("doc")))["releases"]


@query("SELECT concat('crate', CAST(pkg AS VARCHAR)) AS name, '1.0.0' AS version, concat('crate', CAST(dep AS VARCHAR)) AS dep, spec AS req, kind = 'optional' AS optional FROM fx_dep")
def s5_read_crate_index(f):
    dep = F.struct(F.concat(F.lit("crate"), F.col("dep")).alias("name"), F.col("spec").alias("req"), (F.col("kind") == "optional").alias("optional"))
    lines = f.fx_dep.groupBy("pkg").agg(F.collect_list(dep).alias("deps")).select(F.to_json(F.struct(F.concat(F.lit("Crate"), F.col("pkg")).alias("name"), F.lit("1.0.0").alias("vers"), "deps")).alias("line"))
    return D.read_crate_index(lines)["crate_deps"]


@query("SELECT concat('m/', CAST(pkg AS VARCHAR)) AS path, 'v1.0.0' AS version, concat('m/', CAST(dep AS VARCHAR)) AS dep, concat('v1.', CAST(pkg % 5 AS VARCHAR), '.0') AS dep_version, kind <> 'runtime' AS indirect FROM fx_dep")
def s6_read_gomod(f):
    line = F.concat(F.lit("m/"), F.col("dep"), F.lit(" v1."), F.col("pkg") % 5, F.lit(".0"), F.when(F.col("kind") != "runtime", " // indirect").otherwise(""))
    per = f.fx_dep.groupBy("pkg").agg(F.collect_list(line).alias("l"))
    one = F.concat(F.lit("require "), F.col("l")[0])
    block = F.concat(F.lit("require (\n\t"), F.array_join(F.slice("l", F.lit(2), F.size("l")), "\n\t"), F.lit("\n)\nexclude m/x v1.0.0\nreplace m/y => m/z v1.1.0\n"))
    raw = F.concat(F.lit("module m/"), F.col("pkg"), F.lit("\n\ngo 1.17\n"), one, F.lit("\n"), block)
    return D.read_gomod(per.select(F.concat(F.lit("m/"), F.col("pkg")).alias("path"), F.lit("v1.0.0").alias("version"), raw.alias("raw")))["requires"]


@query("""SELECT concat('g:a', CAST(pkg AS VARCHAR)) AS ga, version, row_number() OVER (PARTITION BY pkg ORDER BY version) - 1 AS pos, CAST(NULL AS VARCHAR) AS reason FROM fx_version WHERE pkg % 10 > 1
UNION ALL SELECT DISTINCT concat('g:a', CAST(pkg AS VARCHAR)), '9.9', 0, NULL FROM fx_version WHERE pkg % 10 = 1
UNION ALL SELECT DISTINCT concat('g:a', CAST(pkg AS VARCHAR)), NULL, NULL, 'coordinate-mismatch' FROM fx_version WHERE pkg % 10 = 0""")
def s7_read_version_metadata(f):
    per = f.fx_version.groupBy("pkg").agg(F.array_sort(F.collect_list("version")).alias("v"))
    tags = F.concat(F.lit("<versions><version> "), F.array_join("v", "</version><version>"), F.lit("</version></versions>"))
    body = F.when(F.col("pkg") % 10 == 1, "<release>9.9</release>").otherwise(tags)
    artifact = F.when(F.col("pkg") % 10 == 0, "other").otherwise(F.concat(F.lit("a"), F.col("pkg")))
    xml = F.concat(F.lit('<metadata xmlns="urn:m"><groupId>g</groupId><artifactId>'), artifact, F.lit("</artifactId><versioning>"), body, F.lit("</versioning></metadata>"))
    good, bad = D.read_version_metadata(per.select(F.concat(F.lit("g:a"), F.col("pkg")).alias("ga"), xml.alias("xml")))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query("""SELECT concat('pkg-', CAST(pkg AS VARCHAR)) AS name, '1.0' AS version, string_agg(DISTINCT concat('pkg-', CAST(dep AS VARCHAR), ' (', spec, ')'), '|' ORDER BY concat('pkg-', CAST(dep AS VARCHAR), ' (', spec, ')')) AS requires,
    '>=3.8' AS requires_python, CASE WHEN pkg % 9 = 0 THEN 'missing Version' ELSE '' END AS warnings FROM fx_dep GROUP BY pkg""")
def s8_read_core_metadata(f):
    text = F.concat(F.lit("Requires-Dist: pkg-"), F.col("dep"), F.lit("\n ("), F.col("spec"), F.lit(")"))
    per = f.fx_dep.groupBy("pkg").agg(F.array_join(F.array_sort(F.collect_set(text)), "\n").alias("r"))
    version = F.when(F.col("pkg") % 9 == 0, "").otherwise("Version: 1.0\n")
    doc = F.concat(F.lit("Metadata-Version: 2.1\nName: pkg-"), F.col("pkg"), F.lit("\n"), version, F.col("r"), F.lit("\nRequires-Python: >=3.8\n\nRequires-Dist: in-the-body\n"))
    out = D.read_core_metadata(per.select(F.lit("x").alias("name"), F.lit("1.0").alias("version"), doc.alias("text")))
    return out.select("name", "version", F.array_join(F.array_sort("requires_dist"), "|").alias("requires"), "requires_python", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT DISTINCT pkg, concat('pkg-', CAST(dep AS VARCHAR), CASE kind WHEN 'optional' THEN '; extra == ''o''' WHEN 'peer' THEN '; python_version < ''3'' and extra == ''p'' and os_name == ''nt''' ELSE '' END) AS requirement FROM fx_dep""")
def s9_read_requires_txt(f):
    line = F.concat(F.lit("pkg-"), F.col("dep"), F.when(F.col("kind") == "peer", "; python_version < '3'").otherwise(""), F.lit("  # why"))
    head = F.when(F.col("kind") == "optional", "[o]\n").when(F.col("kind") == "peer", "[p:os_name == 'nt']\n").otherwise("-r base.txt\n")
    per = f.fx_dep.groupBy("pkg", "kind").agg(F.array_join(F.collect_set(line), "\n").alias("t"))
    per = per.withColumn("t", F.concat(head, F.col("t"))).groupBy("pkg").agg(F.array_join(F.collect_list("t"), "\n\n").alias("text"))
    return D.read_requires_txt(per, ["pkg"]).drop("pos")


@query("""SELECT DISTINCT pkg, concat('pkg-', CAST(dep AS VARCHAR), CASE kind WHEN 'runtime' THEN '' ELSE concat('; extra == ''', kind, '''') END) AS requirement FROM fx_dep""")
def s10_read_build_config(f):
    per = f.fx_dep.groupBy("pkg", "kind").agg(F.collect_set(F.concat(F.lit("pkg-"), F.col("dep"))).alias("l"))
    per = per.withColumn("cfg", F.when(F.col("kind") == "runtime", F.concat(F.lit("[options]\ninstall_requires =\n    "), F.array_join("l", "\n    "))).otherwise(F.concat(F.lit("[options.extras_require]\n"), F.col("kind"), F.lit(" =\n    "), F.array_join("l", "\n    "))))
    quoted = F.concat(F.lit('["'), F.array_join("l", '", "'), F.lit('"]'))
    per = per.withColumn("toml", F.when(F.col("kind") == "runtime", F.concat(F.lit("[project]\ndependencies = "), quoted)).otherwise(F.concat(F.lit("[project.optional-dependencies]\n"), F.col("kind"), F.lit(" = "), quoted)))
    per = per.groupBy("pkg").agg(F.array_join(F.collect_list("cfg"), "\n").alias("cfg"), F.array_join(F.collect_list("toml"), "\n").alias("toml"))
    a = D.read_setup_cfg(per.filter("pkg % 2 = 0").select("pkg", F.col("cfg").alias("text")), ["pkg"])
    b = D.read_pyproject(per.filter("pkg % 2 = 1").select("pkg", F.col("toml").alias("text")), ["pkg"])
    return a.union(b).drop("pos")


@query("""SELECT CAST(pkg AS VARCHAR) AS name, '1' AS version, CASE WHEN pkg % 3 = 0 THEN 'setup.cfg' WHEN pkg % 5 = 0 THEN 'pyproject.toml' ELSE 'PKG-INFO' END AS source_kind,
    CASE WHEN pkg % 3 = 0 THEN 'b/setup.cfg' WHEN pkg % 5 = 0 THEN 'pyproject.toml' ELSE 'a/PKG-INFO' END AS detail, 'x' AS requires FROM (SELECT DISTINCT pkg FROM fx_dep)""")
def s11_declared_dependencies(f):
    own = f.fx_dep.select("pkg").distinct()
    src = lambda kind, path, has: F.struct(F.lit(kind).alias("source_kind"), F.lit(path).alias("path"), F.when(has, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("requires"))
    three, five = F.col("pkg") % 3 == 0, F.col("pkg") % 5 == 0
    found = [src("PKG-INFO", "a/PKG-INFO", ~three & ~five), src("PKG-INFO", "a/b/PKG-INFO", ~three & ~five), src("setup.cfg", "b/setup.cfg", three), src("setup.cfg", "c/d/setup.cfg", three), src("pyproject.toml", "pyproject.toml", F.lit(True))]
    rows = own.select(F.col("pkg").cast("string").alias("name"), F.lit("1").alias("version"), F.explode(F.array(*found)).alias("s")).select("name", "version", "s.*")
    out = D.declared_dependencies(rows)
    return out.select("name", "version", "source_kind", F.col("dependency_source_detail").alias("detail"), F.array_join("requires", ",").alias("requires"))


@query("SELECT seq // 100 AS batch_id, CAST(seq AS VARCHAR) AS seq, name, rev, deleted, CAST(seq // 100 * 100 + 99 AS VARCHAR) AS last_seq FROM fx_change")
def s12_read_change_feed(f):
    rev = lambda x: F.struct(x.alias("rev"))
    item = F.to_json(F.struct(F.col("seq").cast("string").alias("seq"), F.col("name").alias("id"), F.array(rev(F.lit("0-old")), rev(F.col("rev"))).alias("changes"), F.when(F.col("deleted"), True).alias("deleted")))
    per = f.fx_change.groupBy(F.expr("seq div 100").alias("batch_id")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    doc = F.concat(F.lit('{"results": [7, {"seq": "0", "id": " "}, '), F.col("items"), F.lit('], "last_seq": "'), F.col("batch_id") * 100 + 99, F.lit('"}'))
    return D.read_change_feed(per.select("batch_id", doc.alias("doc"))).drop("pos", "page")


@query("""SELECT pkg AS name, version, yanked, CASE pkg % 3 WHEN 2 THEN 'only' ELSE 'a|b' END AS requires FROM fx_version""")
def s13_index_lookup(f):
    text = F.when(F.col("pkg") % 3 == 0, '["a", "b"]').when(F.col("pkg") % 3 == 1, "['a', 'b']").otherwise("only")
    index = f.dealt().fx_version.select(F.col("pkg").alias("name"), "version", F.when(F.col("yanked"), True).alias("yanked"), text.alias("dependency"))
    wanted = f.part.select(F.col("p_partkey").alias("name"))
    out = D.index_lookup(index, wanted, ["name"])
    return out.select("name", "version", "yanked", F.array_join("requires_dist", "|").alias("requires"))


@query("""SELECT p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'first' WHEN 3 THEN NULL ELSE CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'second' END END AS value,
    CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 3 THEN NULL ELSE CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'secondary' END END AS origin,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'invalid-argument' ELSE CASE WHEN p_partkey % 5 = 0 THEN CASE p_partkey % 4 WHEN 1 THEN 'not-found' ELSE 'unavailable' END END END AS error FROM part""")
def s14_fallback_read(f):
    key = F.col("p_partkey")
    error = F.when(key % 4 == 1, "not-found").when(key % 4 == 2, "unavailable").when(key % 4 == 3, "invalid-argument")
    primary = f.part.select(key.alias("name"), F.when(key % 4 == 0, "first").alias("value"), error.alias("error"))
    secondary = f.part.filter("p_partkey % 5 <> 0").select(key.alias("name"), F.lit("second").alias("value"))
    return D.fallback_read(primary, secondary, ["name"])


@query("SELECT concat('g:a', CAST(pkg AS VARCHAR), ':1') AS gav, concat('g:a', CAST(dep AS VARCHAR)) AS ga, spec AS version, kind AS scope FROM fx_dep")
def s15_pom_coordinates(f):
    safe = F.replace(F.replace(F.col("spec"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>a"), F.col("dep"), F.lit("</artifactId><version>"), safe, F.lit("</version><scope>"), F.col("kind"), F.lit("</scope></dependency>"))
    per = f.fx_dep.groupBy("pkg").agg(F.array_join(F.collect_list(one), "").alias("d"))
    xml = F.concat(F.lit('<project xmlns="urn:p"><groupId>g</groupId><artifactId>a'), F.col("pkg"), F.lit("</artifactId><version>1</version><properties><k>v</k></properties><dependencies>"), F.col("d"), F.lit("</dependencies></project>"))
    return D.pom_coordinates(per.select(F.concat(F.lit("g:a"), F.col("pkg"), F.lit(":1")).alias("gav"), xml.alias("xml")))["dependencies"].drop("pos")


@query("""SELECT pkg AS name, version, concat('u/', version) AS url, yanked, CASE WHEN deprecated THEN '' ELSE 'r' END AS requires, CASE WHEN NOT deprecated AND files > 1 THEN '>=3.9' WHEN pkg % 2 = 0 THEN '>=3.8' END AS requires_python, CASE WHEN deprecated THEN 0 ELSE 1 END AS n_warnings FROM fx_version""")
def s16_release_metadata(f):
    v = f.fx_version.withColumnRenamed("pkg", "name")
    artifacts = v.select("name", "version", F.concat(F.lit("u/"), F.col("version")).alias("url"), F.lit("h").alias("sha256"), "yanked")
    extracted = v.filter("NOT deprecated").select("name", "version", F.array(F.lit("r")).alias("requires_dist"), F.when(F.col("files") > 1, ">=3.9").alias("requires_python"), F.array(F.lit("w")).alias("warnings"))
    project = v.select("name").distinct().filter("name % 2 = 0").withColumn("requires_python", F.lit(">=3.8"))
    out = D.release_metadata(artifacts, extracted, project)
    return out.select("name", "version", "url", "yanked", F.array_join("requires_dist", ",").alias("requires"), "requires_python", F.size("warnings").alias("n_warnings"))
