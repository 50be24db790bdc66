"""Readers of registry documents: text columns in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.versions import canonical_name

_LINES = r"\r?\n"


def text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files (source_path, text) of a folder, a pattern or a list of paths; .gz files are unpacked."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def read_inventory_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`read_inventory` of files, each in the format that its suffix names (.json, .jsonl or .ndjson, else lines of text), before .gz."""
    files = text_files(spark, path)
    name = F.regexp_replace(F.lower("source_path"), r"\.gz$", "")
    json, lines = name.endswith(".json"), name.rlike(r"\.(jsonl|ndjson)$")
    return read_inventory(files.filter(json), "json").unionByName(read_inventory(files.filter(lines), "jsonl")).unionByName(read_inventory(files.filter(~json & ~lines), "text"))


def read_spec_list(files: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """files (source_path, text): key, source_path, source_line of each first spec; blank lines and comments go.

    pip and maven lists also reject lines that begin with '--'.
    """
    lines = files.select("source_path", F.posexplode(F.split("text", _LINES)).alias("pos", "line"))
    lines = lines.select(F.trim("line").alias("key"), "source_path", (F.col("pos") + 1).cast("bigint").alias("source_line"))
    lines = lines.filter("key <> '' AND NOT key LIKE '#%'")
    if ecosystem in ("pip", "maven"):
        lines = lines.filter("NOT key LIKE '--%'")
    first = Window.partitionBy("key").orderBy("source_path", "source_line")
    return lines.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


_ITEM = "struct<coordinate: string, gav: string, group_id: string, groupId: string, artifact_id: string, artifactId: string, version: string, extension: string>"


def read_inventory(files: DataFrame, format: str = "json") -> DataFrame:
    """files (source_path, text): group_id, artifact_id, version, extension, source_path, source_line.

    Text has a coordinate a line; JSON lines an object or string a line; JSON an
    array, or an object with one of jobs, items, coordinates, gavs or packages and
    `defaults` that items fall back on.
    """
    if format == "json":
        body = lambda names: F.coalesce(*(F.get_json_object("text", f"$.{n}") for n in names), F.col("text"))
        raw = files.select("source_path", F.get_json_object("text", "$.defaults").alias("defaults"), F.posexplode(F.from_json(body(("jobs", "items", "coordinates", "gavs", "packages")), "array<string>")).alias("pos", "item"))
    else:
        raw = files.select("source_path", F.lit(None).cast("string").alias("defaults"), F.posexplode(F.split("text", _LINES)).alias("pos", "item"))
    raw = raw.withColumn("item", F.trim("item")).filter("item <> '' AND NOT item LIKE '#%'")
    parsed = raw.withColumn("i", F.when(F.col("item").startswith("{"), F.from_json("item", _ITEM))).withColumn("d", F.from_json("defaults", _ITEM))
    plain = F.when(F.col("i").isNull(), F.regexp_replace("item", '^"|"$', ""))
    gav = F.split(F.coalesce(F.col("i.coordinate"), F.col("i.gav"), plain), ":")
    part = lambda k, *names: F.coalesce(F.try_element_at(gav, F.lit(k)), *(F.col(f"{s}.{n}") for s in ("i", "d") for n in names))
    return parsed.select(
        part(1, "group_id", "groupId").alias("group_id"), part(2, "artifact_id", "artifactId").alias("artifact_id"), part(3, "version").alias("version"),
        F.coalesce("i.extension", "d.extension").alias("extension"), "source_path", (F.col("pos") + 1).cast("bigint").alias("source_line"),
    )


_DEPS = "map<string, string>"
_PACKUMENT = f"""struct<_id: string, _rev: string, `dist-tags`: {_DEPS}, versions: map<string, struct<deprecated: string, dependencies: {_DEPS}, optionalDependencies: {_DEPS},
 peerDependencies: {_DEPS}, peerDependenciesMeta: map<string, struct<optional: boolean>>, os: array<string>, cpu: array<string>, libc: array<string>>>>"""


def read_packuments(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (name, doc): packages, dist_tags, versions and deps.

    The document's _id names the package, else the requested name. Optional
    dependencies override plain ones; peers marked optional become peerOptional.
    """
    parsed = docs.select(F.col("name").alias("requested"), F.from_json("doc", _PACKUMENT).alias("d")).filter("d IS NOT NULL")
    parsed = parsed.withColumn("name", F.coalesce(F.nullif(F.col("d._id"), F.lit("")), F.col("requested")))
    versions = parsed.select("name", F.explode("d.versions").alias("version", "v"))
    empty = F.from_json(F.lit("{}"), _DEPS)
    all_of = lambda c: F.coalesce(F.col(f"v.{c}"), empty)
    optional = all_of("optionalDependencies")
    plain = F.map_filter(all_of("dependencies"), lambda k, _: ~F.map_contains_key(optional, k))
    is_optional = lambda k: F.coalesce(F.try_element_at(F.col("v.peerDependenciesMeta"), k)["optional"], F.lit(False))
    kinds = {
        "dependency": plain,
        "optional": optional,
        "peer": F.map_filter(all_of("peerDependencies"), lambda k, _: ~is_optional(k)),
        "peerOptional": F.map_filter(all_of("peerDependencies"), lambda k, _: is_optional(k)),
    }

    def entries(kind: str, m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("dep"), e["value"].alias("spec")))

    edges = F.flatten(F.array(*(entries(kind, m) for kind, m in kinds.items())))
    return {
        "packages": parsed.select("name", F.col("d._rev").alias("rev")),
        "dist_tags": parsed.select("name", F.explode(F.col("d").getField("dist-tags")).alias("tag", "version")),
        "versions": versions.select("name", "version", (F.coalesce(F.col("v.deprecated"), F.lit("false")) != "false").alias("deprecated"), "v.os", "v.cpu", "v.libc"),
        "deps": versions.select("name", "version", F.explode(edges).alias("e")).select("name", "version", "e.*"),
    }


_PROJECT = "struct<info: struct<name: string, requires_python: string>, releases: map<string, array<struct<filename: string, yanked: boolean, packagetype: string, digests: map<string, string>>>>>"


def read_project_json(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (name, doc): releases (yanked if it has files and all are) and files."""
    parsed = docs.select(canonical_name(F.col("name")).alias("name"), F.from_json("doc", _PROJECT).alias("d"))
    rows = parsed.select("name", F.col("d.info.requires_python").alias("requires_python"), F.explode("d.releases").alias("version", "files"))
    yanked = (F.size("files") > 0) & F.forall("files", lambda x: F.coalesce(x["yanked"], F.lit(False)))
    return {
        "releases": rows.select("name", "version", yanked.alias("yanked"), F.size("files").cast("bigint").alias("n_files"), "requires_python"),
        "files": rows.select("name", "version", F.explode("files").alias("f")).select("name", "version", "f.filename", F.coalesce("f.yanked", F.lit(False)).alias("yanked"), F.col("f.digests")["sha256"].alias("sha256")),
    }


_CRATE = "struct<name: string, vers: string, yanked: boolean, features: map<string, array<string>>, features2: map<string, array<string>>, deps: array<struct<name: string, req: string, optional: boolean, kind: string>>>"


def read_crate_index(lines: DataFrame, column: str = "line") -> dict[str, DataFrame]:
    """One JSON object a line: crate_versions, crate_deps and crate_features (of both maps). Names match in any case."""
    rows = lines.select(F.from_json(column, _CRATE).alias("c")).filter("c.name IS NOT NULL AND c.vers IS NOT NULL")
    rows = rows.select(F.lower("c.name").alias("name"), F.col("c.vers").alias("version"), "c")
    empty = F.from_json(F.lit("{}"), "map<string, array<string>>")
    entries = F.concat(F.map_entries(F.coalesce("c.features", empty)), F.map_entries(F.coalesce("c.features2", empty)))
    return {
        "crate_versions": rows.select("name", "version", F.coalesce("c.yanked", F.lit(False)).alias("yanked")),
        "crate_deps": rows.select("name", "version", F.explode("c.deps").alias("d")).select("name", "version", F.col("d.name").alias("dep"), "d.req", F.coalesce("d.optional", F.lit(False)).alias("optional")),
        "crate_features": rows.select("name", "version", F.explode(entries).alias("e")).select("name", "version", F.col("e.key").alias("feature"), F.explode_outer("e.value").alias("member")),
    }


def _carried(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far within a document."""
    seen = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(seen))


def read_gomod(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (path, version, raw): modules (declared path, go version), requires, excludes and replaces."""
    lines = docs.select("path", "version", F.posexplode(F.split("raw", _LINES)).alias("pos", "line"))
    indirect = F.col("line").rlike(r"//\s*indirect\b")
    lines = lines.withColumn("indirect", indirect).withColumn("text", F.btrim(F.regexp_replace("line", r"//.*$", ""), F.lit(" \t"))).filter("text <> ''")
    opens, closes = F.regexp_extract("text", r"^(require|exclude|replace|retract)\s*\($", 1), F.col("text") == ")"
    lines = _carried(lines, ["path", "version"], F.when(closes, "").when(opens != "", opens), "block").filter(~closes & (opens == ""))
    inside = F.coalesce("block", F.lit("")) != ""
    verb = F.when(inside, F.col("block")).otherwise(F.regexp_extract("text", r"^(\w+)\s", 1))
    body = F.when(inside, F.col("text")).otherwise(F.regexp_replace("text", r"^\w+\s+", ""))
    bare = F.regexp_replace(F.regexp_replace(body, r"`([^`]*)`", "$1"), r'"([^"]*)"', "$1")  # texts may stand in quotes of either kind
    rows = lines.select("path", "version", "indirect", verb.alias("verb"), F.split(bare, r"\s+").alias("w"), bare.alias("body"))
    of = lambda v: rows.filter(F.col("verb") == v)
    word = lambda i: F.try_element_at("w", F.lit(i))
    old, new = F.split(F.split("body", r"\s*=>\s*")[0], r"\s+"), F.split(F.split("body", r"\s*=>\s*")[1], r"\s+")
    declared = of("module").select("path", "version", word(1).alias("declared"))
    return {
        "modules": docs.select("path", "version").join(declared, ["path", "version"], "left").join(of("go").select("path", "version", word(1).alias("go_version")), ["path", "version"], "left"),
        "requires": of("require").select("path", "version", word(1).alias("dep"), word(2).alias("dep_version"), "indirect"),
        "excludes": of("exclude").select("path", "version", word(1).alias("dep"), word(2).alias("dep_version")),
        "replaces": of("replace").select(
            "path", "version", F.try_element_at(old, F.lit(1)).alias("old_path"), F.coalesce(F.try_element_at(old, F.lit(2)), F.lit("")).alias("old_version"),
            F.try_element_at(new, F.lit(1)).alias("new_path"), F.coalesce(F.try_element_at(new, F.lit(2)), F.lit("")).alias("new_version"),
        ),
    }


_METADATA = "struct<groupId: string, artifactId: string, versioning: struct<latest: string, release: string, versions: struct<version: array<string>>>>"


def read_version_metadata(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (ga, xml): (ga, version, pos) and (ga, reason) of those without versions."""
    plain = F.regexp_replace(F.regexp_replace("xml", r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = docs.select("ga", F.from_xml(plain, _METADATA, {"rowTag": "metadata"}).alias("m"))
    listed = F.array_distinct(F.filter(F.transform(F.col("m.versioning.versions.version"), lambda v: F.trim(v)), lambda v: v != ""))
    fallback = F.array_compact(F.slice(F.array_compact(F.array(F.nullif(F.trim("m.versioning.release"), F.lit("")), F.nullif(F.trim("m.versioning.latest"), F.lit("")))), 1, 1))
    rows = rows.withColumn("versions", F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).otherwise(fallback))
    declared = F.concat_ws(":", F.trim("m.groupId"), F.trim("m.artifactId"))
    reason = (
        F.when(F.col("m").isNull() | (F.col("m.groupId").isNull() & F.col("m.versioning").isNull()), "invalid-xml").when((declared != "") & (declared != F.col("ga")), "coordinate-mismatch")
        .when(F.col("m.versioning").isNull(), "missing-versioning").when(F.size("versions") == 0, "no-versions")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").select("ga", F.posexplode("versions").alias("pos", "version"))
    return good.select("ga", "version", F.col("pos").cast("bigint").alias("pos")), rows.filter("reason IS NOT NULL").select("ga", "reason")


def read_core_metadata(docs: DataFrame) -> DataFrame:
    """docs (name, version, text): the header block of package metadata; Name and Version fall back on the columns with a warning."""
    header = F.regexp_replace(F.regexp_replace("text", r"(?s)\r?\n\r?\n.*$", ""), r"\r?\n[ \t]+", " ")
    all_of = lambda key: F.transform(F.regexp_extract_all(header, F.lit(rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$"), F.lit(1)), lambda x: F.trim(x))
    one = lambda key: F.nullif(F.trim(F.regexp_extract(header, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)), F.lit(""))
    old = F.filter(F.transform(F.flatten(F.transform(all_of("Requires"), lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    wanted = F.when(F.size(all_of("Requires-Dist")) > 0, all_of("Requires-Dist")).otherwise(old)
    warnings = F.array_compact(F.array(F.when(one("Name").isNull(), "missing Name"), F.when(one("Version").isNull(), "missing Version")))
    return docs.select(F.coalesce(one("Name"), F.col("name")).alias("name"), F.coalesce(one("Version"), F.col("version")).alias("version"), wanted.alias("requires_dist"), one("Requires-Python").alias("requires_python"), warnings.alias("warnings"))


def read_requires_txt(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs (keys, text): pos and requirement; a section adds its extra and marker to the lines below it."""
    lines = docs.select(*keys, F.posexplode(F.split("text", _LINES)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim(F.regexp_replace("line", r"(^|\s+)#.*$", ""), F.lit(" \t"))).filter("line <> ''")
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    rows = _carried(lines.withColumn("head", section), keys, F.col("head"), "section").filter(F.col("head").isNull() & ~F.col("line").rlike(r"^(-r|-c|--|-i|-f|-e)"))
    extra, marker = F.nullif(F.trim(F.regexp_extract("section", r"^([^:]*)", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("section", r":(.*)$", 1)), F.lit(""))
    own = F.nullif(F.trim(F.regexp_extract("line", r";(.*)$", 1)), F.lit(""))
    together = F.concat_ws(" and ", own, F.when(extra.isNotNull(), F.concat(F.lit("extra == '"), extra, F.lit("'"))), marker)
    base = F.trim(F.regexp_replace("line", r";.*$", ""))
    return rows.select(*keys, "pos", F.when(together == "", base).otherwise(F.concat(base, F.lit("; "), together)).alias("requirement"))


def read_setup_cfg(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs (keys, text): pos and requirement from install_requires and extras_require."""
    lines = docs.select(*keys, F.posexplode(F.split("text", _LINES)).alias("pos", "line")).filter("trim(line) <> '' AND NOT trim(line) LIKE '#%'")
    rows = _carried(lines, keys, F.when(F.col("line").rlike(r"^\["), F.regexp_extract("line", r"^\[([^\]]*)\]", 1)), "section")
    rows = _carried(rows, keys, F.when(F.col("line").rlike(r"^\["), "").when(F.col("line").rlike(r"^\S+\s*="), F.trim(F.regexp_extract("line", r"^([^=]+)=", 1))), "option")
    value = F.trim(F.when(F.col("line").rlike(r"^\S+\s*="), F.regexp_extract("line", r"^[^=]+=(.*)$", 1)).otherwise(F.col("line")))
    rows = rows.withColumn("value", value).filter("value <> '' AND NOT line LIKE '[%'")
    rows = rows.filter("(section = 'options' AND option = 'install_requires') OR section = 'options.extras_require'")
    extra = F.when(F.col("section") == "options.extras_require", F.concat(F.lit("extra == '"), F.col("option"), F.lit("'")))
    text = F.when(extra.isNull(), F.col("value")).when(F.col("value").contains(";"), F.concat_ws(" and ", "value", extra)).otherwise(F.concat_ws("; ", "value", extra))
    return rows.select(*keys, "pos", text.alias("requirement"))


def read_pyproject(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs (keys, text): pos and requirement of pyproject.toml's project and poetry tables.

    TOML has no built-in reader: one Arrow batch of file rows at a time is parsed
    with the standard library.
    """
    schema = docs.select(*keys).schema.add("pos", "integer").add("requirement", "string")

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                *own, text = row
                out += [(*own, i, r) for i, r in enumerate(pyproject_requirements(text))]
            yield pd.DataFrame(out, columns=[*keys, "pos", "requirement"])

    return docs.select(*keys, "text").mapInPandas(run, schema)


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def _texts(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def poetry_version(text: str) -> str:
    """A version constraint of poetry as specifiers: a caret is ~=, a bare version ==, which has a dot at least; * goes."""
    text = text.strip()
    if text in ("", "*"):
        return ""
    text = "~=" + text[1:] if text[0] == "^" else text if text[0] in "<>=!~" else "==" + text
    if text.startswith("==") and "." not in text:
        text += ".0"
    return text.replace("*", "")


def pyproject_requirements(text: str | None) -> list[str]:
    """Requirements of a pyproject.toml, each once; what isn't of the expected kind is passed over, as is text that isn't TOML.

    An optional package of poetry has a row for each extra that lists it, and one
    without a marker where none does.
    """
    import tomllib

    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return []
    project, poetry = _table(data.get("project")), _table(_table(data.get("tool")).get("poetry"))
    out = _texts(project.get("dependencies"))
    for extra, rows in _table(project.get("optional-dependencies")).items():
        out += [f"{r} and extra == '{extra}'" if ";" in r else f"{r}; extra == '{extra}'" for r in _texts(rows)]
    extras = {extra: _texts(names) for extra, names in _table(poetry.get("extras")).items()}
    for name, spec in _table(poetry.get("dependencies")).items():
        version = spec.get("version") if isinstance(spec, dict) else spec
        if name == "python" or not isinstance(version, str):
            continue
        listed = [e for e, names in extras.items() if name in names] if isinstance(spec, dict) and spec.get("optional") is True else []
        out += [f"{name}{poetry_version(version)}; extra == '{e}'" for e in listed] or [f"{name}{poetry_version(version)}"]
    return list(dict.fromkeys(out))


#: Files that may declare dependencies, in order of preference.
PRIMARY = ("PKG-INFO", "setup.cfg", "pyproject.toml")
FALLBACK = ("requires.txt", "PKG-INFO", "setup.cfg", "pyproject.toml", "requirements.txt")


def declared_dependencies(found: DataFrame, order: tuple[str, ...] = PRIMARY, keys: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """found (keys, source_kind, path, requires): the first source by kind, depth of its path and path that isn't empty."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("source_kind"))
    rows = found.withColumn("rank", rank).filter((F.size("requires") > 0) & (F.col("rank") > 0))
    first = Window.partitionBy(*keys).orderBy("rank", F.size(F.split("path", "/")), "path")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*keys, "source_kind", F.col("path").alias("dependency_source_detail"), "requires")


_FEED = "struct<results: array<string>, last_seq: string>"
_EVENT = "struct<seq: string, id: string, changes: array<struct<rev: string>>, deleted: boolean>"


def read_change_feed(batches: DataFrame, column: str = "doc") -> DataFrame:
    """batches (batch_id, doc): batch_id, pos, seq, name, rev (the last), deleted, last_seq; items without an id go.

    `page` is the number that the page's last_seq begins with, by which pages of one batch are in order.
    """
    rows = batches.select("batch_id", F.from_json(column, _FEED).alias("f"))
    items = rows.select("batch_id", F.col("f.last_seq").alias("last_seq"), F.posexplode("f.results").alias("pos", "item"))
    items = items.withColumn("e", F.from_json("item", _EVENT)).filter("e IS NOT NULL AND trim(coalesce(e.id, '')) <> ''")
    return items.select("batch_id", F.col("pos").cast("bigint").alias("pos"), "e.seq", F.trim("e.id").alias("name"), F.try_element_at("e.changes", F.lit(-1))["rev"].alias("rev"), F.coalesce("e.deleted", F.lit(False)).alias("deleted"), "last_seq", F.regexp_extract("last_seq", r"^(\d+)", 1).try_cast("bigint").alias("page"))


def decode_list(text: Column) -> Column:
    """A JSON list, a list in Python's notation, or a single text."""
    trimmed = F.trim(text)
    python = F.regexp_replace(F.regexp_replace(trimmed, '"', '\\\\"'), "'", '"')
    return F.when(trimmed.rlike(r"^\["), F.coalesce(F.from_json(trimmed, "array<string>"), F.from_json(python, "array<string>"), F.array(trimmed))).when(trimmed != "", F.array(trimmed)).otherwise(F.array().cast("array<string>"))


def index_lookup(index: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows of the wanted keys, with `dependency` decoded; rows without a version go."""
    rows = index.join(wanted.select(*keys).distinct(), keys, "left_semi").filter("version IS NOT NULL AND version <> ''")
    return rows.withColumns({"requires_dist": decode_list(F.col("dependency")), "yanked": F.coalesce("yanked", F.lit(False))})


#: Outcomes of a first source after which the second is asked.
FALL_BACK_ON = ("not-found", "unavailable", "protocol-error")


def fallback_read(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """primary (keys, value, error), secondary (keys, value): value, origin, error; an invalid argument isn't asked again."""
    rows = primary.join(secondary.withColumnRenamed("value", "__second"), keys, "left")
    again = F.col("value").isNull() & (F.col("error").isNull() | F.col("error").isin(*FALL_BACK_ON))
    used = again & F.col("__second").isNotNull()
    return rows.select(
        *keys, F.when(used, F.col("__second")).otherwise(F.col("value")).alias("value"),
        F.when(used, "secondary").when(F.col("value").isNotNull(), "primary").alias("origin"), F.when(~used, F.col("error")).alias("error"),
    )


_POM = """struct<groupId: string, artifactId: string, version: string, properties: map<string,string>, parent: struct<groupId: string, artifactId: string, version: string>,
 dependencies: struct<dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string, optional: string>>>,
 dependencyManagement: struct<dependencies: struct<dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string>>>>>"""


def pom_coordinates(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (gav, xml): poms (own and parent coordinates), properties, dependencies, managed; documents that aren't POMs give nothing."""
    plain = F.regexp_replace(F.regexp_replace("xml", r"(?s)<!--.*?-->", ""), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = docs.select("gav", plain.alias("xml")).filter(F.col("xml").rlike(r"<project[\s>]")).select("gav", F.from_xml("xml", _POM, {"rowTag": "project"}).alias("p"))
    props = rows.select("gav", F.explode("p.properties").alias("key", "value")).withColumn("value", F.trim(F.coalesce("value", F.lit(""))))
    parent = F.when(F.col("p.parent.artifactId").isNotNull(), F.concat_ws(":", "p.parent.groupId", "p.parent.artifactId", "p.parent.version"))
    dep = lambda c: rows.select("gav", F.posexplode(c).alias("pos", "d")).select("gav", F.col("pos").cast("bigint").alias("pos"), F.concat_ws(":", "d.groupId", "d.artifactId").alias("ga"), "d.version", "d.scope")
    return {
        "poms": rows.select("gav", F.coalesce("p.groupId", "p.parent.groupId").alias("group_id"), F.col("p.artifactId").alias("artifact_id"), F.coalesce("p.version", "p.parent.version").alias("version"), parent.alias("parent")),
        "properties": props,
        "dependencies": dep("p.dependencies.dependency"),
        "managed": dep("p.dependencyManagement.dependencies.dependency"),
    }


def release_metadata(artifacts: DataFrame, extracted: DataFrame, project: DataFrame) -> DataFrame:
    """One record a release: artifacts (name, version, url, sha256, yanked), extracted (name, version, requires_dist, requires_python, warnings), project (name, requires_python)."""
    own = extracted.withColumnRenamed("requires_python", "__own")
    rows = artifacts.join(own, ["name", "version"], "left").join(project.select("name", F.col("requires_python").alias("__project")), "name", "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        "name", "version", "url", "sha256", F.coalesce("yanked", F.lit(False)).alias("yanked"), F.coalesce("requires_dist", empty).alias("requires_dist"),
        F.coalesce("__own", "__project").alias("requires_python"), F.coalesce("warnings", empty).alias("warnings"),
    )
