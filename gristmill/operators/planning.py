"""Planning of indexing runs: what to fetch, what to skip, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import before_part, in_order


def parse_requests(lines: DataFrame, ecosystem: str, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """Parsed rows (with name, version) and rejects (with reason). Names as each ecosystem writes them."""
    text = F.trim(column)
    rows = lines.withColumn("__t", text)
    t = F.col("__t")
    if ecosystem == "npm":
        good = t.rlike(r"^(@[^/@\s]+/[^/@\s]+|[^/@\s]+)$")
        name, version = t, F.lit(None).cast("string")
    elif ecosystem == "go":
        versioned = t.rlike(r"^.+@[vV]\d[^@]*$")
        good = ~t.rlike(r"\s") & (t != "")
        name = F.when(versioned, F.regexp_extract(t, r"^(.+)@[^@]*$", 1)).otherwise(t)
        version = F.when(versioned, F.regexp_extract(t, r"@([^@]*)$", 1))
    elif ecosystem == "pip":
        good = t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*(==\S+)?$")
        name, version = F.regexp_extract(t, r"^([^=]+)", 1), F.nullif(F.regexp_extract(t, r"==(\S+)$", 1), F.lit(""))
    elif ecosystem == "maven":
        good = t.rlike(r"^[^:\s]+:[^:\s]+(:[^:\s]+)?$")
        name, version = F.regexp_extract(t, r"^([^:]+:[^:]+)", 1), F.nullif(F.regexp_extract(t, r"^[^:]+:[^:]+:(.+)$", 1), F.lit(""))
    else:
        raise ValueError(f"unknown ecosystem {ecosystem}")
    keep = lines.columns
    return rows.filter(good).select(*keep, name.alias("name"), version.alias("version")), rows.filter(~good).select(*keep, F.lit("invalid-request").alias("reason"))


def go_escape(path: Column) -> Column:
    """Upper-case letters as '!' and lower case; null for paths with '!' or other than ASCII."""
    return F.when(~path.rlike(r"[!\x00-\x1F]|[^\x00-\x7F]"), F.lower(F.regexp_replace(path, "([A-Z])", "!$1")))


def npm_escape(name: Column) -> Column:
    """Percent-encoded but for '@'."""
    return F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%40"), F.lit("@"))


def maven_path(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws("/", F.replace(group, F.lit("."), F.lit("/")), artifact, version)


def fetch_plan(requests: DataFrame, ecosystem: str, base: str) -> DataFrame:
    """Adds the url of each request (name, version)."""
    if ecosystem == "npm":
        url = F.concat(F.lit(base + "/"), npm_escape(F.col("name")))
    elif ecosystem == "go":
        url = F.concat(F.lit(base + "/"), go_escape(F.col("name")), F.lit("/@v/"), go_escape(F.col("version")), F.lit(".mod"))
    elif ecosystem == "maven":
        g, a = F.split("name", ":")[0], F.split("name", ":")[1]
        pom = F.concat(F.lit(base + "/"), maven_path(g, a, F.col("version")), F.lit("/"), a, F.lit("-"), F.col("version"), F.lit(".pom"))
        url = F.coalesce(pom, F.concat(F.lit(base + "/"), F.replace(g, F.lit("."), F.lit("/")), F.lit("/"), a, F.lit("/maven-metadata.xml")))
    else:
        url = F.concat(F.lit(base + "/"), F.col("name"), F.lit("/json"))
    return requests.withColumn("url", url)


def expand_versions(requests: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (name, version), catalog (name, version): distinct pairs, and names without any version."""
    listed = catalog.select("name", F.col("version").alias("listed"))
    open_ = requests.filter("version IS NULL").select("name").distinct().join(listed, "name", "left")
    fixed = requests.filter("version IS NOT NULL").select("name", "version")
    return fixed.union(open_.filter("listed IS NOT NULL").select("name", "listed")).distinct(), open_.filter("listed IS NULL").select("name", F.lit("no-versions").alias("reason"))


def plan_releases(requests: DataFrame, releases: DataFrame, limit: int | None = None, include_yanked: bool = False) -> DataFrame:
    """requests (name, version, pos), releases (name, version, key, yanked): name, version, rank.

    Explicit versions in the given order; otherwise the newest first, yanked ones
    only if all are, cut at `limit`.
    """
    first = requests.filter("version IS NOT NULL").groupBy("name", "version").agg(F.min("pos").alias("pos"))
    explicit = first.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("pos")).cast("bigint")).select("name", "version", "rank")
    open_ = requests.filter("version IS NULL").select("name").distinct().join(explicit.select("name").distinct(), "name", "left_anti")
    rows = open_.join(releases, "name")
    if not include_yanked:
        rows = rows.withColumn("good", F.max(~F.col("yanked")).over(Window.partitionBy("name"))).filter("NOT yanked OR NOT good")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("key"), F.desc("version"))).cast("bigint"))
    if limit is not None:
        rows = rows.filter(F.col("rank") <= limit)
    return explicit.union(rows.select("name", "version", "rank"))


def select_root_version(releases: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """releases (name, version, key, yanked, prerelease): the requested version, else the newest stable, then any, then yanked."""
    rows = releases.join(requested.select("name", F.col("version").alias("wanted")), "name", "left") if requested is not None else releases.withColumn("wanted", F.lit(None).cast("string"))
    best = F.struct(F.coalesce(F.col("wanted") == F.col("version"), F.lit(False)), ~F.col("yanked"), ~F.col("prerelease"), F.col("key"))
    return rows.groupBy("name").agg(F.max_by("version", best).alias("version"))


def skip_existing(requests: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests to do, and those skipped as the index has them."""
    have = index.select(*keys).distinct()
    return requests.join(have, keys, "left_anti"), requests.join(have, keys, "left_semi")


DONE = ("completed", "resume-skip")


def resume_filter(requests: DataFrame, state: DataFrame, key: str, policy: str = "any", done: tuple[str, ...] = DONE) -> DataFrame:
    """Requests not completed: by any state entry of the key, or by its latest alone."""
    if policy == "any":
        over = state.filter(F.col("state_status").isin(*done)).select(key).distinct()
    else:
        over = state.groupBy(key).agg(F.max_by("state_status", "pos").alias("s")).filter(F.col("s").isin(*done)).select(key)
    return requests.join(over, key, "left_anti")


def select_for_sync(requests: DataFrame, completed: DataFrame, local: DataFrame, mode: str, key: str = "coordinate") -> DataFrame:
    """Adds `selected`. completed (key), local (key, can_verify, satisfied).

    full: all; new-only: not completed; repair-missing: verifiable and not
    satisfied; incremental: not completed, or verifiable and not satisfied.
    """
    rows = requests.join(completed.select(key).distinct().withColumn("done", F.lit(True)), key, "left").join(local, key, "left")
    done, broken = F.coalesce("done", F.lit(False)), F.coalesce(F.col("can_verify") & ~F.col("satisfied"), F.lit(False))
    chosen = {"full": F.lit(True), "new-only": ~done, "repair-missing": broken, "incremental": ~done | broken}[mode]
    return rows.select(*requests.columns, chosen.alias("selected"))


def inspect_local(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (coordinate, target, path), files (path, valid): adds reason and satisfied.

    A target of pom or metadata needs its file; 'state-only' targets have none to verify.
    """
    rows = requests.join(files, "path", "left")
    reason = (
        F.when(F.col("target") == "state-only", "state-only").when(F.col("valid").isNull(), F.concat(F.lit("missing-"), F.col("target")))
        .when(~F.col("valid"), F.concat(F.lit("invalid-"), F.col("target"))).otherwise("ready")
    )
    return rows.select(*requests.columns, (F.col("target") != "state-only").alias("can_verify"), reason.alias("reason"), (reason == "ready").alias("satisfied"))


def sha1_modulus(key: Column, n: int) -> Column:
    """The SHA-1 of a text, as one number of 160 bits, modulo n (below 2^31)."""
    digest = F.sha1(key)
    words = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda rest, w: (rest * F.lit((1 << 32) % n) + w) % n)


def shard(requests: DataFrame, n: int, i: int | None = None, limit: int | None = None, key: str = "coordinate") -> DataFrame:
    """Adds shard_index and the 1-based sequence within the shard, in key order; i and limit cut."""
    rows = requests.withColumn("shard_index", sha1_modulus(F.col(key), n))
    if i is not None:
        rows = rows.filter(F.col("shard_index") == i)
    parts = in_order(rows, "shard_index", key)
    own = F.row_number().over(Window.partitionBy("shard_index", "part").orderBy(key)).cast("bigint")
    offsets = before_part(parts, "shard_index", earlier=F.count("*"))
    rows = parts.withColumn("own", own).join(offsets, ["shard_index", "part"]).withColumn("sequence", F.col("own") + F.col("earlier")).select(*requests.columns, "shard_index", "sequence")
    return rows if limit is None else rows.filter(F.col("sequence") <= limit)


def version_strategy(rows: DataFrame, column: str = "version") -> DataFrame:
    """Adds strategy, required, supported and direct_fetch of a Maven version text."""
    v = F.trim(F.coalesce(column, F.lit("")))
    up = F.upper(v)
    kind = (
        F.when(v == "", "none").when(F.endswith(up, F.lit("-SNAPSHOT")), "snapshot").when(up == "LATEST", "latest").when(up == "RELEASE", "release")
        .when(F.left(v, F.lit(1)).isin("[", "(") & F.right(v, F.lit(1)).isin("]", ")"), "range").otherwise("disabled")
    )
    rows = rows.withColumn("strategy", kind)
    return rows.withColumns({
        "required": F.col("strategy").isin("latest", "release", "range", "snapshot"),
        "supported": F.col("strategy") != "snapshot",
        "direct_fetch": F.col("strategy") == "disabled",
    })


def fingerprint(rows: DataFrame, payload: str) -> DataFrame:
    return rows.withColumn("sha256", F.sha2(payload, 256))


def changed_only(new: DataFrame, old: DataFrame, keys: list[str], revision: str = "rev") -> DataFrame:
    """New rows whose revision differs from the stored one; a null revision counts as changed."""
    rows = new.join(old.select(*keys, F.col(revision).alias("__old")), keys, "left")
    return rows.filter(F.col("__old").isNull() | F.col(revision).isNull() | (F.col(revision) != F.col("__old"))).drop("__old")


REQUIRED = ("name", "version", "source_kind", "artifact_path", "filename")


def validate_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (trimmed, lists without repeats, status) and issues (keys, severity, code, detail)."""
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in REQUIRED}
    texts = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.withColumns({**clean, "requires_dist": texts("requires_dist"), "parse_warnings": texts("parse_warnings")})
    issue = lambda severity, code, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    fixed = F.array(*(F.when(F.col(c) == "", issue("error", f"missing_{c}", none)) for c in REQUIRED), F.when(F.size("requires_dist") == 0, issue("warning", "no_dependencies", none)))
    issues = F.concat(F.array_compact(fixed), F.transform("parse_warnings", lambda w: issue("warning", "parse_warning", w)))
    rows = rows.withColumn("issues", issues)
    status = F.when(F.exists("issues", lambda i: i["severity"] == "error"), "error").when(F.size("issues") > 0, "partial").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.drop("issues"), rows.select("name", "version", F.explode("issues").alias("i")).select("name", "version", "i.*")


# What resolvers report, by ecosystem, the code it stands for, and whether to try again.
# States of npm runs.
NPM_STATES = {"conflict": ("RESOLUTION_CONFLICT", False), "npm_error": ("DATA_SOURCE_UNAVAILABLE", True)}
# Codes that a go run's message may begin with.
GO_PREFIXES = {
    "INVALID_ARGUMENT": False, "VERSION_NOT_FOUND": False, "PACKAGE_NOT_FOUND": False, "DATA_SOURCE_UNAVAILABLE": True,
    "BACKEND_MISCONFIGURED": False, "UNSUPPORTED_REPLACE": False, "PROTOCOL_ERROR": False,
}
# Texts in messages, the first that is found.
MESSAGES = {
    "go": (
        ("module version not found", "VERSION_NOT_FOUND", False),
        *((t, "DATA_SOURCE_UNAVAILABLE", True) for t in (
            "proxy returned status", "proxy request failed", "postgres index query failed", "failed to read go proxy response",
            "context deadline exceeded", "i/o timeout", "connection refused", "no such host",
        )),
        *((t, "BACKEND_MISCONFIGURED", False) for t in ("go_index_dsn is required", "failed to initialize indexed metadata source")),
    ),
    "cargo": (
        ("no matching package named", "VERSION_NOT_FOUND", False),
        *((t, "DATA_SOURCE_UNAVAILABLE", True) for t in (
            "spurious network error", "failed to connect", "securetransport error", "unable to update registry", "failed to fetch",
            "updating crates.io index", "failed to fetch cargo crate metadata", "failed to fetch cargo dependency metadata", "crates.io api returned status",
        )),
    ),
}
# Any other message.
OTHERWISE = {"go": ("BACKEND_CRASHED", False), "cargo": ("BACKEND_CRASHED", True), "npm": ("INTERNAL_ERROR", False)}


def resolver_failures(rows: DataFrame) -> DataFrame:
    """rows (ecosystem, message, state, code, retryable, version): adds error_code and retry, by each ecosystem's own rule.

    npm goes by `state` (an empty result means the version, or without one the
    package, isn't there; no state at all breaks the protocol), go by the code that
    a message begins with, else its text, cargo by its text, pip by the code and
    the flag that it reports itself.
    """
    pair = lambda code, again: F.struct(F.lit(code).alias("code"), F.lit(again).alias("again"))
    text = F.lower(F.trim(F.coalesce("message", F.lit(""))))

    def by_text(ecosystem: str) -> Column:
        (first, *rest), other = MESSAGES[ecosystem], OTHERWISE[ecosystem]
        found = F.when(text.contains(first[0]), pair(*first[1:]))
        for t, code, again in rest:
            found = found.when(text.contains(t), pair(code, again))
        return found.otherwise(pair(*other))

    missing = F.when(F.coalesce("version", F.lit("")) != "", pair("VERSION_NOT_FOUND", False)).otherwise(pair("PACKAGE_NOT_FOUND", False))
    npm = F.when(F.col("state").isNull(), pair("PROTOCOL_ERROR", False)).when(F.col("state") == "empty", missing)
    for state, found in NPM_STATES.items():
        npm = npm.when(F.col("state") == state, pair(*found))
    head = F.trim(F.split(F.trim(F.coalesce("message", F.lit(""))), ":")[0])
    go = by_text("go")
    for code, again in GO_PREFIXES.items():
        go = F.when(head == code, pair(code, again)).otherwise(go)
    pip = F.struct(F.coalesce("code", F.lit("BACKEND_CRASHED")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("again"))
    found = F.when(F.col("ecosystem") == "npm", npm.otherwise(pair(*OTHERWISE["npm"]))).when(F.col("ecosystem") == "go", go).when(F.col("ecosystem") == "cargo", by_text("cargo")).otherwise(pip)
    return rows.withColumn("__found", found).withColumns({"error_code": F.col("__found.code"), "retry": F.col("__found.again")}).drop("__found")


def classify_failures(rows: DataFrame) -> DataFrame:
    """rows (kind, http_status, stage): adds retryable and error_code of failed fetches."""
    not_found = (F.col("kind") == "not-found") | F.coalesce(F.col("http_status") == 404, F.lit(False))
    by_kind = F.col("kind").isin("timeout", "url", "os") | ((F.col("kind") == "http") & ~F.col("http_status").isin(400, 401, 403, 404))
    code = F.when(not_found, "not_found").when(F.col("kind") == "http", F.concat(F.lit("http_"), F.col("http_status").cast("string"))).otherwise(F.concat_ws("_", "stage", "kind"))
    return rows.withColumns({"retryable": ~not_found & by_kind, "error_code": code})


def pick_artifact(files: DataFrame) -> DataFrame:
    """files (name, version, filename, digests map): the best wheel or source archive and its hash."""
    wheel = F.col("filename").endswith(".whl")
    python, platform = (F.regexp_extract("filename", r"-([^-]+)-([^-]+)-([^-]+)\.whl$", i) for i in (1, 3))
    sdist = F.col("filename").rlike(r"\.(tar\.gz|zip|tar\.bz2|tgz)$")
    here = (F.when(platform == "any", 0).when(platform.contains("linux"), 1).otherwise(2)) + F.when(python.rlike(r"(^|\.)(py3|cp3\d*)"), 0).otherwise(3)
    # wheels by fit, then source archives; sorted are the rank as a number and the one digest, not its map
    rank = F.when(wheel, here).when(F.col("filename").endswith(".tar.gz"), 10).when(sdist, 11)
    digest = F.coalesce(F.try_element_at("digests", F.lit("sha256")), F.try_element_at(F.map_values("digests"), F.lit(1)))
    rows = files.select("name", "version", "filename", rank.alias("rank"), digest.alias("hash")).filter("rank IS NOT NULL")
    first = Window.partitionBy("name", "version").orderBy("rank", "filename")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return rows.select("name", "version", "filename", F.when(wheel, "wheel").otherwise("sdist").alias("kind"), "hash")


def worklist_status(events: DataFrame, restart: bool = False) -> DataFrame:
    """events (version_id, status, pos): the latest status and whether it may be taken; a restart undoes processing."""
    last = events.groupBy("version_id").agg(F.max_by("status", "pos").alias("status"))
    if restart:
        last = last.withColumn("status", F.when(F.col("status") == "processing", "undone").otherwise(F.col("status")))
    return last.withColumn("selectable", F.col("status").isin("undone", "fail"))


def warm_outcomes(requests: DataFrame, landed: DataFrame, existing: DataFrame) -> DataFrame:
    """requests (coordinate, version), landed (coordinate, valid), existing (coordinate, valid): status, stage, warning of each."""
    rows = version_strategy(requests).join(landed.withColumnRenamed("valid", "landed"), "coordinate", "left").join(existing.withColumnRenamed("valid", "held"), "coordinate", "left")
    fixed = F.col("strategy") == "disabled"
    have = F.coalesce("held", F.lit(False))
    status = (
        F.when(~fixed, "partial").when(have, "skipped").when(F.col("landed").isNull() | ~F.col("landed"), "error").when(F.col("held").isNotNull(), "updated").otherwise("fetched")
    )
    stage = F.when(fixed & ~have & F.col("landed").isNull(), "fetch-pom").when(fixed & ~have & ~F.col("landed"), "validate-pom")
    warning = F.when(F.col("strategy") == "snapshot", "unsupported_snapshot").when(~fixed, F.concat(F.lit("metadata_only_"), F.col("strategy")))
    return rows.select(*requests.columns, status.alias("status"), stage.alias("stage"), warning.alias("warning"))


def index_outcomes(requests: DataFrame, index: DataFrame, landed: DataFrame, completed: DataFrame | None = None, fail_fast: bool = False, dry_run: bool = False) -> DataFrame:
    """requests (name, pos), index (name), landed (name, stage or null for good), in request order: status, stage and whether it is written."""
    rows = requests.join(index.select("name").distinct().withColumn("have", F.lit(True)), "name", "left").join(landed.withColumn("came", F.lit(True)), "name", "left")
    done = completed.select("name").distinct().withColumn("done", F.lit(True)) if completed is not None else None
    rows = rows.join(done, "name", "left") if done is not None else rows.withColumn("done", F.lit(None).cast("boolean"))
    status = F.when(F.col("done") | F.col("have"), "skipped").when(F.col("came") & F.col("stage").isNull(), "stored").otherwise("error")
    step = F.when(F.col("done"), "resume-skip").when(F.col("have"), "skip-existing").when(F.col("came").isNull(), "acquire").otherwise(F.coalesce("stage", F.lit("load")))
    out = rows.select(*requests.columns, status.alias("status"), step.alias("stage"))
    written = (F.col("status") == "stored") & F.lit(not dry_run)
    if fail_fast:
        failed = out.agg(F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False)).alias("failed"))
        out = out.crossJoin(F.broadcast(failed))  # one row
        written = written & ~F.col("failed")
    return out.withColumn("written", written).drop("failed").orderBy("pos")
