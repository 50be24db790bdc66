"""Ordering, deduplication, sets and snapshot tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import opened, written


def dedupe(rows: DataFrame, keys: list[str], keep: str = "first", pos: str = "pos") -> DataFrame:
    """One row for each key: 'first', 'first-position-last-value' or 'last' (value in its last position)."""
    values = [c for c in rows.columns if c not in (*keys, pos)]
    value = F.struct(*values) if values else F.struct(F.lit(1))
    pick = F.min_by(value, F.col(pos)) if keep == "first" else F.max_by(value, F.col(pos))
    at = F.max(pos) if keep == "last" else F.min(pos)
    out = rows.groupBy(*keys).agg(at.alias(pos), pick.alias("__v"))
    return out.select(*keys, pos, *(F.col(f"__v.{c}") for c in values))


def latest_state(state: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    return dedupe(state, [key], "last", pos)


def top_versions(rows: DataFrame, n: int, by: Column, name: str = "name") -> DataFrame:
    order = Window.partitionBy(name).orderBy(by.desc())
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)


def order_nodes(nodes: DataFrame, ecosystem: str, key: Column) -> DataFrame:
    """Adds the position in the root's list: pip by depth, name, version; go the root, then path and version; others by id."""
    by = {"pip": ["depth", "name", key], "go": [F.col("depth") > 0, "name", key]}.get(ecosystem, ["name", key])
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("root").orderBy(*by)).cast("bigint"))


def per_text(rows: DataFrame, column: str, **values: Column) -> DataFrame:
    """Rows with values of a text column, computed once for each distinct text; rows are written, as they are read twice."""
    rows = written(rows, "rows")
    texts = written(rows.select(column).distinct(), "texts")
    found = written(texts.select(F.col(column).alias("__text"), *(v.alias(k) for k, v in values.items())), "text-values")
    return rows.join(found, F.col(column).eqNullSafe(F.col("__text"))).drop("__text")


def claim_batch(status: DataFrame, n: int, states: tuple[str, ...] = ("undone",), offset: int = 0) -> DataFrame:
    """The n lowest ids in one of the states, after `offset` others."""
    return status.filter(F.col("status").isin(*states)).orderBy("version_id").offset(offset).limit(n)


def claims(status: DataFrame, n: int, states: tuple[str, ...] = ("undone",)) -> DataFrame:
    """Every claimable id with the number of its batch: batches of n ids each, in order, the last with what is left.

    Ids are ranked in ranges, each after the ids of the ranges before it. `batch`
    k is what `claim_batch` gives at offset k n.
    """
    ready = status.filter(F.col("status").isin(*states)).withColumn("__all", F.lit(0))
    parts = in_order(ready, "__all", "version_id")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("version_id")) - 1
    rows = parts.withColumn("__rank", rank).join(before_part(parts, "__all", __before=F.count("*")), ["__all", "part"])
    batch = F.floor((F.col("__rank") + F.col("__before")) / n)
    return rows.withColumn("batch", batch.cast("bigint")).drop("__all", "part", "__rank", "__before")


def union_items(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upsert_snapshot(target: DataFrame, updates: DataFrame, keys: list[str], now: str) -> DataFrame:
    """The next snapshot: updates win, created_at stays, updated_at becomes `now` (text of a timestamp)."""
    values = [c for c in target.columns if c not in (*keys, "created_at", "updated_at")]
    u = updates.select(*keys, F.struct(*values).alias("u"))
    t = target.select(*keys, F.struct(*values).alias("t"), "created_at", "updated_at")
    rows = t.join(u, keys, "full_outer")
    stamp = F.lit(now).cast(target.schema["updated_at"].dataType)
    fresh = F.col("u").isNotNull()
    return rows.select(
        *keys, *(F.when(fresh, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in values),
        F.coalesce("created_at", stamp).alias("created_at"), F.when(fresh, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def replace_by_key(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def insert_if_absent(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(updates.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def apply_sync_batch(packages: DataFrame, tombstones: DataFrame, records: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next packages (name, rev) and tombstones (name, rev, deleted_seq): records clear tombstones, deletes remove packages."""
    kept = packages.join(deletes.select("name"), "name", "left_anti")
    upserted = replace_by_key(kept, records.select(*packages.columns), ["name"])
    marks = tombstones.join(records.select("name"), "name", "left_anti")
    return upserted, replace_by_key(marks, deletes.select(*tombstones.columns), ["name"])


def crate_path(name: Column) -> Column:
    """Where a crate's index file is: by the length of its name."""
    low = F.lower(name)
    return (
        F.when(F.length(low) == 1, F.concat(F.lit("1/"), low)).when(F.length(low) == 2, F.concat(F.lit("2/"), low))
        .when(F.length(low) == 3, F.concat(F.lit("3/"), F.left(low, F.lit(1)), F.lit("/"), low))
        .otherwise(F.concat_ws("/", F.left(low, F.lit(2)), F.substring(low, 3, 2), low))
    )


def repository_layout(rows: DataFrame) -> DataFrame:
    """rows (group_id, artifact_id, version): adds directory, pom_path and metadata_path."""
    base = F.concat_ws("/", F.replace("group_id", F.lit("."), F.lit("/")), "artifact_id")
    directory = F.concat_ws("/", base, "version")
    pom = F.concat(directory, F.lit("/"), F.col("artifact_id"), F.lit("-"), F.col("version"), F.lit(".pom"))
    return rows.withColumns({"directory": directory, "pom_path": pom, "metadata_path": F.concat(base, F.lit("/maven-metadata.xml"))})


def repository_metadata(rows: DataFrame) -> DataFrame:
    """path and text of the version list of each artifact of rows (group_id, artifact_id, version)."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    each = rows.groupBy("group_id", "artifact_id").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    listed = F.array_join(F.transform("versions", lambda v: tag("version", escaped(v))), "")
    text = tag("metadata", F.concat(tag("groupId", escaped(F.col("group_id"))), tag("artifactId", escaped(F.col("artifact_id"))), tag("versioning", tag("versions", listed))))
    return repository_layout(each.withColumn("version", F.lit(""))).select(F.col("metadata_path").alias("path"), text.alias("text"))


def write_repository(rows: DataFrame, base: str) -> DataFrame:
    """Writes documents (group_id, artifact_id, version, text) as group/artifact/version/artifact-version.pom below a base, and each artifact's version list beside its versions; path and bytes of what was written.

    A file is written under another name and then renamed, so that it is whole or not
    there, and a task that runs again puts the same in its place. Repeated coordinates
    are written once, with the least text. base: a path, or a URI that pyarrow's file
    systems know, that all executors see.
    """
    once = rows.groupBy("group_id", "artifact_id", "version").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    files = repository_layout(once).select(F.col("pom_path").alias("path"), "text").union(repository_metadata(once))

    def write(batches):
        from pyarrow import record_batch

        system, root = opened(base)
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                data, place = text.encode(), f"{root}/{path}"
                folder, _, name = place.rpartition("/")
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(own := f"{folder}/.{name}-{uuid4().hex}") as out:
                    out.write(data)
                system.move(own, place)
                sizes.append(len(data))
            yield record_batch({"path": batch.column("path"), "bytes": sizes})

    return written(files.repartition("path").mapInArrow(write, "path string, bytes bigint"), "repository-files")


def repository_files(paths: DataFrame, base: str) -> DataFrame:
    """path and bytes of those of paths (path) that are files below a base. Tasks look them up: a listing of all would be the driver's."""

    def look(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])
        system, root = opened(base)
        for batch in batches:
            names = batch.column("path").to_pylist()
            found = [(p, i.size) for p, i in zip(names, system.get_file_info([f"{root}/{p}" for p in names])) if i.is_file]
            yield pa.record_batch({"path": [p for p, _ in found], "bytes": [n for _, n in found]}, schema=schema)

    return paths.select("path").mapInArrow(look, "path string, bytes bigint")


def in_order(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df with `part`: ranges of (by, order), so that rows of a later part come after those of an earlier one.

    A group of any size is cut, where a window over it would be one task; the
    ranges are written, since a second look could cut them otherwise.
    """
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, by, *order)
    return written(ranged.withColumn("part", F.spark_partition_id()), "ordered-parts")


def before_part(parts: DataFrame, by: str, **sums: Column) -> DataFrame:
    """(by, part) with each sum over all earlier parts of the group: as many rows as parts and groups."""
    each = parts.groupBy(by, "part").agg(*(v.alias(k) for k, v in sums.items()))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(by, "part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Writes a snapshot folder, and last of all the pointer to it."""
    path = f"{base}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.range(1).select(F.lit(version).alias("version"), F.lit(path).alias("path")).coalesce(1).write.mode("append").json(f"{base}/pointer")
    return path


def read_snapshot(spark, base: str) -> DataFrame:
    """The snapshot with the highest version in the pointer."""
    (row,) = spark.read.schema("version bigint, path string").json(f"{base}/pointer").orderBy(F.desc("version")).limit(1).collect()
    return spark.read.parquet(row["path"])
