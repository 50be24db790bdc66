"""Node and edge tables, aggregates over graphs and runs, and documents made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import before_part, in_order


def node_table(nodes: DataFrame, ecosystem: str) -> DataFrame:
    """nodes (root, name, version, depth): id, scope and attributes as JSON."""
    ident = F.concat(F.lit(f"{ecosystem}:"), F.col("name").cast("string"), F.lit("@"), F.coalesce(F.col("version").cast("string"), F.lit("")))
    rest = [c for c in nodes.columns if c not in ("root", "name", "version", "depth")]
    attributes = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return nodes.select("root", ident.alias("id"), "name", "version", F.when(F.col("depth") == 0, "root").otherwise("runtime").alias("scope"), attributes.alias("attributes"))


def edge_table(edges: DataFrame, depths: DataFrame, *ecosystems: str) -> DataFrame:
    """edges (root, src, dst, constraint, and parent_depth where it is known), depths (root, node, depth): distinct edges with direct or transitive; `e` tells the ecosystem where there are several.

    cargo: direct if the parent is the root; pip: if the child's least depth is 1;
    npm and maven: if the edge's depth in the tree, one below its parent, is 1. A
    root's direct dependencies go to its edges as a list, so that edges are shuffled
    once, by root, whatever is grouped by it afterwards.
    """
    rows = edges.filter("src <> dst")
    if "parent_depth" not in edges.columns:
        rows = rows.join(depths.select("root", F.col("node").alias("src"), F.col("depth").alias("parent_depth")), ["root", "src"], "left")
    if "pip" in ecosystems:
        first = depths.filter("depth = 1").groupBy("root").agg(F.collect_list("node").alias("first"))
        rows = rows.join(first, "root", "left").withColumn("first", F.coalesce(F.array_contains("first", F.col("dst")), F.lit(False)))
    rows = rows.distinct()
    of = {"cargo": F.col("src") == F.col("root"), "pip": F.col("first") if "pip" in ecosystems else None}
    relation = lambda e: F.when(of.get(e, F.col("parent_depth") == 0), "direct").otherwise("transitive")
    rows = rows.withColumn("__e", F.explode(F.array(*(F.struct(F.lit(e).alias("e"), relation(e).alias("relation")) for e in ecosystems))))
    out = rows.select("root", "src", "dst", "constraint", "__e.relation", (F.col("parent_depth") + 1).alias("depth"), "__e.e")
    return out if len(ecosystems) > 1 else out.drop("e")


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root, document: one JSON text for each root, lists sorted by their parts."""
    n = nodes.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("id", "scope"))).alias("nodes"))
    e = edges.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "relation"))).alias("edges"))
    none = F.array().cast("array<struct<src: bigint, dst: bigint, relation: string>>")
    rows = n.join(e, "root", "left")
    return rows.select("root", F.to_json(F.struct("root", "nodes", F.coalesce("edges", none).alias("edges"))).alias("document"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("root").agg(F.count_distinct("id").alias("node_count"), F.count("*").alias("entry_count"))
    e = edges.groupBy("root").agg(F.count("*").alias("edge_count"), F.count_if(F.col("relation") == "direct").alias("direct_dependency_count"))
    return n.join(e, "root", "left").na.fill(0, ["edge_count", "direct_dependency_count"])


def dependency_totals(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: roots counted and their dependencies, but for failed roots and each root's own edge."""
    good = edges.join(failed.select("root"), "root", "left_anti").groupBy("root").agg((F.count("*") - 1).alias("n"))
    return good.agg(F.count("*").alias("versions"), F.coalesce(F.sum("n"), F.lit(0)).alias("dependencies"))


def status_counts(items: DataFrame, by: list[str] | None = None, statuses: tuple[str, ...] = ("ok", "partial", "error")) -> DataFrame:
    group = items.groupBy(*by) if by else items.groupBy()
    return group.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count("*").alias("total"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


#: Which statuses count as work done, by policy.
RUN_DONE = {"build": ("stored", "skipped"), "sync": ("stored", "skipped", "deleted"), "pip": ("ok", "partial", "resume-skip"), "index": ("indexed", "skipped")}


def run_status(items: DataFrame, policy: str, by: list[str]) -> DataFrame:
    """ok without errors; with errors partial if something was done (maven: if not all are errors), else error."""
    errors, total = F.count_if(F.col("status") == "error"), F.count("*")
    done = (errors < total) if policy == "maven" else F.count_if(F.col("status").isin(*RUN_DONE[policy])) > 0
    return items.groupBy(*by).agg(F.when(errors == 0, "ok").when(done, "partial").otherwise("error").alias("run_status"), errors.alias("errors"), total.alias("total"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (id, extras, scope): extras united, the root's scope wins."""
    extras = F.array_sort(F.array_distinct(F.flatten(F.collect_list("extras"))))
    return nodes.groupBy("id").agg(extras.alias("extras"), F.when(F.bool_or(F.col("scope") == "root"), "root").otherwise("runtime").alias("scope"))


def install_paths(rows: DataFrame) -> DataFrame:
    """rows (root, path, version), '.' for the root: name, version and sorted distinct paths."""
    name = F.when(F.col("path") == ".", "").otherwise(F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1))
    return rows.groupBy("root", name.alias("name"), "version").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def yanked_rollup(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.bool_and(F.coalesce("yanked", F.lit(False))).alias("yanked"))


FOLLOW = ("processed", "advanced", "idle", "transient", "fetched", "updated", "skipped", "deleted")


def follow_totals(batches: DataFrame, by: str, pos: str = "batch_id") -> DataFrame:
    """Running totals over a log of sync batches: within ranges of it, and the sums of the ranges before."""
    columns = [c for c in FOLLOW if c in batches.columns]
    parts = in_order(batches.select(by, pos, *columns), by, pos)
    sofar = Window.partitionBy(by, "part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = before_part(parts, by, **{f"__{c}": F.sum(c) for c in columns})
    rows = parts.select(by, "part", pos, *(F.sum(c).over(sofar).alias(c) for c in columns)).join(before, [by, "part"])
    return rows.select(by, pos, *((F.col(c) + F.col(f"__{c}")).alias(c) for c in columns))


def run_report(items: DataFrame, policy: str, by: list[str]) -> DataFrame:
    """Each item with its run's status and counts."""
    return items.join(run_status(items, policy, by), by)

