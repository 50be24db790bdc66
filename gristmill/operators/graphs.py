"""Graphs of many roots at once: frontiers, closures and fixpoints as joins.

Each step of a loop is one job that writes its new rows once, as a part of a
growing table, with their number counted on the way; the rows so far are the
parts together. That cuts the plan and lets a lost executor's part be read again.
Edges are matched by equi joins alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from ..functions.ranges import nested_ranges, range_bounds, range_test
from ..storage import BROADCAST_ROWS, Dealt, Parts, written
from . import matching as M
from .resolution import candidates, resolve

#: Levels after which a closure looks whether it runs in a circle.
LOOK_FOR_CYCLES = 48


#: Levels that one job of a walk goes. What is known already is looked up once a job, and so only every so many levels.
HOPS = 3


#: Steps that a job of `min_depth` goes where most nodes are roots.
NEAR = 4


#: Edges from which on all nodes of a graph go by height, the most heights, and nodes for each bucket of what they reach.
MANY_EDGES, MOST_HEIGHTS, NODES_A_BUCKET = 100_000, 64, 1 << 13


def _hops(level: DataFrame, follow, depth: int, hops: int = HOPS) -> DataFrame:
    """The rows that `follow` reaches from a level's rows in 1, 2, ... `hops` steps, each with the least depth at which it does."""
    found = []
    for i in range(1, hops + 1):
        level = follow(level).distinct()
        found.append(level.withColumn("depth", F.lit(depth + i).cast("bigint")))
    keys = level.columns
    return reduce(DataFrame.union, found).groupBy(*keys).agg(F.min("depth").alias("depth"))


def min_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (src, dst), roots (root): root, node, depth by shortest path; what isn't reached has no row.

    Where half of the nodes or more are roots, what lies within `NEAR` steps of each
    node is found once, before the walk: of a root that is part of its result. Where
    there are `MANY_EDGES` too, nodes go by height instead, see `_depths_by_height`.
    """
    spark = edges.sparkSession
    start, n = Parts(spark, "roots").add(roots.select("root").distinct())
    edges, n_edges = Parts(spark, "edges").add(edges.select("src", "dst").distinct())
    most = 2 * n >= edges.select("src").distinct().count()
    return _depths_by_height(edges, start) if most and n_edges >= MANY_EDGES else _walk(edges, start, most)


def _walk(edges: DataFrame, roots: DataFrame, near: bool) -> DataFrame:
    """See `min_depth`: level by level, over what lies near each node if asked."""
    seen = Parts(edges.sparkSession, "depths")
    frontier, n = seen.add(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("depth")))
    follow = lambda level: level.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"))
    hops = HOPS
    step = lambda level, depth: _hops(level, follow, depth)
    if near:
        nodes, hops = edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), NEAR
        found = written(_hops(nodes, follow, 0, NEAR).select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("steps")), "near")
        step = lambda level, depth: level.join(found, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg((F.min("steps") + depth).alias("depth"))
    for depth in count(0, hops):
        if not n:
            return seen.rows()
        new = step(frontier.select("root", "node"), depth).join(seen.rows().select("root", "node"), ["root", "node"], "left_anti")
        last = F.col("depth") == depth + hops
        part, n = seen.add(new, last)
        frontier = part.filter(last)


def _heights(edges: DataFrame) -> tuple[DataFrame, list[int]]:
    """node, height, and the number of nodes of each height: 0 where no edge (src, dst) leads on, else one more than the highest that one leads to.

    What leads to a cycle has none, nor has what is higher than `MOST_HEIGHTS`. A
    round only looks at nodes that lead to one of the round before.
    """
    spark, counts = edges.sparkSession, []
    found = Parts(spark, "heights")
    low, n = found.add(edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("height", F.lit(0)))
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    while n and len(counts) < MOST_HEIGHTS:
        counts.append(n)
        above, k = (touched := Parts(spark, "above")).add(edges.join(few(low.select(F.col("node").alias("dst")), n), "dst").select("src").distinct())
        done = found.rows().select(F.col("node").alias("dst"), F.lit(True).alias("done"))
        ready = edges.join(few(above, k), "src").join(done, "dst", "left").groupBy("src").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("ready")).filter("ready")
        low, n = found.add(ready.select(F.col("src").alias("node"), F.lit(len(counts)).alias("height")))
        touched.drop()
    return found.rows().filter(F.col("height") < len(counts)), counts


def _low(counts: list[int]) -> int:
    """The height up to which nodes are walked from together, as they are few: a job for each of their heights would take longer."""
    return max(h for h in range(len(counts)) if h == 0 or sum(counts[: h + 1]) * 16 <= sum(counts))


def _depths_by_height(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """See `min_depth`: what a node reaches is itself, and what the nodes reach that it leads to.

    Nodes of a height need those below alone, and are one job: it reads what these
    reach where it lies, dealt by root, and shuffles that once. What leads to a
    cycle, or is too high, is walked.
    """
    spark = edges.sparkSession
    heights, counts = _heights(edges)
    if not counts:
        return _walk(edges, roots, True)
    low, zero = _low(counts), F.lit(0).cast("bigint")
    buckets = max(spark.sparkContext.defaultParallelism, sum(counts) // NODES_A_BUCKET)
    reach = Dealt(spark, "depths_by_root", ("root",), buckets)
    placed, edged = heights.select(F.col("node").alias("root")), edges.select(F.col("src").alias("root")).distinct()
    others = written(roots.join(placed, "root", "left_anti").join(edged.withColumn("edged", F.lit(True)), "root", "left"), "other-roots")
    # what no edge leads on from, or to, is by itself
    first = heights.filter(F.col("height") <= low).select(F.col("node").alias("root")).union(others.filter("edged IS NULL").select("root"))
    below = written(heights.filter(F.col("height") <= low).select(F.col("node").alias("src")).join(edges, "src"), "low-edges")
    reach.add(_walk(below, first, True).repartition(buckets, "root").withColumn("height", F.lit(low)), ("height",))
    for h in range(low + 1, len(counts)):
        level = heights.filter(F.col("height") == h).select(F.col("node").alias("src"))
        steps = level.join(edges, "src").hint("shuffle_hash")
        known = reach.rows().filter(F.col("height") < h).withColumnRenamed("root", "dst")
        rows = known.join(steps, "dst").select(F.col("src").alias("root"), "node", (F.col("depth") + 1).alias("depth"))
        rows = rows.union(level.select("src", "src", zero)).repartition(buckets, "root").groupBy("root", "node").agg(F.min("depth").alias("depth"))
        reach.add(rows.withColumn("height", F.lit(h)), ("height",))
    found = reach.rows().select("root", "node", "depth")
    if not heights.join(roots, F.col("node") == F.col("root"), "left_anti").isEmpty():
        found = found.join(roots.hint("shuffle_hash"), "root", "left_semi")
    rest = others.filter("edged").select("root")
    return found if rest.isEmpty() else found.union(_walk(edges, rest, False))


def closure(edges: DataFrame, roots: DataFrame, parents: bool = False, max_level: int | None = None) -> DataFrame:
    """version_from, version_to, dep_level: every level at which a dependency occurs; with the parent if asked.

    What a root reaches through a cycle occurs at levels without end: of it there is
    the least level alone (with `max_level`, all up to that). What it reaches on ways
    without cycles has all its levels, also in a graph that has cycles elsewhere.
    """
    steps, knots = edges.select("src", "dst").distinct(), []

    def circles() -> bool:
        knots.append(strong_components(steps).select("node"))
        return not knots[0].isEmpty()

    out = _levels(steps, roots, parents, max_level, circles if max_level is None else None)
    return out if out is not None else _levels_with_cycles(written(steps, "steps"), roots, knots[0], parents)


def _levels(steps: DataFrame, roots: DataFrame, parents: bool, last: int | None = None, circles=None) -> DataFrame | None:
    """Levels up to `last`, or to the end; None if, after `LOOK_FOR_CYCLES` of them, circles() holds."""
    keep = ["version_from", "version_to", *(["version_parent"] if parents else [])]
    out = Parts(steps.sparkSession, "levels")
    level = written(roots.select(F.col("root").alias("version_from"), F.col("root").alias("version_to")), "roots")
    steps = steps.select(F.col("src").alias("version_parent"), F.col("dst").alias("version_to"))
    for depth in count(1):
        if last is not None and depth > last:
            return out.rows()
        nodes = level.select("version_from", F.col("version_to").alias("version_parent")).distinct()
        found = nodes.join(steps, "version_parent").select(*keep).distinct()
        level, n = out.add(found.withColumn("dep_level", F.lit(depth).cast("bigint")))
        if not n:
            return out.rows()
        if circles is not None and depth == LOOK_FOR_CYCLES and circles():
            out.drop()
            return None


def _levels_with_cycles(steps: DataFrame, roots: DataFrame, knots: DataFrame, parents: bool) -> DataFrame:
    """See `closure`. knots (node): those on cycles. Each node is taken twice: as reached without a knot before it or at it, and with one."""
    keep = ["version_from", "version_to", *(["version_parent"] if parents else []), "dep_level"]
    marked = written(steps.join(knots.select(F.col("node").alias("dst"), F.lit(True).alias("knot")), "dst", "left").select("src", "dst", F.coalesce("knot", F.lit(False)).alias("knot")), "marked-steps")
    twice = lambda node, via: F.struct(node.alias("node"), via.alias("via"))
    both = marked.select(F.col("src"), F.col("dst"), "knot", F.explode(F.array(F.lit(False), F.lit(True))).alias("was"))
    both = written(both.select(twice(F.col("src"), F.col("was")).alias("src"), twice(F.col("dst"), F.col("was") | F.col("knot")).alias("dst")), "steps-twice")
    starts = roots.select("root").distinct().join(knots.select(F.col("node").alias("root"), F.lit(True).alias("knot")), "root", "left")
    reach = min_depth(both, starts.select(twice(F.col("root"), F.coalesce("knot", F.lit(False))).alias("root")))
    reach = reach.select(F.col("root.node").alias("version_from"), F.col("node.node").alias("node"), F.col("node.via").alias("via"), "depth")
    reach = written(reach.groupBy("version_from", "node").agg(F.min("depth").alias("depth"), F.max("via").alias("via")), "reached")
    # over a last step from what is reached: the least level, also of a root that is come back to
    over = reach.select("version_from", F.col("node").alias("src"), "depth").join(steps, "src")
    over = over.select("version_from", F.col("dst").alias("version_to"), F.col("src").alias("version_parent"), (F.col("depth") + 1).alias("dep_level"))
    through = reach.filter("via").select("version_from", F.col("node").alias("version_to"))
    over = over.join(through, ["version_from", "version_to"], "left_semi")
    if parents:
        least = over.groupBy("version_from", "version_to").agg(F.min("dep_level").alias("dep_level"))
        over = over.join(least, ["version_from", "version_to", "dep_level"], "left_semi")
    else:
        over = over.groupBy("version_from", "version_to").agg(F.min("dep_level").alias("dep_level"))
    plain = marked.filter("NOT knot").join(knots.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst")
    free = _levels(written(plain, "plain-steps"), starts.filter("knot IS NULL").select("root"), parents)
    return free.join(through, ["version_from", "version_to"], "left_anti").select(*keep).union(over.select(*keep).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes on cycles, by colours.

    What can't be on a cycle is taken away first. Then each node takes the smallest
    node that leads to it as its colour, and what leads back to that node without
    leaving the colour is its component. Components go, and it begins again with
    what is left. All steps are joins and minima.
    """
    spark = edges.sparkSession
    found = Parts(spark, "strong-components")
    left = cyclic_core(edges)
    found.add(left.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component")))
    while not left.isEmpty():
        # colours: only what changed is handed on
        nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        colours, _ = (state := Parts(spark, "colours")).add(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        n = 1
        while n:
            given = colours.filter("moved").join(left, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            next_ = colours.drop("moved").join(given, "node", "left").withColumn("moved", F.coalesce(F.col("new") < F.col("colour"), F.lit(False)))
            colours, _ = state.replace(next_.select("node", F.least("colour", "new").alias("colour"), "moved"))
            n = colours.filter("moved").count()
        own = colours.select("node", "colour")
        inside = left.join(own.withColumnsRenamed({"node": "src", "colour": "c1"}), "src").join(own.withColumnsRenamed({"node": "dst", "colour": "c2"}), "dst").filter("c1 = c2")
        inside = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "reversed-edges")
        back = min_depth(inside, own.filter("node = colour").select(F.col("node").alias("root")))
        # a node alone is on a cycle only if an edge leads from it to itself
        sizes = back.groupBy("root").agg(F.count("*").alias("n"))
        loops = left.filter("src = dst").select(F.col("src").alias("root"), F.lit(True).alias("loop"))
        real = sizes.join(loops, "root", "left").filter("n > 1 OR loop").select("root")
        back = written(back.select("root", "node"), "component")
        found.add(back.join(real, "root", "left_semi").select("node", F.col("root").alias("component")))
        rest = left.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = cyclic_core(written(rest, "edges-left"))
        state.drop()
    return found.rows()


def requirement_graph_go(requires: DataFrame, go_versions: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requires (path, version, dep, dep_version), go_versions (path, version, minor), roots (root path, version).

    Nodes are all reachable (path, version), edges the requirement lists of loaded
    modules; a root drops requirements on itself. A module of go 1.17 or later
    that a root of 1.17 or later requires directly is loaded but not expanded.
    Where half of the paths or more are roots, and there are `MANY_EDGES`, paths go
    by height, see `_modules_by_height`; other roots are walked from.
    """
    # both are joined in every round; counted, so that they are not broadcast where they are many
    spark = requires.sparkSession
    requires, n_requires = Parts(spark, "requires").add(requires.select("path", "version", "dep", "dep_version").distinct())
    roots, n_roots = Parts(spark, "roots").add(roots.select("root", "version").distinct())
    lazy = written(go_versions.select("path", "version", (F.col("minor") >= 17).alias("lazy")), "go-versions")
    own = lambda rows: rows.select("root", F.col("root").alias("path"), "version")

    def of(modules: DataFrame) -> DataFrame:
        # modules and requirements are distinct, and so are these
        return modules.join(requires, ["path", "version"]).filter(F.col("dep") != F.col("root")).select("root", "path", "version", "dep", "dep_version")

    if n_requires < MANY_EDGES or 2 * n_roots < requires.select("path").distinct().count():
        edges = written(of(_modules_by_walk(requires, lazy, roots)), "requirement-edges")
        return own(roots).union(edges.select("root", F.col("dep").alias("path"), F.col("dep_version").alias("version"))).distinct(), edges
    below, rest, buckets = _modules_by_height(requires, lazy, roots)
    others = not rest.isEmpty()
    good = roots.join(rest, ["root", "version"], "left_anti") if others else roots
    modules = below.filter("loaded").select("root", "path", "version").union(own(good))
    # dealt by root as what is below, so that what groups nodes by root goes on in place
    nodes = below.select("root", "path", "version").union(own(good).repartition(buckets, "root"))
    edges = of(modules)
    if others:
        more = written(of(_modules_by_walk(requires, lazy, rest)), "requirement-edges")
        nodes = nodes.union(own(rest).union(more.select("root", F.col("dep").alias("path"), F.col("dep_version").alias("version"))).distinct())
        edges = edges.union(more)
    return nodes, edges


def _modules_by_walk(requires: DataFrame, lazy: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, version of what each root loads, see `requirement_graph_go`."""
    key = ["root", "path", "version"]
    start = roots.select("root", F.col("root").alias("path"), "version").join(lazy, ["path", "version"], "left")
    loaded = Parts(requires.sparkSession, "loaded-modules")

    def follow(level: DataFrame) -> DataFrame:
        reached = level.join(requires, ["path", "version"]).filter(F.col("dep") != F.col("root"))
        return reached.select("root", F.col("dep").alias("path"), F.col("dep_version").alias("version"))

    zero = F.lit(0).cast("bigint")
    first, _ = loaded.add(start.select(*key, F.lit(True).alias("expand"), zero.alias("depth"), F.coalesce("lazy", F.lit(False)).alias("root_lazy")))
    direct = first.join(requires, ["path", "version"]).filter(F.col("dep") != F.col("root")).select("root", F.col("dep").alias("path"), F.col("dep_version").alias("version"), "root_lazy").distinct()
    direct = direct.join(lazy, ["path", "version"], "left").withColumn("expand", ~(F.coalesce("lazy", F.lit(False)) & F.col("root_lazy")))
    frontier, n = loaded.add(direct.select(*key, "expand", (zero + 1).alias("depth"), "root_lazy"))
    frontier = frontier.filter("expand")
    for depth in count(1, HOPS):
        if not n:
            break
        # deeper down everything is expanded, also what was only loaded before
        known = loaded.rows().filter("expand").select(*key)
        new = _hops(frontier.select(*key), follow, depth).join(known, key, "left_anti")
        last = F.col("depth") == depth + HOPS
        part, n = loaded.add(new.select(*key, F.lit(True).alias("expand"), "depth", F.lit(False).alias("root_lazy")), last)
        frontier = part.filter(last)
    return loaded.rows().select(*key).distinct()


def _modules_by_height(requires: DataFrame, lazy: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """root, path, version, loaded of what lies below each root; the roots (root, version) that lead to a cycle of paths, are too high, or have several versions; and in how many buckets the first is dealt by root.

    Versions of a path that require the same are one class, `nth`, and what is below
    a class is what it requires and what is below that. A lazy root has a class of
    its own, -nth: its lazy requirements have nothing below them (class 0), but what
    they require, which isn't loaded by it. Heights are those of paths, so that no
    root comes to its own path again.
    """
    spark = requires.sparkSession
    heights, counts = _heights(written(requires.select(F.col("path").alias("src"), F.col("dep").alias("dst")).distinct(), "paths"))
    named = requires.select(F.col("dep").alias("path"), F.col("dep_version").alias("version")).union(roots.select("root", "version")).distinct()
    lists = requires.join(named, ["path", "version"], "left_semi").groupBy("path", "version").agg(F.array_sort(F.collect_set(F.struct("dep", "dep_version"))).alias("needs"))
    nth = F.dense_rank().over(Window.partitionBy("path").orderBy("needs"))
    classes = written(lists.join(heights.select(F.col("node").alias("path"), "height"), "path").select("path", "version", "height", nth.alias("nth")).join(lazy, ["path", "version"], "left").withColumn("lazy", F.coalesce("lazy", F.lit(False))), "module-classes")
    rest = requires.select(F.col("path").alias("root")).distinct().join(heights.select(F.col("node").alias("root")), "root", "left_anti")
    # roots of several versions have one result, and are walked from too
    rest = rest.union(roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"))
    rest = written(roots.join(rest, "root", "left_semi"), "other-roots")
    found = roots.join(rest, ["root", "version"], "left_anti")
    asked = written(found.join(classes.withColumnRenamed("path", "root"), ["root", "version"]).select("root", "version", F.when(F.col("lazy"), -F.col("nth")).otherwise(F.col("nth")).alias("nth")), "root-classes")
    one = classes.groupBy("path", "nth", "height").agg(F.min("version").alias("version"))
    needs = one.join(requires, ["path", "version"]).drop("version").join(classes.select(F.col("path").alias("dep"), F.col("version").alias("dep_version"), F.col("nth").alias("of")), ["dep", "dep_version"], "left")
    lazies = lazy.filter("lazy").select(F.col("path").alias("dep"), F.col("version").alias("dep_version"), F.lit(True).alias("unexpanded"))
    needs = written(needs.na.fill(0, ["of"]).join(lazies.distinct(), ["dep", "dep_version"], "left").select("path", "nth", "height", "dep", "dep_version", "of", F.coalesce("unexpanded", F.lit(False)).alias("unexpanded")), "class-requirements")
    lazily = needs.join(asked.filter("nth < 0").select(F.col("root").alias("path"), (-F.col("nth")).alias("nth")).distinct(), ["path", "nth"])
    over = lazily.filter("unexpanded AND of > 0").select("path", "nth", "height", F.col("dep").alias("src"), F.col("of").alias("via"))
    over = over.join(needs.select(F.col("path").alias("src"), F.col("nth").alias("via"), "dep", "dep_version"), ["src", "via"])
    rows = needs.select("path", "nth", "height", "dep", "dep_version", "of", F.lit(True).alias("loaded"))
    rows = rows.union(lazily.select("path", -F.col("nth"), "height", "dep", "dep_version", F.when(F.col("unexpanded"), 0).otherwise(F.col("of")), F.lit(True)))
    rows = rows.union(over.select("path", -F.col("nth"), "height", "dep", "dep_version", F.lit(0), F.lit(False)))
    wanted = asked.select(F.col("root").alias("path"), "nth").union(needs.select("dep", "of")).distinct()
    steps = written(rows.join(wanted, ["path", "nth"], "left_semi"), "steps")
    low, key = _low(counts), ["root", "nth", "path", "version"]
    buckets = max(spark.sparkContext.defaultParallelism, sum(counts) // NODES_A_BUCKET)
    below = Dealt(spark, "modules_below", ("root",), buckets)

    def add(rows: DataFrame, h: int) -> None:
        below.add(rows.repartition(buckets, "root").groupBy(*key).agg(F.max("loaded").alias("loaded")).withColumn("height", F.lit(h)), ("height",))

    # classes of low paths are walked from together
    flat = written(steps.filter(F.col("height") <= low), "low-steps")
    ends = [F.struct(F.col(a).alias("path"), F.col(b).cast("int").alias("nth")).alias(c) for a, b, c in (("path", "nth", "src"), ("dep", "of", "dst"))]
    walked = _walk(written(flat.select(*ends).distinct(), "low-classes"), flat.select(ends[0].alias("root")).distinct(), True)
    walked = walked.select(F.col("root.path").alias("root"), F.col("root.nth").alias("nth"), F.col("node.path").alias("src"), F.col("node.nth").alias("via"))
    walked = walked.join(flat.select(F.col("path").alias("src"), F.col("nth").alias("via"), "dep", "dep_version", "loaded"), ["src", "via"])
    add(walked.select("root", "nth", F.col("dep").alias("path"), F.col("dep_version").alias("version"), "loaded"), low)
    # classes are compared as ranges, so that joins are by path alone, as the buckets are
    for h in range(low + 1, len(counts)):
        level = steps.filter(F.col("height") == h).select(F.col("path").alias("src"), F.col("nth").alias("own"), "dep", "dep_version", "of", "loaded")
        known = below.rows().filter(F.col("height") < h).select(F.col("root").alias("dep"), "nth", "path", "version")
        far = known.join(level.filter("of > 0").select("src", "own", "dep", "of").hint("shuffle_hash"), "dep").filter(F.col("nth").between(F.col("of"), F.col("of")))
        direct = level.select(F.col("src").alias("root"), F.col("own").alias("nth"), F.col("dep").alias("path"), F.col("dep_version").alias("version"), "loaded")
        add(far.select(F.col("src").alias("root"), F.col("own").alias("nth"), "path", "version", F.lit(True).alias("loaded")).union(direct), h)
    own = asked.select("root", F.col("nth").alias("own")).hint("shuffle_hash")
    out = below.rows().join(own, "root").filter(F.col("nth").between(F.col("own"), F.col("own"))).select("root", "path", "version", "loaded")
    return out, rest, buckets


def build_list_go(nodes: DataFrame, key) -> DataFrame:
    """nodes (root, path, version): the highest version of each path, the root first. `key` is that of a version, and made once for each."""
    texts, n = Parts(nodes.sparkSession, "version-texts").add(nodes.select("version").distinct())
    order = Window.partitionBy("root").orderBy(F.col("path") != F.col("root"), "path")
    if n > BROADCAST_ROWS:
        best = nodes.groupBy("root", "path").agg(F.max_by("version", key).alias("version"))
    else:
        # places of the few versions, which are numbers, and so compared without a sort
        ranks = F.broadcast(written(texts.withColumn("key", key).select("version", F.row_number().over(Window.orderBy("key", "version")).alias("rank")), "version-ranks"))
        best = nodes.join(ranks, "version", "left").groupBy("root", "path").agg(F.max("rank").alias("rank")).join(ranks, "rank", "left").select("root", "path", "version")
    return best.withColumn("position", F.row_number().over(order).cast("bigint"))


def prune_orphans(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges left when nodes that no edge points at, but for the roots, are dropped again and again."""
    left = Parts(edges.sparkSession, "edges-left")
    edges, n = left.add(edges.distinct())
    while True:
        alive = edges.select(F.col("dst").alias("src")).union(roots.select(F.col("root").alias("src"))).distinct()
        before = n
        edges, n = left.replace(edges.join(alive, "src", "left_semi"))
        if n == before:
            return edges


def drop_weak_feature_edges(edges: DataFrame, features: DataFrame, enabled: DataFrame) -> DataFrame:
    """edges (pkg, dep), features (pkg, feature, member), enabled (pkg, feature).

    An edge goes if its dependency is only named by weak 'dep?/feature' members,
    and is neither enabled as a feature nor named by 'dep:'.
    """
    members = features.select("pkg", "member")
    weak = members.select("pkg", F.regexp_extract("member", r"^([^?]+)\?/", 1).alias("dep")).filter("dep <> ''").distinct()
    strong = members.select("pkg", F.regexp_extract("member", r"^dep:(.+)$", 1).alias("dep")).filter("dep <> ''").union(enabled.select("pkg", F.col("feature").alias("dep"))).distinct()
    return edges.join(weak.join(strong, ["pkg", "dep"], "left_anti"), ["pkg", "dep"], "left_anti")


def root_features(features: DataFrame, deps: DataFrame) -> DataFrame:
    """features (pkg, feature, member), deps (pkg, dep, optional): pkg and its sorted feature names.

    Optional dependencies are features too, unless some member names them by 'dep:'.
    """
    explicit = features.select("pkg", F.regexp_extract("member", r"^dep:(.+)$", 1).alias("dep")).filter("dep <> ''").distinct()
    implied = deps.filter("optional").select("pkg", "dep").distinct().join(explicit, ["pkg", "dep"], "left_anti")
    rows = features.select("pkg", "feature").union(implied)
    return rows.groupBy("pkg").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def selected_versions(wanted: DataFrame, versions: DataFrame, tags: DataFrame | None = None, ecosystem: str = "npm", compatible: Column | None = None) -> DataFrame:
    """pkg, spec, target (the package meant), version for each distinct (pkg, spec), by the ecosystem's rule.

    npm: see `best_match_npm`. cargo: the highest version in the range that isn't
    yanked. pip: the first of `candidates_pip`. go: the version required, where it
    exists. versions: pkg, version, and deprecated (npm) or yanked (pip, cargo).
    """
    wanted = wanted.select("pkg", "spec").distinct()
    if ecosystem == "npm":
        return M.best_match_npm(wanted, versions, tags, compatible).select("pkg", "spec", "target", "version")
    if ecosystem == "go":
        found = versions.select("pkg", F.col("version").alias("spec"), "version").distinct()
    else:
        found = candidates(wanted.select("pkg", F.array("spec").alias("specs")), versions, ecosystem)
        found = found.select("pkg", F.col("specs")[0].alias("spec"), F.col("candidates")[0].alias("version"))
    return wanted.withColumn("target", F.col("pkg")).join(found, ["pkg", "spec"], "left")


def highest_match_closure(
    roots: DataFrame, deps: DataFrame, versions: DataFrame, tags: DataFrame | None = None, ecosystem: str = "npm", compatible: Column | None = None, max_level: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (root, pkg, pkg_version, dep, spec, version, level), conflicts (root, pkg, versions), states (root, state).

    roots (root, version), deps (pkg, version, dep, spec): what a version depends
    on is its own. Edges that nothing fits stay, with a null version, and aren't
    followed. npm and go: every distinct (dep, spec) is resolved once, each frontier
    follows the versions chosen, and a package may have several in one root (for go
    the highest of them wins). pip and cargo: what a root requires of a package is
    met together, see `resolve`; where that can't be, the root's state is conflict.
    Conflicts are those, and packages with several versions side by side.
    States: empty (the root's version isn't known), limit (`max_level` cut it
    off), conflict, else ok.
    """
    spark = deps.sparkSession
    if ecosystem in ("pip", "cargo"):
        selected, edges, clash = resolve(roots, deps, versions, ecosystem)
        cut = None if max_level is None else selected.filter(F.col("level") > max_level).select("root").distinct()
        if max_level is not None:
            selected, edges = (x.filter(F.col("level") <= max_level) for x in (selected, edges))
        several = selected.groupBy("root", "pkg").agg(F.array_sort(F.collect_set("version")).alias("versions")).filter(F.size("versions") > 1)
        several = several.join(clash, ["root", "pkg"], "left_anti")
        known = selected.filter("level = 1").select("root", "version")
        return edges, clash.unionByName(several), _states(roots, known, clash.select("root").distinct(), cut)
    chosen = selected_versions(deps.select(F.col("dep").alias("pkg"), "spec"), versions, tags, ecosystem, compatible)
    chosen = written(chosen.withColumnsRenamed({"pkg": "dep", "version": "picked"}), "chosen-versions")
    known = written(roots.join(versions.select(F.col("pkg").alias("root"), "version").distinct(), ["root", "version"], "left_semi"), "known-roots")
    # only versions that are a root's, or chosen for some spec, are ever come to: the others' dependencies are left out of all steps
    come_to = known.select(F.col("root").alias("pkg"), F.col("version").alias("pkg_version")).union(chosen.filter("picked IS NOT NULL").select("target", "picked")).distinct()
    asked = deps.select("pkg", F.col("version").alias("pkg_version"), "dep", "spec").join(come_to, ["pkg", "pkg_version"], "left_semi").distinct()
    resolved = written(asked.join(chosen, ["dep", "spec"], "left"), "resolved-dependencies")
    seen = Parts(spark, "selected")
    frontier, n = seen.add(known.select("root", F.col("root").alias("pkg"), F.col("version").alias("pkg_version"), F.lit(1).cast("bigint").alias("level")))
    steps = written(resolved.filter("picked IS NOT NULL").select("pkg", "pkg_version", "target", "picked").distinct(), "steps")
    key = ["root", "pkg", "pkg_version"]
    cut = None

    def follow(level: DataFrame) -> DataFrame:
        return level.join(steps, ["pkg", "pkg_version"]).select("root", F.col("target").alias("pkg"), F.col("picked").alias("pkg_version"))

    for depth in count(1, HOPS):
        if not n:
            break
        if max_level is not None and depth > max_level:
            cut = seen.rows().filter(F.col("level") > max_level).select("root").distinct()
            break
        new = _hops(frontier.select(*key), follow, depth).join(seen.rows().select(*key), key, "left_anti").withColumnRenamed("depth", "level")
        last = F.col("level") == depth + HOPS
        part, n = seen.add(new.select(*key, "level"), last)
        frontier = part.filter(last)
    if cut is None and max_level is not None:
        cut = seen.rows().filter(F.col("level") > max_level).select("root").distinct()
    walked = seen.rows() if max_level is None else seen.rows().filter(F.col("level") <= max_level)
    edges = walked.join(resolved, ["pkg", "pkg_version"]).select("root", "pkg", "pkg_version", "dep", "spec", F.col("picked").alias("version"), "level")
    picked = walked.select(*key).groupBy("root", "pkg").agg(F.array_sort(F.collect_set("pkg_version")).alias("versions"))
    conflicts = picked.filter(F.size("versions") > 1)
    return edges, conflicts, _states(roots, known, conflicts.select("root").limit(0), cut)


def _states(roots: DataFrame, known: DataFrame, clashing: DataFrame, cut: DataFrame | None) -> DataFrame:
    """root, state of each root (root, version): known ones (root, version) or not, those that clash, and that a limit cut off."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    rows = roots.select("root", "version").join(mark(known, "known"), ["root", "version"], "left").join(mark(clashing, "clash"), "root", "left")
    rows = rows.withColumn("late", F.lit(None).cast("boolean")) if cut is None else rows.join(mark(cut, "late"), "root", "left")
    state = F.when(F.col("known").isNull(), "empty").when(F.col("late"), "limit").when(F.col("clash"), "conflict").otherwise("ok")
    return rows.select("root", state.alias("state"))


# The order of ASCII characters in names, as npm sorts them; all others come first.
COLLATION = "_-,;:!?.\\'\"()[]{}@*/&#%`^+<=>|~$0123456789" + "".join(c + c.upper() for c in "abcdefghijklmnopqrstuvwxyz")


def collation_key(name: Column) -> Column:
    """Text that orders like the names in that order; a name comes before those that continue it."""
    plain = F.regexp_replace(name, r"[^\x21-\x7E]", "\u0001")
    return F.translate(plain, COLLATION, "".join(chr(0x100 + i) for i in range(len(COLLATION))))


#: Of `dedupe_tree_edges`: roots and edges for each bucket of trees, and rows of a level in a bucket up to which they are hashed, and not sorted, to look up what is known.
ROOTS_A_BUCKET, EDGES_A_BUCKET, HASHED_ROWS = 1 << 15, 1 << 18, 1 << 20


#: Places in a root's level stay below this.
MOST_PLACES = 1 << 63


def dedupe_tree_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (src, dst, kind, and name, valid, alias_target where there are): tree edges of each root breadth first, with the first visit of a node and `deduped` later ones.

    Siblings go by the collation of their names (the edge's `name`, by default its
    target's). Edges that aren't valid are left out. A node is expanded where it is
    met first, by level, then by the place of its parent, then by name.

    Names are compared once, among siblings; a place is the parent's, times the most
    siblings, plus the place among these. Rows of a level are shuffled once, by root
    and target, into the buckets of the levels before, which stay where they are.
    Where a level stands at few nodes, however many roots it has, their edges are
    broadcast; else it is shuffled once more, by node.
    """
    spark = edges.sparkSession
    has = lambda c, other: F.col(c) if c in edges.columns else other
    steps = edges.filter(F.coalesce(has("valid", F.lit(True)), F.lit(False)) & F.col("dst").isNotNull())
    name, alias = has("name", F.col("dst")).cast("string"), has("alias_target", F.lit(None).cast("string")).isNotNull()
    siblings = Window.partitionBy("src").orderBy(collation_key(name), name, "kind", "dst", alias)
    steps = steps.select("src", "dst", "kind", alias.alias("alias"), (F.row_number().over(siblings) - 1).cast("bigint").alias("nth"))
    steps, n_edges = Parts(spark, "steps").add(steps)
    width = (steps.agg(F.max("nth")).first()[0] or 0) + 1
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("place")).filter("root IS NOT NULL").distinct()
    level, n = Parts(spark, "roots").add(start)
    follow, k, top = steps, n_edges, 0
    buckets = max(spark.sparkContext.defaultParallelism, n // ROOTS_A_BUCKET, n_edges // EDGES_A_BUCKET)
    tree = Dealt(spark, "tree_edges", ("root", "dst"), buckets)
    try:
        for depth in count(1):
            if (top + 1) * width >= MOST_PLACES:  # numbered anew, without gaps
                level = written(level.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("place")).cast("bigint") - 1), "places")
                top = level.agg(F.max("place")).first()[0] or 0
            near = F.broadcast(follow) if k <= BROADCAST_ROWS else follow
            rows = level.join(near, F.col("node") == F.col("src")).select("root", "src", "dst", "kind", "alias", (F.col("place") * width + F.col("nth")).alias("place"))
            top = (top + 1) * width - 1
            again = (F.row_number().over(Window.partitionBy("root", "dst").orderBy("place")) > 1) | (F.col("dst") == F.col("root"))
            rows = rows.repartition(buckets, "root", "dst").withColumn("deduped", again)
            if depth > 1:
                old = tree.rows().filter("NOT deduped").select("root", "dst", F.lit(True).alias("old"))
                how = "shuffle_hash" if n * width <= HASHED_ROWS * buckets else "merge"
                rows = rows.hint(how).join(old, ["root", "dst"], "left").withColumn("deduped", F.col("deduped") | F.col("old").isNotNull())
            tree.add(rows.select("root", "src", "dst", "kind", "alias", "place", F.lit(depth).cast("bigint").alias("level"), "deduped"), ("level", "deduped"))
            level = tree.files().filter((F.col("level") == depth) & ~F.col("deduped")).select("root", F.col("dst").alias("node"), "place")
            n = level.count()  # from the files' footers
            if not n:
                break
            # edges of what any root may come to with the next level
            follow, k = Parts(spark, "steps-of-level").add(steps.join(follow.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    finally:
        tree.forget()
    return tree.files().select("root", "src", "dst", "kind", "level", "deduped", (F.col("kind") == "peer").alias("peer"), "alias")


def mediate_nearest(tree: DataFrame) -> DataFrame:
    """tree (root, ga, version, depth, path): the nearest declaration of a ga wins, ties by path; losers are marked."""
    order = Window.partitionBy("root", "ga").orderBy("depth", "path")
    return tree.withColumn("selected", F.row_number().over(order) == 1).withColumn("winner", F.first("version").over(order))


def exclusive_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, dep for what is reachable from each node, less what is needed from outside the set, again and again.

    What is needed from outside has more edges that lead to it than come from the
    set: these are counted once. Each round then takes away what the last round's
    losses point at, from the side of the losses or of what is left, whichever is less.
    """
    spark = edges.sparkSession
    pairs = written(edges.select("src", "dst").distinct(), "edges")
    reach = min_depth(pairs, nodes.select(F.col("node").alias("root"))).select(F.col("root").alias("node"), F.col("node").alias("dep"))
    asked = written(pairs.join(pairs.groupBy("dst").agg(F.count("*").alias("all")), "dst").select("src", "dst", "all"), "counted-edges")
    inside = reach.join(asked, F.col("dep") == F.col("src")).groupBy("node", F.col("dst").alias("dep")).agg(F.count("*").alias("n"), F.max("all").alias("all")).filter("node <> dep")
    outside = F.col("n") < F.col("all")
    judged, n = (parts := Parts(spark, "needed-outside")).add(inside.select("node", "dep", outside.alias("outside")), F.col("outside"))
    lost, left, n_left = judged.filter("outside").drop("outside"), judged.filter("NOT outside").drop("outside"), parts.n - n
    kept, gone, back = (Parts(spark, name) for name in ("exclusive", "lost", "leading-back"))
    while n and n_left:
        if n <= n_left:
            next_ = lost.join(pairs, F.col("dep") == F.col("src")).select("node", F.col("dst").alias("dep")).join(left, ["node", "dep"], "left_semi")
        else:
            into, k = back.replace(left.join(pairs, F.col("dep") == F.col("dst")).select("node", "dst", "src"))
            next_ = lost.withColumnRenamed("dep", "src").join(F.broadcast(into) if k <= BROADCAST_ROWS else into, ["node", "src"]).select("node", F.col("dst").alias("dep"))
        lost, n = gone.add(next_.distinct())
        left, n_left = kept.replace(left.join(lost, ["node", "dep"], "left_anti"))
    return left.union(nodes.select("node", F.col("node").alias("dep")).distinct())


def replaceable(placed: DataFrame, incoming: DataFrame, candidates: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """placed (node, name, version), incoming (node, spec, and src with `own`), candidates (name, candidate): per node and candidate whether all incoming specs accept it, and whether it dedupes.

    own (node, dep): nodes that only hang on a node, itself included (see
    `exclusive_dependencies`); edges from them have no say.
    """
    ranges = nested_ranges(range_bounds(incoming))
    all_of = incoming.groupBy("node").agg(F.count("*").alias("n_incoming"))
    asked = incoming if own is None else incoming.join(own.select("node", F.col("dep").alias("src")), ["node", "src"], "left_anti")
    rows = placed.join(candidates, "name").join(asked.select("node", "spec"), "node", "left").join(ranges, "spec", "left")
    accepts = F.col("spec").isNull() | range_test(F.col("range"), V.semver(F.col("candidate")))
    out = rows.groupBy("node", "name", "version", "candidate").agg(F.bool_and(accepts).alias("replaceable")).join(all_of, "node", "left")
    newer = V.semver(F.col("candidate"))["key"] >= V.semver(F.col("version"))["key"]
    out = out.withColumn("n_incoming", F.coalesce("n_incoming", F.lit(0)).cast("bigint"))
    return out.withColumn("dedupable", (F.col("n_incoming") == 0) | (F.col("candidate") == F.col("version")) | (F.col("replaceable") & F.coalesce(newer, F.lit(False))))


def hoist_report(edges: DataFrame, peers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges (root, pkg, dep, spec, version, level): per (root, name) the version first reached takes the top level, and how many others nest below.

    Also the peer edges (of peers: pkg, dep, spec, and pkg_version where edges have
    it) that the version at the top level doesn't satisfy: root, pkg, dep, spec, top.
    """
    edges = written(edges, "hoisted-edges")
    placed = edges.filter("version IS NOT NULL").groupBy("root", "dep", "version").agg(F.min(F.struct("level", "pkg")).alias("first"), F.count("*").alias("uses"))
    top = placed.groupBy("root", "dep").agg(F.min_by("version", F.struct("first", "version")).alias("top"), (F.count("*") - 1).alias("nested_versions"), F.sum("uses").alias("uses"))
    top = written(top, "top-level")
    if peers is None:
        return top, top.limit(0).select("root", F.lit(None).cast("string").alias("pkg"), "dep", F.lit(None).cast("string").alias("spec"), "top")
    on = [c for c in ("pkg", "pkg_version", "dep", "spec") if c in edges.columns and c in peers.columns]
    asked = edges.join(peers.select(*on).distinct(), on, "left_semi").join(top.select("root", "dep", "top"), ["root", "dep"], "left")
    asked = asked.join(nested_ranges(range_bounds(peers)), "spec", "left")
    fits = F.col("range").isNull() | range_test(F.col("range"), V.semver(F.col("top")))
    return top, asked.filter(F.col("top").isNull() | ~fits).select("root", "pkg", "dep", "spec", "top")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) left when nodes without edges in or without edges out are taken away again and again: cycles, and ways from one to another."""
    left = Parts(edges.sparkSession, "core")
    edges, n = left.add(edges.select("src", "dst").distinct())
    while n:
        inner = edges.select(F.col("src").alias("n")).intersect(edges.select(F.col("dst").alias("n")))
        kept = edges.join(inner.withColumnRenamed("n", "src"), "src", "left_semi").join(inner.withColumnRenamed("n", "dst"), "dst", "left_semi")
        before = n
        edges, n = left.replace(kept.select("src", "dst"))
        if n == before:
            break
    return edges


def cycle_report(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, and the length of the shortest way, however long.

    A node's walk keeps within its strong component, and ends when it comes back.
    """
    spark, knots = edges.sparkSession, strong_components(edges)
    ends = [knots.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("src", "dst")]
    core = edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst")
    core = written(core.select("src", "dst"), "cycle-edges")
    seen, done = Parts(spark, "walks"), Parts(spark, "cycles")
    frontier, n = seen.add(core.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct())
    done.add(frontier.limit(0).select(F.col("root").alias("node"), F.lit(0).cast("bigint").alias("length")))
    for depth in count(1):
        if not n:
            return done.rows()
        reached = written(frontier.join(core, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct(), "reached")
        back, _ = done.add(reached.filter("root = node").select("node", F.lit(depth).cast("bigint").alias("length")))
        new = reached.filter("root <> node").join(seen.rows(), ["root", "node"], "left_anti")
        frontier, n = seen.add(new.join(back.select(F.col("node").alias("root")), "root", "left_anti").select("root", "node"))


def peer_groups(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst, kind, valid): members (node, group: smallest node) joined by valid peer edges both ways, and entries (src, dst, node).

    An entry is a valid edge of another kind into a group, with each node that it
    reaches over valid peer edges from its target on.
    """
    peers = edges.filter("kind = 'peer' AND valid").select("src", "dst").distinct()
    both = written(peers.union(peers.select("dst", "src")).distinct(), "peer-edges")
    state = Parts(edges.sparkSession, "peer-labels")
    label, _ = state.add(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("group")))
    n = 1
    while n:
        # the smallest label of the neighbours, then of the label's own label, which halves the way to the smallest node
        near = both.join(label, both["dst"] == label["node"]).select(F.col("src").alias("node"), "group")
        best = label.union(near).groupBy("node").agg(F.min("group").alias("group"))
        up = label.select(F.col("node").alias("group"), F.col("group").alias("top"))
        new = best.join(up, "group", "left").select("node", F.least("group", "top").alias("group"))
        new = new.join(label.withColumnRenamed("group", "was"), "node").select("node", "group", (F.col("group") != F.col("was")).alias("moved"))
        moved = written(new, "moved-labels")
        n = moved.filter("moved").count()
        label, _ = state.replace(moved.select("node", "group"))
    entering = edges.filter("kind <> 'peer' AND valid").join(label.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    reach = min_depth(peers, entering.select(F.col("dst").alias("root")).distinct()).select(F.col("root").alias("dst"), "node")
    return label, entering.join(reach, "dst").select("src", "dst", "node")


def effective_poms(poms: DataFrame, properties: DataFrame) -> DataFrame:
    """poms (gav, parent), properties (gav, key, value): gav, key, value with what parents pass down, and ${key} replaced until nothing changes.

    Chains of parents may be as long as they are; one that comes back to its own
    POM raises. Values of any length are filled in; those that lead back to their
    own name stay as they were written, and so do values that need one of these.
    """
    chain = Parts(poms.sparkSession, "parents")
    level, n = chain.add(poms.select("gav", F.col("gav").alias("from"), F.col("parent").alias("next"), F.lit(0).alias("depth")))
    up = poms.select(F.col("gav").alias("next"), F.col("parent").alias("above"))
    while n:
        above = level.filter("next IS NOT NULL").join(up, "next").select("gav", F.col("next").alias("from"), F.col("above").alias("next"), (F.col("depth") + 1).alias("depth"))
        level, n = chain.add(above.withColumn("next", F.when(F.col("gav") == F.col("from"), F.raise_error(F.concat(F.lit("its own parent: "), F.col("gav").cast("string"))).cast(poms.schema["parent"].dataType)).otherwise(F.col("next"))))
    own = chain.rows().join(properties.withColumnRenamed("gav", "from"), "from")
    names = lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(r"\$\{([\w.-]+)\}"), F.lit(1)))
    own = own.groupBy("gav", "key").agg(F.min_by("value", "depth").alias("value")).withColumn("names", names(F.col("value")))
    own = written(own, "own-properties")
    chain.drop()
    # a value is filled in once all names in it are; unknown names are as they stand. What is never ready leads in a circle.
    known = own.select("gav", F.col("key").alias("name"), F.lit(True).alias("known"))
    uses = own.select("gav", "key", F.explode("names").alias("name")).join(known, ["gav", "name"])
    done, waiting = Parts(poms.sparkSession, "settled"), Parts(poms.sparkSession, "waiting")
    new, n = done.add(own.join(uses.select("gav", "key").distinct(), ["gav", "key"], "left_anti").select("gav", "key", "value"))
    left, _ = waiting.add(uses)
    while n:
        # names that were filled in by the last round are taken from the list; what has none left is ready
        got = left.join(new.select("gav", F.col("key").alias("name"), F.lit(True).alias("ready")), ["gav", "name"], "left")
        ready = got.groupBy("gav", "key").agg(F.count_if(F.col("ready").isNull()).alias("open")).filter("open = 0").select("gav", "key")
        ready = written(ready, "ready")
        values = uses.join(ready, ["gav", "key"]).join(done.rows().select("gav", F.col("key").alias("name"), F.col("value").alias("put")), ["gav", "name"])
        maps = values.groupBy("gav", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "put"))).alias("puts"))
        text = F.aggregate("names", F.col("value"), lambda t, k: F.replace(t, F.concat(F.lit("${"), k, F.lit("}")), F.coalesce(F.try_element_at("puts", k), F.concat(F.lit("${"), k, F.lit("}")))))
        left, _ = waiting.replace(got.filter("ready IS NULL").select("gav", "key", "name").join(ready, ["gav", "key"], "left_anti"))
        new, n = done.add(own.join(maps, ["gav", "key"]).select("gav", "key", text.alias("value")))
    stuck = own.join(done.rows().select("gav", "key"), ["gav", "key"], "left_anti").select("gav", "key", "value")
    return done.rows().unionByName(stuck)
