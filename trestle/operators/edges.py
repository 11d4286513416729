"""Dependency edges between modules: conditions, slices, layers and cycles.

``module_edges(file, kind, specifier, resolved_path, line, type_only,
erases_request, names)``. Which kinds of edges count differs by operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.predicates import or_, two_valued
from ..schema import to_violations
from .conditions import Condition, Elements

FORWARD = ("import", "re-export", "dynamic", "type-expression")
STATIC = ("import", "re-export")


def candidates(root: str = "") -> Column:
    """Paths by which an edge may be meant: resolved, bare specifier, root-relative; an unresolved one has its specifier alone."""
    bare = F.when(~F.col("specifier").rlike(r"^[./]"), F.col("specifier"))
    relative = F.when(F.col("resolved_path").startswith(root.rstrip("/") + "/"), F.substring(F.col("resolved_path"), F.lit(len(root.rstrip("/")) + 2), F.length("resolved_path"))) if root else F.lit(None).cast("string")
    return F.when(F.col("resolved_path").isNull(), F.array("specifier")).otherwise(F.array_compact(F.array("resolved_path", bare, relative)))


def edge_matches(globs: list[str], root: str = "") -> Column:
    return two_valued(F.exists(candidates(root), lambda c: or_(*[c.rlike(glob_regex(g)) for g in globs])))


def matched_candidate(globs: list[str], root: str = "") -> Column:
    """The first candidate that a glob matches."""
    return F.get(F.filter(candidates(root), lambda c: or_(*[c.rlike(glob_regex(g)) for g in globs])), 0)


def is_type_only() -> Column:
    return two_valued(F.col("type_only"))


def forward(edges: DataFrame, kinds: tuple[str, ...] = FORWARD, ignore_types: bool = False) -> DataFrame:
    found = edges.where(F.col("kind").isin(*kinds))
    return found.where(~is_type_only()) if ignore_types else found


def importing(modules: DataFrame, edges: DataFrame, globs: list[str], root: str = "") -> DataFrame:
    """Modules with an edge that matches (semi join)."""
    return modules.join(forward(edges).where(edge_matches(globs, root)).select("file"), "file", "left_semi")


def not_importing(modules: DataFrame, edges: DataFrame, globs: list[str], root: str = "") -> DataFrame:
    return modules.join(forward(edges).where(edge_matches(globs, root)).select("file"), "file", "left_anti")


def _per_edge(population: DataFrame, edges: DataFrame, verb: str) -> DataFrame:
    rows = edges.join(population.select("file").distinct(), "file", "left_semi")
    target = F.coalesce("resolved_path", "specifier")
    return to_violations(rows, "file", F.concat(F.col("file"), F.lit(f" {verb} "), target), file="file", line="line", identity=F.concat_ws("::", F.col("file"), F.lit(verb), target))


def only_import_from(edges: DataFrame, globs: list[str], root: str = "", ignore_types: bool = False) -> Condition:
    return Condition("only import from the allowed places", lambda p: _per_edge(p, forward(edges, FORWARD, ignore_types).where(~edge_matches(globs, root)), "should not import"))


def not_import_from(edges: DataFrame, globs: list[str], root: str = "", ignore_types: bool = False) -> Condition:
    return Condition("not import from the forbidden places", lambda p: _per_edge(p, forward(edges, FORWARD, ignore_types).where(edge_matches(globs, root)), "must not import"))


def depend_on(edges: DataFrame, globs: list[str], root: str = "", ignore_type_imports: bool = False) -> Condition:
    """At least one matching edge that exists at run time."""
    runtime = ~is_type_only() if ignore_type_imports else ~is_type_only() | (F.col("kind") == "import")

    def run(p: DataFrame) -> DataFrame:
        missing = p.join(forward(edges).where(runtime & edge_matches(globs, root)).select("file"), "file", "left_anti")
        return to_violations(missing, "file", F.concat(F.col("file"), F.lit(" should depend on "), F.lit(", ".join(globs))), file="file")

    return Condition("depend on one of the places", run)


def only_type_imports_from(edges: DataFrame, globs: list[str], root: str = "") -> Condition:
    return Condition("import types only", lambda p: _per_edge(p, forward(edges, STATIC).where(~is_type_only() & edge_matches(globs, root)), "should import only types from"))


def not_have_aliased_imports(specifiers: DataFrame) -> Condition:
    """No named import under another name."""

    def run(p: DataFrame) -> DataFrame:
        rows = specifiers.where(two_valued(F.col("alias") != F.col("name"))).join(p.select("file").distinct(), "file", "left_semi")
        return to_violations(rows, "file", F.concat(F.lit('"'), F.col("name"), F.lit('" as "'), F.col("alias"), F.lit('"')), file="file", line="line")

    return Condition("not alias imports", run)


def only_be_imported_via(edges: DataFrame, globs: list[str]) -> Condition:
    """Every importer matches; edges of all kinds count."""

    def run(p: DataFrame) -> DataFrame:
        bad = edges.where(~or_(*[F.col("file").rlike(glob_regex(g)) for g in globs])).select(F.col("file").alias("importer"), F.col("resolved_path").alias("_target"), "line")
        rows = p.select("file").join(bad, F.col("file") == F.col("_target"))
        return to_violations(rows, "file", F.concat(F.col("file"), F.lit(" is imported by "), F.col("importer")), file="importer", line="line", identity=F.concat_ws("::", "file", "importer"))

    return Condition("only be imported via the given places", run)


def be_imported(edges: DataFrame) -> Condition:
    def run(p: DataFrame) -> DataFrame:
        dead = p.join(edges.select(F.col("resolved_path").alias("_target")), F.col("file") == F.col("_target"), "left_anti")
        return to_violations(dead, "file", F.concat(F.col("file"), F.lit(" is imported by nothing")), file="file")

    return Condition("be imported", run)


def no_unused_exports(exports: DataFrame, references: DataFrame) -> Condition:
    """Each export but the default is referenced from another file."""

    def run(p: DataFrame) -> DataFrame:
        used = references.where("ref_file <> file").select("file", "name")
        own = exports.where("name <> 'default'").join(p.select("file").distinct(), "file", "left_semi")
        return to_violations(own.join(used, ["file", "name"], "left_anti"), "name", F.concat(F.col("name"), F.lit(" is exported and never used")), file="file", line="line")

    return Condition("have no unused exports", run)


def max_exports(exports: DataFrame, n: int) -> Condition:
    """At most ``n`` named exports; the finding carries the count."""

    def run(p: DataFrame) -> DataFrame:
        counted = exports.where("name <> 'default'").groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > n)
        rows = counted.join(p.select("file").distinct(), "file", "left_semi")
        return to_violations(rows, "file", F.concat(F.col("file"), F.lit(f" has more than {n} exports")), file="file", measured=F.col("n"))

    return Condition(f"have at most {n} exports", run)


def default_export(wanted: bool, column: str = "has_default_export") -> Condition:
    from .conditions import element_condition

    held = two_valued(F.col(column))
    return element_condition("have a default export" if wanted else "not have a default export", held if wanted else ~held, Elements("file", "file", None))


# slices
def slices_by_prefix(files: DataFrame, prefix: str, path: str = "file") -> DataFrame:
    """``slice`` is the path segment that follows the first occurrence of ``prefix``."""
    at = F.instr(path, prefix)
    rest = F.substring(F.col(path), at + len(prefix), F.length(path))
    return files.where(at > 0).select(F.col(path).alias("file"), F.element_at(F.split(rest, "/"), 1).alias("slice")).where("slice <> ''").distinct()


def slices_by_definition(files: DataFrame, definition: dict[str, str], path: str = "file") -> DataFrame:
    """A file belongs to the first definition whose glob it matches."""
    case = F.lit(None).cast("string")
    for name, glob in reversed(list(definition.items())):
        case = F.when(F.col(path).rlike(glob_regex(glob)), name).otherwise(case)
    return files.select(F.col(path).alias("file"), case.alias("slice")).where("slice IS NOT NULL").distinct()


def slice_sites(edges: DataFrame, slices: DataFrame, kinds: tuple[str, ...] = STATIC, skip: str | None = None) -> DataFrame:
    """Edges between two different slices with their sites; ``skip`` names a flag that takes an edge out."""
    found = edges.where(F.col("kind").isin(*kinds))
    if skip:
        found = found.where(~two_valued(F.col(skip)))
    a = slices.select("file", F.col("slice").alias("src"))
    b = slices.select(F.col("file").alias("resolved_path"), F.col("slice").alias("dst"))
    return found.join(a, "file").join(b, "resolved_path").where("src <> dst").select("src", "dst", "file", "resolved_path", "line")


def slice_graph(sites: DataFrame) -> DataFrame:
    return sites.select("src", "dst").distinct()


def strongly_connected(graph: DataFrame, most_on_driver: int = 200_000, _materialise=None) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every cycle of two or more nodes.

    A condensed graph is small; up to ``most_on_driver`` distinct edges one pass over
    them on the driver suffices. Beyond that nodes that can't be on a cycle are peeled
    off and labels spread forward and backward, in files of the shared folder.
    """
    edges = graph.where("src <> dst").select("src", "dst").distinct()
    head = edges.limit(most_on_driver + 1).collect()
    spark = graph.sparkSession
    kind = graph.schema["src"].dataType.simpleString()
    if len(head) <= most_on_driver:
        found = _tarjan([(r[0], r[1]) for r in head])
        return spark.createDataFrame([(n, min(c)) for c in found for n in c], f"node {kind}, component {kind}")
    return _spread(edges)


def _tarjan(edges: list[tuple]) -> list[list]:
    graph: dict = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in sorted(graph):
        if start in index:
            continue
        work = [(start, iter(graph[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1:
                        out.append(part)
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                on.add(step)
                work.append((step, iter(graph[step])))
            elif step in on:
                low[node] = min(low[node], index[step])
    return out


def _keep(df: DataFrame) -> DataFrame:
    """A written copy in the folder that the executors share."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _spread(edges: DataFrame) -> DataFrame:
    """Components by forward and backward labels: nodes whose smallest reaching and smallest reached labels agree share a cycle; solved ones leave."""
    left, solved = _keep(edges), None

    def reach(e: DataFrame, a: str, b: str) -> DataFrame:
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        labels = _keep(nodes.withColumn("label", F.col("node")))
        while True:
            passed = e.join(labels.withColumnRenamed("node", a), a).select(F.col(b).alias("node"), "label")
            new = _keep(labels.select("node", "label").union(passed).groupBy("node").agg(F.min("label").alias("label")))
            if new.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").isEmpty():
                return new
            labels = new

    while not left.isEmpty():
        ahead = reach(left, "src", "dst").withColumnRenamed("label", "fore")
        behind = reach(left, "dst", "src").withColumnRenamed("label", "back")
        labels = _keep(ahead.join(behind, "node"))
        hit = labels.where("fore = back").select("node", F.col("fore").alias("component"))
        hit = hit.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1").drop("n")
        solved = hit if solved is None else solved.union(hit)
        # an edge inside a cycle joins nodes with equal labels both ways; equal fore and back are done
        f, g = labels.select(F.col("node").alias("src"), F.struct("fore", "back").alias("x")), labels.select(F.col("node").alias("dst"), F.struct("fore", "back").alias("y"))
        left = _keep(left.join(f, "src").join(g, "dst").where("x = y AND x.fore <> x.back").select("src", "dst"))
    if solved is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return solved


def cycle_edges(sites: DataFrame) -> DataFrame:
    """Each slice edge inside a cycle, once, at its first site by path and line."""
    members = strongly_connected(slice_graph(sites))
    inside = sites.join(members.withColumnRenamed("node", "src").withColumnRenamed("component", "c1"), "src").join(members.withColumnRenamed("node", "dst").withColumnRenamed("component", "c2"), "dst").where("c1 = c2")
    return inside.groupBy("src", "dst").agg(F.min(F.struct("file", "line")).alias("site"), F.first("c1").alias("component"))


def be_free_of_cycles(sites: DataFrame) -> DataFrame:
    """Findings: one for each edge inside a cycle."""
    rows = cycle_edges(sites)
    return to_violations(rows, "src", F.concat(F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(" is part of a cycle")), file=F.col("site.file"), line=F.col("site.line"), identity=F.concat_ws("->", "src", "dst"))


def respect_layer_order(sites: DataFrame, layers: list[str]) -> DataFrame:
    """Findings: one for each site of an edge to a layer that comes earlier; slices that aren't listed are left out."""
    order = F.create_map(*[x for i, name in enumerate(layers) for x in (F.lit(name), F.lit(i))])
    rows = sites.where(two_valued(F.try_element_at(order, F.col("dst")) < F.try_element_at(order, F.col("src"))))
    return _sites(rows, " must not depend on the layer above, ")


def not_depend_on(sites: DataFrame, *forbidden: str) -> DataFrame:
    return _sites(sites.where(F.col("dst").isin(*forbidden)), " must not depend on ")


def _sites(rows: DataFrame, verb: str) -> DataFrame:
    return to_violations(rows, "src", F.concat(F.col("src"), F.lit(verb), F.col("dst")), file="file", line="line", identity=F.concat_ws("->", "src", "dst", "file", "resolved_path"))
