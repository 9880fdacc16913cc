"""Queries of the general problems: hierarchies and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import heavy, hierarchy
from codeweft.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = hierarchy.class_links(table(spark, d, "parsed_classes"))
    h = hierarchy.Hierarchy(links)
    cols = lambda a, r: (F.col(f"{a}.g").alias("repo"), F.col(f"{a}.n").alias("name"), r.alias("root"))
    up = h.ancestors(only_roots=True).select(*cols("v", F.col("at.n")), F.col("way.d").alias("depth"))
    top = nodes.join(h.children(), "id", "left_anti").select(*cols("id", F.col("id.n")), F.lit(0).alias("depth"))
    loops = h.cycles().select(*cols("id", F.lit("")), F.lit(-1).alias("depth"))
    return up.union(top).union(loops)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each class with each of its descendants and the fewest links between them."""
    _, links = hierarchy.class_links(table(spark, d, "parsed_classes"))
    up = hierarchy.Hierarchy(links).ancestors()
    return up.select(F.col("at.g").alias("repo"), F.col("at.n").alias("name"), F.col("v.n").alias("descendant"), F.col("way.d").alias("depth"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path to each class from each root it reaches, from the root down: the least by names of the shortest ones.

    There is one path for each class and root, as all of them can be exponentially many; a root's own is its name, with
    depth 0. Classes that reach no root, as all above them lies on cycles, have root '', depth -1 and the path from the
    nearest class on a cycle (the way around, for those on one). So every class has a row.
    """
    nodes, links = hierarchy.class_links(table(spark, d, "parsed_classes"))
    h = hierarchy.Hierarchy(links, paths="n")
    row = lambda c, root, depth, path: (F.col(f"{c}.g").alias("repo"), F.col(f"{c}.n").alias("name"), root.alias("root"), depth.alias("depth"), path.alias("path"))
    path = F.concat_ws(" > ", F.reverse("way.p"), F.col("v.n"))
    below = h.ancestors(only_roots=True).select(*row("v", F.col("at.n"), F.col("way.d"), path))
    top = nodes.join(h.children(), "id", "left_anti").select(*row("id", F.col("id.n"), F.lit(0), F.col("id.n")))
    return below.union(top).union(h.to_cycles().select(*row("v", F.lit(""), F.lit(-1), path)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_names(table(spark, d, "parsed_functions")).select("callee")


def p3_callers(spark: SparkSession, d: str) -> DataFrame:
    return heavy.callers_per_name(table(spark, d, "parsed_functions"))


_PAIRS = """
WITH pairs AS (
  SELECT DISTINCT file, name, line_start, regexp_replace(c, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+$', '', 'g') AS callee
  FROM (SELECT file, name, line_start, unnest(calls) AS c FROM parsed_functions WHERE name IS DISTINCT FROM '__file__') WHERE c IS NOT NULL),
per AS (SELECT callee, count(*) AS callers FROM pairs WHERE callee <> '' GROUP BY callee)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_paths, p3_found, p3_callers)}
ORACLE = {
    "p3_callers": _PAIRS + "SELECT callee, callers FROM per",
    "p3_found": _PAIRS + "SELECT callee FROM per WHERE callers * 100 >= (SELECT sum(callers) FROM per)",
}
