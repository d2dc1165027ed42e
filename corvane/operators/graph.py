"""The file graph: four relations of seeds, in one step or transitively."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.extract import EDGE, python, script, units
from corvane.session import Stored


class Graph(NamedTuple):
    files: DataFrame
    edges: DataFrame  # file level: Python, JavaScript, TypeScript, partners
    groups: list[units.Units]  # unit level: Go, C#
    limitations: DataFrame


def build(files: DataFrame, aliases: DataFrame | None = None) -> Graph:
    """files: root, rel_path, language, role, tokens, text."""
    py, py_limits = python.extract(files)
    js, js_limits = script.extract(files, aliases)
    go, cs = units.go_units(files), units.csharp_units(files)
    pairs = units.partners(files).select("root", "src", "dst", F.lit("imports").alias("relation"), F.lit("csharp_partner").alias("source_tool"), F.lit("heuristic").alias("authority"))
    # the index is built once: edges and units are far smaller than the texts they come from
    stored = Stored(files.sparkSession)
    edges, _ = stored.table(py.unionByName(js).unionByName(pairs))
    go, cs = (u._replace(unit_files=stored.table(u.unit_files)[0], unit_edges=stored.table(u.unit_edges)[0]) for u in (go, cs))
    limits = py_limits.unionByName(js_limits).unionByName(go.limitations).unionByName(cs.limitations)
    return Graph(files, edges, [go, cs], limits)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("root", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("importers").alias("relation"), "source_tool", "authority").distinct()


def unit_steps(group: units.Units, seeds: DataFrame) -> DataFrame:
    """root, src, src_test, to_unit, relation: the units that seeds (root, src) lead to, before any of their files is looked at."""
    seed_units = seeds.join(group.unit_files.select("root", F.col("path").alias("src"), F.col("unit_id").alias("unit"), F.col("test").alias("src_test")), ["root", "src"])
    forward = seed_units.join(group.unit_edges.select("root", F.col("src_unit").alias("unit"), F.col("dst_unit").alias("to_unit")), ["root", "unit"]).withColumn("relation", F.lit("imports"))
    backward = seed_units.join(group.unit_edges.select("root", F.col("dst_unit").alias("unit"), F.col("src_unit").alias("to_unit")), ["root", "unit"]).withColumn("relation", F.lit("importers"))
    same = seed_units.withColumn("to_unit", F.col("unit")).withColumn("relation", F.lit("peers"))
    steps = [x.select("root", "src", "src_test", "to_unit", "relation") for x in (forward, backward, same)]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def told_tests(reached: DataFrame) -> DataFrame:
    """Of units reached, with ``test`` of their files: tests count in the seed's own unit only, as its tests."""
    tests = F.col("test") & (F.col("relation") == "peers")
    return reached.where(~F.col("test") | tests).withColumn("relation", F.when(tests, "tests").otherwise(F.col("relation")))


def unit_relations(group: units.Units, seeds: DataFrame) -> DataFrame:
    """Relations of seeds (root, src) by units: the seeds cut the units down before any file pair exists."""
    members = group.unit_files.select("root", F.col("unit_id").alias("to_unit"), F.col("path").alias("dst"), "test")
    reached = unit_steps(group, seeds).join(members, ["root", "to_unit"]).where("src <> dst")
    return told_tests(reached).select("root", "src", "dst", "relation", F.lit("units").alias("source_tool"), F.lit("heuristic").alias("authority")).distinct()


def file_relations(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Imports and importers of the seeds (root, src) by edges between files."""
    near = graph.edges.join(seeds, ["root", "src"], "left_semi")
    back = reverse(graph.edges.join(seeds.select("root", F.col("src").alias("dst")), ["root", "dst"], "left_semi"))
    return near.select(*EDGE).unionByName(back.select(*EDGE))


def relations(graph: Graph, seeds: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """One step from the seeds (root, src): imports, importers, peers, tests. An empty allow-list is all."""
    out = file_relations(graph, seeds)
    for group in graph.groups:
        out = out.unionByName(unit_relations(group, seeds))
    return out.where(F.col("relation").isin(*allowed)) if allowed else out


def closure(edges: DataFrame, seeds: DataFrame, most_steps: int = 50) -> DataFrame:
    """root, seed, node, steps: everything reachable, by breadth-first steps; each level is stored, visited nodes drop out."""
    stored = Stored(edges.sparkSession)
    links, _ = stored.table(edges.select("root", F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    visited, _ = stored.table(seeds.select("root", F.col("src").alias("seed"), F.col("src").alias("node"), F.lit(0).alias("steps")).distinct())
    frontier = visited
    levels = [visited]
    for step in range(1, most_steps + 1):
        reached = frontier.join(links, ["root", "node"]).select("root", "seed", F.col("to").alias("node")).distinct()
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        frontier, _ = stored.table(reached.join(seen, ["root", "seed", "node"], "left_anti").withColumn("steps", F.lit(step)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
