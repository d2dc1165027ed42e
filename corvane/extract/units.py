"""Languages whose files form units: Go packages (directories) and C# projects.

Edges are kept between units; files are reached seed -> unit -> units -> files, so a unit's files are never multiplied with
another's before the seeds have cut them down.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.extract import limitation
from corvane.functions.exprs import base_name, directory, normalise, outside

# Directories in which no module or project is looked for.
GO_SKIPPED = (".git", ".claude", "node_modules", "vendor", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", ".next", ".nuxt", ".turbo", ".cache", "coverage", "testdata", ".pytest_cache", "site-packages")
CSHARP_SKIPPED = (".git", ".claude", "node_modules", "bin", "obj", ".vs", ".idea", "packages", "TestResults")


def ancestors(parts, last):
    """The directories from '.' down to the first ``last`` parts."""
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))


class Units(NamedTuple):
    units: DataFrame  # root, unit_id, kind, dir
    unit_files: DataFrame  # root, unit_id, path, test
    unit_edges: DataFrame  # root, src_unit, dst_unit
    limitations: DataFrame
    packages: DataFrame | None = None  # root, unit_id, name, version


def go_imports(files: DataFrame) -> DataFrame:
    """root, src, spec: quoted paths of import lines and blocks."""
    go = files.where((F.col("language") == "Go") & F.col("text").isNotNull())
    blocks = F.concat(F.regexp_extract_all("text", F.lit(r"(?ms)^import\s*\(([^)]*)\)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^import\s+((?:[\w.]+\s+)?\"[^\"\n]+\")"), F.lit(1)))
    return go.select("root", F.col("rel_path").alias("src"), F.explode(F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"\n]+)\""), F.lit(1)))))).alias("spec"))


def module_roots(files: DataFrame) -> DataFrame:
    """root, dir, module of every go.mod; a tree without one is a module named after its root."""
    mods = files.where(base_name(F.col("rel_path")) == "go.mod").where(outside(F.col("rel_path"), GO_SKIPPED))
    named = mods.select("root", directory(F.col("rel_path")).alias("dir"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''")
    bare = files.select("root").distinct().join(named.select("root"), "root", "left_anti").select("root", F.lit(".").alias("dir"), F.substring_index("root", "@", 1).alias("module"))
    return named.unionByName(bare)


def go_units(files: DataFrame) -> Units:
    """Packages by directory; the import path is the innermost module's name and the directory below it."""
    go = files.where(F.col("language") == "Go").select("root", F.col("rel_path").alias("path"), directory(F.col("rel_path")).alias("dir"))
    modules = module_roots(files)
    # a directory is matched by its ancestors: an equi-join, however many modules a tree has
    parts = F.when(F.col("dir") == ".", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    placed = go.select("root", "dir").distinct().select("root", "dir", F.posexplode(ancestors(parts, F.size(parts))).alias("depth", "base")).join(modules.select("root", F.col("dir").alias("base"), "module"), ["root", "base"])
    inner = placed.groupBy("root", "dir").agg(F.max(F.struct("depth", "base", "module")).alias("m"))
    below = F.when(F.col("m.base") == ".", F.when(F.col("dir") == ".", "").otherwise(F.concat(F.lit("/"), "dir"))).otherwise(F.substring("dir", F.length("m.base") + 1, F.length("dir")))
    units = inner.select("root", F.concat("m.module", below).alias("unit_id"), F.lit("go").alias("kind"), "dir")
    # two modules may claim one path: the first module root in order wins
    units = units.withColumn("_n", F.row_number().over(Window.partitionBy("root", "unit_id").orderBy("dir"))).where("_n = 1").drop("_n")
    unit_files = go.join(units.select("root", "dir", "unit_id"), ["root", "dir"]).select("root", "unit_id", "path", F.endswith("path", F.lit("_test.go")).alias("test"))
    sources = go_imports(files.where(~F.endswith("rel_path", F.lit("_test.go")))).join(unit_files.select("root", F.col("path").alias("src"), F.col("unit_id").alias("src_unit")), ["root", "src"])
    edges = sources.join(units.select("root", F.col("unit_id").alias("spec")), ["root", "spec"], "left_semi").select("root", "src_unit", F.col("spec").alias("dst_unit")).where("src_unit <> dst_unit").distinct()
    return Units(units, unit_files, edges, limitation(go.select("root").distinct(), "go_static_parse", "packages are read from source text; build tags are not evaluated", F.lit("go")))


def csharp_units(files: DataFrame) -> Units:
    """Projects with their references; a source file belongs to the innermost project above it."""
    schema = "ItemGroup array<struct<ProjectReference: array<struct<_Include: string>>, PackageReference: array<struct<_Include: string, _Version: string>>>>"
    projects = files.where(F.endswith(F.lower("rel_path"), F.lit(".csproj")) & outside(F.col("rel_path"), CSHARP_SKIPPED)).select("root", "text", F.col("rel_path").alias("unit_id"), directory(F.col("rel_path")).alias("dir"))
    parsed = projects.withColumn("xml", F.from_xml("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    items = parsed.select("root", "unit_id", "dir", F.explode("xml.ItemGroup").alias("g"))
    references = items.select("root", "unit_id", "dir", F.explode("g.ProjectReference").alias("r")).select("root", F.col("unit_id").alias("src_unit"), normalise(F.concat_ws("/", "dir", F.translate("r._Include", "\\", "/"))).alias("dst_unit"))
    edges = references.join(projects.select("root", F.col("unit_id").alias("dst_unit")), ["root", "dst_unit"], "left_semi").where("src_unit <> dst_unit").select("root", "src_unit", "dst_unit").distinct()
    packages = items.select("root", "unit_id", F.explode("g.PackageReference").alias("p")).select("root", "unit_id", F.col("p._Include").alias("name"), F.col("p._Version").alias("version"))
    sources = files.where(F.rlike("rel_path", F.lit(r"(?i)\.(?:cs|axaml|xaml)$")) & outside(F.col("rel_path"), CSHARP_SKIPPED)).select("root", F.col("rel_path").alias("path"))
    # a file is matched by its ancestor directories: an equi-join, no theta join over all projects
    above = sources.select("root", "path", F.posexplode(ancestors(F.split("path", "/"), F.size(F.split("path", "/")) - 1)).alias("depth", "dir")).join(projects.select("root", "dir", "unit_id"), ["root", "dir"])
    owned = above.groupBy("root", "path").agg(F.max(F.struct("depth", "unit_id")).alias("best")).select("root", F.col("best.unit_id").alias("unit_id"), "path", F.lit(False).alias("test"))
    # a project without item groups is valid: only text that is no XML element is an error
    unreadable = limitation(projects.where("text IS NULL"), "csproj_unreadable", "the content is no text", F.col("unit_id"))
    bad = limitation(projects.where(F.col("text").isNotNull() & ~F.rlike("text", F.lit(r"(?s)^\ufeff?\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<Project\b[^>]*(?:/>|>.*</Project>)\s*$"))), "csproj_parse_error", "no project element could be read", F.col("unit_id")).unionByName(unreadable)
    none = limitation(files.where(F.endswith("rel_path", F.lit(".cs"))).select("root").distinct().join(projects.select("root").distinct(), "root", "left_anti"), "no_csproj_files", "no project file above C# sources", F.lit("csharp"))
    return Units(projects.select("root", "unit_id", F.lit("csproj").alias("kind"), "dir"), owned, edges, bad.unionByName(none), packages)


def partners(files: DataFrame) -> DataFrame:
    """A view and its code-behind import each other: root, src, dst."""
    views = files.where(F.endswith("rel_path", F.lit(".axaml"))).select("root", F.col("rel_path").alias("src"))
    pair = views.withColumn("dst", F.concat("src", F.lit(".cs"))).join(files.select("root", F.col("rel_path").alias("dst")), ["root", "dst"], "left_semi")
    return pair.select("root", "src", "dst").unionByName(pair.select("root", F.col("dst").alias("src"), F.col("src").alias("dst")))
