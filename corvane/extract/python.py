"""Imports between Python files: absolute with every package prefix, and relative ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.extract import edges_of, limitation, resolve, too_large
from corvane.functions.exprs import directory, normalise

MOST_BYTES = 512 * 1024


def statements(files: DataFrame) -> DataFrame:
    """root, src, dots, module: one per import statement; of ``import a, b`` only the first name counts."""
    lines = files.where(F.endswith("rel_path", F.lit(".py"))).select("root", F.col("rel_path").alias("src"), F.explode(F.split("text", "\r?\n")).alias("line"))
    line = F.trim("line")
    plain = F.regexp_extract(line, r"^import\s+([A-Za-z_][\w.]*)", 1)
    dots = F.regexp_extract(line, r"^from\s+(\.*)[\w.]*\s+import\b", 1)
    origin = F.regexp_extract(line, r"^from\s+\.*([\w.]*)\s+import\b", 1)
    some = (plain != "") | (dots != "") | (origin != "")
    return lines.where(some).select("root", "src", F.length(dots).alias("dots"), F.when(plain != "", plain).otherwise(origin).alias("module")).distinct()


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    small, limits = too_large(files.where(F.col("language") == "Python"), MOST_BYTES)
    found = statements(small)
    # a.b.c stands for a, a.b and a.b.c
    prefixes = found.where("dots = 0").select("root", "src", F.explode(F.expr("transform(sequence(1, size(split(module, '[.]'))), i -> array_join(slice(split(module, '[.]'), 1, i), '/'))")).alias("spec"))
    absolute = prefixes.select("root", "src", "spec", F.explode(F.array(F.struct(F.lit(0).alias("prio"), F.concat("spec", F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("prio"), F.concat("spec", F.lit("/__init__.py")).alias("path")))).alias("c")).select("root", "src", "spec", "c.prio", "c.path")
    # n dots go n - 1 directories up
    up = F.concat(directory(F.col("src")), F.repeat(F.lit("/.."), F.col("dots") - 1))
    tail = F.when(F.col("module") == "", "").otherwise(F.concat(F.lit("/"), F.replace("module", F.lit("."), F.lit("/"))))
    near = found.where("dots > 0").select("root", "src", F.concat(up, tail).alias("spec"), "module")
    choices = F.array(F.struct(F.lit(0).alias("prio"), F.when(F.col("module") != "", F.concat("spec", F.lit(".py"))).alias("p")), F.struct(F.lit(1).alias("prio"), F.concat("spec", F.lit("/__init__.py")).alias("p")))
    relative = near.select("root", "src", "spec", F.explode(choices).alias("c")).select("root", "src", "spec", F.col("c.prio").alias("prio"), normalise(F.col("c.p")).alias("path")).where("path IS NOT NULL")
    pairs = resolve(absolute.unionByName(relative), files)
    none = files.select("root").distinct().join(files.where(F.col("language") == "Python").select("root").distinct(), "root", "left_anti")
    limits = limits.unionByName(limitation(none, "no_python_files", "no Python in this tree", F.lit("python")))
    return edges_of(pairs, "imports", "python_regex", "heuristic"), limits
