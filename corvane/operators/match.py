"""Joins of the file graph's queries: finding files, tagging candidates by the first match, falling back to base names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.exprs import base_name, directory

# The order in which relations are tried and what each is worth.
PRIORITY = {"seed": 1, "imports": 2, "importers": 3, "peers": 4, "tests": 5}
SCORES = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.75, 5: 0.7}


def find(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, src of files named by path or as parts of a named directory, the names that match nothing). wanted: root, name."""
    names = wanted.select("root", F.rtrim("name", F.lit("/")).alias("name")).distinct()
    exact = files.join(names.withColumnRenamed("name", "rel_path"), ["root", "rel_path"], "left_semi").select("root", F.col("rel_path").alias("src"), F.col("rel_path").alias("name"))
    parts = F.split("rel_path", "/")
    above = files.select("root", F.col("rel_path").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("name")).where("name <> src")
    inside = above.join(names, ["root", "name"], "left_semi").select("root", "src", "name")
    both = exact.unionByName(inside)
    return both.select("root", "src").distinct(), names.join(both, ["root", "name"], "left_anti")


def find_file(files: DataFrame, wanted: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(root, src of files named by relative or absolute path; root, name, problem, suggestions of names that are no file).

    A directory's name is answered with up to ``most`` of the files right in it. wanted: root, name; files may have ``path``.
    """
    names = wanted.select("root", F.rtrim("name", F.lit("/")).alias("name")).distinct()
    known = files.select("root", "rel_path", F.array(F.col("rel_path"), F.col("path") if "path" in files.columns else F.concat_ws("/", "root", "rel_path")).alias("as"))
    hit = known.select("root", F.col("rel_path").alias("src"), F.explode("as").alias("name")).join(names, ["root", "name"]).select("root", "name", "src").distinct()
    missed = names.join(hit, ["root", "name"], "left_anti")
    # of each directory only as many files as are shown are kept
    inside = files.select("root", directory(F.col("rel_path")).alias("dir"), "rel_path").join(missed.select("root", F.col("name").alias("dir")), ["root", "dir"], "left_semi")
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy("root", "dir").orderBy(F.split("rel_path", "/")))).where(F.col("_n") <= most)
    shown = ranked.groupBy("root", F.col("dir").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "rel_path"))), lambda x: x["rel_path"]).alias("suggestions"))
    told = missed.join(shown, ["root", "name"], "left")
    return hit.select("root", "src").distinct(), told.select("root", "name", F.when(F.col("suggestions").isNotNull(), "is_directory").otherwise("file_not_found").alias("problem"), F.coalesce("suggestions", F.expr("CAST(array() AS array<string>)")).alias("suggestions"))


def tag(seeds: DataFrame, related: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates (root, request, path) with the score of their first matching relation.

    The first match counts, not the best score: a test that imports the seed gets 0.70 even if it is also its peer.
    """
    marks = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    own = seeds.select("root", "request", F.col("src").alias("path"), F.lit(1).alias("priority"))
    rest = related.select("root", "request", F.col("dst").alias("path"), marks[F.col("relation")].alias("priority"))
    first = own.unionByName(rest).groupBy("root", "request", "path").agg(F.min("priority").alias("priority"))
    scores = F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])
    known = first.join(files.select("root", F.col("rel_path").alias("path"), "language", "role", "tokens"), ["root", "path"])
    return known.withColumn("score", F.when((F.col("priority") == 3) & (F.col("role") == "test"), 0.7).otherwise(scores[F.col("priority")]))


def by_base_name(names: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, name, path, how) of names found by path or by a unique base name, and limitations for ambiguous ones."""
    exact = names.join(files.select("root", F.col("rel_path").alias("name")), ["root", "name"], "left_semi").select("root", "name", F.col("name").alias("path"), F.lit("path").alias("how"))
    missed = names.join(exact, ["root", "name"], "left_anti").withColumn("base", base_name(F.col("name")))
    bases = files.groupBy("root", base_name(F.col("rel_path")).alias("base")).agg(F.count("*").alias("n"), F.min("rel_path").alias("path"))
    hits = missed.join(bases, ["root", "base"])
    limits = hits.select("root", F.when(F.col("n") > 1, "ambiguous_basename_match").otherwise("basename_match_only").alias("kind"), F.col("name").alias("scope"))
    return exact.unionByName(hits.where("n = 1").select("root", "name", "path", F.lit("base_name").alias("how"))), limits
