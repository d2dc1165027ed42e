"""Edge extractors: ``extract(files) -> (edges, limitations)``.

``files`` has root, rel_path, language, role, tokens and ``text``; ``edges`` has root, src, dst, relation, source_tool,
authority; ``limitations`` has root, kind, message, scope. Specifiers are resolved against the files table by equi-joins
on candidate paths, never against a disk, and an extractor reports what it cannot know instead of guessing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE = ["root", "src", "dst", "relation", "source_tool", "authority"]


def resolve(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of the candidate paths of each specifier, the existing one of least priority. candidates: root, src, spec, path, prio."""
    known = files.select("root", F.col("rel_path").alias("path"))
    hit = candidates.join(known, ["root", "path"])
    return hit.groupBy("root", "src", "spec").agg(F.min(F.struct("prio", "path")).alias("best")).select("root", "src", F.col("best.path").alias("dst")).where("src <> dst").distinct()


def edges_of(pairs: DataFrame, relation: str, tool: str, authority: str) -> DataFrame:
    return pairs.select("root", "src", "dst", F.lit(relation).alias("relation"), F.lit(tool).alias("source_tool"), F.lit(authority).alias("authority"))


def limitation(rows: DataFrame, kind: str, message: str, scope: Column) -> DataFrame:
    return rows.select("root", F.lit(kind).alias("kind"), F.lit(message).alias("message"), scope.alias("scope"))


def too_large(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(files small enough to parse, limitations of the others)."""
    size = F.octet_length("text")
    big = files.where(size > most)
    return files.where((size <= most) | F.col("text").isNull()), limitation(big, "file_too_large", f"over {most} bytes, not parsed", F.col("rel_path"))


def last_per(rows: DataFrame, *keys: str, order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")
