"""Version control as rows. The commands run on the driver; their output is parsed as columns, so tests need no repository."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[..., str]


def runner(repo: str, seconds: int = 60) -> Runner:
    return lambda *args: subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, timeout=seconds).stdout


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(k, line) for k, line in enumerate(text.split("\n"))], "ord int, line string")


def status(spark: SparkSession, run: Runner) -> DataFrame:
    """rel_path, state (modified or untracked)."""
    rows = lines(spark, run("status", "--porcelain")).where("length(line) > 3")
    return rows.select(F.substring("line", 4, 100_000).alias("rel_path"), F.when(F.startswith("line", F.lit("?")), "untracked").otherwise("modified").alias("state"))


def head(run: Runner) -> tuple[str, str]:
    return run("rev-parse", "--abbrev-ref", "HEAD").strip(), run("rev-parse", "HEAD").strip()


def changed(spark: SparkSession, run: Runner, ref: str) -> DataFrame:
    """rel_path of the files changed since a reference."""
    return lines(spark, run("diff", "--name-only", ref)).select(F.trim("line").alias("rel_path")).where("rel_path <> ''")


def diff_counts(spark: SparkSession, stat: str) -> DataFrame:
    """additions, deletions from the last line of a --stat."""
    tail = F.element_at(F.filter(F.split(F.lit(stat), "\n"), lambda s: F.trim(s) != ""), -1)
    number = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(tail, p, 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("int")
    return spark.range(1).select(number(r"(\d+) insertion").alias("additions"), number(r"(\d+) deletion").alias("deletions"))


def commits(spark: SparkSession, run: Runner, n: int) -> DataFrame:
    """hash, short_hash, author, date, message; lines with fewer fields are dropped."""
    parts = F.split("line", "\x1f")
    rows = lines(spark, run("log", f"-{n}", "--date=short", "--pretty=format:%H%x1f%h%x1f%an%x1f%ad%x1f%s")).where(F.size(parts) >= 5)
    return rows.orderBy("ord").select(*[parts[k].alias(c) for k, c in enumerate(("hash", "short_hash", "author", "date", "message"))])
