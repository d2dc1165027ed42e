"""Choosing rows under a token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_fit(rows: DataFrame, group: Sequence[str], order: Sequence[Column], budget: Column | int, need: str, used: str | None = None) -> DataFrame:
    """The rows taken: walk each group in order, take a row if what it needs still fits, else skip it and go on.

    ``need`` is what must fit, ``used`` what is then taken off (they differ where only signatures are sent); both are at
    least one. What is left never grows, so of the rows of one size those that are taken come first: of each size no more
    than the budget holds are walked. That leaves a bounded number of rows a group, however many the group has, and the
    cut is a rank per group and size that Spark prunes before its shuffle. The walk itself is a fold over sizes.
    """
    used = used or need
    limit = budget if isinstance(budget, Column) else F.lit(budget).cast("bigint")
    sized = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group, need).orderBy(*order)))
    if not isinstance(budget, Column):
        sized = sized.where((F.col("_k") <= budget) & (F.col(need) <= budget))
    most = F.col("_k") * F.col(need) <= limit if used == need else (F.col("_k") <= limit) & (F.col(need) <= limit)
    kept = sized.where(most).withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    walk = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(need).cast("bigint").alias("need"), F.col(used).cast("bigint").alias("used"))))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.expr("CAST(array() AS array<int>)").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["sum"] + x["need"] <= F.col("_limit")
        return F.struct(F.when(fits, acc["sum"] + x["used"]).otherwise(acc["sum"]).alias("sum"), F.when(fits, F.concat(acc["taken"], F.array(x["_at"]))).otherwise(acc["taken"]).alias("taken"))

    folded = kept.groupBy(*group).agg(walk.alias("_walk"), F.max(limit).alias("_limit")).select(*group, F.explode(F.aggregate("_walk", start, step, lambda acc: acc["taken"])).alias("_at"))
    return kept.join(folded, [*group, "_at"], "left_semi").drop("_at", "_k")


def first_fit_marked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], budget: Column | int, need: str, key: Sequence[str], used: str | None = None) -> DataFrame:
    """All rows with ``included``; ``key`` names a row within its group."""
    taken = first_fit(rows, group, order, budget, need, used).select(*group, *key, F.lit(True).alias("included"))
    return rows.join(taken, [*group, *key], "left").withColumn("included", F.coalesce("included", F.lit(False)))


def prefix_fit(rows: DataFrame, group: Sequence[str], order: Sequence[Column], budget: int, need: str) -> DataFrame:
    """Rows of each group in order up to the first that does not fit. Sizes are at least one, so the running sum decides.

    No more than ``budget`` rows of a group can fit: a rank, which Spark prunes before its shuffle, cuts the rest off first.
    """
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= budget).drop("_k")
    running = F.sum(need).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
