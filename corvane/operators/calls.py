"""Metrics over the call log: aggregates per feature, totals, limitation kinds, the unrated tail, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.exprs import ADVISORY, CONTENT_FEATURES


def last(calls: DataFrame, n: int) -> DataFrame:
    """The tail of the log: a distributed top-n."""
    return calls.orderBy(F.col("seq").desc(), F.col("call_id").desc()).limit(n)


def stats() -> list[Column]:
    ratio = (F.col("candidates_total") > 0) & (F.col("compression_ratio") > 0) & ~F.isnan("compression_ratio")
    budget = F.sum(F.when(F.col("budget_used") > 0, F.col("budget_used"))).cast("bigint")
    return [
        F.count("*").alias("calls"),
        F.count_if("has_error").alias("errors"),
        F.count_if(F.col("limitation_count") > 0).alias("warnings"),
        F.sum("latency_ms").cast("bigint").alias("ms"),
        budget.alias("tokens"),
        F.count_if(F.col("budget_used") > 0).alias("budgeted"),
        F.sum(F.when(ratio, 1 / F.col("compression_ratio"))).alias("ratio_sum"),
        F.count_if(ratio).alias("ratios"),
        F.count_if(F.col("feedback") == "good").alias("good"),
        F.count_if(F.col("feedback") == "bad").alias("bad"),
        F.min("seq").alias("first_seq"),
    ]


def means(sums: DataFrame, *keys: str) -> DataFrame:
    """Averages are cut, not rounded; a feature without budgets or ratios has 0."""
    return sums.select(
        *keys, "calls", "errors", "warnings",
        F.coalesce(F.expr("ms div calls"), F.lit(0)).cast("bigint").alias("avg_ms"),
        F.when(F.col("budgeted") > 0, F.expr("tokens div budgeted")).otherwise(0).cast("bigint").alias("avg_tok"),
        F.when(F.col("ratios") > 0, F.round(F.col("ratio_sum") / F.col("ratios"), 6)).otherwise(0.0).alias("ratio"),
        "good", "bad", "first_seq",
    )


def by_feature(calls: DataFrame) -> DataFrame:
    return means(calls.groupBy("feature").agg(*stats()), "feature")


def totals(calls: DataFrame) -> DataFrame:
    """Sums of the features' sums, in the same pass: a mean of means would be wrong."""
    return means(calls.agg(*stats()))


def limitation_kinds(calls: DataFrame) -> DataFrame:
    """kind, class (advisory or quality), n, first_seq, first_pos: in order of first appearance."""
    kinds = calls.select("seq", F.posexplode("limitation_kinds").alias("pos", "kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first")).select("kind", F.when(F.col("kind").isin(*ADVISORY), "advisory").otherwise("quality").alias("class"), "n", F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos"))


def parsed_time(ts: Column) -> Column:
    """RFC 3339 with a zone; anything else is null and left out."""
    return F.try_to_timestamp(F.when(F.rlike(ts, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")), ts))


def period(calls: DataFrame) -> DataFrame:
    at = parsed_time(F.col("ts"))
    return calls.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("parsed")).select(F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), F.round((F.unix_seconds("last") - F.unix_seconds("first")) / 60).cast("bigint").alias("minutes"), "parsed")


def helpful(calls: DataFrame) -> DataFrame:
    """Percent of ratings that are good, cut; no row without ratings."""
    rated = calls.agg(F.count_if(F.col("feedback") == "good").alias("good"), F.count_if(F.col("feedback") == "bad").alias("bad"))
    return rated.where("good + bad > 0").select("good", "bad", F.expr("good * 100 div (good + bad)").cast("bigint").alias("percent"))


def unrated_tail(calls: DataFrame, key: str | None = None) -> DataFrame:
    """Content calls after the last rated one, of the log or of each key: two map-side combined aggregates."""
    content = calls.where(F.col("feature").isin(*CONTENT_FEATURES))
    rated = F.coalesce(F.col("feedback"), F.lit("")) != ""
    keys = [key] if key else []
    grouped = content.groupBy(*keys).agg(F.coalesce(F.max(F.when(rated, F.col("seq"))), F.lit(-1)).alias("last_rated"))
    if not key:
        newest = grouped.first()["last_rated"]
        return content.where(F.col("seq") > newest).agg(F.count("*").alias("unrated"))
    joined = content.join(grouped, key)
    counted = joined.where("seq > last_rated").groupBy(*keys).agg(F.count("*").alias("unrated"))
    return grouped.select(*keys).join(counted, key, "left").select(*keys, F.coalesce("unrated", F.lit(0)).alias("unrated"))


def rate_last(calls: DataFrame, rating: str, at: str) -> DataFrame:
    """The log with the last record rated."""
    if rating not in ("good", "bad"):
        raise ValueError("a rating is good or bad")
    is_last = F.col("seq") == F.lit(calls.agg(F.max("seq")).first()[0])
    return calls.withColumn("feedback", F.when(is_last, rating).otherwise(F.col("feedback"))).withColumn("feedback_at", F.when(is_last, at).otherwise(F.col("feedback_at")))


def shown(calls: DataFrame, n: int = 50) -> DataFrame:
    ratio = F.col("compression_ratio")
    saved = F.when((ratio > 0) & ~F.isnan(ratio), ((1 - ratio) * 100).cast("int")).otherwise(0)
    return last(calls, n).select("seq", "call_id", "feature", "files_included", "budget_used", "latency_ms", saved.alias("saved"))


def log_lines(calls: DataFrame, n: int = 100) -> DataFrame:
    """feature, seed (the first one's base name, +more), note (ERROR, else kinds, else their number)."""
    first = F.substring_index(F.col("seed_files")[0], "/", -1)
    more = F.size("seed_files") - 1
    seed = F.when(F.size("seed_files") == 0, "").when(more > 0, F.concat(first, F.lit(" +"), more.cast("string"))).otherwise(first)
    note = F.when(F.col("has_error"), "ERROR").when(F.size("limitation_kinds") > 0, F.array_join("limitation_kinds", ",")).when(F.col("limitation_count") > 0, F.col("limitation_count").cast("string")).otherwise("")
    return last(calls, n).select("seq", "call_id", "feature", seed.alias("seed"), note.alias("note"))
