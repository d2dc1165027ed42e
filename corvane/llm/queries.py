"""Queries over the training-data tables, by problem number, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import abuse, conversations, leakage, mixing, origin, parsing, percentiles, secrets

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The finest cells: any of the coarser ones is a merge of these."""
    return percentiles.percentiles(table(spark, folder, "calls"), ("feature", "project", "day"), ("feature", "project", "day"))


def p1_by_feature(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(table(spark, folder, "calls"), ("feature",), ("feature", "day"))


def p1_by_project(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(table(spark, folder, "calls"), ("feature", "project"), ("feature", "project"))


def p1_certified(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.certified(table(spark, folder, "calls"))


def p1_certified_days(spark: SparkSession, folder: str) -> DataFrame:
    """Per project, merged over days."""
    return percentiles.certified(table(spark, folder, "calls"), key="project", over="day")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.found(table(spark, folder, "files"), table(spark, folder, "context_facts"))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redacted(table(spark, folder, "files"), "file_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, folder, "session_turns")).selectExpr("sid AS session_id")


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "session_turns"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.found(table(spark, folder, "files"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.rates(table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return origin.found(table(spark, folder, "files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The leaked pairs of p6_found, with whether the passage stands there word for word."""
    return leakage.leaks(leakage.stored(table(spark, folder, "documents")), table(spark, folder, "eval_items"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).selection()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels")).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(abuse.scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels")))


P1_CERTIFIED = """
WITH plain AS (
  SELECT DISTINCT call_id, regexp_replace(lower(trim(feature)), '[_\\s]+', '-', 'g') AS feature, latency_ms, compression_ratio FROM calls
), long AS (
  SELECT feature, 'latency_ms' AS metric FROM plain WHERE latency_ms >= 0
  UNION ALL
  SELECT feature, 'compression_ratio' FROM plain WHERE compression_ratio > 0 AND NOT isnan(compression_ratio)
), counted AS (SELECT feature, metric, count(*) AS n FROM long GROUP BY ALL)
SELECT feature, metric, CAST(q AS DOUBLE) AS q, n, true AS within_bound
FROM counted, unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]) AS u(q)
"""


P1_CERTIFIED_DAYS = P1_CERTIFIED.replace("regexp_replace(lower(trim(feature)), '[_\\s]+', '-', 'g') AS feature", "trim(project) AS project").replace("feature", "project").replace("SELECT DISTINCT call_id, trim(project) AS project, latency_ms", "SELECT DISTINCT call_id, trim(project) AS project, feature, latency_ms")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_certified": P1_CERTIFIED, "p1_certified_days": P1_CERTIFIED_DAYS}
