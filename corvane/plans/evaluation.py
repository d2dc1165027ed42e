"""Checks of answers: golden members, budgets, ratios, stable results, expected symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.exprs import row_hash, symbol_matches
from corvane.operators import graph as g
from corvane.plans import context as capsule
from corvane.plans import questions
from corvane.session import Stored

# Kinds of scenarios that are carried out; any other one fails with a note.
KINDS = ("golden_files", "budget_compliance", "context_compression", "determinism", "golden_symbols")
DEFAULT_BUDGET, DEFAULT_REPEATS = 3000, 3


def golden(included: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario_id, missing, forbidden, passed. included: scenario_id, rel_path; scenarios: scenario_id, expected_files, forbidden_files."""
    expected = scenarios.select("scenario_id", F.explode_outer("expected_files").alias("rel_path"))
    missing = expected.where("rel_path IS NOT NULL").join(included, ["scenario_id", "rel_path"], "left_anti").groupBy("scenario_id").agg(F.count("*").alias("missing"))
    banned = scenarios.select("scenario_id", F.explode_outer("forbidden_files").alias("rel_path")).join(included, ["scenario_id", "rel_path"], "left_semi").groupBy("scenario_id").agg(F.count("*").alias("forbidden"))
    out = scenarios.select("scenario_id").join(missing, "scenario_id", "left").join(banned, "scenario_id", "left").na.fill(0)
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("forbidden") == 0))


def within_budget(summary: DataFrame) -> DataFrame:
    return summary.select("request", (F.col("used") <= F.col("budget")).alias("passed"))


def compressed(summary: DataFrame, most: float) -> DataFrame:
    return summary.select("request", (F.col("ratio") <= most).alias("passed"))


def result_hash(rows: DataFrame, key: str) -> DataFrame:
    """One digest per key, independent of the order of rows and of anything time-based.

    The rows' digests are added and xor-ed as numbers, so that a key with many rows is combined before the shuffle.
    """
    columns = sorted(c for c in rows.columns if c != key)
    half = lambda at: F.conv(F.substring("h", at, 16), 16, -10).cast("bigint")
    hashed = rows.select(key, row_hash(*[F.col(c) for c in columns]).alias("h"))
    return hashed.groupBy(key).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(half(1).cast("decimal(38,0)")), F.bit_xor(half(17)), F.bit_xor(half(33)), F.bit_xor(half(49))), 256).alias("digest"))


def stable(digests: DataFrame, key: str) -> DataFrame:
    """Whether all repetitions of a key have one digest."""
    return digests.groupBy(key).agg((F.countDistinct("digest") == 1).alias("passed"), F.count("*").alias("runs"))


def symbols_present(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """scenario_id, symbol, present. wanted: scenario_id, root, path, symbol."""
    pairs = wanted.join(symbols.select("root", "path", "name"), ["root", "path"], "left")
    return pairs.groupBy("scenario_id", "symbol").agg(F.coalesce(F.bool_or(symbol_matches(F.col("name"), F.col("symbol"))), F.lit(False)).alias("present"))


def summary(results: DataFrame) -> DataFrame:
    """total, passed, failed, score."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("double")).alias("score"))


def run(graph: g.Graph, scenarios: DataFrame, suite: str | None = None) -> DataFrame:
    """scenario_id, suite, kind, passed, value, note: every scenario of a suite, all of them as one plan.

    scenarios: scenario_id, suite, kind, root, budget, repeat_count, max_ratio, seed_files, expected_files, forbidden_files,
    expected_symbols. Each asks for one capsule over its seeds; ``determinism`` asks as often as it says, at least twice.
    ``value`` is what was measured: missing and forbidden files, tokens used, the ratio, different results, missing symbols.
    """
    wanted = scenarios if suite is None else scenarios.where(F.col("suite") == suite)
    asked = wanted.where(F.col("kind").isin("golden_files", "budget_compliance", "context_compression", "determinism"))
    budget = F.when(F.coalesce("budget", F.lit(0)) > 0, F.col("budget")).otherwise(DEFAULT_BUDGET)
    requests, _ = Stored(graph.files.sparkSession).table(asked.select("root", F.col("scenario_id").alias("request"), F.explode("seed_files").alias("name"), budget.alias("budget"), F.col("kind"), F.when(F.coalesce("repeat_count", F.lit(0)) >= 2, F.col("repeat_count")).otherwise(DEFAULT_REPEATS).alias("repeats")))
    plain = requests.select("root", "request", "name", "budget")
    answer = capsule.context(graph, plain)
    files = golden(answer.rows.select(F.col("request").alias("scenario_id"), "rel_path"), wanted.where("kind = 'golden_files'"))
    out = files.select("scenario_id", "passed", (F.col("missing") + F.col("forbidden")).cast("double").alias("value"))
    summary = answer.summary.withColumnRenamed("request", "scenario_id")
    fits = wanted.where("kind = 'budget_compliance'").select("scenario_id").join(summary, "scenario_id")
    out = out.unionByName(fits.select("scenario_id", (F.col("used") <= F.col("budget")).alias("passed"), F.col("used").cast("double").alias("value")))
    small = wanted.where("kind = 'context_compression'").select("scenario_id", "max_ratio").join(summary, "scenario_id")
    out = out.unionByName(small.select("scenario_id", (F.col("ratio") <= F.col("max_ratio")).alias("passed"), F.col("ratio").alias("value")))
    again = requests.where("kind = 'determinism'")
    most = again.agg(F.max("repeats")).first()[0] or 0
    if most:
        runs = None
        for turn in range(most):
            now = again.where(F.col("repeats") > turn).select("root", "request", "name", "budget")
            digest, _ = Stored(graph.files.sparkSession).table(result_hash(capsule.context(graph, now).rows, "request"))
            runs = digest if runs is None else runs.unionByName(digest)
        same = runs.groupBy("request").agg(F.count_distinct("digest").alias("different"))
        out = out.unionByName(same.select(F.col("request").alias("scenario_id"), (F.col("different") == 1).alias("passed"), F.col("different").cast("double").alias("value")))
    named = wanted.where("kind = 'golden_symbols'").select("scenario_id", "root", F.col("seed_files")[0].alias("path"), F.explode("expected_symbols").alias("symbol"))
    found = questions.symbols(graph.files.join(named.select("root", F.col("path").alias("rel_path")).distinct(), ["root", "rel_path"], "left_semi"))[0]
    lost = symbols_present(found, named).groupBy("scenario_id").agg(F.count_if(~F.col("present")).alias("lost"))
    out = out.unionByName(lost.select("scenario_id", (F.col("lost") == 0).alias("passed"), F.col("lost").cast("double").alias("value")))
    judged = wanted.select("scenario_id", "suite", "kind").join(out, "scenario_id", "left")
    note = F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("kind not carried out: "), "kind")).when(F.col("passed").isNull(), "no answer for the seeds").otherwise("")
    return judged.select("scenario_id", "suite", "kind", F.coalesce("passed", F.lit(False)).alias("passed"), "value", note.alias("note"))
