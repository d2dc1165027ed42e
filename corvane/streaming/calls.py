"""The call log as a stream: metrics per feature and time window, and the unrated tail per project, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corvane.functions.exprs import CONTENT_FEATURES


def windowed(calls: DataFrame, at: str = "received_at", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls, errors and latency per feature and window; rows later than the watermark are dropped, repeats within it too."""
    timed = calls.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["call_id"])
    grouped = timed.groupBy(F.window("_at", window), "feature").agg(F.count("*").alias("calls"), F.count_if("has_error").alias("errors"), F.sum("latency_ms").alias("ms"))
    return grouped.select(F.col("window.start").alias("start"), "feature", "calls", "errors", "ms")


def unrated(calls: DataFrame, key: str = "project") -> DataFrame:
    """key, unrated: content calls since the last rated one, updated as batches arrive.

    State is two numbers per key: the last rated seq and the count after it; order inside a batch is by seq.
    """

    def step(keys, batches, state):
        import pandas as pd

        last, count = state.get if state.exists else (-1, 0)
        parts = [b for b in batches]
        rows = pd.concat(parts).sort_values("seq") if parts else None
        if rows is not None:
            rated = rows.loc[rows["rated"], "seq"]
            if len(rated) and rated.max() > last:
                last, count = int(rated.max()), 0
            count += int(((rows["seq"] > last) & ~rows["rated"]).sum())
        state.update((last, count))
        yield pd.DataFrame({key: [keys[0]], "unrated": [count]})

    content = calls.where(F.col("feature").isin(*CONTENT_FEATURES)).select(key, "seq", (F.coalesce(F.col("feedback"), F.lit("")) != "").alias("rated"))
    return content.groupBy(key).applyInPandasWithState(step, f"{key} string, unrated bigint", "last bigint, count bigint", "update", GroupStateTimeout.NoTimeout)
