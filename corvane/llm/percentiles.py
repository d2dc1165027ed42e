"""Percentiles of call metrics over any combination of features, projects and days, from mergeable relative-error sketches.

Cells (one sketch for each combination of the asked keys and metric) are the stored form: cells of other partitions,
projects or days merge into coarser ones with the same bound. Stages: repeated deliveries collapse in one hash aggregate
over the projected columns; each partition then sketches its own rows (no group is gathered anywhere), so a hot feature or
project costs one sketch per partition; the sketches, not the values, are shuffled and merged, in two steps.

Cases: ``latency_ms`` null or negative is no measurement (counted in n_missing), zero is one; ``compression_ratio`` null,
NaN or <= 0 is not filled in (n_missing), values above 1 count. Features are compared in lower case with ``_`` and blanks
read as ``-``; a null feature is a group of its own. The day is that of ``ts`` in UTC, of ``received_at`` where ``ts`` is
null or malformed. A call delivered again counts once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.sketch import RelativeSketch, rank_error, runs

MOST_HELD = 20_000  # combinations of keys that a task sketches at once
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
METRICS = ("latency_ms", "compression_ratio")


def call_values(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per call and metric: the keys (feature, project, day), metric, value (null: no measurement)."""
    feature = F.regexp_replace(F.lower(F.trim("feature")), r"[_\s]+", "-")
    # an own offset is honoured; without one the session's zone (UTC) holds
    stamp = F.try_to_timestamp(F.trim("ts"))
    plain = calls.select(
        "call_id",
        feature.alias("feature"),
        F.trim("project").alias("project"),
        F.to_date(F.coalesce(stamp, F.col("received_at").cast("timestamp"))).alias("day") if "day" in keys else F.lit(None).cast("date").alias("day"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.col("compression_ratio").cast("double").alias("compression_ratio"),
    )
    if "day" in keys:
        # only received_at differs between deliveries: the first delivery names the day where ts cannot
        once = plain.groupBy(*[c for c in plain.columns if c != "day"]).agg(F.min("day").alias("day"))
    else:
        once = plain.distinct()
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    ratio = F.when((F.col("compression_ratio") > 0) & ~F.isnan("compression_ratio"), F.col("compression_ratio"))
    return once.select(*keys, latency.alias("latency_ms"), ratio.alias("compression_ratio"))


def schema_of(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys] + ["metric string", "n bigint", "n_missing bigint", "sketch binary"])


def sketch_partitions(keys: Sequence[str], k: int, high: bool, schema: pa.Schema):
    """For mapInArrow: sketches of each combination of keys in the partition.

    No more than ``MOST_HELD`` combinations are held at once; then they go out and begin anew, to be merged with the others.
    """

    def packed(held: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        rows = ((*group, m, s.n, missing, s.to_bytes()) for group, pairs in held.items() for m, (s, missing) in zip(METRICS, pairs))
        while part := list(itertools.islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        # coins of different partitions and rounds are independent, and the same when a task is run again
        here, rounds = TaskContext.get().partitionId() if TaskContext.get() else 0, 0

        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros(table.num_rows, dtype=np.int64)
            names = []
            for key in keys:
                column = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
                column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                names.append(column.dictionary.to_pylist())
                codes = codes * max(1, len(names[-1])) + column.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            sorted_codes = codes[order]
            values = {m: table[m].to_numpy()[order] for m in METRICS}
            for start, end in runs([sorted_codes]):
                code, group = int(sorted_codes[start]), []
                for value in reversed(names):
                    code, at = divmod(code, max(1, len(value)))
                    group.append(value[at])
                group = tuple(reversed(group))
                if group not in held:
                    held[group] = [[RelativeSketch(k, high, hash_seed((here, rounds, *group), m)), 0] for m in METRICS]
                for (sketch, _), pair, metric in zip(held[group], held[group], METRICS):
                    part = values[metric][start:end].astype(float)
                    sketch.update(part)
                    pair[1] += int(np.isnan(part).sum())
            if len(held) > MOST_HELD:
                yield from packed(held)
                held, rounds = {}, rounds + 1
        yield from packed(held)

    return run


def hash_seed(group: tuple, metric: str) -> int:
    seed = 1469598103934665603
    for byte in repr((group, metric)).encode():
        seed = (seed ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return seed


def merge_sorted(keys: Sequence[str], schema: pa.Schema):
    """For mapInArrow over rows sorted by the keys and metric: merge each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sketch, missing, rows = None, None, 0, []

        def close() -> None:
            if sketch is not None:
                rows.append((*current, sketch.n, missing, sketch.to_bytes()))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*keys, "metric", "n_missing", "sketch"]]
            for *group, lost, data in zip(*columns):
                other = RelativeSketch.from_bytes(data)
                if group != current:
                    close()
                    current, sketch, missing = group, other, lost
                else:
                    sketch.merge(other)
                    missing += lost
            if len(rows) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def arrow_schema(df: DataFrame, keys: Sequence[str]) -> pa.Schema:
    kinds = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "int": pa.int32()}
    types = dict(df.dtypes)
    return pa.schema([(key, kinds[types[key]]) for key in keys] + [("metric", pa.string()), ("n", pa.int64()), ("n_missing", pa.int64()), ("sketch", pa.binary())])


def build_cells(values: DataFrame, keys: Sequence[str], k: int = 32, high: bool = True) -> DataFrame:
    """A sketch for each combination of keys and metric."""
    partial = values.mapInArrow(sketch_partitions(keys, k, high, arrow_schema(values, keys)), schema_of(values, keys))
    return merge_cells(partial, keys, local=False)


def merge_cells(cells: DataFrame, keys: Sequence[str], local: bool = True) -> DataFrame:
    """Cells merged to coarser keys: within the partitions first (where a partition may hold several of a key), then across them."""
    keys = list(keys)
    kept = cells.select(*keys, "metric", "n", "n_missing", "sketch")
    merge = merge_sorted(keys, arrow_schema(kept, keys))
    order = [*keys, "metric"]
    if local:
        kept = kept.sortWithinPartitions(*order).mapInArrow(merge, schema_of(kept, keys))
    return kept.repartition(*order).sortWithinPartitions(*order).mapInArrow(merge, schema_of(kept, keys))


def quantile_rows(cells: DataFrame, keys: Sequence[str], qs: Sequence[float] = QUANTILES) -> DataFrame:
    """One row per cell and quantile: q, value and the range of ranks it is certified for (rank_low..rank_high of n)."""
    types = dict(cells.dtypes)
    kinds = {"string": pa.string(), "date": pa.date32()}
    schema = ", ".join([f"`{key}` {types[key]}" for key in keys] + ["metric string, n bigint, n_missing bigint, q double, value double, rank_low bigint, rank_high bigint"])
    arrow = pa.schema([(key, kinds[types[key]]) for key in keys] + [("metric", pa.string()), ("n", pa.int64()), ("n_missing", pa.int64()), ("q", pa.float64()), ("value", pa.float64()), ("rank_low", pa.int64()), ("rank_high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *group, n, missing, data in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*keys, "metric", "n", "n_missing", "sketch"]]):
                sketch = RelativeSketch.from_bytes(data)
                for q, value in zip(qs, sketch.quantiles(qs)):
                    target = max(1, int(np.ceil(q * n - 1e-9))) if n else 0
                    tail = n - target if sketch.high else target
                    slack = int(np.ceil(rank_error(sketch.k) * tail))
                    rows.append((*group, n, missing, q, value, max(0, target - slack), min(n, target + slack)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return cells.mapInArrow(run, schema)


def percentiles(calls: DataFrame, keys: Sequence[str] = ("feature",), finest: Sequence[str] = ("feature", "day"), qs: Sequence[float] = QUANTILES, k: int = 32) -> DataFrame:
    """Percentiles per keys, rolled up from cells of the finest keys."""
    cells = build_cells(call_values(calls, finest), finest, k)
    return quantile_rows(merge_cells(cells, keys) if set(keys) != set(finest) else cells, keys, qs)


def certified(calls: DataFrame, qs: Sequence[float] = QUANTILES, k: int = 32, key: str = "feature", over: str = "project") -> DataFrame:
    """Each reported percentile per key, merged from cells by key and ``over``, with whether its bound holds on exact ranks."""
    found = percentiles(calls, (key,), (key, over), qs, k).withColumnRenamed(key, "feature")
    values = call_values(calls, [key]).withColumnRenamed(key, "feature")
    long = values.select("feature", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("m")).select("feature", "m.*").where("x is not null")
    # ranks come from one pass over the counted values
    bounds = found.where("value is not null").groupBy("feature", "metric").agg(F.collect_list(F.struct("q", "value", "rank_low", "rank_high")).alias("asked"))
    counted = long.groupBy("feature", "metric", "x").agg(F.count("*").alias("c"))
    ranked = (
        counted.join(bounds, counted["feature"].eqNullSafe(bounds["feature"]) & (counted["metric"] == bounds["metric"]))
        .select(counted["feature"], counted["metric"], "x", "c", F.explode("asked").alias("a"))
        .groupBy("feature", "metric", F.col("a.q").alias("q"), F.col("a.rank_low").alias("low"), F.col("a.rank_high").alias("high"))
        .agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") < F.col("a.value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("a.value"), F.col("c")).otherwise(0)).alias("upto"))
    )
    return ranked.select(F.col("feature").alias(key), "metric", "q", F.col("n").cast("bigint").alias("n"), ((F.col("upto") >= F.col("low")) & (F.col("below") < F.greatest("high", F.lit(1)))).alias("within_bound"))
