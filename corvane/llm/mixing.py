"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

1. Tokens per document of a public tokenizer (the file's path is a parameter); stored once, as small rows.
2. Each source is cut into shards by a seeded hash, each shard, in seeded order, into blocks of ``block_tokens``.
3. Per mix, the highest quotients w / (2 s + 1) give whole numbers of blocks to sources, none more than
   ``max_repeats`` times the blocks it has; what a capped source cannot take goes to the next quotients. The divisor is
   found by bisection, so the number of blocks does not matter. Every source's quota goes to its shards the same way.
4. A shard gives each of its blocks once per full pass and those that start the seeded order once more.

Cases: source names are compared trimmed, in lower case, with blanks and ``-`` as ``_``; documents without source or of
sources no mix names are left out; a null or negative ``max_repeats`` is 1, a null or negative share 0; target rows of one
source in a mix are added (the least cap holds); shares are relative to their sum in the mix; a source without documents
gets nothing and is reported; a null or empty text has no tokens and is never chosen; repeated texts are documents of
their own; ties of quotients go to the larger share, then to the name; an empty documents table gives shares of null.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import Stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 64_000_000
MOST_TARGETS = 100_000  # rows of the targets table, gathered on the driver


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(tokenizer)
        for batch in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, type=pa.int64())], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), source_name(F.col("source")).alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def apportion(weights: dict[str, float], seats: int, caps: dict[str, int]) -> dict[str, int]:
    """Whole numbers summing to ``seats`` (or to all caps, if less) by highest quotients w / (2 s + 1) under the caps."""
    names = [k for k in weights if weights[k] > 0 and caps.get(k, 0) > 0]
    seats = min(seats, sum(caps[k] for k in names))
    given = dict.fromkeys(weights, 0)
    if not names or seats <= 0:
        return given

    def at(divisor: float) -> dict[str, int]:
        return {k: min(caps[k], math.floor(weights[k] / divisor + 0.5)) for k in names}

    low, high = 1e-300, 2.0 * max(weights[k] for k in names) + 1.0  # at high nobody has a seat
    for _ in range(2200):
        middle = math.sqrt(low * high) if high / low > 4 else (low + high) / 2
        if not low < middle < high:
            break
        if sum(at(middle).values()) > seats:
            low = middle
        else:
            high = middle
    given |= at(high)
    # the seats that tie at this divisor, by highest quotient
    rest = seats - sum(given.values())
    while rest > 0:
        k = min((k for k in names if given[k] < caps[k]), key=lambda k: (-weights[k] / (2 * given[k] + 1), -weights[k], k))
        given[k] += 1
        rest -= 1
    return given


class Mix:
    """A plan of mixes over documents: ``shares`` and ``selection``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = 1024, total_tokens: int | None = None, seed: int = 0, shard_tokens: int = SHARD_TOKENS):
        self.spark = documents.sparkSession
        self.block_tokens = block_tokens
        stored = Stored(self.spark)
        rows = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        self.shares_wanted: dict = {}
        self.repeats: dict = {}
        for r in rows:
            if r["source"] is None or r["mix_id"] is None:
                continue
            share = r["target_share"] if r["target_share"] is not None and r["target_share"] > 0 and math.isfinite(r["target_share"]) else 0.0
            cap = r["max_repeats"] if r["max_repeats"] is not None and r["max_repeats"] >= 0 else 1
            wanted, repeats = self.shares_wanted.setdefault(r["mix_id"], {}), self.repeats.setdefault(r["mix_id"], {})
            wanted[r["source"]] = wanted.get(r["source"], 0.0) + share
            repeats[r["source"]] = min(cap, repeats.get(r["source"], cap))
        named = sorted({s for m in self.shares_wanted.values() for s in m})
        counted = token_counts(documents, tokenizer).where(F.col("source").isin(named) & (F.col("tokens") > 0)) if named else token_counts(documents, tokenizer).where("false")
        self.documents, _ = stored.table(counted)
        self.tokens = {r["source"]: r["n"] for r in self.documents.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per named source
        order = F.xxhash64(F.lit(seed), "doc_id")
        # shards of about shard_tokens: a source's shards are its own number, so a hot source has more of them
        number = F.create_map(*[F.lit(x) for s in named for x in (s, self.shard_number(s, shard_tokens))])[F.col("source")] if named else F.lit(1)
        placed = self.documents.withColumn("shard", F.pmod(order, number)).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id"))
        sized = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("held")).collect()  # a row per shard
        self.shards: dict = {}
        for r in sized:
            self.shards.setdefault(r["source"], {})[r["shard"]] = max(1, round(r["held"] / block_tokens))
        cuts = self.spark.createDataFrame([(r["source"], r["shard"], r["held"], self.shards[r["source"]][r["shard"]]) for r in sized], "source string, shard bigint, held bigint, cuts bigint")
        before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        # equal cuts: a shard's blocks differ by no more than a document
        self.blocks = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(cuts, ["source", "shard"]).withColumn("block", F.expr("before * cuts div held")).drop("before", "held", "cuts")
        self.plan = {m: self.plan_mix(m, total_tokens) for m in self.shares_wanted}

    def shard_number(self, source: str, shard_tokens: int) -> int:
        return max(1, math.ceil(self.tokens.get(source, 0) / shard_tokens))

    def plan_mix(self, mix, total_tokens: int | None) -> dict:
        """Per source: quota of blocks; per shard of it: quota. Unless given, the total is the largest at which no source's
        share needs more than its cap, so that targets are met; sources without documents are left out of that."""
        wanted, repeats = self.shares_wanted[mix], self.repeats[mix]
        have = {s: sum(self.shards.get(s, {}).values()) for s in wanted}
        filled = {s: w for s, w in wanted.items() if w > 0 and have[s]}
        largest = min((have[s] * repeats[s] / w for s, w in filled.items()), default=0.0) * sum(filled.values())
        seats = round(total_tokens / self.block_tokens) if total_tokens else math.floor(largest + 1e-9)
        quotas = apportion(wanted, seats, {s: have[s] * repeats[s] for s in wanted})
        return {s: (quotas[s], apportion({k: float(b) for k, b in self.shards.get(s, {}).items()}, quotas[s], {k: b * repeats[s] for k, b in self.shards.get(s, {}).items()})) for s in wanted}

    def selection(self) -> DataFrame:
        """mix_id, doc_id, source, tokens, repeats: the chosen documents."""
        rows = [(m, s, shard, q // self.shards[s][shard], q % self.shards[s][shard]) for m, plan in self.plan.items() for s, (_, per) in plan.items() for shard, q in per.items() if q]
        quotas = self.spark.createDataFrame(rows, "mix_id int, source string, shard bigint, passes bigint, more bigint")
        chosen = self.blocks.join(quotas, ["source", "shard"])
        return chosen.select("mix_id", "doc_id", "source", "tokens", (F.col("passes") + (F.col("block") < F.col("more")).cast("bigint")).alias("repeats")).where("repeats > 0")

    def shares(self) -> DataFrame:
        """mix_id, source, target_share (of 1), quota_blocks, tokens, actual_share, repeats_most, capped."""
        got = self.selection().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("repeats_most"))
        rows = []
        for m, plan in self.plan.items():
            total = sum(self.shares_wanted[m].values())
            for s, (quota, _) in plan.items():
                limit = sum(self.shards.get(s, {}).values()) * self.repeats[m][s]
                rows.append((m, s, self.shares_wanted[m][s] / total if total else 0.0, quota, quota >= limit))
        wanted = self.spark.createDataFrame(rows, "mix_id int, source string, target_share double, quota_blocks bigint, capped boolean")
        whole = F.sum("tokens").over(Window.partitionBy("mix_id"))  # a row per target
        return wanted.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", "quota_blocks", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / whole).alias("actual_share"), F.coalesce("repeats_most", F.lit(0)).alias("repeats_most"), "capped")
