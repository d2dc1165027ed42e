"""Agent sessions as event tables: calls of a tool, what was edited after each, retries, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.exprs import EDIT_TOOLS, calls_tool, seeds_of

PART = 4096  # entries of a session that one task looks at
EVENTS = ["session_id", "entry_idx", "block_idx", "role", "is_call", "is_edit", "file", "command"]


def events(blocks: DataFrame, tool: str) -> DataFrame:
    """Blocks (session_id, entry_idx, block_idx, role, tool, command, file) with is_call and is_edit."""
    return blocks.select("session_id", "entry_idx", "block_idx", "role", calls_tool(F.col("command"), tool).alias("is_call"), F.coalesce(F.col("tool").isin(*EDIT_TOOLS), F.lit(False)).alias("is_edit"), "file", "command")


def blocked(rows: DataFrame) -> DataFrame:
    """With ``part``: stretches of a session by entry number, so that no session, however long, is one task."""
    return rows.withColumn("part", F.floor(F.col("entry_idx") / PART))


def signals(found: DataFrame) -> DataFrame:
    """Per call: how many assistant entries until the first edit and the next call (-1: none), looking no further than that call.

    Later entries only; blocks of the call's own entry do not count. What follows is looked for inside a stretch of the
    session first, then in the summaries of the stretches after it.
    """
    entries = blocked(
        found.groupBy("session_id", "entry_idx").agg(
            F.bool_or(F.col("role") == "assistant").alias("assistant"),
            F.min(F.when(F.col("is_call"), F.col("block_idx"))).alias("call_block"),
            F.min(F.when(F.col("is_edit"), F.col("block_idx"))).alias("edit_block"),
        )
    )
    order = Window.partitionBy("session_id", "part").orderBy("entry_idx")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    call, edit = F.when(F.col("call_block").isNotNull(), F.struct("entry_idx", "call_block", "turn")), F.when(F.col("edit_block").isNotNull(), F.struct("entry_idx", "edit_block", "turn"))
    numbered = entries.withColumn("turn", F.sum(F.col("assistant").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("session_id", "part").agg(F.max("turn").alias("turns"), F.min(call).alias("first_call"), F.min(edit).alias("first_edit"))
    over_parts = Window.partitionBy("session_id").orderBy("part")

    def absolute(x: Column, block: str) -> Column:
        return F.when(x.isNotNull(), F.struct(x["entry_idx"].alias("entry_idx"), x[block].alias(block), (x["turn"] + F.col("offset")).alias("turn")))

    placed = parts.withColumn("offset", F.coalesce(F.sum("turns").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = over_parts.rowsBetween(1, Window.unboundedFollowing)
    beyond = placed.select("session_id", "part", "offset", F.min(absolute(F.col("first_call"), "call_block")).over(later).alias("later_call"), F.min(absolute(F.col("first_edit"), "edit_block")).over(later).alias("later_edit"))
    looked = numbered.withColumn("next_call", F.min(call).over(after)).withColumn("next_edit", F.min(edit).over(after)).join(beyond, ["session_id", "part"])
    looked = looked.select(
        "session_id", "entry_idx", (F.col("turn") + F.col("offset")).alias("turn"),
        F.coalesce(absolute(F.col("next_call"), "call_block"), F.col("later_call")).alias("next_call"),
        F.coalesce(absolute(F.col("next_edit"), "edit_block"), F.col("later_edit")).alias("next_edit"),
    )
    calls = found.where("is_call").select("session_id", "entry_idx", "block_idx", "command")
    joined = calls.join(looked, ["session_id", "entry_idx"])
    before_call = F.col("next_edit").isNotNull() & (F.col("next_call").isNull() | (F.struct(F.col("next_edit.entry_idx"), F.col("next_edit.edit_block")) < F.struct(F.col("next_call.entry_idx"), F.col("next_call.call_block"))))
    return joined.select(
        "session_id", "entry_idx", "block_idx", "command",
        before_call.alias("edit_after"),
        F.when(before_call, F.col("next_edit.turn") - F.col("turn")).otherwise(-1).cast("int").alias("turns_to_edit"),
        F.when(F.col("next_call").isNotNull(), F.col("next_call.turn") - F.col("turn")).otherwise(-1).cast("int").alias("turns_to_call"),
        F.col("next_call.entry_idx").alias("next_entry"), F.col("next_call.call_block").alias("next_block"),
    )


def edited_between(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Per call the distinct files edited after it and before the next call, in order of first edit.

    The call an edit belongs to is the last one in an earlier entry: a running maximum over stretches of a session.
    """
    marked = blocked(found.select("session_id", "entry_idx", "block_idx", "is_edit", "file", F.when(F.col("is_call"), F.struct("entry_idx", "block_idx")).alias("call")))
    ends = marked.groupBy("session_id", "part").agg(F.max("call").alias("last_call"))
    before = ends.select("session_id", "part", F.max("last_call").over(Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    order = Window.partitionBy("session_id", "part").orderBy("entry_idx", "block_idx").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.withColumn("here", F.max("call").over(order)).join(before, ["session_id", "part"]).withColumn("owner", F.coalesce("here", "earlier"))
    owned = running.where("is_edit AND file IS NOT NULL AND owner IS NOT NULL AND entry_idx > owner.entry_idx")
    first = owned.groupBy("session_id", F.col("owner.entry_idx").alias("entry_idx"), F.col("owner.block_idx").alias("block_idx"), "file").agg(F.min(F.struct(owned["entry_idx"].alias("e"), owned["block_idx"].alias("b"))).alias("at"))
    return first.groupBy("session_id", "entry_idx", "block_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files_edited"))


def retries(found: DataFrame) -> DataFrame:
    """Per call whether the next one names a file of the same base name."""
    calls = blocked(found.where("is_call").select("session_id", "entry_idx", "block_idx", F.transform(seeds_of(F.col("command")), lambda p: F.substring_index(p, "/", -1)).alias("names")))
    starts = calls.groupBy("session_id", "part").agg(F.min_by("names", F.struct("entry_idx", "block_idx")).alias("names"))
    after = starts.select("session_id", "part", F.lead("names").over(Window.partitionBy("session_id").orderBy("part")).alias("beyond"))
    order = Window.partitionBy("session_id", "part").orderBy("entry_idx", "block_idx")
    followed = calls.withColumn("following", F.lead("names").over(order)).join(after, ["session_id", "part"])
    return followed.select("session_id", "entry_idx", "block_idx", F.coalesce(F.arrays_overlap("names", F.coalesce("following", "beyond")), F.lit(False)).alias("retry_after"))


def excerpts(entries: DataFrame, reach: int = 3) -> DataFrame:
    """Per call entry up to ``reach`` entries before and after it, the latter stopping before the next call.

    entries: session_id, entry_idx, role, preview, is_call. Entries are numbered by stretches; a call asks for the numbers
    around its own, so neighbours meet by session and number.
    """
    parts = blocked(entries)
    sizes = parts.groupBy("session_id", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select("session_id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("entry_idx"))
    numbered = parts.withColumn("k", inside).join(offsets, ["session_id", "part"]).withColumn("k", F.col("k") + F.col("offset")).select("session_id", "entry_idx", "role", "preview", "is_call", "k")
    asked = numbered.where("is_call").select("session_id", F.col("entry_idx").alias("centre"), F.explode(F.sequence(F.col("k") - reach, F.col("k") + reach)).alias("k"))
    around = asked.join(numbered, ["session_id", "k"]).groupBy("session_id", F.col("centre").alias("entry_idx")).agg(F.array_sort(F.collect_list(F.struct("entry_idx", "role", "preview", "is_call"))).alias("near"))
    stop = F.array_min(F.transform(F.filter("near", lambda x: x["is_call"] & (x["entry_idx"] > F.col("entry_idx"))), lambda x: x["entry_idx"]))
    kept = F.filter("near", lambda x: F.col("stop").isNull() | (x["entry_idx"] < F.col("stop")))
    return around.withColumn("stop", stop).select("session_id", "entry_idx", F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["preview"].alias("preview"))).alias("excerpt"))


def facts(rows: DataFrame) -> DataFrame:
    """Per session: first and last time (as strings, empty ones left out), user and assistant entries."""
    at = F.when(F.col("ts") != "", F.col("ts"))
    entries = rows.groupBy("session_id", "uuid").agg(F.min("role").alias("role"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    return entries.groupBy("session_id").agg(F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.count_if(F.col("role").isin("user", "assistant")).alias("turns"))


def analysis_pack(blocks: DataFrame, tool: str) -> DataFrame:
    """One row per call with all its signals."""
    found = events(blocks, tool)
    calls = signals(found)
    texts = blocks.groupBy("session_id", "entry_idx").agg(F.min("role").alias("role"), F.max(F.coalesce("text", F.lit(""))).alias("preview"), F.bool_or(calls_tool(F.col("command"), tool)).alias("is_call"))
    out = calls.join(edited_between(found, calls), ["session_id", "entry_idx", "block_idx"], "left").join(retries(found), ["session_id", "entry_idx", "block_idx"], "left").join(excerpts(texts), ["session_id", "entry_idx"], "left")
    return out.withColumn("files_edited", F.coalesce("files_edited", F.expr("CAST(array() AS array<string>)"))).drop("next_entry", "next_block")
