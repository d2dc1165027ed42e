"""Conversations rebuilt from message rows: entries, reply components, order, turns, and which conversations to drop.

1. Rows become entries (session, uuid) in one hash aggregate: repeated deliveries collapse, blocks are merged.
2. Reply links (an entry and its parent) give components by large-star/small-star; a session whose entries are one
   component with exactly one first entry is reached as a whole, since every entry has at most one parent.
3. Order: an entry stands after its parent. Where time already rises strictly along every reply, time is that order;
   where it does not (ties, nulls, clock steps, forks), the depth below the first entry is computed by pointer doubling.
4. Next turns are found in two levels: inside blocks of a session, then over block ends, so that no session longer than
   ``BLOCK`` is one task.

Cases: ``session_id`` is compared trimmed and in lower case; rows with a blank or null one are
rebuilt from reply links alone: each component of them is a session, named ``thread:`` and the number of its component (their
``uuid`` must then be unique among them); a null ``uuid``
makes an entry of its own row; repeated rows with clashing fields keep the least value; a preview of only spaces or
zero-width characters is blank; roles and types have the aliases below in any case; an entry that is its own parent is a
cycle; an empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.components import connected_components
from corvane.session import Stored

BLOCK = 4096  # entries of a session that are looked at in one task
PARTS = 256  # blocks of a longer session
USER, ASSISTANT, OTHER = 1, 2, 3
ALIASES = {
    USER: ("user", "human", "customer", "prompter"),
    ASSISTANT: ("assistant", "ai", "model", "bot", "agent"),
    OTHER: ("system", "summary", "file-history-snapshot", "tool", "developer", "meta"),
}
NAMES = {name: code for code, names in ALIASES.items() for name in names}
SOLID = r"[^\s\p{Z}\p{Cf}\p{Cc}ᅟᅠㅤ⠀]"
EDGES = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
PLAIN = r"^[!-~]+$"  # nothing to trim


def trimmed(name: Column) -> Column:
    """In lower case, without blanks of any kind at the ends."""
    return F.lower(F.when(F.rlike(name, F.lit(PLAIN)), name).otherwise(F.regexp_replace(name, EDGES, "")))


def kind_of(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.try_element_at(codes, trimmed(name))


def session_name(column: Column) -> Column:
    return trimmed(F.coalesce(column, F.lit("")))


def has_text(column: Column) -> Column:
    return F.coalesce(F.rlike(column, F.lit(SOLID)), F.lit(False))


def parsed_time(ts: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(F.trim(ts)))


def entries(turns: DataFrame) -> DataFrame:
    """One row per entry: sid, uuid, s (session), id, parent (null for a first entry), kind, content (0/1), at (microseconds)."""
    rows = turns.select(
        session_name(F.col("session_id")).alias("sid"),
        F.coalesce("uuid", F.concat(F.lit("row:"), F.col("turn_id").cast("string"))).alias("uuid"),
        F.col("parent_uuid").alias("parent"),
        F.coalesce(kind_of(F.col("role")), kind_of(F.col("entry_type"))).alias("kind"),
        (has_text(F.col("content_preview")) | has_text(F.col("tool"))).cast("int").alias("content"),
        parsed_time(F.col("ts")).alias("at"),
    )
    rows = rows.select("sid", "uuid", F.when(F.col("parent").isNotNull(), F.xxhash64("sid", "parent")).alias("parent"), "kind", "content", "at")
    once = rows.groupBy("sid", "uuid").agg(F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.max("content").alias("content"), F.min("at").alias("at"))
    # from here on 64-bit hashes stand for sessions and entries
    return once.select("sid", "uuid", F.xxhash64("sid").alias("s"), F.xxhash64("sid", "uuid").alias("id"), "parent", "kind", "content", "at")


def reply_components(found: DataFrame, stored: Stored) -> DataFrame:
    """(id, component) of the entries, over reply links."""
    links = found.where("parent is not null").select(F.col("id").alias("u"), F.col("parent").alias("v"))
    return connected_components(links, stored)


def threads(found: DataFrame, components: DataFrame) -> DataFrame:
    """The entries, those without a session in sessions of their own: the components of their reply links."""
    blank = found.where("sid = ''").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    name = F.concat(F.lit("thread:"), F.lower(F.hex("component")))
    named = blank.withColumn("sid", name).withColumn("s", F.xxhash64("sid")).drop("component")
    return found.where("sid <> ''").unionByName(named.select(found.columns))


def session_facts(found: DataFrame, components: DataFrame) -> DataFrame:
    """Per session: first entries, whether all lie in one component, whether a kind is unknown, turns with content."""
    own = found.select("s", "id", F.col("parent").isNull().alias("first"), "kind", "content")
    labelled = own.join(components.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return labelled.groupBy("s").agg(
        F.count_if("first").alias("firsts"),
        (F.min("component") != F.max("component")).alias("split"),
        F.bool_or(F.col("kind").isNull()).alias("unknown"),
        F.max(F.when(F.col("kind") == USER, F.col("content")).otherwise(0)).alias("user"),
        F.max(F.when(F.col("kind") == ASSISTANT, F.col("content")).otherwise(0)).alias("assistant"),
    )


def depths(found: DataFrame, stored: Stored, most_rounds: int = 60) -> DataFrame:
    """(id, depth): steps from the entry up to its first entry, by pointer doubling. Only for sessions without cycles."""
    current, path = stored.table(found.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    for _ in range(most_rounds):
        if current.where("up is not null").isEmpty():
            return current.select("id", "depth")
        above = current.select(F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more"))
        stepped = current.join(above.hint("shuffle_hash"), "up", "left").select("id", F.col("next_up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        following, next_path = stored.table(stepped)
        stored.drop(path)
        current, path = following, next_path
    raise RuntimeError("depths not stable: there is a cycle")


def ordered(found: DataFrame, whole: DataFrame, stored: Stored) -> DataFrame:
    """Entries of the sessions in ``whole`` (reached from one first entry), with ``pos``: rises along every reply."""
    kept = found.select("s", "id", "parent", "kind", "content", "at").join(whole.select("s"), "s", "left_semi")
    above = kept.select(F.col("id").alias("parent"), F.col("at").alias("before"))  # a row per entry
    rises = F.col("at").isNotNull() & (F.col("parent").isNull() | F.coalesce(F.col("before") < F.col("at"), F.lit(False)))
    # per parent first: several replies to one entry have no order by time alone
    replies = kept.join(above.hint("shuffle_hash"), "parent", "left").groupBy("s", "parent").agg(F.bool_and(rises).alias("rises"), F.count("*").alias("n"))
    timed = replies.groupBy("s").agg((F.bool_and("rises") & (F.max("n") <= 1)).alias("timed"))
    marked, _ = stored.table(kept.join(timed, "s"))
    odd = marked.where("not timed")
    by_time = marked.where("timed").select("s", "id", "kind", "content", F.col("at").alias("pos"), F.lit(0).cast("bigint").alias("tie"))
    by_depth = odd.join(depths(odd, stored).hint("shuffle_hash"), "id").select("s", "id", "kind", "content", F.col("depth").alias("pos"), F.coalesce("at", F.lit(0)).alias("tie"))
    return by_time.unionByName(by_depth)


def blocked(placed: DataFrame) -> DataFrame:
    """With ``block``: parts of a session in its order, with about as many entries each; a session up to BLOCK is one block.

    The cuts are quantiles of the session's own places, so an outlier in time moves no more than itself.
    """
    long = placed.groupBy("s").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("s")
    fractions = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    cuts = placed.select("s", "pos").join(long, "s").groupBy("s").agg(F.percentile_approx("pos", fractions, F.lit(20 * PARTS)).alias("cuts"))
    # only sessions longer than a block have cuts: few rows
    below = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda n, cut: n + (cut < F.col("pos")).cast("bigint"))
    return placed.join(cuts, "s", "left").withColumn("block", F.coalesce(below, F.lit(0).cast("bigint"))).drop("cuts")


def unanswered(placed: DataFrame) -> DataFrame:
    """Sessions in which a user turn with content has no assistant turn with content before the next one or the end."""
    turns = blocked(placed.where((F.col("content") == 1) & F.col("kind").isin(USER, ASSISTANT)))
    inside = Window.partitionBy("s", "block").orderBy("pos", "tie", "id")
    following = turns.withColumn("next_kind", F.lead("kind").over(inside)).withColumn("rank", F.row_number().over(inside))
    # of a block only its first kind, its last kind and whether it holds an open question inside go on
    ends = following.groupBy("s", "block").agg(
        F.max(F.when(F.col("rank") == 1, F.col("kind"))).alias("first_kind"),
        F.max(F.when(F.col("next_kind").isNull(), F.col("kind"))).alias("last_kind"),
        F.bool_or((F.col("kind") == USER) & F.coalesce(F.col("next_kind") == USER, F.lit(False))).alias("open"),
    )
    after = ends.withColumn("next_first", F.lead("first_kind").over(Window.partitionBy("s").orderBy("block")))
    return after.groupBy("s").agg(F.bool_or(F.col("open") | ((F.col("last_kind") == USER) & (F.coalesce("next_first", F.lit(USER)) == USER))).alias("open")).where("open").select("s")


def sessions(turns: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sid, s, reason) of the sessions to drop, the ordered entries of the others (and maybe more), and all entries."""
    stored = Stored(turns.sparkSession)
    found, _ = stored.table(entries(turns))
    components = reply_components(found, stored)
    if not found.where("sid = ''").isEmpty():
        found, _ = stored.table(threads(found, components))
    facts, _ = stored.table(session_facts(found, components))
    broken = F.col("unknown") | F.col("split") | (F.col("firsts") != 1)
    empty = (F.col("user") == 0) | (F.col("assistant") == 0)
    # only where nothing else speaks against a session does its order matter
    placed = ordered(found, facts.where(~broken & ~empty), stored)
    if keep:
        placed, _ = stored.table(placed)
    lost = facts.where(broken | empty).select("s", F.when(broken, "broken").otherwise("empty").alias("reason"))
    reasons = lost.unionByName(unanswered(placed).select("s", F.lit("unanswered").alias("reason")))
    names = found.select("s", "sid").join(reasons.select("s"), "s", "left_semi").distinct()
    return reasons.join(names, "s").select("sid", "s", "reason"), placed, found


def dropped_sessions(turns: DataFrame) -> DataFrame:
    return sessions(turns, keep=False)[0].select("sid", "reason")


def conversations(turns: DataFrame) -> DataFrame:
    """Turns of the kept sessions: session_id, position, block, role, preview, tools.

    ``position`` counts from 1 through the session; a turn has the previews of its blocks, in order, and its tools.
    """
    drop, placed, found = sessions(turns, keep=True)
    good = placed.where(F.col("kind").isin(USER, ASSISTANT)).join(drop.select("s"), "s", "left_anti")
    parts = blocked(good)
    inside = Window.partitionBy("s", "block").orderBy("pos", "tie", "id")
    numbered = parts.withColumn("rank", F.row_number().over(inside))
    sizes = parts.groupBy("s", "block").agg(F.count("*").alias("m"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("m").over(Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    positions = numbered.join(offsets.select("s", "block", "offset"), ["s", "block"]).select("id", (F.col("offset") + F.col("rank")).alias("position"))
    placed_turns = positions.join(found.select("id", "sid", "kind"), "id").select("id", "sid", "kind", "position")
    texts = turns.select(F.xxhash64(session_name(F.col("session_id")), F.coalesce("uuid", F.concat(F.lit("row:"), F.col("turn_id").cast("string")))).alias("id"), "block_idx", "content_preview", "tool").distinct()
    blocks = texts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "content_preview", "tool"))).alias("b"))
    return placed_turns.join(blocks, "id").select(
        F.col("sid").alias("session_id"),
        "position",
        F.when(F.col("kind") == USER, "user").otherwise("assistant").alias("role"),
        F.array_join(F.filter(F.transform("b", lambda x: x["content_preview"]), has_text), "\n").alias("preview"),
        F.filter(F.transform("b", lambda x: x["tool"]), has_text).alias("tools"),
    )
