"""Context capsules: ranked files for a change, in two tiers under a token budget. Many requests run as one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import exprs
from corvane.operators import budget as fit
from corvane.operators import graph as g
from corvane.operators import match
from corvane.session import Stored

REASONS = {1: "requested file", 2: "imported by a requested file", 3: "imports a requested file", 4: "same unit as a requested file", 5: "test of a requested file"}


class Capsule(NamedTuple):
    rows: DataFrame  # request, rank, rel_path, language, role, score, reason, tokens, tier, content_mode, content
    summary: DataFrame
    limitations: DataFrame


BLOCK = ["root", "unit", "test", "role"]  # of the files of a unit, those that every request ranks alike


class Considered(NamedTuple):
    """What requests consider, without a row for each of their files: single files, and blocks of a unit's files."""

    singles: DataFrame  # root, request, path, priority, score, known columns of the file, block: whether it lies in a reached block
    reached: DataFrame  # root, request, unit, test, role, priority, score
    scanned: DataFrame  # request, edges_scanned


def scored(rows: DataFrame) -> DataFrame:
    """The score of the first relation that holds; a test that imports the seed gets 0.70."""
    scores = F.create_map(*[F.lit(x) for pair in match.SCORES.items() for x in pair])
    return rows.withColumn("score", F.when((F.col("priority") == 3) & (F.col("role") == "test"), 0.7).otherwise(scores[F.col("priority")]))


def consider(graph: g.Graph, known: DataFrame, blocks: DataFrame, seeds: DataFrame, allowed: tuple[str, ...] = ()) -> Considered:
    """seeds: root, request, src; known: the files with their blocks; blocks: how many files each has (n)."""
    stored = Stored(known.sparkSession)
    marks = F.create_map(*[F.lit(x) for pair in match.PRIORITY.items() for x in pair])
    some = lambda rows: rows.where(F.col("relation").isin(*allowed)) if allowed else rows
    files = seeds.select("root", "src").distinct()
    loose, _ = stored.table(some(seeds.join(g.file_relations(graph, files), ["root", "src"])).select("root", "request", "dst", "relation"))
    steps = [g.unit_steps(group, files) for group in graph.groups]
    roles = known.select("root", F.col("path").alias("src"), F.col("role").alias("src_role"))
    led = g.told_tests(steps[0].unionByName(steps[1]).withColumnRenamed("to_unit", "unit").join(blocks.select(*BLOCK, "n"), ["root", "unit"]))
    # a seed is no relative of its own
    others = F.col("n") - (F.col("relation").isin("peers", "tests") & (F.col("test") == F.col("src_test")) & (F.col("role") == F.col("src_role"))).cast("bigint")
    led = some(led.join(roles, ["root", "src"])).select(*BLOCK, "src", "relation", others.alias("n")).where("n > 0")
    asked, _ = stored.table(seeds.join(led, ["root", "src"]).select("request", *BLOCK, marks[F.col("relation")].alias("priority"), "n"))
    reached, _ = stored.table(scored(asked.groupBy("request", *BLOCK).agg(F.min("priority").alias("priority"))))
    own = seeds.select("root", "request", F.col("src").alias("path"), F.lit(1).alias("priority"))
    first = own.unionByName(loose.select("root", "request", F.col("dst").alias("path"), marks[F.col("relation")].alias("priority"))).groupBy("root", "request", "path").agg(F.min("priority").alias("priority"))
    placed = first.join(known, ["root", "path"]).join(reached.select("request", *BLOCK, F.col("priority").alias("_p")), ["request", *BLOCK], "left")
    singles, _ = stored.table(scored(placed.withColumn("priority", F.least("priority", "_p")).withColumn("block", F.col("_p").isNotNull()).drop("_p")))
    scanned = loose.select("request", F.lit(1).cast("bigint").alias("n")).unionByName(asked.select("request", "n")).groupBy("request").agg(F.sum("n").alias("edges_scanned"))
    return Considered(singles, reached, scanned)


def lots_of(found: Considered, blocks: DataFrame) -> DataFrame:
    """request, score, n, tokens, actual: sums over the files that a request considers, those of one block together."""
    singles = found.singles.withColumn("actual", F.when(F.col("score") >= 1, F.col("near")).otherwise(F.col("far")))
    held = found.singles.where("block").groupBy("request", *BLOCK).agg(F.count("*").alias("_n"), F.sum("tokens").alias("_tokens"), F.sum("far").alias("_far"))
    rest = found.reached.join(blocks, BLOCK).join(held, ["request", *BLOCK], "left")
    less = lambda c: (F.col(c) - F.coalesce(f"_{c}", F.lit(0))).cast("bigint")
    whole = rest.select("request", "score", less("n").alias("n"), less("tokens").alias("tokens"), less("far").alias("actual")).where("n > 0")
    return singles.select("request", "score", F.lit(1).cast("bigint").alias("n"), F.col("tokens").cast("bigint").alias("tokens"), F.col("actual").cast("bigint").alias("actual")).unionByName(whole)


FILE = ["request", "root", "path", "language", "role", "priority", "score", "tokens", "actual", "mode"]


def expanded(found: Considered, known: DataFrame, which: str) -> DataFrame:
    """The files that requests consider, one by one, where ``which`` holds of the score."""
    near = F.col("score") >= 1
    singles = found.singles.where(which).withColumn("actual", F.when(near, F.col("near")).otherwise(F.col("far"))).withColumn("mode", F.when(near, F.col("near_mode")).otherwise(F.col("far_mode")))
    members = found.reached.where(which).join(known, BLOCK).join(found.singles.select("root", "request", "path"), ["root", "request", "path"], "left_anti")
    return singles.select(*FILE).unionByName(members.withColumn("actual", F.col("far")).withColumn("mode", F.col("far_mode")).select(*FILE))


def fitted(found: Considered, known: DataFrame, room: DataFrame) -> DataFrame:
    """Tier 2: first fit against what tier 1 leaves of the budget: the full size must fit, what is then used is the actual size.

    Of a block's files of one size only those that come first can be taken, as many as there is room for tokens, and some more
    for those that are single files of the request; the others are never joined to it. room: request, room.
    """
    room = room.where("room > 0")
    extra = found.singles.where("block").groupBy("request").agg(F.count("*").alias("_s"))
    wanted = found.reached.where("score < 0.8").join(room, "request").join(extra, "request", "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    most = wanted.groupBy(*BLOCK).agg(F.max("room").alias("_room"), F.max("_s").alias("_more"))
    numbered = known.join(most, BLOCK).where("tokens <= _room").withColumn("_k", F.row_number().over(Window.partitionBy(*BLOCK, "tokens").orderBy("path"))).where("_k <= _room + _more").drop("_room", "_more")
    members = wanted.join(numbered, BLOCK).where("tokens <= room AND _k <= room + _s").join(found.singles.select("root", "request", "path"), ["root", "request", "path"], "left_anti")
    queue = members.withColumn("actual", F.col("far")).withColumn("mode", F.col("far_mode")).select(*FILE, "room")
    single = found.singles.where("score < 0.8").join(room, "request").withColumn("actual", F.col("far")).withColumn("mode", F.col("far_mode")).select(*FILE, "room")
    return fit.first_fit(queue.unionByName(single), ["request"], [F.col("score").desc(), F.col("path"), F.col("root")], F.col("room"), "tokens", "actual").select(*FILE)


def context(graph: g.Graph, requests: DataFrame, allowed: tuple[str, ...] = (), depth: str = "full", changed: DataFrame | None = None, symbols: DataFrame | None = None) -> Capsule:
    """requests: root, request, name (file or directory), budget. changed: root, path (an empty one means all in full).

    Tier 1 (score 0.8 and more) is always in, tier 2 as far as the budget goes. Files of a unit are met as blocks, whose sums
    answer for all of them, so that many requests over large units need no row for each pair of request and file; only
    ``rows``, which are as many as the files sent, has them.
    """
    files = graph.files
    seeds, missing = match.find(files, requests.select("root", "name"))
    stored = Stored(files.sparkSession)  # what several parts of the answer read is computed once
    per_request, _ = stored.table(requests.join(match_names(files, requests), ["root", "name"]).select("root", "request", "src").distinct())
    outlines = files.select("root", F.col("rel_path").alias("path"), "text")
    if symbols is not None:
        named = symbols.groupBy("root", "path").agg(exprs.outline(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"])).alias("outline"))
        outlines = outlines.join(named, ["root", "path"], "left")
    else:
        outlines = outlines.withColumn("outline", F.lit(None).cast("string"))
    short = F.coalesce("outline", exprs.first_lines(F.col("text")))
    known = files.select("root", F.col("rel_path").alias("path"), "language", "role", "tokens")
    touched = changed is not None and not changed.isEmpty()
    if touched:
        known = known.join(changed.select("root", "path", F.lit(True).alias("touched")).distinct(), ["root", "path"], "left")
    # near: of the files asked for, far: of all others
    near = F.lit("signatures" if depth == "signatures" else "full")
    far = F.when(F.col("touched").isNull(), "signatures").otherwise("full") if touched and depth != "signatures" else near
    known = known.withColumn("near_mode", near).withColumn("far_mode", far)
    if touched or depth == "signatures":
        known = known.join(outlines.select("root", "path", exprs.tokens(short).alias("short_tokens")), ["root", "path"])
    for name in ("near", "far"):
        known = known.withColumn(name, F.when(F.col(f"{name}_mode") == "full", F.col("tokens")).otherwise(F.col("short_tokens")) if "short_tokens" in known.columns else F.col("tokens"))
    units = [group.unit_files.select("root", "path", F.col("unit_id").alias("unit"), "test") for group in graph.groups]
    known, _ = stored.table(known.join(units[0].unionByName(units[1]), ["root", "path"], "left").drop("touched", "short_tokens"))
    blocks, _ = stored.table(known.where("unit IS NOT NULL").groupBy(*BLOCK).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("far").alias("far")))
    found = consider(graph, known, blocks, per_request, allowed)
    limits = requests.groupBy("request").agg(F.max("budget").cast("bigint").alias("budget"))
    lots, _ = stored.table(lots_of(found, blocks))
    first = lots.groupBy("request").agg(F.sum(F.when(F.col("score") >= 0.8, F.col("tokens")).otherwise(0)).alias("tier1"))
    room = first.join(limits, "request").select("request", F.greatest(F.col("budget") - F.col("tier1"), F.lit(0)).alias("room"))
    taken, _ = stored.table(fitted(found, known, room))
    included = expanded(found, known, "score >= 0.8").withColumn("tier", F.lit(1)).unionByName(taken.withColumn("tier", F.lit(2)))
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), "path")
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    content = outlines.select("root", "path", "text", short.alias("short"))
    rows = included.withColumn("rank", F.row_number().over(order)).join(content, ["root", "path"]).select("request", "rank", F.col("path").alias("rel_path"), "language", "role", "score", reasons[F.col("priority")].alias("reason"), F.col("actual").alias("tokens"), "tier", F.col("mode").alias("content_mode"), F.when(F.col("mode") == "full", F.col("text")).otherwise(F.col("short")).alias("content"))
    summary = summarise(lots, taken).join(limits, "request").join(found.scanned, "request", "left").withColumn("edges_scanned", F.coalesce("edges_scanned", F.lit(0)))
    over = summary.where("critical_tokens > budget").select("request", F.lit("critical_path_over_budget").alias("kind"))
    cut = summary.where("contextual_out > 0").select("request", F.lit("contextual_trimmed").alias("kind"))
    lost = missing.join(requests.select("root", "request", "name"), ["root", "name"]).select("request", F.lit("seed_file_not_found").alias("kind"))
    return Capsule(rows, summary, over.unionByName(cut).unionByName(lost))


def match_names(files: DataFrame, requests: DataFrame) -> DataFrame:
    """root, name, src: every file a request's name stands for."""
    parts = F.split("rel_path", "/")
    every = files.select("root", F.col("rel_path").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("name"))
    return every.join(requests.select("root", "name").distinct(), ["root", "name"], "left_semi")


def summarise(lots: DataFrame, taken: DataFrame) -> DataFrame:
    """The counts of each request: lots are all files considered, taken those of tier 2 that fit."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    first = F.col("score") >= 0.8
    sums = lots.groupBy("request").agg(
        total("n").alias("considered"),
        total(F.when(first, F.col("n"))).alias("critical"),
        total(F.when(first, F.col("tokens"))).alias("critical_tokens"),
        total(F.when(first, F.col("actual"))).alias("_critical_used"),
        total(F.when(~first, F.col("tokens"))).alias("_contextual_tokens"),
        total(F.when(F.col("score") >= 1, F.col("tokens"))).alias("seed_only_tokens"),
    )
    fits = taken.groupBy("request").agg(F.count("*").alias("contextual_in"), total("tokens").alias("_taken_tokens"), total("actual").alias("contextual_in_tokens"))
    out = sums.join(fits, "request", "left").na.fill(0, ["contextual_in", "_taken_tokens", "contextual_in_tokens"])
    out = out.withColumn("included", F.col("critical") + F.col("contextual_in")).withColumn("excluded", F.col("considered") - F.col("included")).withColumn("contextual_out", F.col("excluded"))
    out = out.withColumn("contextual_out_tokens", F.col("_contextual_tokens") - F.col("_taken_tokens")).withColumn("used", F.col("_critical_used") + F.col("contextual_in_tokens"))
    out = out.drop("_critical_used", "_contextual_tokens", "_taken_tokens")
    whole = F.col("critical_tokens") + F.col("contextual_in_tokens") + F.col("contextual_out_tokens")
    return out.withColumn("total", whole).withColumn("ratio", F.when(F.col("total") > 0, exprs.ratio_cut(F.col("used") / F.col("total"))).otherwise(0.0)).withColumn("avoided", F.greatest(F.col("total") - F.col("used"), F.lit(0)))
