"""Questions over the file graph: related files, tests, impact, explanation, overview, failures, verification, symbols."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import exprs
from corvane.operators import budget as fit
from corvane.operators import graph as g
from corvane.operators import match
from corvane.sources import files as tree
from corvane.sources import logs

# How sure each relation is.
RELATED = {"imports": 0.92, "importers": 0.88, "tests": 0.90, "peers": 0.75}
ORDER = {"imports": 1, "importers": 2, "tests": 3, "peers": 4}


def mapped(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def related(graph: g.Graph, seeds: DataFrame) -> DataFrame:
    """root, src, rel_path, relation, confidence, tokens, authority: each file once, by the first relation that has it."""
    edges = g.relations(graph, seeds).withColumn("ord", mapped(ORDER)[F.col("relation")])
    first = edges.groupBy("root", "src", "dst").agg(F.min(F.struct("ord", "relation", "authority")).alias("m"))
    known = first.join(graph.files.select("root", F.col("rel_path").alias("dst"), "tokens"), ["root", "dst"])
    return known.select("root", "src", F.col("dst").alias("rel_path"), F.col("m.relation").alias("relation"), mapped(RELATED)[F.col("m.relation")].alias("confidence"), "tokens", F.col("m.authority").alias("authority"))


def tests_of(graph: g.Graph, seeds: DataFrame) -> DataFrame:
    """Tests by unit (0.95) and files of role test that import the seed (0.97); the unit's signal wins."""
    edges = g.relations(graph, seeds, ("tests", "importers")).join(graph.files.select("root", F.col("rel_path").alias("dst"), "role"), ["root", "dst"])
    signals = edges.where((F.col("relation") == "tests") | (F.col("role") == "test")).withColumn("ord", F.when(F.col("relation") == "tests", 1).otherwise(2))
    once = signals.groupBy("root", "src", "dst").agg(F.min("ord").alias("ord"))
    routed = once.join(tree.file_runner(graph.files), "root", "left")
    return routed.select("root", "src", F.col("dst").alias("rel_path"), exprs.run_command(F.col("dst"), F.coalesce("system", F.lit(""))).alias("run_command"), F.when(F.col("ord") == 1, 0.95).otherwise(0.97).alias("confidence"))


def all_tests(files: DataFrame, budget: int) -> DataFrame:
    """All tests of a tree in path order, up to the first that overflows the budget."""
    return fit.prefix_fit(files.where("role = 'test'").select("root", "rel_path", "tokens"), ["root"], [F.col("rel_path")], budget, "tokens").select("root", "rel_path", F.lit(0.5).alias("confidence"), "running")


def impact(graph: g.Graph, changed: DataFrame) -> DataFrame:
    """root, kind (changed, impacted, test, generated_warning), rel_path, via, confidence: one step back. changed: root, src."""
    own = changed.join(graph.files.select("root", F.col("rel_path").alias("src"), "role"), ["root", "src"], "left")
    back = g.relations(graph, changed, ("importers",)).join(changed.select("root", F.col("src").alias("dst")), ["root", "dst"], "left_anti")
    hit = back.groupBy("root", "dst").agg(F.min("src").alias("via"))
    rows = own.select("root", F.lit("changed").alias("kind"), F.col("src").alias("rel_path"), F.lit(None).cast("string").alias("via"), F.lit(1.0).alias("confidence"))
    rows = rows.unionByName(hit.select("root", F.lit("impacted").alias("kind"), F.col("dst").alias("rel_path"), "via", F.lit(0.88).alias("confidence")))
    tests = tests_of(graph, changed).groupBy("root", "rel_path").agg(F.min("src").alias("via"), F.max("confidence").alias("confidence"))
    rows = rows.unionByName(tests.select("root", F.lit("test").alias("kind"), "rel_path", "via", "confidence"))
    return rows.unionByName(own.where("role = 'generated'").select("root", F.lit("generated_warning").alias("kind"), F.col("src").alias("rel_path"), F.lit(None).cast("string").alias("via"), F.lit(1.0).alias("confidence")))


def transitive_impact(graph: g.Graph, changed: DataFrame, most_steps: int = 50) -> DataFrame:
    """Everything that depends on the changed files, with its distance: an extension over file-level edges."""
    return g.closure(g.reverse(graph.edges), changed, most_steps)


DECLARED = {
    "Go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?(\w+)|type\s+(\w+))",
    "C#": r"(?m)\b(?:class|interface|enum|struct|record)\s+(\w+)",
    "JavaScript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+(\w+)",
    "TypeScript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|type)\s+(\w+)",
}


def symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, path, name, kind, ord; limitations): Python by its syntax tree, others by their declarations."""
    schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("ord", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for root, path, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                try:
                    body = ast.parse(text or "").body
                except (SyntaxError, ValueError, RecursionError):
                    continue
                found = []

                def visit(nodes: list, prefix: str) -> None:
                    for node in nodes:
                        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            found.append((prefix + node.name, "class" if isinstance(node, ast.ClassDef) else "function"))
                            if isinstance(node, ast.ClassDef):
                                visit(node.body, prefix + node.name + ".")

                visit(body, "")
                rows += [(root, path, name, kind, k) for k, (name, kind) in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    python = files.where("language = 'Python' AND text IS NOT NULL").select("root", F.col("rel_path").alias("path"), "text").mapInArrow(run, "root string, path string, name string, kind string, ord int")
    out = python
    for lang, pattern in DECLARED.items():
        names = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        if lang == "Go":
            names = F.transform(F.arrays_zip(names.alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("b")), lambda x: F.concat(x["a"], x["b"]))
        part = files.where((F.col("language") == lang) & F.col("text").isNotNull()).select("root", F.col("rel_path").alias("path"), F.posexplode(names).alias("ord", "name"))
        out = out.unionByName(part.select("root", "path", "name", F.lit("declaration").alias("kind"), F.col("ord").cast("int").alias("ord")))
    limits = files.where(~F.col("language").isin("Python", *DECLARED)).select("root", F.lit("lsp_not_available").alias("kind"), F.lit("no symbol source for this language").alias("message"), F.col("rel_path").alias("scope"))
    return out, limits


def find_symbols(found: DataFrame, part: str) -> DataFrame:
    return found.where(F.contains(F.lower("name"), F.lit(part.lower())))


def explain(graph: g.Graph, seeds: DataFrame) -> DataFrame:
    """root, src, section, value, detail, ord: symbols, imports, dependents, tests, peers, risks, packages of files."""
    own = graph.files.join(seeds.select("root", F.col("src").alias("rel_path")), ["root", "rel_path"], "left_semi")
    head = own.select("root", F.col("rel_path").alias("src"), F.lit("file").alias("section"), F.col("role").alias("value"), F.col("language").alias("detail"), F.col("tokens").cast("int").alias("ord"))
    named, _ = symbols(own)
    rows = head.unionByName(named.select("root", F.col("path").alias("src"), F.lit("symbol").alias("section"), F.col("name").alias("value"), F.col("kind").alias("detail"), "ord"))
    sections = {"imports": "import", "importers": "dependent", "tests": "test", "peers": "peer"}
    edges = g.relations(graph, seeds)
    order = F.row_number().over(Window.partitionBy("root", "src", "relation").orderBy("dst")) - 1
    rows = rows.unionByName(edges.select("root", "src", "dst", "relation", "authority").distinct().select("root", "src", mapped(sections)[F.col("relation")].alias("section"), F.col("dst").alias("value"), F.col("authority").alias("detail"), order.cast("int").alias("ord")))
    risks = own.select("root", F.col("rel_path").alias("src"), F.posexplode(exprs.risk_notes(F.col("rel_path"), F.col("role"))).alias("ord", "value")).select("root", "src", F.lit("risk").alias("section"), "value", F.lit("").alias("detail"), "ord")
    rows = rows.unionByName(risks)
    for group in graph.groups:
        if group.packages is not None:
            mine = group.unit_files.join(seeds.select("root", F.col("src").alias("path")), ["root", "path"]).join(group.packages, ["root", "unit_id"])
            rows = rows.unionByName(mine.select("root", F.col("path").alias("src"), F.lit("package").alias("section"), F.col("name").alias("value"), F.col("version").alias("detail"), F.lit(0).alias("ord")))
    return rows


def overview(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """root, section, value, notes, ord: languages, systems, top level, config files, notable directories, generated areas."""
    def numbered(rows: DataFrame, section: str, *order) -> DataFrame:
        return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("root").orderBy(*order)) - 1).cast("int")).select("root", F.lit(section).alias("section"), "value", "notes", "ord")

    parts = F.split("rel_path", "/")
    out = numbered(tree.languages(files, "root").select("root", F.col("language").alias("value"), F.col("files").cast("string").alias("notes"), "files"), "language", F.col("files").desc(), "value")
    out = out.unionByName(numbered(tree.build_systems(files).select("root", F.col("name").alias("value"), F.lit("").alias("notes"), "phase"), "build_system", "phase", "value"))
    out = out.unionByName(numbered(tree.test_systems(files).select("root", F.col("name").alias("value"), F.lit("").alias("notes"), "phase"), "test_system", "phase", "value"))
    first = files.groupBy("root", parts[0].alias("value")).agg(F.min(F.struct(parts.alias("walk"), F.col("role").alias("role"))).alias("m"))
    out = out.unionByName(numbered(first.select("root", "value", exprs.top_note(F.col("value"), F.col("m.role")).alias("notes"), "m"), "top_level", F.col("m.walk")))
    config = files.where("role = 'config' AND instr(rel_path, '/') = 0").select("root", F.col("rel_path").alias("value"), F.lit("").alias("notes"))
    out = out.unionByName(numbered(config, "config_file", "value"))
    direct = files.where(F.size(parts) == 2).groupBy("root", parts[0].alias("value")).agg(F.count("*").alias("n"), F.min(parts).alias("walk"))
    out = out.unionByName(numbered(direct.select("root", "value", F.col("n").cast("string").alias("notes"), "walk"), "notable_dir", F.col("walk")).where("ord < 12"))
    areas = files.where("role = 'generated'").groupBy("root", exprs.directory(F.col("rel_path")).alias("value")).agg(F.min(parts).alias("walk"))
    out = out.unionByName(numbered(areas.select("root", "value", F.lit("").alias("notes"), "walk"), "generated_area", F.col("walk")))
    if ignore:
        listed = F.posexplode(F.array(*[F.lit(p) for p in ignore[:20]])).alias("ord", "value")
        out = out.unionByName(files.select("root").distinct().select("root", listed).select("root", F.lit("ignored").alias("section"), "value", F.lit("").alias("notes"), "ord"))
    return out


def failure_context(files: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, log_id with suspected path, limitations). failures: root, log_id, text.

    A failing Go test leads to test files that mention its name, rather than to any test file.
    """
    signals = logs.failure_signals(failures.select("log_id", "text"))
    named = signals.where("kind = 'file'").join(failures.select("root", "log_id"), "log_id").select("root", "log_id", F.col("value").alias("name"), "confidence")
    hits, limits = match.by_base_name(named.select("root", "name").distinct(), files)
    by_file = named.join(hits, ["root", "name"]).select("root", "log_id", "path", "confidence")
    tests = signals.where("kind = 'test'").join(failures.select("root", "log_id"), "log_id").select("root", "log_id", F.substring_index("value", "/", 1).alias("name"), "confidence")
    declared = files.where("role = 'test' AND text IS NOT NULL").select("root", F.col("rel_path").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:func|def)\s+(\w+)"), F.lit(1)))).alias("name"))
    by_test = tests.join(declared, ["root", "name"]).select("root", "log_id", "path", "confidence")
    suspects = by_file.unionByName(by_test).groupBy("root", "log_id", "path").agg(F.max("confidence").alias("confidence"))
    return signals, suspects, limits


def suspected_commands(suspects: DataFrame) -> DataFrame:
    """root, log_id, command: what to run for the suspected files of a log."""
    per_log = suspects.groupBy("root", "log_id").agg(F.bool_or(F.endswith("path", F.lit("_test.go"))).alias("tests"), F.bool_or(F.endswith("path", F.lit(".go"))).alias("go"))
    commands = F.filter(F.array(F.when(F.col("tests"), "go test ./... -v"), F.when(F.col("go"), "go build ./...")), lambda c: c.isNotNull())
    return per_log.select("root", "log_id", F.explode(commands).alias("command"))


def failure_requests(suspects: DataFrame, budget: int = 6000) -> DataFrame:
    """The suspected files of each log as the request of one capsule: root, request, name, budget."""
    return suspects.select("root", F.col("log_id").cast("string").alias("request"), F.col("path").alias("name"), F.lit(budget).alias("budget"))


DOTNET = (".csproj", ".fsproj", ".vbproj", ".sln")


def solution(files: DataFrame) -> DataFrame:
    """root, sln: the shortest path of a solution file, the first in walk order on ties."""
    named = files.where(exprs.extension(F.col("rel_path")) == ".sln")
    return named.groupBy("root").agg(F.min_by("rel_path", F.struct(F.length("rel_path"), exprs.walk_key(F.col("rel_path")))).alias("sln"))


def verify_systems(files: DataFrame) -> DataFrame:
    """root, go, npm, python, dotnet, dotnet_tests, sln: what decides on the commands of every tree."""
    has = lambda *names: F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))
    found = tree.build_systems(files).groupBy("root").agg(has("Go Modules").alias("go"), has("npm").alias("npm"), has("Poetry", "pip", "Pipenv").alias("python"), has("MSBuild").alias("msbuild"))
    ext, name = exprs.extension(F.col("rel_path")), F.lower(exprs.base_name(F.col("rel_path")))
    seen = files.groupBy("root").agg(F.bool_or(ext.isin(*DOTNET)).alias("project"), F.bool_or((ext == ".csproj") & (F.contains(name, F.lit("test")) | F.contains(name, F.lit("spec")))).alias("tested"))
    every = seen.join(found, "root", "left").join(solution(files), "root", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return every.select("root", flag("go").alias("go"), flag("npm").alias("npm"), flag("python").alias("python"), (flag("msbuild") | flag("project")).alias("dotnet"), flag("tested").alias("dotnet_tests"), "sln")


def verify_plan(files: DataFrame, changed: DataFrame) -> DataFrame:
    """root, command, kind, required, cost, ord: what to run for changed files, by build system. changed: root, src."""
    systems = verify_systems(files).join(changed.select("root").distinct(), "root", "left_semi")
    affected = affected_directories(changed)

    def rows(when, ord_: int, command, kind: str, cost: str = "") -> DataFrame:
        return systems.where(when).select("root", command.alias("command"), F.lit(kind).alias("kind"), F.lit(True).alias("required"), F.lit(cost).alias("cost"), F.lit(ord_).alias("ord"))

    say = F.lit
    out = rows("go", 0, say("go build ./..."), "build").unionByName(rows("go", 1, say("go vet ./..."), "vet", "fast"))
    targeted = systems.where("go").join(affected, "root").select("root", F.concat(F.lit("go test ./"), "dir", F.lit("/... -race")).alias("command"), F.lit("test").alias("kind"), F.lit(True).alias("required"), F.lit("medium").alias("cost"), F.lit(2).alias("ord"))
    every = systems.where("go").join(affected, "root", "left_anti").select("root", F.lit("go test ./... -race").alias("command"), F.lit("test").alias("kind"), F.lit(True).alias("required"), F.lit("slow").alias("cost"), F.lit(2).alias("ord"))
    out = out.unionByName(targeted).unionByName(every)
    out = out.unionByName(rows("npm", 3, say("npm run build"), "build")).unionByName(rows("npm", 4, say("npm test"), "test"))
    out = out.unionByName(rows("python", 5, say("pytest"), "test"))
    return out.unionByName(rows("dotnet", 6, F.concat_ws(" ", F.lit("dotnet build"), "sln"), "build")).unionByName(rows("dotnet AND dotnet_tests", 7, say("dotnet test"), "test", "medium"))


def affected_directories(changed: DataFrame) -> DataFrame:
    """root, dir: the directories of changed files; the root's own is none."""
    return changed.select("root", exprs.directory(F.col("src")).alias("dir")).where("dir <> '.'").distinct()


def verify_summary(files: DataFrame, changed: DataFrame) -> DataFrame:
    """root, considered, selected, limitation: the counts of a plan; a tree without a known build system has a limitation."""
    systems = verify_systems(files).join(changed.select("root").distinct(), "root", "left_semi")
    considered = F.when(F.col("go"), 4).otherwise(0) + F.when(F.col("npm"), 3).otherwise(0) + F.when(F.col("python"), 2).otherwise(0) + F.when(F.col("dotnet"), 2).otherwise(0)
    selected = verify_plan(files, changed).groupBy("root").agg(F.count("*").alias("selected"))
    counted = systems.select("root", considered.alias("considered")).join(selected, "root", "left")
    return counted.select("root", "considered", F.coalesce("selected", F.lit(0)).alias("selected"), F.when(F.col("considered") == 0, "unknown_build_system").alias("limitation"))


# --- limitations of answers -------------------------------------------------------------------------------------------
def limits_of(graph: g.Graph, seeds: DataFrame, feature: str, budget: int = 4000) -> DataFrame:
    """root, src, kind: what an answer about the seeds (root, src) cannot say. feature: related, tests, explain or impact."""
    known = graph.files.select("root", F.col("rel_path").alias("src"), "language", "tokens")
    placed = seeds.join(known, ["root", "src"], "left")
    # languages with a graph; others are routed to no provider
    routed = F.col("language").isin("Go", "Python", "JavaScript", "TypeScript", "C#")
    missing = "seed_file_not_found" if feature in ("related", "tests") else "file_not_found"
    out = placed.where("language IS NULL").select("root", "src", F.lit(missing).alias("kind"))
    lone = {"related": "no_lang_provider", "tests": "no_lang_provider", "explain": "no_import_provider", "impact": "no_import_graph"}[feature]
    out = out.unionByName(placed.where(F.col("language").isNotNull() & ~routed).select("root", "src", F.lit(lone).alias("kind")))
    if feature == "related":
        total = related(graph, seeds).groupBy("root", "src").agg(F.sum("tokens").alias("total"))
        out = out.unionByName(total.where(F.col("total") > budget).select("root", "src", F.lit("over_budget").alias("kind")))
    if feature == "impact":
        none = graph.files.select("root").distinct().join(seeds.select("root").distinct(), "root", "left_anti")
        out = out.unionByName(none.select("root", F.lit(None).cast("string").alias("src"), F.lit("no_changed_files").alias("kind")))
    return out


# --- call records of answers ------------------------------------------------------------------------------------------
def call_records(feature: str, seeds: DataFrame, limits: DataFrame, budget: int, at: str, answers: DataFrame | None = None) -> DataFrame:
    """The call record of each answered request (one per root and seed), as the call log stores them.

    seeds: root, src; limits: root, src, kind; answers (of context only): root, src, files_returned, candidates_total,
    files_included, compression_ratio, budget_used, import_edges_scanned. A request whose only file is missing is an error.
    """
    kinds = limits.where("src IS NOT NULL").groupBy("root", "src").agg(F.sort_array(F.collect_set("kind")).alias("limitation_kinds"))
    rows = seeds.select("root", "src").distinct().join(kinds, ["root", "src"], "left")
    if answers is not None:
        rows = rows.join(answers, ["root", "src"], "left")
    empty = F.expr("CAST(array() AS array<string>)")
    take = lambda c, t, zero: (F.coalesce(F.col(c), zero) if answers is not None else zero).cast(t).alias(c)
    all_kinds = F.coalesce("limitation_kinds", empty)
    return rows.select(
        "root", F.lit(at).alias("ts"), F.lit(feature).alias("feature"), F.array("src").alias("seed_files"),
        take("files_returned", "array<string>", empty), take("candidates_total", "int", F.lit(0)), take("files_included", "int", F.lit(0)),
        take("compression_ratio", "double", F.lit(0.0)), F.lit(budget).alias("budget_requested"), take("budget_used", "int", F.lit(0)), F.lit(0).cast("bigint").alias("latency_ms"),
        take("import_edges_scanned", "int", F.lit(0)), F.lit(False).alias("lsp_enhanced"), F.arrays_overlap(all_kinds, F.array(F.lit("file_not_found"), F.lit("seed_file_not_found"))).alias("has_error"),
        F.size(all_kinds).alias("limitation_count"), all_kinds.alias("limitation_kinds"), F.lit("").alias("feedback"), F.lit("").alias("feedback_at"),
    )


def status(graph: g.Graph) -> DataFrame:
    """root, files, languages, edges, units, limitations: what is known of every tree."""
    files = graph.files.groupBy("root").agg(F.count("*").alias("files"), F.count_distinct(F.when(F.col("language") != "", F.col("language"))).alias("languages"))
    edges = graph.edges.groupBy("root").agg(F.count("*").alias("edges"))
    units = graph.groups[0].units.select("root").unionByName(graph.groups[1].units.select("root")).groupBy("root").agg(F.count("*").alias("units"))
    limits = graph.limitations.groupBy("root").agg(F.count("*").alias("limitations"))
    out = files.join(edges, "root", "left").join(units, "root", "left").join(limits, "root", "left")
    return out.na.fill(0, ["edges", "units", "limitations"])


def references(declared: DataFrame, uses: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, src, dst: importers of C# files by a given table of references; limitations where there is none).

    declared: root, path, name of top-level types; uses: root, path, name, from a tool that resolves names. No guess is
    made from project references: a tree without references has the limitation ``tool_not_available`` and no rows.
    """
    pairs = declared.select("root", F.col("path").alias("src"), "name").join(uses.select("root", F.col("path").alias("dst"), "name"), ["root", "name"]).where("src <> dst").select("root", "src", "dst").distinct()
    own = files.where("language = 'C#'").select("root").distinct()
    limits = own.join(uses.select("root").distinct(), "root", "left_anti").select("root", F.lit("tool_not_available").alias("kind"), F.lit("no references table for this tree").alias("message"), F.lit("csharp").alias("scope"))
    return pairs, limits
