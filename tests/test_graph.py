"""A small tree in four languages with hand-derived edges, and the questions over it."""

import pytest
from pyspark.sql import functions as F

from corvane.extract import script
from corvane.operators import graph as g
from corvane.operators import match
from corvane.plans import context, evaluation, questions
from corvane.sources import files as tree

TREE = {
    "a/__init__.py": "", "a/m.py": "import a.b.c\nfrom . import x\nfrom ..z import y\nimport p, q\n", "a/x.py": "from .b import c\n", "a/b/__init__.py": "", "a/b/c.py": "from ..m import y\n# import a.m\n", "p.py": "class P:\n    def go(self):\n        pass\n\ndef f():\n    pass\n", "q.py": "", "test_m.py": "import a.m\n\ndef test_it():\n    pass\n",
    "web/tsconfig.json": '{\n  // aliases\n  "extends": "./base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"], "~one": ["lib/one.ts"]}}}', "web/base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"@old/*": ["old/*"], "@mix/*": ["x"]}}}',
    "web/main.ts": "import x from './util';\nimport type { T } from '@lib/one';\nconst q = require('~one');\nexport * from './dir';\nconst l = import('../../../out');\nimport react from 'react';\nimport o from '@old/o';\n", "web/util.js": "", "web/lib/one.ts": "", "web/dir/index.ts": "", "web/old/o.tsx": "",
    "go.mod": "module ex.com/app\n", "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"ex.com/app/lib"\n\tsub "ex.com/sub/deep"\n)\n', "lib/lib.go": "package lib\n\nfunc Lib() {}\n", "lib/more.go": "package lib\n", "lib/lib_test.go": 'package lib\n\nimport "ex.com/app/cmd"\n\nfunc TestLib() {}\n', "sub/go.mod": "module ex.com/sub\n", "sub/deep/d.go": "package deep\n",
    "App/App.csproj": '<Project><ItemGroup><ProjectReference Include="..\\Core\\Core.csproj" /><PackageReference Include="Json" Version="1.2" /></ItemGroup></Project>', "App/Main.cs": "class Main {}", "App/View.axaml": "<V/>", "App/View.axaml.cs": "class View {}", "App/Inner/Inner.csproj": "<Project><ItemGroup></ItemGroup></Project>", "App/Inner/I.cs": "", "Core/Core.csproj": "<Project><ItemGroup></ItemGroup></Project>", "Core/C.cs": "", "Bad/Bad.csproj": "<Project",
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("r", "/r/" + p, p, len(t), bytearray(t.encode())) for p, t in TREE.items()]
    files = tree.classify(spark.createDataFrame(rows, "root string, path string, rel_path string, size long, content binary")).cache()
    configs = [("r", p, t) for p, t in TREE.items() if p.endswith(".json")]
    aliases = spark.createDataFrame(script.aliases_of(configs), "root string, prefix string, target string, rank int")
    return g.build(files, aliases)


def seeds(spark, *paths):
    return spark.createDataFrame([("r", p) for p in paths], "root string, src string")


def pairs(df, relation):
    return {(r["src"], r["dst"]) for r in df.where(F.col("relation") == relation).collect()}


def test_file_edges(graph):
    got = {(r["src"], r["dst"]) for r in graph.edges.collect()}
    assert got == {
        ("a/m.py", "a/__init__.py"), ("a/m.py", "a/b/__init__.py"), ("a/m.py", "a/b/c.py"), ("a/m.py", "p.py"), ("a/x.py", "a/b/__init__.py"), ("a/b/c.py", "a/m.py"), ("test_m.py", "a/__init__.py"), ("test_m.py", "a/m.py"),
        ("web/main.ts", "web/util.js"), ("web/main.ts", "web/lib/one.ts"), ("web/main.ts", "web/dir/index.ts"), ("web/main.ts", "web/old/o.tsx"),
        ("App/View.axaml", "App/View.axaml.cs"), ("App/View.axaml.cs", "App/View.axaml"),
    }


def test_relations_are_mirror_images(spark, graph):
    every = graph.files.select("root", F.col("rel_path").alias("src"))
    found = g.relations(graph, every).cache()
    # a test stands for its directory's unit as a seed, but is no part of what others import
    assert pairs(found, "imports") == {(b, a) for a, b in pairs(found, "importers") if not a.endswith("_test.go")} | {(a, b) for a, b in pairs(found, "imports") if a.endswith("_test.go")}
    assert pairs(found, "peers") >= {("lib/lib.go", "lib/more.go"), ("App/Main.cs", "App/View.axaml.cs")} and ("App/Main.cs", "App/Inner/I.cs") not in pairs(found, "peers")
    assert pairs(found, "tests") == {("lib/lib.go", "lib/lib_test.go"), ("lib/more.go", "lib/lib_test.go")}
    imports = pairs(found, "imports")
    assert {("cmd/main.go", "lib/lib.go"), ("cmd/main.go", "lib/more.go"), ("cmd/main.go", "sub/deep/d.go"), ("App/Main.cs", "Core/C.cs")} <= imports
    assert not any(a == "lib/lib.go" for a, _ in imports)  # test files give no edges


def test_limitations(graph):
    kinds = {(r["kind"], r["scope"]) for r in graph.limitations.collect()}
    assert ("go_static_parse", "go") in kinds and ("csproj_parse_error", "Bad/Bad.csproj") in kinds


def test_closure_with_a_cycle(spark, graph):
    got = {(r["node"], r["steps"]) for r in g.closure(graph.edges, seeds(spark, "test_m.py")).collect()}
    assert got == {("test_m.py", 0), ("a/__init__.py", 1), ("a/m.py", 1), ("a/b/__init__.py", 2), ("a/b/c.py", 2), ("p.py", 2)}


def test_questions(spark, graph):
    related = {(r["rel_path"], r["relation"], r["confidence"]) for r in questions.related(graph, seeds(spark, "a/m.py")).collect()}
    assert related == {("a/__init__.py", "imports", 0.92), ("a/b/__init__.py", "imports", 0.92), ("a/b/c.py", "imports", 0.92), ("p.py", "imports", 0.92), ("test_m.py", "importers", 0.88)}
    tests = {(r["rel_path"], r["run_command"], r["confidence"]) for r in questions.tests_of(graph, seeds(spark, "a/m.py", "lib/lib.go")).collect()}
    assert tests == {("test_m.py", "", 0.97), ("lib/lib_test.go", "go test ./lib/...", 0.95)}
    impact = {(r["kind"], r["rel_path"]) for r in questions.impact(graph, seeds(spark, "a/m.py", "not/there.py")).collect()}
    assert impact == {("changed", "a/m.py"), ("changed", "not/there.py"), ("impacted", "test_m.py"), ("impacted", "a/b/c.py"), ("test", "test_m.py")}
    explained = {(r["section"], r["value"]) for r in questions.explain(graph, seeds(spark, "App/Main.cs", "p.py")).collect()}
    assert {("symbol", "P.go"), ("symbol", "f"), ("package", "Json"), ("dependent", "a/m.py"), ("symbol", "Main")} <= explained
    plan = {(r["command"], r["required"]) for r in questions.verify_plan(graph.files, seeds(spark, "lib/lib.go")).collect()}
    assert plan == {("go build ./...", True), ("go vet ./...", True), ("go test ./lib/... -race", True), ("dotnet build", True)}
    shown = {(r["section"], r["value"]) for r in questions.overview(graph.files, ["*.log"]).collect()}
    assert {("build_system", "Go Modules"), ("test_system", "Go test"), ("notable_dir", "lib"), ("ignored", "*.log")} <= shown


def request(spark, budget, *names):
    return spark.createDataFrame([("r", "q", n, budget) for n in names], "root string, request string, name string, budget int")


def test_context_tiers_and_budget(spark, graph):
    got = context.context(graph, request(spark, 3, "lib/lib.go", "nowhere"))
    rows = {r["rel_path"]: (r["score"], r["tier"]) for r in got.rows.collect()}
    assert rows["lib/lib.go"] == (1.0, 1) and rows["cmd/main.go"] == (0.8, 1)
    summary = got.summary.first()
    assert summary["critical"] == 2 and summary["contextual_out"] == 2 and summary["used"] == summary["critical_tokens"]
    assert {r["kind"] for r in got.limitations.collect()} == {"critical_path_over_budget", "contextual_trimmed", "seed_file_not_found"}
    wide = context.context(graph, request(spark, 9999, "lib/lib.go"))
    assert {r["rel_path"] for r in wide.rows.collect()} == {"lib/lib.go", "cmd/main.go", "lib/more.go", "lib/lib_test.go"}
    assert [r["rank"] for r in wide.rows.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert evaluation.within_budget(wide.summary).first()["passed"]
    named, _ = questions.symbols(graph.files)
    short = context.context(graph, request(spark, 9999, "p.py"), depth="signatures", symbols=named)
    assert short.rows.where("rel_path = 'p.py'").first()["content"] == "P\n  .go\nf"


def test_a_test_that_imports_the_seed_counts_as_importer(spark, graph):
    found = spark.createDataFrame([("r", "q", "p.py", "test_m.py", "importers"), ("r", "q", "p.py", "test_m.py", "peers")], "root string, request string, src string, dst string, relation string")
    own = spark.createDataFrame([("r", "q", "p.py")], "root string, request string, src string")
    assert {r["path"]: r["score"] for r in match.tag(own, found, graph.files).collect()} == {"p.py": 1.0, "test_m.py": 0.7}


def test_base_names_and_failures(spark, graph):
    log = "x/lib.go:12: boom\nnone/d.go:3\n--- FAIL: TestLib (0.1s)\n  panic: a\npanic: a\nlib/lib.go:9\n  File \"m.py\", line 3\nlib/lib.go:12\n"
    logs = spark.createDataFrame([("r", "l", log)], "root string, log_id string, text string")
    signals, suspects, limits = questions.failure_context(graph.files, logs)
    assert sorted((r["kind"], r["value"], r["line"]) for r in signals.collect()) == [("file", "lib/lib.go", 9), ("file", "m.py", 3), ("file", "none/d.go", 3), ("file", "x/lib.go", 12), ("panic", "panic: a", 0), ("panic", "panic: a", 0), ("test", "TestLib", 0)]
    assert {r["path"] for r in suspects.collect()} == {"lib/lib.go", "lib/lib_test.go", "sub/deep/d.go", "a/m.py"}
    assert {r["kind"] for r in limits.collect()} == {"basename_match_only"}


def test_evaluation(spark):
    scenarios = spark.createDataFrame([("s1", ["a", "b"], ["z"]), ("s2", ["a"], ["b"]), ("s3", [], [])], "scenario_id string, expected_files array<string>, forbidden_files array<string>")
    included = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "b")], "scenario_id string, rel_path string")
    got = evaluation.golden(included, scenarios)
    assert {r["scenario_id"]: r["passed"] for r in got.collect()} == {"s1": True, "s2": False, "s3": True}
    assert evaluation.summary(got).first()["score"] == pytest.approx(2 / 3)


def test_many_requests_over_one_unit_store_no_pairs(spark, monkeypatch):
    from corvane.session import Stored

    rows = [("r", "go.mod", "", "other", "module x")] + [("r", f"p/f{k:02}.go", "Go", "source", "package p") for k in range(40)]
    graph = g.build(spark.createDataFrame(rows, "root string, rel_path string, language string, role string, text string").withColumn("tokens", F.lit(2)))
    asked = spark.createDataFrame([("r", f"q{k}", f"p/f{k:02}.go", 11) for k in range(40)], "root string, request string, name string, budget int")
    made, table = [], Stored.table
    monkeypatch.setattr(Stored, "table", lambda self, df, *a, **k: made.append(table(self, df, *a, **k)) or made[-1])
    got = context.context(graph, asked)
    # itself, and four of the other 39 in order of their paths
    assert {(r["considered"], r["included"], r["used"], r["total"], r["edges_scanned"]) for r in got.summary.collect()} == {(40, 5, 10, 80, 39)}
    assert [r["rel_path"] for r in got.rows.where("request = 'q2'").orderBy("rank").collect()] == ["p/f02.go", "p/f00.go", "p/f01.go", "p/f03.go", "p/f04.go"]
    assert max(df.count() for df, _ in made) < 300
