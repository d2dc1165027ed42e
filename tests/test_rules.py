"""Rules that hold at any size: order of a log, budgets, aliases, commands, records of answers, places of stored tables."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane import session, sinks
from corvane.extract import script
from corvane.functions import exprs
from corvane.operators import budget, graph, match, sessions
from corvane.plans import questions
from corvane.sources import files, logs


def test_a_log_of_several_parts_keeps_its_order(spark, tmp_path):
    log = str(tmp_path / "log")
    wanted = []
    for part, n in enumerate((300, 3, 40)):
        rows = [(f"{part}-{k}", "context") for k in range(n)]
        wanted += [r[0] for r in rows]
        logs.append_calls(spark.createDataFrame(rows, "ts string, feature string").coalesce(1), log)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = logs.read_calls(spark, log).cache()
        assert [r["ts"] for r in read.orderBy("seq").collect()] == wanted
        assert read.select("seq").distinct().count() == len(wanted)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def walked(rows, limit):
    used, out = 0, []
    for name, need, cost in rows:
        if used + need <= limit:
            used += cost
            out.append(name)
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_is_the_walk(spark, seed):
    pick = random.Random(seed)
    rows = [(k, pick.choice([1, 2, 2, 5, 9, 30])) for k in range(120)]
    table = spark.createDataFrame([("g", f"{k:03}", n, max(1, n // 2)) for k, n in rows], "g string, k string, need int, cost int")
    same = budget.first_fit(table, ["g"], [F.col("k")], 40, "need").collect()
    assert {r["k"] for r in same} == walked([(f"{k:03}", n, n) for k, n in rows], 40)
    less = budget.first_fit(table, ["g"], [F.col("k")], 40, "need", "cost").collect()
    assert {r["k"] for r in less} == walked([(f"{k:03}", n, max(1, n // 2)) for k, n in rows], 40)
    marked = budget.first_fit_marked(table, ["g"], [F.col("k")], 40, "need", ["k"]).collect()
    assert len(marked) == 120 and {r["k"] for r in marked if r["included"]} == {r["k"] for r in same}


def tree(spark, texts):
    rows = [("r", "/r/" + p, p, len(t), bytearray(t.encode())) for p, t in texts.items()]
    return files.classify(spark.createDataFrame(rows, "root string, path string, rel_path string, size long, content binary"))


def test_aliases_come_from_the_tree(spark):
    config = json.dumps({"extends": "./base.json", "compilerOptions": {"paths": {"@a/*": ["lib/*"]}}})
    texts = {"tsconfig.json": config, "base.json": '{"compilerOptions": {"paths": {"~one": ["lib/one.mts"], "#*": ["lib/*"]}}}', "web/x.cts": "import y from '@a/two'; \nimport {\n  z,\n} from \"~one\"\nimport '#two'\nimport type { T } from './gone'\n", "lib/one.mts": "", "lib/two.ts": "", "a/b/c/d/e/f/g/tsconfig.json": '{"compilerOptions": {"paths": {"@deep": ["x"]}}}', "node_modules/m/i.js": "import './j'", "node_modules/m/j.js": ""}
    own = tree(spark, texts)
    assert {tuple(r)[1:3] for r in script.config_aliases(own).collect()} == {("@a/*", "lib/"), ("~one", "lib/one.mts"), ("#*", "lib/")}
    edges, _ = script.extract(own)
    assert {(r["src"], r["dst"]) for r in edges.collect()} >= {("web/x.cts", "lib/two.ts"), ("web/x.cts", "lib/one.mts")}
    assert not any(r["src"].startswith("node_modules") for r in edges.collect())


def test_commands_and_risks(spark):
    rows = spark.createDataFrame([("a.go", "source", ""), ("d/a.go", "source", "pytest"), ("t/x.py", "test", "pytest"), ("t/x.ts", "test", "Vitest"), ("t/x.rb", "test", ""), ("interface/a.go", "source", ""), ("Interface/a.go", "source", ""), ("x/my_iface.go", "source", ""), ("api/x.py", "source", ""), ("x/api_v1.py", "generated", "")], "p string, role string, system string")
    got = {r["p"]: (r["c"], r["n"]) for r in rows.select("p", exprs.run_command(F.col("p"), F.col("system")).alias("c"), exprs.risk_notes(F.col("p"), F.col("role")).alias("n")).collect()}
    assert got["a.go"][0] == "go test ." and got["d/a.go"][0] == "go test ./d/..." and got["t/x.py"][0] == "pytest t/x.py" and got["t/x.ts"][0] == "npx vitest t/x.ts" and got["t/x.rb"][0] == ""
    assert got["interface/a.go"][1] == ["interface definition"] and got["Interface/a.go"][1] == [] and got["x/my_iface.go"][1] == ["interface definition"]
    assert got["api/x.py"][1] == [] and len(got["x/api_v1.py"][1]) == 2


def test_limits_records_and_plans(spark):
    own = tree(spark, {"b/big.sln": "", "a.sln": "", "x.csproj": "<Project/>", "T.Tests.csproj": "<Project", "y.md": "z", "s.py": "import q\n", "q.py": "x = 1\n" * 50})
    built = graph.build(own)
    asked = spark.createDataFrame([("r", "s.py"), ("r", "y.md"), ("r", "gone.py")], "root string, src string")
    limits = questions.limits_of(built, asked, "related", 10)
    assert {(r["src"], r["kind"]) for r in limits.collect()} == {("gone.py", "seed_file_not_found"), ("y.md", "no_lang_provider"), ("s.py", "over_budget")}
    records = {r["seed_files"][0]: (r["has_error"], r["limitation_kinds"]) for r in questions.call_records("related", asked, limits, 10, "2024-01-01T00:00:00Z").collect()}
    assert records == {"s.py": (False, ["over_budget"]), "y.md": (False, ["no_lang_provider"]), "gone.py": (True, ["seed_file_not_found"])}
    assert {r["kind"] for r in built.limitations.collect()} >= {"csproj_parse_error", "no_js_ts_files"}
    plan = {r["command"] for r in questions.verify_plan(own, asked).collect()}
    assert plan == {"dotnet build a.sln", "dotnet test"}
    bare = tree(spark, {"s.py": ""})
    assert questions.verify_summary(bare, asked.where("src = 's.py'")).first()["limitation"] == "unknown_build_system"
    uses = spark.createDataFrame([("r", "B.cs", "A")], "root string, path string, name string")
    declared = spark.createDataFrame([("r", "A.cs", "A")], "root string, path string, name string")
    pairs, none = questions.references(declared, uses, tree(spark, {"A.cs": "", "B.cs": ""}))
    assert [tuple(r) for r in pairs.collect()] == [("r", "A.cs", "B.cs")] and none.count() == 0
    assert questions.references(declared, uses.where("false"), tree(spark, {"A.cs": ""}))[1].first()["kind"] == "tool_not_available"


def test_stored_tables_are_removed_and_need_a_shared_folder(spark):
    stored = session.Stored(spark)
    assert stored.table(spark.range(3).toDF("x"))[0].count() == 3 and os.path.isdir(stored.base.removeprefix("file://"))
    stored.close()
    assert not os.path.isdir(stored.base.removeprefix("file://"))

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

        class sparkContext:  # noqa: N801
            master = "spark://a:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_stretches_of_a_session_change_nothing(spark, monkeypatch):
    pick = random.Random(5)
    rows = []
    for s in range(6):
        for entry in range(pick.choice([1, 7, 40])):
            for block in range(pick.choice([1, 1, 2])):
                kind = pick.choice(["call", "edit", "other", "other"])
                rows.append((f"s{s}", entry, block, pick.choice(["user", "assistant"]), {"call": "Bash", "edit": "Edit"}.get(kind, "Read"), f"tool context --files=d/f{pick.randrange(3)}" if kind == "call" else None, f"f{pick.randrange(3)}", f"t{entry}"))
    blocks = spark.createDataFrame(rows, "session_id string, entry_idx int, block_idx int, role string, tool string, command string, file string, text string")

    def pack(part):
        monkeypatch.setattr(sessions, "PART", part)
        return sorted(str(r.asDict(True)) for r in sessions.analysis_pack(blocks, "tool").collect())

    whole = pack(10_000)
    assert len(whole) > 20 and pack(4) == whole and pack(1) == whole


def test_names_of_files_and_directories(spark):
    own = tree(spark, {f"d/f{k}.py": "" for k in range(7)} | {"d/e/g.py": "", "a.py": ""})
    asked = spark.createDataFrame([("r", "a.py"), ("r", "/r/d/f0.py"), ("r", "d/"), ("r", "no.py")], "root string, name string")
    hit, told = match.find_file(own, asked)
    assert {r["src"] for r in hit.collect()} == {"a.py", "d/f0.py"}
    assert {r["name"]: (r["problem"], r["suggestions"]) for r in told.collect()} == {"d": ("is_directory", [f"d/f{k}.py" for k in range(5)]), "no.py": ("file_not_found", [])}


def test_packs_runs_and_renderings(spark, tmp_path):
    pack = spark.createDataFrame([("s", 1)], "session_id string, entry_idx int")
    assert sinks.latest_pack(str(tmp_path / "none")) is None
    sinks.save_pack(pack, str(tmp_path), "20240101-000000")
    last = sinks.save_pack(pack, str(tmp_path), "20240301-000000")
    assert sinks.latest_pack(str(tmp_path)) == last
    session_file = tmp_path / "s.jsonl"
    session_file.write_text("{}\n")
    with zipfile.ZipFile(sinks.session_zip(last, str(session_file), str(tmp_path / "x.zip"))) as z:
        assert sorted(z.namelist()) == ["analysis-20240301-000000.json", "s.jsonl"]
    with zipfile.ZipFile(sinks.session_zip(last, str(tmp_path / "gone"), str(tmp_path / "y.zip"))) as z:
        assert z.namelist() == ["analysis-20240301-000000.json"]
    assert sinks.run_id("tests").startswith("tests-") and len(sinks.run_id("tests")) == 14
    plan = spark.createDataFrame([("go vet", "vet", True, "fast", 1), ("go build", "build", True, "", 0)], "command string, kind string, required boolean, cost string, ord int")
    shown = sinks.render("verify-plan", plan, spark.createDataFrame([("unknown_build_system",)], "kind string"))
    assert shown.startswith("# Verification\n\n| ord |") and shown.index("go build") < shown.index("go vet") and shown.endswith("- unknown_build_system\n")
    log = tmp_path / "fail.log"
    log.write_text("a.go:1\n")
    assert logs.read_failure(spark, str(log)).first()["text"] == "a.go:1\n" and logs.read_failure(spark, str(log), "inline").first()["text"] == "inline"
