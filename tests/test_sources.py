"""Logs, sessions, version control, settings, sinks and streams on small files."""

import json
import os

from pyspark.sql import functions as F

from corvane import config, sinks
from corvane.operators import calls as metrics
from corvane.operators import sessions
from corvane.sources import files, git, logs
from corvane.streaming import calls as stream


def test_call_log_roundtrip(spark, tmp_path):
    log = str(tmp_path / "calls.jsonl")
    long = json.dumps({"ts": "x", "feature": "context", "seed_files": ["f" * 70_000]})
    with open(log, "w") as f:
        f.write('{"ts": "2024-01-01T00:00:00Z", "feature": "context", "feedback": "good"}\n\nnot json\n{"feature": "tests", "latency_ms": 5}\n' + long + "\n")
    rows = logs.read_calls(spark, log).orderBy("seq").collect()
    assert [r["feature"] for r in rows] == ["context", "tests", "context"] and rows[1]["ts"] == "" and rows[1]["seed_files"] == [] and rows[0]["candidates_total"] == 0
    assert logs.read_calls(spark, str(tmp_path / "none")).count() == 0
    assert metrics.unrated_tail(logs.read_calls(spark, log)).first()["unrated"] == 2
    rated = metrics.rate_last(logs.read_calls(spark, log), "bad", "now")
    assert [r["feedback"] for r in rated.orderBy("seq").collect()] == ["good", "", "bad"]
    out = str(tmp_path / "out")
    logs.append_calls(logs.read_calls(spark, log), out)
    logs.append_calls(logs.read_calls(spark, log), out)
    assert logs.read_calls(spark, out).where("ts = ''").count() == 0 and logs.read_calls(spark, out).count() == 6
    logs.replace_log(rated, out)
    assert logs.read_calls(spark, out).count() == 3
    assert os.path.getsize(logs.export_zip(out, str(tmp_path / "x.zip"))) > 0


def test_session_blocks(spark, tmp_path):
    lines = [
        {"type": "summary"},
        {"type": "user", "uuid": "1", "sessionId": "s", "timestamp": "t1", "message": {"role": "user", "content": "do it"}},
        {"type": "assistant", "uuid": "2", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Bash", "input": {"command": "cd a && tool context --files=x/a.py"}}]}},
        {"type": "assistant", "uuid": "3", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}, {"type": "tool_use", "name": "Write", "input": {"path": "b.py"}}]}},
        {"type": "assistant", "uuid": "4", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": "tool related --files y/a.py"}}]}},
        {"type": "user", "uuid": "5", "sessionId": "s", "message": {"role": "user", "content": [{"type": "text", "text": "mytool tool"}]}},
    ]
    path = str(tmp_path / "s.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, lines)) + "\nbroken{\n")
    blocks = logs.read_session_blocks(spark, path).cache()
    assert [(r["entry_idx"], r["block_idx"], r["tool"], r["file"]) for r in blocks.orderBy("entry_idx", "block_idx").collect()] == [(0, 0, None, None), (1, 0, None, None), (1, 1, "Bash", None), (2, 0, "Edit", "a.py"), (2, 1, "Write", "b.py"), (3, 0, "Bash", None), (4, 0, None, None)]
    pack = {r["entry_idx"]: r for r in sessions.analysis_pack(blocks, "tool").collect()}
    first, second = pack[1], pack[3]
    assert (first["edit_after"], first["turns_to_edit"], first["turns_to_call"], first["files_edited"], first["retry_after"]) == (True, 1, 2, ["a.py", "b.py"], True)
    assert (second["edit_after"], second["turns_to_edit"], second["turns_to_call"], second["files_edited"], second["retry_after"]) == (False, -1, -1, [], False)
    assert [x["role"] for x in first["excerpt"]] == ["user", "assistant", "assistant"]
    assert logs.latest_sessions(spark, str(tmp_path)) and logs.latest_sessions(spark, str(tmp_path))[0].endswith("s.jsonl")


def test_tree_scan(spark, tmp_path):
    for path, text in {"a.py": "x = 1\n", "build/x.py": "", "node_modules/y.js": "", "docs/z.md": "# z", "skip.log": "", ".gitignore": "*.log\n# c\n\n"}.items():
        where = tmp_path / path
        where.parent.mkdir(exist_ok=True)
        where.write_text(text)
    got = {r["rel_path"]: (r["role"], r["tokens"], r["size"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("source", 1, 6), "docs/z.md": ("docs", 1, 3), ".gitignore": ("config", 2, 11)}


def test_git_output(spark):
    outputs = {"status": " M a/b.py\n?? new.txt\n", "diff": "a.py\n\n b.py \n", "log": "h1\x1fs1\x1fAnn\x1f2024-01-01\x1fmsg\nbad\x1fline\n"}
    run = lambda *args: outputs[args[0]]
    assert {tuple(r) for r in git.status(spark, run).collect()} == {("a/b.py", "modified"), ("new.txt", "untracked")}
    assert {r[0] for r in git.changed(spark, run, "HEAD~1").collect()} == {"a.py", "b.py"}
    assert [r["short_hash"] for r in git.commits(spark, run, 5).collect()] == ["s1"]
    assert tuple(git.diff_counts(spark, " a | 2 +-\n 2 files changed, 11 insertions(+), 3 deletions(-)\n").first()) == (11, 3)


def test_settings(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{"default_budget": 5, "unknown": 1}')
    b.write_text('{"default_budget": "no", "cache_seconds": 9}')
    assert config.load(str(a), str(b), str(tmp_path / "none")) == config.Config(default_budget=5, cache_seconds=9)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1)], "x string, y int")
    assert sinks.to_markdown(df).splitlines()[2] == "| a\\|b | 1 |" and json.loads(sinks.to_json(df)) == [{"x": "a|b", "y": 1}]
    sinks.write_artifact(df, str(tmp_path), "context", "2024-01-01")
    sinks.write_artifact(df, str(tmp_path), "context", "2024-01-02")
    assert sinks.latest_artifact(str(tmp_path), "context").endswith("2024-01-02")
    runs = spark.createDataFrame([("r1", "context", "old")], "run_id string, feature string, v string")
    sinks.save_runs(runs, str(tmp_path / "runs"))
    sinks.save_runs(runs.withColumn("v", F.lit("new")), str(tmp_path / "runs"))
    assert [r["v"] for r in sinks.read_runs(spark, str(tmp_path / "runs")).collect()] == ["new"]


def test_streams(spark, tmp_path):
    rows = [(1, "p", 1, "context", "good", False, 5, "2024-01-01 00:10:00"), (2, "p", 2, "context", None, True, 7, "2024-01-01 00:20:00"), (2, "p", 2, "context", None, True, 7, "2024-01-01 00:21:00"), (3, "q", 3, "status", None, False, 1, "2024-01-01 05:00:00")]
    batch = spark.createDataFrame(rows, "call_id long, project string, seq long, feature string, feedback string, has_error boolean, latency_ms long, at string").withColumn("received_at", F.col("at").cast("timestamp")).drop("at")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = stream.windowed(source).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["feature"], r["calls"], r["errors"], r["ms"]) for r in spark.table("windows").collect()] == [("context", 2, 1, 12)]
    query = stream.unrated(source).writeStream.outputMode("update").format("memory").queryName("tails").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["project"], r["unrated"]) for r in spark.table("tails").collect()} == {("p", 2)}
