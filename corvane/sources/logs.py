"""Call logs, sessions and failure logs: read, written, patched."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CALLS = "ts STRING, feature STRING, seed_files ARRAY<STRING>, files_returned ARRAY<STRING>, candidates_total INT, files_included INT, compression_ratio DOUBLE, budget_requested INT, budget_used INT, latency_ms BIGINT, import_edges_scanned INT, lsp_enhanced BOOLEAN, has_error BOOLEAN, limitation_count INT, limitation_kinds ARRAY<STRING>, feedback STRING, feedback_at STRING"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON-lines log with ``seq``, their order. Blank and malformed lines are dropped; a missing file is empty.

    Missing keys are zero values. Lines of any length are read. The parts of a log follow one another by time of writing and
    name, lines of a part by their place: its split's first byte and the line's number in that split, neither of which depends
    on how Spark packs splits into tasks. Only the list of parts and splits is grouped for that.
    """
    if "://" not in path and not os.path.exists(path):
        lines = spark.createDataFrame([], "value string, seq bigint")
    else:
        lines = placed(spark.read.text(path))
    parsed = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", CALLS + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).where("r._bad IS NULL")
    flat = parsed.select("seq", "r.*").drop("_bad")
    zero = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False), "array<string>": F.expr("CAST(array() AS array<string>)")}
    return flat.select("seq", *[F.coalesce(c, zero[t].cast(t)).alias(c) for c, t in flat.dtypes if c != "seq"])


def placed(lines: DataFrame) -> DataFrame:
    """value, seq: lines with a number that rises with their place in the files they come from."""
    at = lines.select("value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = at.groupBy("part", "written", "block").agg(F.min("id").alias("first_id"))
    parts = splits.select("part", "written").distinct().withColumn("ord", F.row_number().over(Window.orderBy("written", "part")) - 1)  # a row per part file
    known = splits.join(parts.select("part", "ord"), "part").select("part", "block", "first_id", "ord")
    # a line has a byte or more, so numbers of one split stay below the next one's first byte; parts are below 4 TB
    return at.join(known, ["part", "block"]).select("value", (F.shiftleft(F.col("ord").cast("bigint"), 42) + F.col("block") + F.col("id") - F.col("first_id")).alias("seq"))


def append_calls(records: DataFrame, path: str) -> None:
    """Append records; ts defaults to now in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records.withColumn("ts", F.coalesce(F.nullif("ts", F.lit("")), now)).drop("seq").write.mode("append").json(path)


def replace_log(records: DataFrame, path: str) -> None:
    """Write beside and swap: a reader sees the old or the new log."""
    mark = uuid.uuid4().hex
    beside, old = f"{path}.{mark}", f"{path}.{mark}.old"
    records.drop("seq").write.json(beside)
    spark = records.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # of whatever kind the path is
    if store.exists(place(path)) and not store.rename(place(path), place(old)):
        raise OSError(f"{path} could not be set aside")
    if not store.rename(place(beside), place(path)):
        raise OSError(f"{path} could not be replaced; its records are in {old}")
    store.delete(place(old), True)


def export_zip(path: str, target: str) -> str:
    """A log as a zip of its part files under their base names."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        names = [path] if os.path.isfile(path) else [os.path.join(path, n) for n in sorted(os.listdir(path)) if not n.startswith((".", "_"))]
        for name in names:
            out.write(name, os.path.basename(name))
    return target


def latest_sessions(spark: SparkSession, folder: str, n: int = 5) -> list[str]:
    """The newest session files by modification time: a top-n over file metadata."""
    seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "modificationTime")
    return [r["path"] for r in seen.orderBy(F.col("modificationTime").desc(), "path").limit(n).collect()]


def read_session_blocks(spark: SparkSession, *paths: str) -> DataFrame:
    """Session JSON lines as blocks: session_id, entry_idx, block_idx, entry_type, role, ts, block_type, tool, command, file, text.

    Only user and assistant entries; content is an array of blocks or one string.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("from_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    entries = lines.select("from_file", "at", get("$.sessionId", "string").alias("session_id"), get("$.type", "string").alias("entry_type"), get("$.uuid", "string").alias("uuid"), get("$.timestamp", "string").alias("ts"), get("$.message.role", "string").alias("role"), get("$.message.content", "array<variant>").alias("blocks"), get("$.message.content", "string").alias("plain")).where(F.col("entry_type").isin("user", "assistant"))
    ordered = entries.withColumn("entry_idx", F.row_number().over(Window.partitionBy("from_file").orderBy("at")) - 1)
    exploded = ordered.select("*", F.posexplode_outer("blocks").alias("pos", "b"))
    part = lambda path: F.try_variant_get("b", path, "string")
    return exploded.select(
        "session_id", "entry_idx", F.coalesce("pos", F.lit(0)).alias("block_idx"), "uuid", "entry_type", F.coalesce("role", "entry_type").alias("role"), "ts",
        F.coalesce(part("$.type"), F.lit("text")).alias("block_type"), part("$.name").alias("tool"), part("$.input.command").alias("command"),
        F.coalesce(F.nullif(part("$.input.file_path"), F.lit("")), F.nullif(part("$.input.path"), F.lit(""))).alias("file"),
        F.coalesce(part("$.text"), F.when(F.col("blocks").isNull(), F.col("plain"))).alias("text"),
    )


def read_failure(spark: SparkSession, path: str | None = None, text: str | None = None, root: str = "", log_id: str = "log") -> DataFrame:
    """root, log_id, text of a failure log given by path or as text; text wins."""
    if not text:
        if not path:
            raise ValueError("give a path or a text")
        return spark.read.text(path, wholetext=True).select(F.lit(root).alias("root"), F.lit(log_id).alias("log_id"), F.col("value").alias("text"))
    return spark.createDataFrame([(root, log_id, text)], "root string, log_id string, text string")


# Patterns of failures and how sure each is.
FAILURES = (("file", r"([a-zA-Z0-9_/\-.]+\.go):(\d+)", 0.90), ("test", r"--- FAIL:\s+(\S+)", 0.95), ("file", r"File \"([^\"]+\.py)\", line (\d+)", 0.85))
PANIC = 0.80


def failure_signals(logs: DataFrame) -> DataFrame:
    """log_id, kind (file, test, panic), value, confidence, line: signals of a log, files and tests once each at first sight.

    logs: log_id, text.
    """
    lines = logs.select("log_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    found = []
    for rank, (kind, pattern, confidence) in enumerate(FAILURES):
        values = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        numbers = F.regexp_extract_all("line", F.lit(pattern), F.lit(2)) if kind == "file" else F.transform(values, lambda _: F.lit("0"))
        found.append(lines.select("log_id", "line_no", F.lit(rank).alias("rank"), F.posexplode(F.arrays_zip(values.alias("value"), numbers.alias("number"))).alias("at", "x")).select("log_id", F.lit(kind).alias("kind"), F.col("x.value").alias("value"), F.lit(confidence).alias("confidence"), F.col("x.number").cast("int").alias("line"), "line_no", "rank", "at"))
    both = found[0].unionByName(found[1]).unionByName(found[2])
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("log_id", "kind", "value").orderBy("line_no", "rank", "at"))).where("_n = 1").drop("_n", "rank", "at")
    panics = lines.where(F.startswith(F.trim("line"), F.lit("panic:"))).select("log_id", F.lit("panic").alias("kind"), F.trim("line").alias("value"), F.lit(PANIC).alias("confidence"), F.lit(0).alias("line"), "line_no")
    return once.unionByName(panics)
