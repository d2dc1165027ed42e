"""Results written: JSON artifacts, packs, runs, tables as Markdown."""

from __future__ import annotations

import hashlib
import json
import os
import time
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_artifact(df: DataFrame, folder: str, feature: str, stamp: str) -> str:
    """One JSON folder per feature and time; the latest is the greatest name."""
    path = f"{folder}/{feature}/{stamp}"
    df.write.mode("overwrite").json(path)
    return path


def latest_artifact(folder: str, feature: str) -> str | None:
    base = os.path.join(folder, feature)
    names = sorted(os.listdir(base)) if os.path.isdir(base) else []
    return os.path.join(base, names[-1]) if names else None


def save_runs(runs: DataFrame, path: str) -> None:
    """Append-only, by feature; reading takes the last write of an id."""
    runs.withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("feature").parquet(path)


def read_runs(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("written_at").desc()))).where("_n = 1").drop("_n")


def to_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as indented JSON, characters unescaped."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it instead")
    return json.dumps(rows, indent=2, ensure_ascii=False, default=str)


def to_markdown(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1_000) -> str:
    """A small result as a Markdown table."""
    columns = list(columns or df.columns)
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it instead")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]])


def run_id(feature: str) -> str:
    """A new id of a run; it is no part of any digest of results."""
    return f"{feature}-{hashlib.sha256(f'{time.time_ns()}-{feature}'.encode()).hexdigest()[:8]}"


PACK = "analysis-"


def save_pack(pack: DataFrame, folder: str, stamp: str | None = None) -> str:
    """An analysis of sessions as one JSON folder named by its time (UTC)."""
    path = os.path.join(folder, PACK + (stamp or time.strftime("%Y%m%d-%H%M%S", time.gmtime())) + ".json")
    pack.coalesce(1).write.mode("overwrite").json(path)
    return path


def latest_pack(folder: str) -> str | None:
    """The latest analysis: the greatest name; none where there is none."""
    names = sorted(n for n in os.listdir(folder) if n.startswith(PACK) and n.endswith(".json")) if os.path.isdir(folder) else []
    return os.path.join(folder, names[-1]) if names else None


def session_zip(pack: str, session: str | None, target: str) -> str:
    """An analysis together with the session it is about; a missing session is left out."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        parts = [os.path.join(pack, n) for n in sorted(os.listdir(pack)) if not n.startswith((".", "_"))] if os.path.isdir(pack) else [pack]
        for n, name in enumerate(parts):
            out.write(name, os.path.basename(pack) if len(parts) == 1 else f"{n:05}-{os.path.basename(pack)}")
        if session and os.path.isfile(session):
            out.write(session, os.path.basename(session))
    return target


# What the Markdown of each answer shows, in this order.
SHOWN = {
    "context": ("Context", ("rank", "rel_path", "score", "reason", "tokens", "content_mode")),
    "related": ("Related files", ("rel_path", "relation", "confidence", "tokens")),
    "tests": ("Tests", ("rel_path", "run_command", "confidence")),
    "impact": ("Impact", ("kind", "rel_path", "via", "confidence")),
    "explain-file": ("File", ("section", "value", "detail", "ord")),
    "repo-overview": ("Repository", ("section", "value", "notes", "ord")),
    "failure-context": ("Failures", ("kind", "value", "confidence", "line")),
    "verify-plan": ("Verification", ("ord", "command", "kind", "required", "cost")),
}


def render(feature: str, answer: DataFrame, limits: DataFrame | None = None, most: int = 1_000) -> str:
    """A small answer as Markdown under its heading, in a stable order, with what it cannot say below."""
    title, columns = SHOWN[feature]
    order = ("ord",) if "ord" in columns and feature == "verify-plan" else ("section", "ord") if "ord" in columns else ("rank",) if "rank" in columns else columns
    body = to_markdown(answer.orderBy(*order), columns, most)
    notes = [f"- {r['kind']}" for r in limits.select("kind").distinct().orderBy("kind").collect()] if limits is not None else []
    return "\n".join([f"# {title}", "", body, *(["", "Limitations:", *notes] if notes else [])]) + "\n"
