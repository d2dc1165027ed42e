"""File trees as tables: walk, ignore rules, classification, marker files."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs

# Directories no walk enters.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "vendor", ".claude", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", ".dist", "build", ".build", "target", ".idea", ".vscode", ".DS_Store")
MOST_TOPS = 10_000  # directories the driver opens at most
BATCH_BYTES = 32 << 20
# Files that show a build or test system, at the root or anywhere.
BUILD_ROOT = {"Go Modules": ("go.mod",), "npm": ("package.json",), "Cargo": ("Cargo.toml",), "Maven": ("pom.xml",), "Gradle": ("build.gradle", "build.gradle.kts"), "Make": ("Makefile", "makefile", "GNUmakefile"), "CMake": ("CMakeLists.txt",), "Bazel": ("BUILD", "WORKSPACE", "MODULE.bazel"), "Poetry": ("pyproject.toml",), "Pipenv": ("Pipfile",), "pip": ("requirements.txt", "setup.py", "setup.cfg"), "Bundler": ("Gemfile",), "Composer": ("composer.json",), "Mix": ("mix.exs",), "sbt": ("build.sbt",), "Docker": ("Dockerfile",), "Docker Compose": ("docker-compose.yml", "docker-compose.yaml"), "MSBuild": ("global.json", "Directory.Build.props", "Directory.Build.targets", "NuGet.Config")}
BUILD_DEEP = {"Vite": ("vite.config.ts", "vite.config.js", "vite.config.mts", "vite.config.mjs"), "Next.js": ("next.config.js", "next.config.ts", "next.config.mjs"), "Webpack": ("webpack.config.js", "webpack.config.ts", "webpack.config.mjs"), "Rollup": ("rollup.config.js", "rollup.config.ts", "rollup.config.mjs"), "Turbo": ("turbo.json",), "Electron": ("electron-builder.yml", "electron-builder.json"), "Nx": ("nx.json",)}
TEST_ROOT = {"pytest": ("pytest.ini", "pyproject.toml", "setup.cfg"), "Jest": ("jest.config.js", "jest.config.ts", "jest.config.mjs"), "Vitest": ("vitest.config.ts", "vitest.config.js"), "RSpec": (".rspec",), "Mocha": (".mocharc.js", ".mocharc.yml", ".mocharc.yaml"), "PHPUnit": ("phpunit.xml", "phpunit.xml.dist")}
TEST_DEEP = {"Playwright": ("playwright.config.ts", "playwright.config.js", "playwright.config.mjs"), "Cypress": ("cypress.config.ts", "cypress.config.js"), "Vitest": ("vitest.config.ts", "vitest.config.js")}


def not_skipped(path: Column, names: Iterable[str] = SKIPPED) -> Column:
    """No directory above the file has one of the names."""
    return exprs.outside(path, names)


def ignore_patterns(root: str, name: str = ".gitignore") -> list[str]:
    """The patterns of a root's ignore file: trimmed, without blanks and comments; no negation."""
    path = os.path.join(root, name)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as lines:
        return [p for p in (line.strip() for line in lines) if p and not p.startswith("#")]


def glob(text: Column, pattern: str) -> Column:
    """One * is prefix and suffix; of several only the part before the first counts; no other wildcards."""
    if "*" not in pattern:
        return text == pattern
    head, _, tail = pattern.partition("*")
    if "*" in tail:
        return F.startswith(text, F.lit(head))
    return F.startswith(text, F.lit(head)) & F.endswith(text, F.lit(tail)) & (F.length(text) >= len(head) + len(tail))


def matcher(pattern: str):
    return lambda part: glob(part, pattern)


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern matches the path or, for directories, one of its ancestors."""
    out = F.lit(False)
    for pattern in patterns:
        if pattern.endswith("/"):
            bare = pattern.strip("/")
            out = out | F.startswith(path, F.lit(bare + "/")) | F.contains(path, F.lit("/" + bare + "/"))
        elif "/" not in pattern:
            out = out | F.exists(F.split(path, "/"), matcher(pattern))
        elif pattern.startswith("/"):
            out = out | glob(path, pattern[1:]) | F.startswith(path, F.lit(pattern[1:] + "/"))
        else:
            out = out | glob(path, pattern) | F.endswith(path, F.lit("/" + pattern))
    return out


def tops(base: str, most: int = MOST_TOPS) -> list[tuple[str, bool]]:
    """(relative path, whether all below it counts): directories that are opened level by level until there are ``most`` of them."""
    out, level = [], [""]
    while level and len(out) + len(level) < most:
        below = []
        for rel in level:
            out.append((rel, False))  # its own files only
            try:
                below += [os.path.join(rel, e.name) for e in os.scandir(os.path.join(base, rel)) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED]
            except OSError:
                continue
        level = below
    return out + [(rel, True) for rel in level]


def below(base: str):
    """Lists the files under directories, on the executors: skipped directories are not entered, unreadable files left out."""
    schema = pa.schema([("rel_path", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for folder, inside, names in os.walk(os.path.join(base, top)):
                    inside[:] = [d for d in inside if d not in SKIPPED] if deep else []
                    rows = []
                    for name in names:
                        path = os.path.join(folder, name)
                        try:
                            rows.append((os.path.relpath(path, base).replace(os.sep, "/"), os.stat(path).st_size))
                        except OSError:
                            continue
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_bytes(base: str):
    """Reads the files, a bounded number of bytes at a time."""
    schema = pa.schema([("rel_path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for rel, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(os.path.join(base, rel), "rb") as f:
                        rows.append((rel, size, f.read()))
                except OSError:
                    continue
                held += len(rows[-1][2])
                if held > BATCH_BYTES:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return run


def scan(spark: SparkSession, root: str, patterns: Iterable[str] | None = None) -> DataFrame:
    """root, path, rel_path, size, language, role, tokens, content, text of a tree. Unreadable files are left out.

    Of a tree on a mounted file system the driver opens only some top directories; executors list what is below them and
    read it, without entering skipped directories: a file source would hide names that begin with a dot or underscore, such
    as package files. Other stores are read as binary files, with that limitation. Every byte is kept, so token counts are
    those of the files.
    """
    base = root.rstrip("/")
    patterns = ignore_patterns(base) if patterns is None else list(patterns)
    if "://" in base:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(base)
        named = raw.select(F.substring_index("path", base + "/", -1).alias("rel_path"), F.col("length").alias("size"), "content").where(not_skipped(F.col("rel_path")))
    else:
        starts = spark.createDataFrame(tops(base), "top string, deep boolean")
        listed = starts.repartition(spark.sparkContext.defaultParallelism).mapInArrow(below(base), "rel_path string, size bigint").where(~ignored(F.col("rel_path"), patterns))
        named = listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read_bytes(base), "rel_path string, size bigint, content binary")
    kept = named.where(~ignored(F.col("rel_path"), patterns))
    return classify(kept.select(F.lit(base).alias("root"), F.concat(F.lit(base + "/"), F.col("rel_path")).alias("path"), "rel_path", "size", "content"))


def classify(files: DataFrame) -> DataFrame:
    lang = exprs.language(F.col("rel_path"))
    return files.withColumn("language", lang).withColumn("role", exprs.role(F.col("rel_path"), F.col("language"))).withColumn("tokens", exprs.tokens(F.col("content"))).withColumn("text", exprs.text_of(F.col("content")))


def systems(files: DataFrame, at_root: dict, deep: dict, go_test: bool = False) -> DataFrame:
    """root, name, phase, in the order root systems, deep ones not yet named, Go test."""
    spark = files.sparkSession
    rows = [(f, name, 0) for name, fs in at_root.items() for f in fs] + [(f, name, 1) for name, fs in deep.items() for f in fs]
    marks = spark.createDataFrame(rows, "marker string, name string, phase int")
    named = files.select("root", "rel_path", exprs.base_name(F.col("rel_path")).alias("marker"))
    hits = named.join(F.broadcast(marks), "marker").where("phase = 1 OR instr(rel_path, '/') = 0").select("root", "name", "phase")  # a fixed table
    if go_test:
        hits = hits.unionByName(files.where(F.endswith("rel_path", F.lit("_test.go"))).select("root", F.lit("Go test").alias("name"), F.lit(2).alias("phase")).distinct())
    return hits.groupBy("root", "name").agg(F.min("phase").alias("phase"))


def build_systems(files: DataFrame) -> DataFrame:
    return systems(files, BUILD_ROOT, BUILD_DEEP)


def test_systems(files: DataFrame) -> DataFrame:
    return systems(files, TEST_ROOT, TEST_DEEP, go_test=True)


def file_runner(files: DataFrame) -> DataFrame:
    """root, system: the first test system of a tree that runs single files."""
    single = test_systems(files).where(F.col("name").isin("pytest", "Jest", "Vitest"))
    return single.groupBy("root").agg(F.min(F.struct("phase", "name"))["name"].alias("system"))


def languages(files: DataFrame, *keys: str) -> DataFrame:
    return files.where("language <> ''").groupBy(*keys, "language").agg(F.count("*").alias("files"))
