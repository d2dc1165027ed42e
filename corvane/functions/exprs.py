"""Pure column rules: tokens, languages, roles, paths, commands, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names by lower-case extension.
LANGUAGE_OF_EXTENSION = {
    ".go": "Go", ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".rs": "Rust", ".java": "Java", ".cs": "C#", ".axaml": "C#", ".xaml": "C#", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++", ".hpp": "C++", ".rb": "Ruby", ".kt": "Kotlin", ".kts": "Kotlin", ".swift": "Swift", ".php": "PHP", ".scala": "Scala", ".hs": "Haskell", ".ex": "Elixir", ".exs": "Elixir", ".clj": "Clojure", ".ml": "OCaml", ".mli": "OCaml", ".fs": "F#", ".fsx": "F#", ".lua": "Lua", ".r": "R", ".dart": "Dart", ".md": "Markdown", ".mdx": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".xml": "XML", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "SCSS", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell", ".ps1": "PowerShell", ".proto": "Protobuf", ".tf": "Terraform", ".tfvars": "Terraform",
}
# Limitation kinds that inform and do not mean worse results; features that answer with content; edit tools.
ADVISORY = ("contextual_trimmed", "critical_path_over_budget", "over_budget")
CONTENT_FEATURES = ("context", "explain-file", "impact", "verify-plan", "failure-context", "repo-overview", "related", "tests", "symbols")
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "str_replace_editor")
# Notes of usual top-level directories.
TOP_NOTES = {"cmd": "command entry points", "internal": "internal packages", "pkg": "public packages", "api": "API definitions", "web": "web/frontend", "frontend": "web/frontend", "ui": "web/frontend", "test": "test suites", "tests": "test suites", "spec": "test suites", "specs": "test suites", "docs": "documentation", "doc": "documentation", "documentation": "documentation", "scripts": "build/automation scripts", "script": "build/automation scripts", "deploy": "infrastructure/deployment", "infra": "infrastructure/deployment", "terraform": "infrastructure/deployment", "k8s": "infrastructure/deployment", "kubernetes": "infrastructure/deployment", "proto": "protobuf definitions", "protobuf": "protobuf definitions"}
AUTO_BUDGET = 999_999


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def tokens(text: Column) -> Column:
    """A token per four bytes, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.octet_length(text) / 4).cast("bigint"))


def text_of(content: Column) -> Column:
    """Binary content as text; null where it is not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The parent directory, '.' at the root."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


def outside(path: Column, names: Sequence[str]) -> Column:
    """No directory above the file has one of the names."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in names])) | (F.size(parts) == 1)


def walk_key(path: Column) -> Column:
    """Order of a directory walk: by path components."""
    return F.split(path, "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Display name by extension, '' if unknown."""
    return F.coalesce(lookup(extension(path), LANGUAGE_OF_EXTENSION), F.lit(""))


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def role(path: Column, lang: Column) -> Column:
    """generated, vendor, test, docs, config, source or other: the first that fits."""
    low, name = F.lower(path), base_name(path)
    ends, holds = lambda *xs: any_of(*[F.endswith(low, F.lit(x)) for x in xs]), lambda *xs: any_of(*[F.contains(low, F.lit(x)) for x in xs])
    return (
        F.when(holds("generated", ".gen.") | ends(".pb.go", "_gen.go", ".generated.ts"), "generated")
        .when(F.startswith(low, F.lit("vendor/")) | holds("/vendor/"), "vendor")
        .when(ends("_test.go", ".test.ts", ".spec.ts", ".test.js", ".spec.js") | F.startswith(name, F.lit("test_")) | holds("/test/", "/tests/", "/spec/", "/__tests__/"), "test")
        .when(holds(".tests/", ".test/", ".specs/", ".spec/") | ends("tests.cs", "specs.cs"), "test")
        .when((lang == "Markdown") | holds("/docs/", "/doc/") | name.isin("README", "CHANGELOG", "LICENSE"), "docs")
        .when(lang.isin("YAML", "TOML", "JSON") | ends(".env") | F.startswith(name, F.lit(".")) | name.isin("Makefile", "Dockerfile"), "config")
        .when(lang != "", "source")
        .otherwise("other")
    )


def is_test_name(path: Column) -> Column:
    """By name only; differs from the role ``test``."""
    name = F.lower(base_name(path))
    return F.endswith(name, F.lit("_test.go")) | F.startswith(name, F.lit("test_")) | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec."))


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..``; null where the path leaves its root."""
    step = lambda acc, part: (
        F.when(acc.isNull(), acc)
        .when(part.isin("", "."), acc)
        .when(part == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.concat(acc, F.array(part)))
    )
    return F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS array<string>)"), step, lambda acc: F.array_join(acc, "/"))


def first_lines(text: Column, n: int = 60) -> Column:
    """The first lines, each ended by a line feed."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r", ""), "\n$", ""), "\n")
    return F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n"))


def outline(names: Column) -> Column:
    """Symbols as an outline: members indented under the part after their first dot."""
    return F.array_join(F.transform(names, lambda s: F.when(F.instr(s, ".") > 0, F.concat(F.lit("  ."), F.regexp_replace(s, r"^[^.]*\.", ""))).otherwise(s)), "\n")


def symbol_matches(name: Column, wanted: Column) -> Column:
    return (name == wanted) | F.endswith(name, F.concat(F.lit("."), wanted))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def ratio_cut(x: Column) -> Column:
    """Two decimals, cut off."""
    return (x * 100).cast("bigint") / 100


def ratio_round(x: Column) -> Column:
    """Two decimals, rounded: metrics, unlike capsules."""
    return F.round(x, 2)


def segments(command: Column) -> Column:
    """The commands of a shell line, split at && || ; and line ends, not at a pipe."""
    return F.transform(F.split(F.regexp_replace(command, r"&&|\|\||;", "\n"), "\n"), lambda s: F.trim(s))


def calls_tool(command: Column, tool: str) -> Column:
    return F.coalesce(F.exists(segments(command), lambda s: (s == tool) | F.startswith(s, F.lit(tool + " "))), F.lit(False))


def seeds_of(command: Column) -> Column:
    """The files a command names after --files."""
    given = F.coalesce(F.nullif(F.regexp_extract(command, r"--files=(.*)", 1), F.lit("")), F.regexp_extract(command, r"--files (.*)", 1))
    return F.filter(F.transform(F.split(F.split(given, " --")[0], ","), lambda s: F.trim(s)), lambda s: s != "")


def run_command(path: Column, system: Column) -> Column:
    """Go by the file, others by the first test system of the tree that runs single files; '' without one."""
    go = F.when(directory(path) == ".", "go test .").otherwise(F.concat(F.lit("go test ./"), directory(path), F.lit("/...")))
    other = F.when(system == "pytest", F.concat(F.lit("pytest "), path)).when(system.isin("Jest", "Vitest"), F.concat(F.lit("npx "), F.lower(system), F.lit(" "), path)).otherwise("")
    return F.when(F.endswith(path, F.lit(".go")), go).otherwise(other)


def risk_notes(path: Column, file_role: Column) -> Column:
    name = F.lower(base_name(path))
    notes = F.array(
        F.when(file_role == "generated", "generated file"),
        F.when(F.endswith(name, F.lit(".go")) & (F.contains(path, F.lit("interface")) | F.contains(name, F.lit("iface"))), "interface definition"),
        F.when(any_of(*[F.contains(name, F.lit(w)) for w in ("handler", "router", "controller", "api")]), "request surface"),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def top_note(name: Column, file_role: Column) -> Column:
    return F.coalesce(lookup(F.lower(name), TOP_NOTES), F.when(file_role == "config", "configuration").otherwise(""))


def relation_label(score: Column) -> Column:
    return F.when(score >= 1.0, "seed").when(score >= 0.9, "imports").when(score >= 0.8, "importers").when(score >= 0.75, "peers").otherwise("tests")


def parse_budget(text: str | None) -> int:
    """'' and 'auto' are as good as no limit."""
    if text in (None, "", "auto"):
        return AUTO_BUDGET
    value = int(text)
    if value <= 0:
        raise ValueError("a budget is positive")
    return value


def project_key(path: Column) -> Column:
    return F.translate(path, ":\\/.", "----")


def relative(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def row_hash(*columns: Column) -> Column:
    """A stable digest of a result row."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit("s")))


def uri_path(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(uri, "^file://(?:localhost)?", ""))


def path_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))
