"""Column rules on literals, one row per case."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import exprs
from corvane.sources.files import ignored, not_skipped


def values(spark, column, rows, schema="p string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column).collect()]


def test_roles_by_first_match(spark):
    paths = ["a/generated/x.go", "x.gen.ts", "a.pb.go", "vendor/x.go", "a/vendor/x.py", "a_test.go", "test_a.py", "a.spec.ts", "a/tests/x.py", "tests/x.py", "x.test.tsx", "Foo.Tests/A.cs", "ATests.cs", "README.md", "a/docs/x.txt", "LICENSE", "a.yaml", ".env", "Makefile", "a.py", "a.bin", "GenerateD.py"]
    got = values(spark, exprs.role(F.col("p"), exprs.language(F.col("p"))), paths)
    assert got == ["generated", "generated", "generated", "vendor", "vendor", "test", "test", "test", "test", "source", "source", "test", "test", "docs", "docs", "docs", "config", "config", "config", "source", "other", "generated"]


def test_languages_and_tokens(spark):
    assert values(spark, exprs.language(F.col("p")), ["a.PY", "a/b.c.ts", "noext", "x.unknown"]) == ["Python", "TypeScript", "", ""]
    assert values(spark, exprs.tokens(F.col("p")), ["", "abc", "abcdefgh", "äöü€"]) == [1, 1, 2, 2]


def test_paths(spark):
    assert values(spark, exprs.normalise(F.col("p")), ["a/./b/../c", "../a", "a/../..", "./a//b", ""]) == ["a/c", None, None, "a/b", ""]
    assert values(spark, exprs.directory(F.col("p")), ["a/b.c", "a", "a/b/c"]) == ["a", ".", "a/b"]
    ordered = [r[0] for r in spark.createDataFrame([("a.go",), ("a/b.go",), ("a/a/z.go",)], "p string").orderBy(exprs.walk_key(F.col("p"))).collect()]
    assert ordered == ["a/a/z.go", "a/b.go", "a.go"]
    assert values(spark, exprs.project_key(F.col("p")), ["C:\\a.b/c"]) == ["C--a-b-c"]
    assert values(spark, exprs.uri_path(exprs.path_uri(F.col("p"))), ["/a b/c+d.py"]) == ["/a b/c+d.py"]


def test_names(spark):
    assert values(spark, exprs.is_test_name(F.col("p")), ["a/x.test.tsx", "a/test_x", "tests/x.py", "x_test.go"]) == [True, True, False, True]
    assert values(spark, exprs.outline(F.split("p", ",")), ["A,A.b,A.b.c"]) == ["A\n  .b\n  .b.c"]
    assert values(spark, exprs.first_lines(F.col("p"), 2), ["a\r\nb\r\nc", "a", "a\n"]) == ["a\nb\n", "a\n", "a\n"]
    assert values(spark, exprs.truncate(F.col("p"), 5), ["abcdef", "abcde"]) == ["ab...", "abcde"]
    assert values(spark, exprs.symbol_matches(F.col("p"), F.lit("b")), ["b", "a.b", "ab"]) == [True, True, False]


def test_commands(spark):
    commands = ["cd x && tool context --files=a/b.py,c.py --budget 5", "echo tool", "x | tool y", "tool", "toolx y", None]
    assert values(spark, exprs.calls_tool(F.col("p"), "tool"), commands) == [True, False, False, True, False, False]
    assert values(spark, exprs.seeds_of(F.col("p")), [commands[0], "tool context --files a.py , b.py --x", "tool"]) == [["a/b.py", "c.py"], ["a.py", "b.py"], []]


@pytest.mark.parametrize("text,value", [("", 999_999), ("auto", 999_999), ("12", 12)])
def test_budget(text, value):
    assert exprs.parse_budget(text) == value


def test_ignore_forms(spark):
    paths = ["build/x", "a/build/y", "a.log", "b/c.log", "top/z", "b/top/z", "x/y/z.txt", "k"]
    assert values(spark, ignored(F.col("p"), ["build/", "*.log", "/top", "y/z.txt"]), paths) == [True, True, True, True, True, False, True, False]
    assert values(spark, not_skipped(F.col("p")), ["node_modules/a", "a/.git/b", "a/b", "build"]) == [False, False, True, True]
