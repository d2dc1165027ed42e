"""The relations of all files, in linear form."""

from corvane.operators import graph as g
from corvane.queries import registry


def test_relations_of_every_file_are_in_registered_results(spark, tmp_path):
    tree = {
        "m.go": 'package m\n\nimport "r/a"\n', "a/x.go": "package a\n", "a/y.go": "package a\n", "a/y_test.go": "package a\n", "b/z.go": 'package b\n\nimport "r/a"\n', "b/w.go": "package b\n",
        "p/__init__.py": "", "p/q.py": "import p.s\n", "p/s.py": "", "t/c.csproj": "<Project><ItemGroup><ProjectReference Include=\"../u/d.csproj\"/></ItemGroup></Project>", "t/C.cs": "class C {}", "u/d.csproj": "<Project><ItemGroup></ItemGroup></Project>", "u/D.cs": "class D {}",
    }
    rows = [(k, "r", "s1", path, bytearray(text.encode())) for k, (path, text) in enumerate(tree.items())]
    spark.createDataFrame(rows, "file_id bigint, repo string, snapshot string, rel_path string, content binary").write.parquet(f"{tmp_path}/files.parquet")
    folder, known = str(tmp_path), registry.queries()
    members = [tuple(r) for name in ("members_go", "members_csharp") for r in known[name](spark, folder).select("path", "unit_id", "test").collect()]
    assert {m[0] for m in members} == {p for p in tree if p.endswith((".go", ".cs"))} and len(members) == 8
    links = {tuple(r) for r in known["unit_edges"](spark, folder).select("src_unit", "dst_unit").collect()}
    assert links == {("r", "r/a"), ("r/b", "r/a"), ("t/c.csproj", "u/d.csproj")}
    assert {(r["src"], r["dst"]) for r in known["file_edges"](spark, folder).collect()} >= {("p/q.py", "p/s.py")}

    # every pair of the graph follows from these rows
    pairs = set()
    for src, unit, _ in members:
        for dst, other, test in members:
            if src != dst and unit == other:
                pairs.add((src, dst, "tests" if test else "peers"))
            if not test and (unit, other) in links:
                pairs.add((src, dst, "imports"))
            if not test and (other, unit) in links:
                pairs.add((src, dst, "importers"))
    graph = registry.graph_of(spark, folder)
    seeds = graph.files.selectExpr("root", "rel_path AS src")
    got = {(r["src"], r["dst"], r["relation"]) for group in graph.groups for r in g.unit_relations(group, seeds).collect()}
    assert got == pairs and len({p[0] for p in pairs}) == 8
