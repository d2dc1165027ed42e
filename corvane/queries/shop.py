"""Source trees made of the star schema, one per region, so that every relation of the file graph has many known rows.

Each nation is a Go package, a Python package, a TypeScript directory and a C# project; suppliers and customers are files
that import their neighbours. The text of the trees comes from the same statement in both engines (``TREE``); what the
graph must find in it is written down in SQL from keys alone and never reads the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs
from corvane.session import Stored

# Spark and DuckDB run this alike; braces are table names.
TREE = """
nat AS (SELECT n_nationkey AS n, n_regionkey AS r, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt FROM {nation}),
cust AS (SELECT c_custkey AS k, n, r, c_mktsegment AS seg, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nxt, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nxt2, lag(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS prv FROM {customer} JOIN nat ON c_nationkey = n),
sup AS (SELECT s_suppkey AS k, n, r, nxt FROM {supplier} JOIN nat ON s_nationkey = n),
shop AS (
SELECT 'r' || r AS root, 'go.mod' AS rel_path, 'mod' AS kind, 'module shop' || r || chr(10) AS text FROM nat GROUP BY r
UNION ALL SELECT 'r' || r, 'pytest.ini', 'ini', '[pytest]' || chr(10) FROM nat GROUP BY r
UNION ALL SELECT 'r' || r, 'tsconfig.json', 'json', '{{"compilerOptions": {{"paths": {{"@all/*": ["web/*"]}}}}}}' || chr(10) FROM nat GROUP BY r
UNION ALL SELECT 'r' || r, 'n' || n || '/s' || k || '.go', 'go', 'package n' || n || chr(10) || chr(10) || 'import (' || chr(10) || '"fmt"' || chr(10) || coalesce('"shop' || r || '/n' || nxt || '"' || chr(10), '') || '"shop' || r || '/n' || (k % 25) || '"' || chr(10) || ')' || chr(10) || chr(10) || 'func S' || k || '() {{}}' || chr(10) FROM sup
UNION ALL SELECT 'r' || r, 'n' || n || '/c' || k || '_test.go', 'gotest', 'package n' || n || chr(10) || chr(10) || 'func TestC' || k || '() {{}}' || chr(10) FROM cust WHERE seg = 'BUILDING'
UNION ALL SELECT 'r' || r, 'py/n' || n || '/p' || k || '.py', 'py', 'import os' || chr(10) || coalesce('from .p' || nxt || ' import f' || nxt || chr(10), '') || coalesce('import py.n' || n || '.p' || prv || chr(10), '') || chr(10) || 'def f' || k || '():' || chr(10) || '    pass' || chr(10) FROM cust WHERE seg = 'MACHINERY'
UNION ALL SELECT 'r' || r, 'web/n' || n || '/c' || k || (CASE WHEN nxt IS NULL THEN '.test' ELSE '' END) || '.ts', CASE WHEN nxt IS NULL THEN 'tstest' ELSE 'ts' END, coalesce('import {{ f' || nxt || ' }} from "./c' || nxt || (CASE WHEN nxt2 IS NULL THEN '.test' ELSE '' END) || '";' || chr(10), '') || coalesce('import type back, {{ g }} from "@all/n' || n || '/c' || prv || '";' || chr(10), '') || 'export function f' || k || '() {{}}' || chr(10) FROM cust WHERE seg = 'AUTOMOBILE'
UNION ALL SELECT 'r' || r, 'Net/N' || n || '/C' || k || '.cs', 'cs', 'class C' || k || ' {{}}' || chr(10) FROM cust WHERE seg = 'HOUSEHOLD'
UNION ALL SELECT 'r' || r, 'Net/N' || n || '/N' || n || '.csproj', 'csproj', '<Project><ItemGroup>' || coalesce('<ProjectReference Include="..' || chr(92) || 'N' || nxt || chr(92) || 'N' || nxt || '.csproj" />', '') || '<PackageReference Include="Pack" Version="1.' || n || '" /></ItemGroup></Project>' FROM nat
UNION ALL SELECT 'r' || r, 'docs/n' || n || '/c' || k || '.md', 'md', '# ' || k || chr(10) FROM cust WHERE seg = 'FURNITURE')"""

# --- what must come out, from keys -------------------------------------------------------------------------------------
FILES = (
    TREE.format(nation="nation", customer="customer", supplier="supplier")
    + """,
f AS (SELECT root, rel_path, kind, greatest(1, octet_length(encode(text)) // 4) AS tokens,
  CASE kind WHEN 'go' THEN 'Go' WHEN 'gotest' THEN 'Go' WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'tstest' THEN 'TypeScript' WHEN 'cs' THEN 'C#' WHEN 'md' THEN 'Markdown' WHEN 'json' THEN 'JSON' ELSE '' END AS language,
  CASE WHEN kind IN ('gotest', 'tstest') THEN 'test' WHEN kind = 'md' THEN 'docs' WHEN kind = 'json' THEN 'config' WHEN kind IN ('go', 'py', 'ts', 'cs') THEN 'source' ELSE 'other' END AS role,
  CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '.' END AS dir FROM shop)"""
)
GRAPH = (
    FILES
    + """,
py AS (SELECT 'r' || r AS root, 'py/n' || n || '/p' || k || '.py' AS src, unnest(['py/n' || n || '/p' || nxt || '.py', 'py/n' || n || '/p' || prv || '.py']) AS dst FROM cust WHERE seg = 'MACHINERY'),
ts AS (SELECT 'r' || r AS root, 'web/n' || n || '/c' || k || CASE WHEN nxt IS NULL THEN '.test' ELSE '' END || '.ts' AS src, unnest(['web/n' || n || '/c' || nxt || CASE WHEN nxt2 IS NULL THEN '.test' ELSE '' END || '.ts', 'web/n' || n || '/c' || prv || '.ts']) AS dst FROM cust WHERE seg = 'AUTOMOBILE'),
fe AS (SELECT *, 'python_regex' AS source_tool FROM py WHERE dst IS NOT NULL UNION ALL SELECT *, 'script_regex' FROM ts WHERE dst IS NOT NULL),
gomem AS (SELECT 'r' || r AS root, 'shop' || r || '/n' || n AS unit, 'n' || n || '/s' || k || '.go' AS path, false AS test FROM sup UNION ALL SELECT 'r' || r, 'shop' || r || '/n' || n, 'n' || n || '/c' || k || '_test.go', true FROM cust WHERE seg = 'BUILDING'),
csmem AS (SELECT 'r' || r AS root, 'Net/N' || n || '/N' || n || '.csproj' AS unit, 'Net/N' || n || '/C' || k || '.cs' AS path, false AS test FROM cust WHERE seg = 'HOUSEHOLD'),
mem AS (SELECT * FROM gomem UNION ALL SELECT * FROM csmem),
goue AS (SELECT DISTINCT 'r' || s.r AS root, 'shop' || s.r || '/n' || s.n AS u, 'shop' || s.r || '/n' || t.n AS v FROM sup s JOIN nat t ON t.r = s.r AND t.n <> s.n AND (t.n = s.nxt OR t.n = s.k % 25) WHERE 'shop' || t.r || '/n' || t.n IN (SELECT unit FROM gomem)),
csue AS (SELECT 'r' || r AS root, 'Net/N' || n || '/N' || n || '.csproj' AS u, 'Net/N' || nxt || '/N' || nxt || '.csproj' AS v FROM nat WHERE nxt IS NOT NULL),
ue AS (SELECT *, 'go' AS kind FROM goue UNION ALL SELECT *, 'csproj' FROM csue),
seeds AS (SELECT root, min(rel_path) AS src FROM f WHERE role = 'source' GROUP BY root, dir),
rel AS (SELECT s.root, s.src, e.dst, 'imports' AS relation FROM seeds s JOIN fe e ON e.root = s.root AND e.src = s.src
UNION SELECT s.root, s.src, e.src, 'importers' FROM seeds s JOIN fe e ON e.root = s.root AND e.dst = s.src
UNION SELECT s.root, s.src, m.path, 'imports' FROM seeds s JOIN mem a ON a.root = s.root AND a.path = s.src JOIN ue ON ue.root = s.root AND ue.u = a.unit JOIN mem m ON m.root = s.root AND m.unit = ue.v WHERE NOT m.test
UNION SELECT s.root, s.src, m.path, 'importers' FROM seeds s JOIN mem a ON a.root = s.root AND a.path = s.src JOIN ue ON ue.root = s.root AND ue.v = a.unit JOIN mem m ON m.root = s.root AND m.unit = ue.u WHERE NOT m.test
UNION SELECT s.root, s.src, m.path, CASE WHEN m.test THEN 'tests' ELSE 'peers' END FROM seeds s JOIN mem a ON a.root = s.root AND a.path = s.src JOIN mem m ON m.root = s.root AND m.unit = a.unit AND m.path <> s.src),
ranked AS (SELECT rel.*, CASE relation WHEN 'imports' THEN 1 WHEN 'importers' THEN 2 WHEN 'tests' THEN 3 ELSE 4 END AS ord, f.tokens, f.role, f.language FROM rel JOIN f ON f.root = rel.root AND f.rel_path = rel.dst),
related AS (SELECT root, src, dst AS rel_path, arg_min(relation, ord) AS relation, min(tokens) AS tokens FROM ranked GROUP BY root, src, dst),
tested AS (SELECT root, src, dst AS rel_path, CASE WHEN min(CASE WHEN relation = 'tests' THEN 1 ELSE 2 END) = 1 THEN 0.95::DOUBLE ELSE 0.97::DOUBLE END AS confidence FROM ranked WHERE relation = 'tests' OR relation = 'importers' AND role = 'test' GROUP BY root, src, dst)"""
)
RUN = "CASE WHEN ends_with(rel_path, '.go') THEN 'go test ./' || regexp_replace(rel_path, '/[^/]*$', '') || '/...' ELSE 'pytest ' || rel_path END"
RELATED = "CASE relation WHEN 'imports' THEN 0.92::DOUBLE WHEN 'importers' THEN 0.88::DOUBLE WHEN 'tests' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END"
BUDGET = 150
CAPSULE = (
    GRAPH
    + f""",
marks AS (SELECT root, src, src AS path, 1 AS priority FROM seeds UNION ALL SELECT root, src, dst, CASE relation WHEN 'imports' THEN 2 WHEN 'importers' THEN 3 WHEN 'peers' THEN 4 ELSE 5 END FROM rel),
best AS (SELECT root, src, path, min(priority) AS priority FROM marks GROUP BY ALL),
cand AS (SELECT b.root || ':' || b.src AS request, b.path, b.priority, f.language, f.role, f.tokens, CASE WHEN b.priority = 3 AND f.role = 'test' THEN 0.7 WHEN b.priority = 1 THEN 1.0 WHEN b.priority = 2 THEN 0.9 WHEN b.priority = 3 THEN 0.8 WHEN b.priority = 4 THEN 0.75 ELSE 0.7 END::DOUBLE AS score FROM best b JOIN f ON f.root = b.root AND f.rel_path = b.path),
room AS (SELECT request, greatest({BUDGET} - coalesce(sum(tokens) FILTER (score >= 0.8), 0), 0) AS room FROM cand GROUP BY request),
queue AS (SELECT c.request, path, tokens, room, row_number() OVER (PARTITION BY c.request ORDER BY score DESC, path) AS k FROM cand c JOIN room USING (request) WHERE score < 0.8),
walk AS (SELECT request, path, k, tokens <= room AS included, CASE WHEN tokens <= room THEN tokens ELSE 0 END AS used FROM queue WHERE k = 1
  UNION ALL SELECT q.request, q.path, q.k, w.used + q.tokens <= q.room, CASE WHEN w.used + q.tokens <= q.room THEN w.used + q.tokens ELSE w.used END FROM walk w JOIN queue q ON q.request = w.request AND q.k = w.k + 1),
chosen AS (SELECT c.*, CASE WHEN score >= 0.8 THEN 1 ELSE 2 END AS tier, coalesce(w.included, true) AS included FROM cand c LEFT JOIN walk w ON w.request = c.request AND w.path = c.path),
counted AS (SELECT request, {BUDGET} AS budget, count(*) AS considered, count(*) FILTER (included) AS included, count(*) FILTER (tier = 2 AND NOT included) AS contextual_out, coalesce(sum(tokens) FILTER (included), 0)::BIGINT AS used, sum(tokens)::BIGINT AS total, coalesce(sum(tokens) FILTER (tier = 1), 0)::BIGINT AS critical_tokens FROM chosen GROUP BY request)"""
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """root, rel_path, language, role, tokens, text of the trees, stored: the graph reads them many times."""
    read = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("nation", "customer", "supplier")}
    trees = spark.sql(f"WITH {TREE} SELECT root, rel_path, text FROM shop", **read)
    lang = exprs.language(F.col("rel_path"))
    known = trees.withColumn("language", lang).withColumn("role", exprs.role(F.col("rel_path"), F.col("language"))).withColumn("tokens", exprs.tokens(F.col("text")))
    return Stored(spark).table(known)[0]


def seeds(tree: DataFrame) -> DataFrame:
    """One request per directory: its first source file."""
    return tree.where("role = 'source'").groupBy("root", exprs.directory(F.col("rel_path")).alias("dir")).agg(F.min("rel_path").alias("src")).select("root", "src")
