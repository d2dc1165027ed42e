"""All queries of the core over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.extract import python as py
from corvane.extract import script as js
from corvane.extract import units
from corvane.functions import exprs
from corvane.operators import budget as fit
from corvane.operators import calls as metrics
from corvane.operators import graph as g
from corvane.operators import sessions
from corvane.plans import context as capsule
from corvane.plans import evaluation, questions
from corvane.queries import shop
from corvane.session import Stored
from corvane.sources import files as tree
from corvane.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tree_of(spark: SparkSession, folder: str, text: bool = True) -> DataFrame:
    """Every snapshot of a repository as a tree of its own, classified by the path rules."""
    files = table(spark, folder, "files")
    out = files.select("file_id", F.concat("repo", F.lit("@"), "snapshot").alias("root"), "rel_path", exprs.language(F.col("rel_path")).alias("language"), *(["content"] if text else []), exprs.tokens(F.col("content")).alias("tokens"))
    out = out.withColumn("role", exprs.role(F.col("rel_path"), F.col("language")))
    return out.withColumn("text", exprs.text_of(F.col("content"))).drop("content") if text else out


def graph_of(spark: SparkSession, folder: str) -> g.Graph:
    return g.build(tree_of(spark, folder))


def trees(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of the files table and, where the star schema is there, its trees."""
    own = tree_of(spark, folder).select("root", "rel_path", "language", "role", "tokens", "text")
    try:
        return own.unionByName(shop.files(spark, folder))
    except AnalysisException:
        return own


def shop_graph(spark: SparkSession, folder: str) -> g.Graph:
    return g.build(shop.files(spark, folder))


# --- SQL parts ---------------------------------------------------------------------------------------------------------
PLAIN_CALLS = "compression_ratio > 0 AND NOT isnan(compression_ratio) AND candidates_total > 0"
STATS = f"""count(*) AS calls, count(*) FILTER (has_error) AS errors, count(*) FILTER (limitation_count > 0) AS warnings,
  coalesce(CAST(trunc(sum(latency_ms) / count(*)) AS BIGINT), 0) AS avg_ms,
  coalesce(CAST(sum(budget_used) FILTER (budget_used > 0) // count(*) FILTER (budget_used > 0) AS BIGINT), 0) AS avg_tok,
  coalesce(round(avg(1 / compression_ratio) FILTER ({PLAIN_CALLS}), 6), 0.0) AS ratio,
  count(*) FILTER (feedback = 'good') AS good, count(*) FILTER (feedback = 'bad') AS bad, min(seq) AS first_seq"""
# Fixed values, written out once more: what the other engine must find must not come from the code it checks.
LANGUAGES = r"""CASE lower(regexp_extract(rel_path, '(\.[^./]*)$', 1))
  WHEN '.go' THEN 'Go' WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.mjs' THEN 'JavaScript' WHEN '.rs' THEN 'Rust'
  WHEN '.java' THEN 'Java' WHEN '.cs' THEN 'C#' WHEN '.axaml' THEN 'C#' WHEN '.xaml' THEN 'C#' WHEN '.cpp' THEN 'C++' WHEN '.cc' THEN 'C++' WHEN '.cxx' THEN 'C++' WHEN '.c' THEN 'C'
  WHEN '.h' THEN 'C/C++' WHEN '.hpp' THEN 'C++' WHEN '.rb' THEN 'Ruby' WHEN '.kt' THEN 'Kotlin' WHEN '.kts' THEN 'Kotlin' WHEN '.swift' THEN 'Swift' WHEN '.php' THEN 'PHP' WHEN '.scala' THEN 'Scala'
  WHEN '.hs' THEN 'Haskell' WHEN '.ex' THEN 'Elixir' WHEN '.exs' THEN 'Elixir' WHEN '.clj' THEN 'Clojure' WHEN '.ml' THEN 'OCaml' WHEN '.mli' THEN 'OCaml' WHEN '.fs' THEN 'F#' WHEN '.fsx' THEN 'F#'
  WHEN '.lua' THEN 'Lua' WHEN '.r' THEN 'R' WHEN '.dart' THEN 'Dart' WHEN '.md' THEN 'Markdown' WHEN '.mdx' THEN 'Markdown' WHEN '.json' THEN 'JSON' WHEN '.yaml' THEN 'YAML' WHEN '.yml' THEN 'YAML'
  WHEN '.toml' THEN 'TOML' WHEN '.xml' THEN 'XML' WHEN '.html' THEN 'HTML' WHEN '.htm' THEN 'HTML' WHEN '.css' THEN 'CSS' WHEN '.scss' THEN 'SCSS' WHEN '.sass' THEN 'SCSS' WHEN '.sql' THEN 'SQL'
  WHEN '.sh' THEN 'Shell' WHEN '.bash' THEN 'Shell' WHEN '.zsh' THEN 'Shell' WHEN '.fish' THEN 'Shell' WHEN '.ps1' THEN 'PowerShell' WHEN '.proto' THEN 'Protobuf' WHEN '.tf' THEN 'Terraform' WHEN '.tfvars' THEN 'Terraform'
  ELSE '' END"""
ROLES = f"""CASE WHEN contains(lower(rel_path), 'generated') OR contains(lower(rel_path), '.gen.') OR lower(rel_path) LIKE '%.pb.go' OR ends_with(lower(rel_path), '_gen.go') OR lower(rel_path) LIKE '%.generated.ts' THEN 'generated'
  WHEN starts_with(lower(rel_path), 'vendor/') OR contains(lower(rel_path), '/vendor/') THEN 'vendor'
  WHEN ends_with(lower(rel_path), '_test.go') OR starts_with(parse_filename(rel_path), 'test_') OR regexp_matches(lower(rel_path), '\\.(test|spec)\\.(ts|js)$') OR regexp_matches(lower(rel_path), '/(test|tests|spec|__tests__)/') THEN 'test'
  WHEN regexp_matches(lower(rel_path), '\\.(tests?|specs?)/') OR regexp_matches(lower(rel_path), '(tests|specs)\\.cs$') THEN 'test'
  WHEN {LANGUAGES} = 'Markdown' OR regexp_matches(lower(rel_path), '/docs?/') OR parse_filename(rel_path) IN ('README', 'CHANGELOG', 'LICENSE') THEN 'docs'
  WHEN {LANGUAGES} IN ('YAML', 'TOML', 'JSON') OR ends_with(lower(rel_path), '.env') OR starts_with(parse_filename(rel_path), '.') OR parse_filename(rel_path) IN ('Makefile', 'Dockerfile') THEN 'config'
  WHEN {LANGUAGES} <> '' THEN 'source' ELSE 'other' END"""
TREE = f"tree AS (SELECT file_id, repo || '@' || snapshot AS root, rel_path, {LANGUAGES} AS language, {ROLES} AS role, greatest(1, octet_length(content) // 4) AS tokens, TRY(decode(content)) AS text FROM files)"
DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"


# --- calls (call metrics) ----------------------------------------------------------------------------------------------
@query(f"SELECT feature, {STATS} FROM calls GROUP BY feature")
def calls_by_feature(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.by_feature(table(spark, folder, "calls"))


@query(f"SELECT {STATS} FROM calls")
def calls_totals(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.totals(table(spark, folder, "calls"))


@query("""SELECT kind, CASE WHEN kind IN ('contextual_trimmed', 'critical_path_over_budget', 'over_budget') THEN 'advisory' ELSE 'quality' END AS class, count(*) AS n, min(seq) AS first_seq, CAST(min(struct_pack(s := seq, p := pos)).p - 1 AS INT) AS first_pos
FROM (SELECT seq, unnest(limitation_kinds) AS kind, unnest(generate_series(1, len(limitation_kinds))) AS pos FROM calls) GROUP BY kind""")
def calls_limitation_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.limitation_kinds(table(spark, folder, "calls"))


@query("""WITH t AS (SELECT CASE WHEN regexp_matches(ts, '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)$') THEN epoch_us(TRY_CAST(ts AS TIMESTAMPTZ)) END AS us FROM calls)
SELECT min(us) AS first_us, max(us) AS last_us, CAST(round((max(us) // 1000000 - min(us) // 1000000) / 60) AS BIGINT) AS minutes, count(us) AS parsed FROM t""")
def calls_period(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.period(table(spark, folder, "calls"))


@query("SELECT good, bad, CAST(good * 100 // (good + bad) AS BIGINT) AS percent FROM (SELECT count(*) FILTER (feedback = 'good') AS good, count(*) FILTER (feedback = 'bad') AS bad FROM calls) WHERE good + bad > 0")
def calls_helpful_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.helpful(table(spark, folder, "calls"))


CONTENT = "('" + "', '".join(("context", "explain-file", "impact", "verify-plan", "failure-context", "repo-overview", "related", "tests", "symbols")) + "')"


@query(f"""WITH c AS (SELECT project, seq, coalesce(feedback, '') <> '' AS rated FROM calls WHERE feature IN {CONTENT}), m AS (SELECT project, coalesce(max(seq) FILTER (rated), -1) AS last FROM c GROUP BY project)
SELECT m.project, count(c.seq) AS unrated FROM m LEFT JOIN c ON c.project = m.project AND c.seq > m.last GROUP BY m.project""")
def calls_unrated_tail(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.unrated_tail(table(spark, folder, "calls"), "project")


@query("""SELECT seq, call_id, feature, files_included, budget_used, latency_ms, CASE WHEN compression_ratio > 0 AND NOT isnan(compression_ratio) THEN CAST(trunc((1 - compression_ratio) * 100) AS INT) ELSE 0 END AS saved
FROM calls ORDER BY seq DESC, call_id DESC LIMIT 50""")
def calls_show_last(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.shown(table(spark, folder, "calls"))


@query("""SELECT seq, call_id, feature,
 CASE WHEN len(seed_files) = 0 THEN '' WHEN len(seed_files) > 1 THEN parse_filename(seed_files[1]) || ' +' || (len(seed_files) - 1) ELSE parse_filename(seed_files[1]) END AS seed,
 CASE WHEN has_error THEN 'ERROR' WHEN len(limitation_kinds) > 0 THEN array_to_string(limitation_kinds, ',') WHEN limitation_count > 0 THEN CAST(limitation_count AS VARCHAR) ELSE '' END AS note
FROM calls ORDER BY seq DESC, call_id DESC LIMIT 100""")
def calls_log_last(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.log_lines(table(spark, folder, "calls"))


@query("SELECT call_id, received_at, seq, CASE WHEN seq = (SELECT max(seq) FROM calls) THEN 'good' ELSE feedback END AS feedback FROM calls")
def calls_rate_last(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.rate_last(table(spark, folder, "calls"), "good", "2024-07-01T00:00:00Z").select("call_id", "received_at", "seq", "feedback")


# --- files (classified index) ------------------------------------------------------------------------------------------
@query(f"SELECT file_id, {LANGUAGES} AS language, {ROLES} AS role, greatest(1, octet_length(content) // 4) AS tokens FROM files")
def files_classified(spark: SparkSession, folder: str) -> DataFrame:
    return tree_of(spark, folder, text=True).select("file_id", "language", "role", "tokens")


@query(f"WITH {TREE} SELECT root, language, count(*) AS files FROM tree WHERE language <> '' GROUP BY ALL")
def files_languages(spark: SparkSession, folder: str) -> DataFrame:
    return tree.languages(tree_of(spark, folder), "root")


@query(f"""WITH {TREE}, t AS (SELECT root, string_split(rel_path, '/')[1] AS value, string_split(rel_path, '/') AS walk, role FROM tree)
SELECT root, value, first(role ORDER BY walk) AS role, count(*) AS files FROM t GROUP BY root, value""")
def files_top_level(spark: SparkSession, folder: str) -> DataFrame:
    files = tree_of(spark, folder)
    parts = F.split("rel_path", "/")
    return files.groupBy("root", parts[0].alias("value")).agg(F.min(F.struct(parts.alias("w"), F.col("role").alias("r")))["r"].alias("role"), F.count("*").alias("files"))


# Marker files of build and test systems with their phase, and notes of top-level directories.
BUILD_MARKS = """(VALUES
  ('go.mod', 'Go Modules', 0), ('package.json', 'npm', 0), ('Cargo.toml', 'Cargo', 0), ('pom.xml', 'Maven', 0), ('build.gradle', 'Gradle', 0), ('build.gradle.kts', 'Gradle', 0),
  ('Makefile', 'Make', 0), ('makefile', 'Make', 0), ('GNUmakefile', 'Make', 0), ('CMakeLists.txt', 'CMake', 0), ('BUILD', 'Bazel', 0), ('WORKSPACE', 'Bazel', 0),
  ('MODULE.bazel', 'Bazel', 0), ('pyproject.toml', 'Poetry', 0), ('Pipfile', 'Pipenv', 0), ('requirements.txt', 'pip', 0), ('setup.py', 'pip', 0), ('setup.cfg', 'pip', 0),
  ('Gemfile', 'Bundler', 0), ('composer.json', 'Composer', 0), ('mix.exs', 'Mix', 0), ('build.sbt', 'sbt', 0), ('Dockerfile', 'Docker', 0), ('docker-compose.yml', 'Docker Compose', 0),
  ('docker-compose.yaml', 'Docker Compose', 0), ('global.json', 'MSBuild', 0), ('Directory.Build.props', 'MSBuild', 0), ('Directory.Build.targets', 'MSBuild', 0), ('NuGet.Config', 'MSBuild', 0), ('vite.config.ts', 'Vite', 1),
  ('vite.config.js', 'Vite', 1), ('vite.config.mts', 'Vite', 1), ('vite.config.mjs', 'Vite', 1), ('next.config.js', 'Next.js', 1), ('next.config.ts', 'Next.js', 1), ('next.config.mjs', 'Next.js', 1),
  ('webpack.config.js', 'Webpack', 1), ('webpack.config.ts', 'Webpack', 1), ('webpack.config.mjs', 'Webpack', 1), ('rollup.config.js', 'Rollup', 1), ('rollup.config.ts', 'Rollup', 1), ('rollup.config.mjs', 'Rollup', 1),
  ('turbo.json', 'Turbo', 1), ('electron-builder.yml', 'Electron', 1), ('electron-builder.json', 'Electron', 1), ('nx.json', 'Nx', 1)) AS marks(marker, name, phase)"""
TEST_MARKS = """(VALUES
  ('pytest.ini', 'pytest', 0), ('pyproject.toml', 'pytest', 0), ('setup.cfg', 'pytest', 0), ('jest.config.js', 'Jest', 0), ('jest.config.ts', 'Jest', 0), ('jest.config.mjs', 'Jest', 0),
  ('vitest.config.ts', 'Vitest', 0), ('vitest.config.js', 'Vitest', 0), ('.rspec', 'RSpec', 0), ('.mocharc.js', 'Mocha', 0), ('.mocharc.yml', 'Mocha', 0), ('.mocharc.yaml', 'Mocha', 0),
  ('phpunit.xml', 'PHPUnit', 0), ('phpunit.xml.dist', 'PHPUnit', 0), ('playwright.config.ts', 'Playwright', 1), ('playwright.config.js', 'Playwright', 1), ('playwright.config.mjs', 'Playwright', 1), ('cypress.config.ts', 'Cypress', 1),
  ('cypress.config.js', 'Cypress', 1), ('vitest.config.ts', 'Vitest', 1), ('vitest.config.js', 'Vitest', 1)) AS marks(marker, name, phase)"""
TOP = """(VALUES
  ('cmd', 'command entry points'), ('internal', 'internal packages'), ('pkg', 'public packages'), ('api', 'API definitions'), ('web', 'web/frontend'), ('frontend', 'web/frontend'),
  ('ui', 'web/frontend'), ('test', 'test suites'), ('tests', 'test suites'), ('spec', 'test suites'), ('specs', 'test suites'), ('docs', 'documentation'),
  ('doc', 'documentation'), ('documentation', 'documentation'), ('scripts', 'build/automation scripts'), ('script', 'build/automation scripts'), ('deploy', 'infrastructure/deployment'), ('infra', 'infrastructure/deployment'),
  ('terraform', 'infrastructure/deployment'), ('k8s', 'infrastructure/deployment'), ('kubernetes', 'infrastructure/deployment'), ('proto', 'protobuf definitions'), ('protobuf', 'protobuf definitions')) AS notes(name, note)"""


def found_systems(marks: str) -> str:
    return f"SELECT root, name, min(phase) AS phase FROM tree JOIN {marks} ON parse_filename(rel_path) = marker WHERE phase = 1 OR NOT contains(rel_path, '/') GROUP BY ALL"


@query(f"""WITH {TREE}, t AS (SELECT root, string_split(rel_path, '/')[1] AS value, string_split(rel_path, '/') AS walk FROM tree WHERE len(string_split(rel_path, '/')) = 2), d AS (SELECT root, value, count(*) AS n, min(walk) AS walk FROM t GROUP BY root, value)
SELECT root, 'notable_dir' AS section, value, CAST(n AS VARCHAR) AS notes, ord FROM (SELECT *, CAST(row_number() OVER (PARTITION BY root ORDER BY walk) - 1 AS INT) AS ord FROM d) WHERE ord < 12
UNION ALL SELECT root, 'language', language, CAST(n AS VARCHAR), CAST(row_number() OVER (PARTITION BY root ORDER BY n DESC, language) - 1 AS INT) FROM (SELECT root, language, count(*) AS n FROM tree WHERE language <> '' GROUP BY ALL)
UNION ALL SELECT root, 'generated_area', dir, '', CAST(row_number() OVER (PARTITION BY root ORDER BY walk) - 1 AS INT) FROM (SELECT root, {DIR.format("rel_path")} AS dir, min(string_split(rel_path, '/')) AS walk FROM tree WHERE role = 'generated' GROUP BY ALL)
UNION ALL SELECT root, 'config_file', rel_path, '', CAST(row_number() OVER (PARTITION BY root ORDER BY rel_path) - 1 AS INT) FROM tree WHERE role = 'config' AND NOT contains(rel_path, '/')
UNION ALL SELECT root, 'build_system', name, '', CAST(row_number() OVER (PARTITION BY root ORDER BY phase, name) - 1 AS INT) FROM ({found_systems(BUILD_MARKS)})
UNION ALL SELECT root, 'test_system', name, '', CAST(row_number() OVER (PARTITION BY root ORDER BY phase, name) - 1 AS INT) FROM (SELECT root, name, min(phase) AS phase FROM ({found_systems(TEST_MARKS)} UNION ALL SELECT DISTINCT root, 'Go test', 2 FROM tree WHERE ends_with(rel_path, '_test.go')) GROUP BY ALL)
UNION ALL SELECT root, 'top_level', value, coalesce(note, CASE WHEN role = 'config' THEN 'configuration' ELSE '' END), CAST(row_number() OVER (PARTITION BY root ORDER BY walk) - 1 AS INT)
  FROM (SELECT root, string_split(rel_path, '/')[1] AS value, min(string_split(rel_path, '/')) AS walk, first(role ORDER BY string_split(rel_path, '/')) AS role FROM tree GROUP BY ALL) LEFT JOIN {TOP} ON notes.name = lower(value)""")
def overview_sections(spark: SparkSession, folder: str) -> DataFrame:
    return questions.overview(tree_of(spark, folder))


@query(f"WITH {TREE} SELECT root, {DIR.format('rel_path')} AS dir, count(*) AS files, sum(tokens)::BIGINT AS tokens FROM tree GROUP BY ALL")
def files_directories(spark: SparkSession, folder: str) -> DataFrame:
    return tree_of(spark, folder).groupBy("root", exprs.directory(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {TREE}, t AS (SELECT root, rel_path, tokens, sum(tokens) OVER (PARTITION BY root ORDER BY rel_path ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM tree WHERE role = 'test')
SELECT root, rel_path, CAST(0.5 AS DOUBLE) AS confidence, running FROM t WHERE running <= 4000""")
def tests_prefix_budget(spark: SparkSession, folder: str) -> DataFrame:
    return questions.all_tests(tree_of(spark, folder), 4000)


@query(f"""WITH {TREE} SELECT root, rel_path, (regexp_matches(lower(parse_filename(rel_path)), '_test\\.go$|^test_|\\.test\\.|\\.spec\\.')) AS by_name, role = 'test' AS by_role FROM tree""")
def tests_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return tree_of(spark, folder).select("root", "rel_path", exprs.is_test_name(F.col("rel_path")).alias("by_name"), (F.col("role") == "test").alias("by_role"))


# --- budgets -----------------------------------------------------------------------------------------------------------
@query("""WITH RECURSIVE t AS (SELECT source, doc_id, greatest(1, octet_length(encode(text)) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL AND greatest(1, octet_length(encode(text)) // 4) <= 3000),
w AS (SELECT source, doc_id, tokens, k, true AS included, tokens AS used FROM t WHERE k = 1
  UNION ALL SELECT t.source, t.doc_id, t.tokens, t.k, w.used + t.tokens <= 3000, CASE WHEN w.used + t.tokens <= 3000 THEN w.used + t.tokens ELSE w.used END FROM w JOIN t ON t.source = w.source AND t.k = w.k + 1)
SELECT source, doc_id, tokens FROM w WHERE included""")
def budget_first_fit_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source IS NOT NULL").select("source", "doc_id", exprs.tokens(F.col("text")).alias("tokens"))
    return fit.first_fit(docs, ["source"], [F.col("doc_id")], 3000, "tokens")


@query("""WITH t AS (SELECT source, doc_id, sum(greatest(1, octet_length(encode(text)) // 4)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents WHERE source IS NOT NULL)
SELECT source, doc_id, running FROM t WHERE running <= 3000""")
def budget_prefix_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source IS NOT NULL").select("source", "doc_id", exprs.tokens(F.col("text")).alias("tokens"))
    return fit.prefix_fit(docs, ["source"], [F.col("doc_id")], 3000, "tokens").select("source", "doc_id", "running")


@query("SELECT source, lang, count(*) AS docs, sum(greatest(1, octet_length(encode(text)) // 4))::BIGINT AS tokens, greatest(0, sum(greatest(1, octet_length(encode(text)) // 4)) - 3000)::BIGINT AS avoided FROM documents GROUP BY ALL")
def documents_token_sums(spark: SparkSession, folder: str) -> DataFrame:
    t = exprs.tokens(F.col("text"))
    return table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(t).alias("tokens")).withColumn("avoided", F.greatest(F.col("tokens") - 3000, F.lit(0)))


# --- graph -------------------------------------------------------------------------------------------------------------
@query(f"WITH {shop.GRAPH} SELECT root, src, dst FROM py WHERE dst IS NOT NULL")
def imports_python(spark: SparkSession, folder: str) -> DataFrame:
    return py.extract(shop.files(spark, folder))[0].select("root", "src", "dst")


@query(f"""WITH {TREE} SELECT DISTINCT root, src, spec FROM (SELECT root, rel_path AS src, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+(?:type\\s+)?(?:[\\w$*{{][^''"`;]*?\\s+from\\s+)?[''"]([^''"\\n]+)[''"]', 1)) AS spec FROM tree
WHERE language IN ('JavaScript', 'TypeScript') AND octet_length(encode(text)) <= 1048576) WHERE spec[1] IN ('.', '@', '~', '#')""")
def import_specifiers_script(spark: SparkSession, folder: str) -> DataFrame:
    files = tree_of(spark, folder).where("language IN ('JavaScript', 'TypeScript')").where(F.octet_length("text") <= js.MOST_BYTES)
    return js.specifiers(files)


@query(f"""WITH {TREE} SELECT DISTINCT root, src, spec FROM (SELECT root, src, unnest(regexp_extract_all(block, '"([^"\\n]+)"', 1)) AS spec FROM (
SELECT root, rel_path AS src, unnest(list_concat(regexp_extract_all(text, '(?ms)^import\\s*\\(([^)]*)\\)', 1), regexp_extract_all(text, '(?m)^import\\s+((?:[\\w.]+\\s+)?"[^"\\n]+")', 1))) AS block FROM tree WHERE language = 'Go' AND text IS NOT NULL))""")
def import_specifiers_go(spark: SparkSession, folder: str) -> DataFrame:
    return units.go_imports(tree_of(spark, folder))


@query(f"""WITH {TREE} SELECT t.root, regexp_extract(t.root, '^([^@]*)', 1) || CASE WHEN d = '.' THEN '' ELSE '/' || d END AS unit_id, count(*) AS files, count(*) FILTER (ends_with(rel_path, '_test.go')) AS tests
FROM (SELECT *, {DIR.format("rel_path")} AS d FROM tree WHERE language = 'Go') t GROUP BY ALL""")
def units_go(spark: SparkSession, folder: str) -> DataFrame:
    return units.go_units(tree_of(spark, folder)).unit_files.groupBy("root", "unit_id").agg(F.count("*").alias("files"), F.count_if("test").alias("tests"))


@query(f"WITH {shop.GRAPH} SELECT root, src, dst, relation FROM rel WHERE relation IN ('peers', 'tests') AND ends_with(src, '.go')")
def peers_and_tests_go(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first file of each package; members_go has all of them in linear form."""
    files = shop.files(spark, folder)
    return g.unit_relations(units.go_units(files), shop.seeds(files).where(F.endswith("src", F.lit(".go")))).where("relation IN ('peers', 'tests')").select("root", "src", "dst", "relation")


@query(f"""WITH {TREE} SELECT t.root, regexp_extract(t.root, '^([^@]*)', 1) || CASE WHEN d = '.' THEN '' ELSE '/' || d END AS unit_id, rel_path AS path, ends_with(rel_path, '_test.go') AS test
FROM (SELECT *, {DIR.format("rel_path")} AS d FROM tree WHERE language = 'Go') t""")
def members_go(spark: SparkSession, folder: str) -> DataFrame:
    """Every Go file with its package: all peers and tests, without a row per pair."""
    return units.go_units(tree_of(spark, folder)).unit_files.select("root", "unit_id", "path", "test")


@query(f"WITH {shop.GRAPH} SELECT root, unit AS unit_id, path, test FROM csmem")
def members_csharp(spark: SparkSession, folder: str) -> DataFrame:
    """Every C# file with its project; the files table has no projects."""
    return units.csharp_units(trees(spark, folder)).unit_files.select("root", "unit_id", "path", "test")


@query(f"""WITH {TREE}, {shop.GRAPH},
gd AS (SELECT root, rel_path, {DIR.format("rel_path")} AS d, text FROM tree WHERE language = 'Go'),
gu AS (SELECT DISTINCT root, d, regexp_extract(root, '^([^@]*)', 1) || CASE WHEN d = '.' THEN '' ELSE '/' || d END AS unit FROM gd),
gb AS (SELECT root, d, unnest(list_concat(regexp_extract_all(text, '(?ms)^import\\s*\\(([^)]*)\\)', 1), regexp_extract_all(text, '(?m)^import\\s+((?:[\\w.]+\\s+)?"[^"\\n]+")', 1))) AS block FROM gd WHERE text IS NOT NULL AND NOT ends_with(rel_path, '_test.go')),
gi AS (SELECT root, d, unnest(regexp_extract_all(block, '"([^"\\n]+)"', 1)) AS spec FROM gb)
SELECT root, u AS src_unit, v AS dst_unit, kind FROM ue
UNION ALL SELECT DISTINCT gi.root, a.unit, b.unit, 'go' FROM gi JOIN gu a ON a.root = gi.root AND a.d = gi.d JOIN gu b ON b.root = gi.root AND b.unit = gi.spec WHERE a.unit <> b.unit""")
def unit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between all packages and projects; importers are the same rows read backwards."""
    files = trees(spark, folder)
    groups = (("go", units.go_units(files)), ("csproj", units.csharp_units(files)))
    parts = [group.unit_edges.select("root", "src_unit", "dst_unit", F.lit(kind).alias("kind")) for kind, group in groups]
    return parts[0].unionByName(parts[1])


@query(f"WITH {shop.GRAPH} SELECT root, 'Net/N' || n || '/N' || n || '.csproj' AS unit_id, 'Pack' AS name, '1.' || n AS version FROM (SELECT 'r' || r AS root, n FROM nat)")
def packages_csharp(spark: SparkSession, folder: str) -> DataFrame:
    return units.csharp_units(shop.files(spark, folder)).packages.select("root", "unit_id", "name", "version")


@query("SELECT 'r' || n_regionkey AS root, '@all/*' AS prefix, 'web/' AS target, 0 AS rank FROM nation GROUP BY n_regionkey")
def tsconfig_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return js.config_aliases(shop.files(spark, folder))


@query(f"WITH {shop.GRAPH} SELECT root, src, dst, 'imports' AS relation, source_tool, 'heuristic' AS authority FROM fe")
def file_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between all files of languages whose edges are files'; those of the files table lead out of their snapshots."""
    return g.build(trees(spark, folder)).edges


@query(f"WITH {shop.GRAPH} SELECT root, 'imports' AS relation, source_tool, 'heuristic' AS authority, count(*) AS edges FROM fe GROUP BY ALL")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return graph.edges.groupBy("root", "relation", "source_tool", "authority").agg(F.count("*").alias("edges"))


@query(f"""WITH {TREE}, roots AS (SELECT DISTINCT root FROM tree), has AS (SELECT root, bool_or(language = 'Go') AS go, bool_or(language = 'Python') AS py, bool_or(regexp_matches(lower(rel_path), '\\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$') AND NOT regexp_matches(rel_path, '(^|/)(node_modules|\\.git|\\.claude|dist|build|out|\\.next|\\.nuxt|\\.svelte-kit|coverage|\\.turbo|\\.cache)/')) AS js, bool_or(ends_with(rel_path, '.cs')) AS cs FROM tree GROUP BY root)
SELECT root, 'go_static_parse' AS kind, 'go' AS scope FROM has WHERE go UNION ALL SELECT root, 'no_python_files', 'python' FROM has WHERE NOT py UNION ALL SELECT root, 'no_js_ts_files', 'script' FROM has WHERE NOT js
UNION ALL SELECT root, 'no_csproj_files', 'csharp' FROM has WHERE cs UNION ALL SELECT root, 'file_too_large', rel_path FROM tree WHERE language = 'Python' AND octet_length(encode(text)) > 524288""")
def graph_limitations(spark: SparkSession, folder: str) -> DataFrame:
    """Of the snapshots in the files table, none of which has a project file."""
    return graph_of(spark, folder).limitations.select("root", "kind", "scope")


@query(f"""WITH {shop.GRAPH} SELECT f.root, count(*) AS files, count(DISTINCT language) FILTER (language <> '') AS languages, (SELECT count(*) FROM fe WHERE fe.root = f.root) AS edges, (SELECT count(DISTINCT unit) FROM gomem g WHERE g.root = f.root) + (SELECT count(*) FROM nat WHERE 'r' || r = f.root) AS units, 1::BIGINT AS limitations FROM f GROUP BY f.root""")
def graph_status(spark: SparkSession, folder: str) -> DataFrame:
    return questions.status(shop_graph(spark, folder))


@query(f"WITH {shop.GRAPH} SELECT root, src, rel_path, relation, {shop.RELATED} AS confidence, tokens::BIGINT AS tokens, 'heuristic' AS authority FROM related")
def related_files(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return questions.related(graph, shop.seeds(graph.files))


@query(f"WITH {shop.GRAPH} SELECT root, src, 'over_budget' AS kind FROM related GROUP BY root, src HAVING sum(tokens) > 150")
def related_limits(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return questions.limits_of(graph, shop.seeds(graph.files), "related", 150)


@query(f"""WITH {shop.GRAPH}, asked AS (SELECT root, min(rel_path) AS src FROM f GROUP BY root, dir)
SELECT root, src, 'no_import_graph' AS kind FROM asked JOIN f ON f.root = asked.root AND f.rel_path = asked.src WHERE f.language NOT IN ('Go', 'Python', 'TypeScript', 'C#')""".replace("SELECT root, src, 'no_import", "SELECT asked.root, src, 'no_import"))
def impact_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first file of any kind in each directory."""
    graph = shop_graph(spark, folder)
    asked = graph.files.groupBy("root", exprs.directory(F.col("rel_path")).alias("dir")).agg(F.min("rel_path").alias("src")).select("root", "src")
    return questions.limits_of(graph, asked, "impact")


@query(f"""WITH {shop.GRAPH}, t AS (SELECT root, src, sum(tokens) AS total FROM related GROUP BY root, src)
SELECT s.root, 'related' AS feature, s.src AS seed, 150 AS budget_requested, false AS has_error, CASE WHEN total > 150 THEN 1 ELSE 0 END AS limitation_count, CASE WHEN total > 150 THEN 'over_budget' ELSE '' END AS kinds FROM seeds s LEFT JOIN t ON t.root = s.root AND t.src = s.src""")
def call_records_related(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as rows of the call log: what the metrics read."""
    graph = shop_graph(spark, folder)
    asked = shop.seeds(graph.files)
    records = questions.call_records("related", asked, questions.limits_of(graph, asked, "related", 150), 150, "2024-07-01T00:00:00Z")
    return records.select("root", "feature", F.col("seed_files")[0].alias("seed"), "budget_requested", "has_error", "limitation_count", F.array_join("limitation_kinds", ",").alias("kinds"))


@query(f"WITH {shop.GRAPH} SELECT root, src, rel_path, {shop.RUN} AS run_command, confidence FROM tested")
def tests_of_files(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return questions.tests_of(graph, shop.seeds(graph.files))


@query(f"""WITH {shop.GRAPH} SELECT root, 'changed' AS kind, src AS rel_path, NULL AS via, 1.0::DOUBLE AS confidence FROM seeds
UNION ALL SELECT root, 'impacted', dst, min(src), 0.88::DOUBLE FROM rel WHERE relation = 'importers' AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.root = rel.root AND s.src = rel.dst) GROUP BY root, dst
UNION ALL SELECT root, 'test', rel_path, min(src), max(confidence) FROM tested GROUP BY root, rel_path""")
def impact_of_files(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return questions.impact(graph, shop.seeds(graph.files))


@query(f"""WITH RECURSIVE {shop.GRAPH}, first AS (SELECT root, min(src) AS src FROM seeds WHERE ends_with(src, '.py') GROUP BY root),
w AS (SELECT root, src AS seed, src AS node, 0 AS steps FROM first UNION SELECT w.root, w.seed, fe.src, w.steps + 1 FROM w JOIN fe ON fe.root = w.root AND fe.dst = w.node WHERE w.steps < 60)
SELECT root, seed, node, min(steps)::INT AS steps FROM w GROUP BY ALL""")
def transitive_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Of one Python file of each tree: everything that depends on it."""
    graph = shop_graph(spark, folder)
    first = shop.seeds(graph.files).where(F.endswith("src", F.lit(".py"))).groupBy("root").agg(F.min("src").alias("src"))
    return questions.transitive_impact(graph, first, 60)


@query(f"""WITH {shop.GRAPH} SELECT s.root, s.src, 'file' AS section, f.role AS value, f.language AS detail, f.tokens::INT AS ord FROM seeds s JOIN f ON f.root = s.root AND f.rel_path = s.src
UNION ALL SELECT s.root, s.src, 'symbol', CASE f.kind WHEN 'go' THEN 'S' WHEN 'cs' THEN 'C' ELSE 'f' END || regexp_extract(s.src, '(\d+)\.[a-z]+$', 1), CASE WHEN f.kind = 'py' THEN 'function' ELSE 'declaration' END, 0 FROM seeds s JOIN f ON f.root = s.root AND f.rel_path = s.src
UNION ALL SELECT root, src, CASE relation WHEN 'imports' THEN 'import' WHEN 'importers' THEN 'dependent' WHEN 'tests' THEN 'test' ELSE 'peer' END, dst, 'heuristic', (row_number() OVER (PARTITION BY root, src, relation ORDER BY dst) - 1)::INT FROM rel
UNION ALL SELECT s.root, s.src, 'package', 'Pack', '1.' || regexp_extract(m.unit, 'N(\d+)', 1), 0 FROM seeds s JOIN csmem m ON m.root = s.root AND m.path = s.src""")
def explain_files(spark: SparkSession, folder: str) -> DataFrame:
    graph = shop_graph(spark, folder)
    return questions.explain(graph, shop.seeds(graph.files))


@query(f"""WITH {shop.FILES} SELECT root, rel_path AS path, CASE kind WHEN 'go' THEN 'S' WHEN 'cs' THEN 'C' WHEN 'gotest' THEN 'TestC' ELSE 'f' END || regexp_extract(rel_path, '(\d+)[._a-z]+$', 1) AS name, CASE WHEN kind = 'py' THEN 'function' ELSE 'declaration' END AS kind, 0 AS ord FROM f WHERE language IN ('Go', 'Python', 'TypeScript', 'C#')""")
def symbols_of_files(spark: SparkSession, folder: str) -> DataFrame:
    return questions.symbols(shop.files(spark, folder))[0]


@query(f"""WITH {TREE} SELECT root, rel_path AS path, unnest(regexp_extract_all(text, '(?m)\\b(?:class|interface|enum|struct|record)\\s+(\\w+)', 1)) AS name FROM tree WHERE language = 'C#' AND text IS NOT NULL""")
def symbols_csharp(spark: SparkSession, folder: str) -> DataFrame:
    return questions.symbols(tree_of(spark, folder).where("language = 'C#'"))[0].select("root", "path", "name")


def capsules(spark: SparkSession, folder: str) -> capsule.Capsule:
    """One request per directory: its first source file, under a budget that leaves files out."""
    graph = shop_graph(spark, folder)
    requests = shop.seeds(graph.files).select("root", F.concat("root", F.lit(":"), "src").alias("request"), F.col("src").alias("name"), F.lit(shop.BUDGET).alias("budget"))
    return capsule.context(graph, requests)


@query(f"""WITH RECURSIVE {shop.CAPSULE} SELECT request, (row_number() OVER (PARTITION BY request ORDER BY score DESC, path))::INT AS rank, path AS rel_path, language, role, score, tier, tokens::BIGINT AS tokens, 'full' AS content_mode FROM chosen WHERE included""")
def context_capsules(spark: SparkSession, folder: str) -> DataFrame:
    return capsules(spark, folder).rows.select("request", "rank", "rel_path", "language", "role", "score", "tier", "tokens", "content_mode")


@query(f"""WITH RECURSIVE {shop.CAPSULE} SELECT request, considered, included, contextual_out, critical_tokens, used, total, CASE WHEN total > 0 THEN trunc(used * 100.0 / total) / 100 ELSE 0 END::DOUBLE AS ratio, greatest(total - used, 0)::BIGINT AS avoided FROM counted""")
def context_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return capsules(spark, folder).summary.select("request", "considered", "included", "contextual_out", "critical_tokens", "used", "total", "ratio", "avoided")


@query(f"""WITH RECURSIVE {shop.CAPSULE} SELECT request, 'critical_path_over_budget' AS kind FROM counted WHERE critical_tokens > budget UNION ALL SELECT request, 'contextual_trimmed' FROM counted WHERE contextual_out > 0""")
def context_limitations(spark: SparkSession, folder: str) -> DataFrame:
    return capsules(spark, folder).limitations


@query(f"WITH RECURSIVE {shop.CAPSULE} SELECT request, used <= budget AS passed FROM counted")
def context_within_budget(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.within_budget(capsules(spark, folder).summary)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || c_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT 'r0' AS node, 0 AS steps UNION SELECT e.src, w.steps + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, min(steps) AS steps FROM w GROUP BY node""")
def closure_foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(key("c", "o_custkey").alias("src"), key("n", "c_nationkey").alias("dst")).distinct()
    edges = edges.unionByName(t("supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"))).unionByName(t("nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")))
    back = edges.select(F.lit("tpch").alias("root"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.closure(back, spark.createDataFrame([("tpch", "r0")], "root string, src string")).select("node", "steps")


@query("""SELECT o_custkey, l_suppkey, min(CASE WHEN s_nationkey = c_nationkey THEN 1 WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 3 END) AS priority, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY ALL""")
def priority_match_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Tagging by the first match that holds: a customer's suppliers are of its nation, else of its region, else others."""
    t = lambda n: table(spark, folder, n)
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_region"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("lines"))
    tagged = pairs.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    priority = F.when(F.col("s_nationkey") == F.col("c_nationkey"), 1).when(F.col("s_region") == F.col("c_region"), 2).otherwise(3)
    return tagged.select("o_custkey", "l_suppkey", priority.alias("priority"), "lines")


# --- failures ----------------------------------------------------------------------------------------------------------
@query("""WITH l AS (SELECT doc_id AS log_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE source = 'failure_log'),
f AS (SELECT log_id, line_no, 0 AS rank, unnest(regexp_extract_all(line, '([a-zA-Z0-9_/\\-.]+\\.go):(\\d+)', 1)) AS value, CAST(0.9 AS DOUBLE) AS confidence, 'file' AS kind FROM l
 UNION ALL SELECT log_id, line_no, 1, unnest(regexp_extract_all(line, '--- FAIL:\\s+(\\S+)', 1)), 0.95, 'test' FROM l
 UNION ALL SELECT log_id, line_no, 2, unnest(regexp_extract_all(line, 'File "([^"]+\\.py)", line (\\d+)', 1)), 0.85, 'file' FROM l),
o AS (SELECT log_id, kind, value, arg_min(confidence, line_no * 10 + rank) AS confidence, min(line_no) AS line_no FROM f GROUP BY ALL)
SELECT log_id, kind, value, confidence, line_no FROM o UNION ALL SELECT log_id, 'panic', trim(line), 0.8, line_no FROM l WHERE starts_with(trim(line), 'panic:')""")
def failure_log_signals(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source = 'failure_log'").select(F.col("doc_id").alias("log_id"), "text")
    return logs.failure_signals(docs).select("log_id", "kind", "value", "confidence", F.col("line_no").cast("bigint").alias("line_no"))


FAILURES = "WITH " + shop.GRAPH + """, logs AS (SELECT 'r' || r AS root, k AS log_id, 'n' || n || '/s' || k || '.go' AS path, (SELECT min(c.k) FROM cust c WHERE c.n = sup.n AND c.seg = 'BUILDING') AS test, n FROM sup)"""


def shop_failures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(the trees, a log per supplier: its file is named by base name only, with a failing test of its nation)."""
    files = shop.files(spark, folder)
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    tests = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("c_custkey").alias("test"))
    rows = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(tests, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    text = F.concat_ws("\n", F.concat(F.lit("build/s"), "s_suppkey", F.lit(".go:7: undefined")), F.when(F.col("test").isNotNull(), F.concat(F.lit("--- FAIL: TestC"), "test", F.lit("/part (0.1s)"))))
    return files, rows.select(F.concat(F.lit("r"), "n_regionkey").alias("root"), F.col("s_suppkey").alias("log_id"), text.alias("text"))


@query(FAILURES + """ SELECT root, log_id, path, 0.9::DOUBLE AS confidence FROM logs UNION ALL SELECT root, log_id, 'n' || n || '/c' || test || '_test.go', 0.95::DOUBLE FROM logs WHERE test IS NOT NULL""")
def failure_suspects(spark: SparkSession, folder: str) -> DataFrame:
    return questions.failure_context(*shop_failures(spark, folder))[1]


@query(FAILURES + " SELECT root, 'basename_match_only' AS kind, 'build/s' || log_id || '.go' AS scope FROM logs")
def failure_limits(spark: SparkSession, folder: str) -> DataFrame:
    return questions.failure_context(*shop_failures(spark, folder))[2]


@query(FAILURES + " SELECT root, log_id, 'go build ./...' AS command FROM logs UNION ALL SELECT root, log_id, 'go test ./... -v' FROM logs WHERE test IS NOT NULL")
def failure_commands(spark: SparkSession, folder: str) -> DataFrame:
    return questions.suspected_commands(questions.failure_context(*shop_failures(spark, folder))[1])


@query(FAILURES + """, l AS (SELECT root, log_id, unnest(['n' || n || '/s' || log_id || '.go', 'n' || n || '/c' || test || '_test.go']) AS src FROM logs), l2 AS (SELECT * FROM l WHERE src IS NOT NULL),
d AS (SELECT DISTINCT l2.root, log_id, a.unit FROM l2 JOIN gomem a ON a.root = l2.root AND a.path = l2.src),
c AS (SELECT root, log_id, src AS path FROM l2 UNION SELECT d.root, log_id, m.path FROM d JOIN gomem m ON m.root = d.root AND m.unit = d.unit UNION SELECT d.root, log_id, m.path FROM d JOIN goue ON goue.root = d.root AND (goue.u = d.unit) JOIN gomem m ON m.root = d.root AND m.unit = goue.v AND NOT m.test UNION SELECT d.root, log_id, m.path FROM d JOIN goue ON goue.root = d.root AND (goue.v = d.unit) JOIN gomem m ON m.root = d.root AND m.unit = goue.u AND NOT m.test)
SELECT log_id::VARCHAR AS request, count(*) AS considered FROM c GROUP BY log_id""")
def failure_capsules(spark: SparkSession, folder: str) -> DataFrame:
    """The capsules over the suspected files of every log."""
    files, failures = shop_failures(spark, folder)
    suspects, _ = Stored(spark).table(questions.failure_context(files, failures)[1])
    return capsule.context(g.build(files), questions.failure_requests(suspects)).summary.select("request", "considered")


@query(f"""WITH {shop.GRAPH}, roots AS (SELECT DISTINCT root FROM f), plan AS (SELECT root, 'go build ./...' AS command, 'build' AS kind, '' AS cost, 0 AS ord FROM roots UNION ALL SELECT root, 'go vet ./...', 'vet', 'fast', 1 FROM roots UNION ALL SELECT DISTINCT root, 'go test ./' || regexp_replace(src, '/[^/]*$', '') || '/... -race', 'test', 'medium', 2 FROM seeds UNION ALL SELECT root, 'dotnet build', 'build', '', 6 FROM roots)
SELECT root, command, kind, true AS required, cost, ord FROM plan""")
def verify_commands(spark: SparkSession, folder: str) -> DataFrame:
    files = shop.files(spark, folder)
    return questions.verify_plan(files, shop.seeds(files))


@query(f"WITH {shop.GRAPH} SELECT root, 6 AS considered, count(*) + 3 AS selected, NULL AS limitation FROM seeds GROUP BY root")
def verify_counts(spark: SparkSession, folder: str) -> DataFrame:
    files = shop.files(spark, folder)
    return questions.verify_summary(files, shop.seeds(files))


# --- sessions ----------------------------------------------------------------------------------------------------------
TURNS = "(SELECT DISTINCT lower(trim(session_id)) AS session_id, uuid, role, ts FROM session_turns)"


@query(f"""WITH e AS (SELECT session_id, uuid, min(role) AS role, min(nullif(ts, '')) AS lo, max(nullif(ts, '')) AS hi FROM {TURNS} GROUP BY ALL)
SELECT session_id, min(lo) AS first_ts, max(hi) AS last_ts, count(*) FILTER (role IN ('user', 'assistant')) AS turns FROM e GROUP BY ALL""")
def session_facts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "session_turns")
    return sessions.facts(turns.withColumn("session_id", F.lower(F.trim("session_id"))))


def event_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the blocks of one user's session: a view is a call, a purchase an edit, each an entry of its own."""
    e = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("string").alias("session_id"), (F.row_number().over(order) - 1).alias("entry_idx"), F.lit(0).alias("block_idx"), F.when(F.col("event_type") == "signup", "user").otherwise("assistant").alias("role"), F.when(F.col("event_type") == "purchase", "Edit").otherwise("Bash").alias("tool"), F.when(F.col("event_type") == "view", F.concat(F.lit("tool context --files=d/f"), (F.col("event_id") % 7).cast("string"))).alias("command"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("file"), F.col("event_type").alias("text"))


EVENT_CTE = """b AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS entry_idx, event_type, event_id, sum(CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events),
n AS (SELECT *, min(CASE WHEN event_type = 'view' THEN entry_idx END) OVER w AS next_call, min(CASE WHEN event_type = 'purchase' THEN entry_idx END) OVER w AS next_edit, min(CASE WHEN event_type = 'view' THEN turn END) OVER w AS call_turn, min(CASE WHEN event_type = 'purchase' THEN turn END) OVER w AS edit_turn FROM b WINDOW w AS (PARTITION BY session_id ORDER BY entry_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {EVENT_CTE} SELECT session_id, entry_idx, next_edit IS NOT NULL AND (next_call IS NULL OR next_edit < next_call) AS edit_after,
CASE WHEN next_edit IS NOT NULL AND (next_call IS NULL OR next_edit < next_call) THEN CAST(edit_turn - turn AS INT) ELSE -1 END AS turns_to_edit, CASE WHEN next_call IS NOT NULL THEN CAST(call_turn - turn AS INT) ELSE -1 END AS turns_to_call FROM n WHERE event_type = 'view'""")
def call_signals_events(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.signals(sessions.events(event_blocks(spark, folder), "tool")).select("session_id", "entry_idx", "edit_after", "turns_to_edit", "turns_to_call")


@query(f"""WITH {EVENT_CTE}, p AS (SELECT session_id, entry_idx, 'f' || (event_id % 5) AS file, max(CASE WHEN event_type = 'view' THEN entry_idx END) OVER (PARTITION BY session_id ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS owner, event_type FROM b),
f AS (SELECT session_id, owner AS entry_idx, file, min(entry_idx) AS first_at FROM p WHERE event_type = 'purchase' AND owner IS NOT NULL GROUP BY ALL)
SELECT session_id, entry_idx, array_to_string(list(file ORDER BY first_at), ',') AS files_edited FROM f GROUP BY ALL""")
def files_edited_events(spark: SparkSession, folder: str) -> DataFrame:
    found = sessions.events(event_blocks(spark, folder), "tool")
    return sessions.edited_between(found, found).select("session_id", "entry_idx", F.array_join("files_edited", ",").alias("files_edited"))


@query(f"""WITH {EVENT_CTE}, c AS (SELECT session_id, entry_idx, event_id % 7 AS f FROM b WHERE event_type = 'view') SELECT session_id, entry_idx, coalesce(f = lead(f) OVER (PARTITION BY session_id ORDER BY entry_idx), false) AS retry_after FROM c""")
def call_retries_events(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.retries(sessions.events(event_blocks(spark, folder), "tool")).select("session_id", "entry_idx", "retry_after")


@query(f"""WITH {EVENT_CTE} SELECT c.session_id, c.entry_idx, string_agg(x.event_type, ',' ORDER BY x.entry_idx) AS excerpt FROM n c JOIN b x ON x.session_id = c.session_id AND x.entry_idx BETWEEN c.entry_idx - 3 AND c.entry_idx + 3 AND (c.next_call IS NULL OR x.entry_idx < c.next_call)
WHERE c.event_type = 'view' GROUP BY ALL""")
def call_excerpts_events(spark: SparkSession, folder: str) -> DataFrame:
    entries = event_blocks(spark, folder).select("session_id", "entry_idx", "role", F.col("text").alias("preview"), F.col("command").isNotNull().alias("is_call"))
    return sessions.excerpts(entries).select("session_id", "entry_idx", F.array_join(F.transform("excerpt", lambda x: x["preview"]), ",").alias("excerpt"))


SIGNALS, EDITED, RETRIES, EXCERPTS = (SQL[n].split(EVENT_CTE, 1)[1] for n in ("call_signals_events", "files_edited_events", "call_retries_events", "call_excerpts_events"))


@query(f"""WITH {EVENT_CTE}{EDITED[: EDITED.rindex("SELECT session_id, entry_idx, array_to_string")]}, edited AS ({EDITED[EDITED.rindex("SELECT session_id, entry_idx, array_to_string") :]}), signals AS ({SIGNALS}){RETRIES[: RETRIES.rindex("SELECT session_id")]}, again AS ({RETRIES[RETRIES.rindex("SELECT session_id") :]}), around AS ({EXCERPTS})
SELECT s.*, coalesce(files_edited, '') AS files_edited, retry_after, excerpt FROM signals s LEFT JOIN edited USING (session_id, entry_idx) LEFT JOIN again USING (session_id, entry_idx) LEFT JOIN around USING (session_id, entry_idx)""")
def session_analysis_events(spark: SparkSession, folder: str) -> DataFrame:
    pack = sessions.analysis_pack(event_blocks(spark, folder), "tool")
    return pack.select("session_id", "entry_idx", "edit_after", "turns_to_edit", "turns_to_call", F.array_join("files_edited", ",").alias("files_edited"), "retry_after", F.array_join(F.transform("excerpt", lambda x: x["preview"]), ",").alias("excerpt"))


@query(f"""WITH RECURSIVE {shop.CAPSULE}, w2 AS (SELECT request, used, budget, CASE WHEN total > 0 THEN trunc(used * 100.0 / total) / 100 ELSE 0 END::DOUBLE AS ratio FROM counted)
SELECT 'files ' || request AS scenario_id, 'files' AS suite, 'golden_files' AS kind, EXISTS (SELECT 1 FROM chosen c WHERE c.request = w2.request AND c.included AND c.path = regexp_replace(w2.request, '^[^:]*:', '')) AS passed, 0.0::DOUBLE AS value, '' AS note FROM w2
UNION ALL SELECT 'never ' || request, 'files', 'golden_files', false, 1.0, '' FROM w2
UNION ALL SELECT 'budget ' || request, 'budgets', 'budget_compliance', used <= budget, used::DOUBLE, '' FROM w2
UNION ALL SELECT 'ratio ' || request, 'budgets', 'context_compression', ratio <= 0.9, ratio, '' FROM w2
UNION ALL SELECT 'same ' || request, 'stable', 'determinism', true, 1.0, '' FROM w2
UNION ALL SELECT 'symbol ' || request, 'symbols', 'golden_symbols', true, 0.0, '' FROM w2
UNION ALL SELECT 'other ' || request, 'other', 'golden_tests', false, NULL, 'kind not carried out: golden_tests' FROM w2""")
def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """Seven scenarios for the first source file of each directory: of every kind, some that must fail."""
    graph = shop_graph(spark, folder)
    src = F.col("src")
    symbol = F.concat(F.when(F.endswith(src, F.lit(".go")), "S").when(F.endswith(src, F.lit(".cs")), "C").otherwise("f"), F.regexp_extract(src, r"(\d+)\.[a-z]+$", 1))
    kinds = (("files", "files", "golden_files"), ("never", "files", "golden_files"), ("budget", "budgets", "budget_compliance"), ("ratio", "budgets", "context_compression"), ("same", "stable", "determinism"), ("symbol", "symbols", "golden_symbols"), ("other", "other", "golden_tests"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("suite"), F.lit(k).alias("kind")) for n, s, k in kinds])).alias("k")
    scenarios = shop.seeds(graph.files).select("root", "src", each).select(
        F.concat("k.name", F.lit(" "), "root", F.lit(":"), "src").alias("scenario_id"), "k.suite", "k.kind", "root", F.lit(shop.BUDGET).alias("budget"), F.lit(2).alias("repeat_count"), F.lit(0.9).alias("max_ratio"),
        F.array(src).alias("seed_files"), F.array(F.when(F.col("k.name") == "never", "nowhere.go").otherwise(src)).alias("expected_files"), F.array(F.lit("go.mod")).alias("forbidden_files"), F.array(symbol).alias("expected_symbols"),
    )
    return evaluation.run(graph, scenarios)


# --- evaluation --------------------------------------------------------------------------------------------------------
@query("SELECT l_returnflag AS key, count(DISTINCT l_linestatus || '|' || l_quantity) AS rows_seen, true AS passed FROM lineitem GROUP BY ALL")
def stable_result_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of a result does not depend on how its rows are partitioned."""
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("key"), "l_linestatus", "l_quantity").distinct()
    runs = evaluation.result_hash(rows, "key").unionByName(evaluation.result_hash(rows.repartition(5), "key"))
    return rows.groupBy("key").agg(F.count("*").alias("rows_seen")).join(evaluation.stable(runs, "key").select("key", "passed"), "key")


@query("SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || text) AS digest, doc_id FROM documents")
def documents_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("digest"), "doc_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
