"""Source files nobody of the project wrote by hand: generated, minified, third-party, or data saved as code.

A random forest scores every code file by compression ratio, token entropy, identifier lengths, comment density, line and
literal shape, role, depth and naming marks of the path. Its labels are header notices alone, which are cut off before
features are taken: a generator's, a minifier's or another project's notice is a positive, an own authors' notice or none a
negative. Files without a notice are negatives of little weight, and negatives that a fit finds suspicious are left out of
the next (reliable negatives), for many of them are generated all the same.

A notice is also evidence by itself, for most generated files look like any other code. So a file is reported if its notice
says so, if the forest does, or by one of two exact checks: it lies in a vendored tree, or nearly all of it are literals
(data stored as code). A notice or tree that names one of the repositories of the table is first-party and no case.

Cases: null or empty content has only its path; content that is not text is taken as characters and scored like any;
null role, size or path are unknown values; repeated contents are scored each; prose, plain configuration and lock-step
formats are never scored by shape (only code is). Without a labelled file of each class there is no forest and its score
is 0. Extra columns are ignored. A name, a path part or a string that merely contains a word such as ``generated`` or
``vendor`` says nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import Stored

MOST_LABELLED = 20_000  # files the forest is fitted on at most, by hash of the id
THRESHOLD = 0.66
RELIABLE = 0.5  # files without a foreign notice that a fit scores from here on are no negatives of the next
UNLABELLED_WEIGHT = 0.25
CLEANINGS = 2
TREES, DEPTH = 32, 8
FEATURES = ("log_size", "compression", "token_entropy", "identifier_length", "short_identifiers", "comments", "line_mean", "line_max", "blanks", "digits", "literals", "distinct_tokens", "literal_lines", "tool_name", "minified_name", "generated_role", "path_depth")
LITERALS, LITERAL_LINES, TOOL_NAME = FEATURES.index("literals"), FEATURES.index("literal_lines"), FEATURES.index("tool_name")
DATA_FROM = 2000  # characters: shorter tables of literals are code like any
CODE = ("py", "go", "js", "mjs", "cjs", "jsx", "ts", "tsx", "cs", "java", "c", "h", "cpp", "rs", "rb", "php", "css", "scss", "kt", "swift")

# --- notices --------------------------------------------------------------------------------------------------------
COMMENT_LINE = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|''')")
GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|source)\b|\bDO NOT (?:EDIT|MODIFY)\b|\b(?:code|file|source|output|class|module|content|document)s?\b[^.\n]{0,40}\b(?:auto(?:matically)?[- ]?)?(?:generated|created|produced|emitted|written) (?:by|from|using|with)\b|\b(?:auto(?:matically)?[- ])(?:generated|created|produced)\b|\bmachine[- ](?:written|generated|made)\b|\bgenerated (?:by|from|using) \w|\bmanual changes will be (?:lost|overwritten)\b"
    r"|\bDiese Datei wurde (?:von|mit|automatisch)\b|\berzeugt\b[^\n]{0,20}\bNicht (?:bearbeiten|ändern)\b|\b(?:généré|genere)e?s? (?:par|automatiquement)\b|\bNe pas modifier\b|\b[Gg]enerado (?:por|automáticamente)\b|\bNo editar\b",
    re.IGNORECASE,
)
COPIED = re.compile(r"\b(?:vendored )?copy of (?:the )?([\w.\-/]+)|\b(?:copied|vendored|imported|taken|adapted|forked|ported)\b(?: verbatim| unchanged)? from (?:the )?([\w.\-/]+)|@licen[sc]e (?:the )?([\w.\-]+)|\bCopyright \(c\) [\d,\- ]*(?:by )?(?:the )?([\w.\-]+)|\bSPDX-License-Identifier\b|\bThis file is part of (?:the )?([\w.\-]+)|\(c\) (?:\d+ )?(?:the )?([\w.\-]+) (?:authors|project|contributors)", re.IGNORECASE)
BANNER = re.compile(r"^/\*[!*]\s*[@\w.\-]+ v?\d+(?:\.\d+)+")
MAPPED = re.compile(r"(?:^|\n)(?://|/\*)[#@] sourceMappingURL=[^\n]*\s*$")
# File names and directories that tools write, and directories that hold other people's sources.
WRITTEN_NAMES = re.compile(r"(?:\.pb\.\w+|_pb2(?:_grpc)?\.pyi?|_pb\.(?:ts|js|d\.ts)|\.g\.(?:cs|dart|i\.cs)|\.designer\.\w+|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|\.freezed\.dart)$|(?:^|/)(?:__generated__|generated|gen|autogen|\.generated)/", re.IGNORECASE)
VENDORED = re.compile(r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|external|externals|site-packages)/(?:@[\w.\-]+/)?([\w.\-]+)/", re.IGNORECASE)
MINIFIED_NAME = re.compile(r"\.min\.(?:\w+\.)?(?:js|mjs|css)$", re.IGNORECASE)

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\S")
LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\b\d[\w.]*")
LITERAL_LINE = re.compile(r"^[\s\-+]*(?:(?:\"[^\"\n]*\"|'[^'\n]*'|[\-+]?\d[\w.\-+]*)[\s,;|\-+]*)+[\])};]*\s*$")
LINE_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*(?:\s|/|$)|<!--|--\s)")


def leading_comment(text: str) -> tuple[str, str]:
    """(the block of comments at the top, the rest)."""
    at = 0
    inside = False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if inside:
            inside = "*/" not in line
        elif line.strip() and not line.startswith("#!"):
            if not COMMENT_LINE.match(line) or line.lstrip().startswith(('"""', "'''")):
                break
            inside = line.lstrip().startswith("/*") and "*/" not in line
            if line.lstrip().startswith("/*") and "*/" in line and line[line.index("*/") + 2 :].strip():
                at += line.index("*/") + 2
                break
        at = end + 1
    return text[:at], text[at:]


def notice(head: str, text: str) -> tuple[str, str | None]:
    """(generated | copied | minified | none, the name of whoever the notice names)."""
    if GENERATED.search(head):
        return "generated", None
    holder = None
    for m in COPIED.finditer(head):
        holder = next((g for g in m.groups() if g), None) or holder
        if holder:
            return "copied", holder.strip(".,").lower()
    if BANNER.match(head.lstrip()) or "sourceMappingURL=" in text and MAPPED.search(text):
        return "minified", None
    return "none", None


def entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def shape(body: str) -> list[float]:
    """The features of a text without its leading comments and map reference."""
    body = MAPPED.split(body)[0] if "sourceMappingURL=" in body else body
    n = len(body)
    if not n:
        return [0.0] * 13
    raw = body.encode("utf-8", "surrogatepass")
    lines = body.split("\n")
    solid = [line for line in lines if line.strip()] or [""]
    tokens = Counter(TOKEN.findall(body))
    total = sum(tokens.values())
    names = {t: c for t, c in tokens.items() if t[0].isalpha() or t[0] == "_"}
    named = sum(names.values())
    literal = sum(map(len, LITERAL.findall(body)))
    long_lines = [line for line in solid if len(line) > 8]
    return [
        math.log1p(n),
        len(zlib.compress(raw, 1)) / len(raw),
        entropy(tokens),
        sum(len(t) * c for t, c in names.items()) / named if named else 0.0,
        sum(c for t, c in names.items() if len(t) <= 2) / named if named else 0.0,
        sum(bool(LINE_COMMENT.match(line)) for line in solid) / len(solid),
        math.log1p(n / len(solid)),
        math.log1p(max(map(len, solid))),
        sum(map(body.count, " \n\t")) / n,
        sum(map(body.count, "0123456789")) / n,
        literal / n,
        len(tokens) / total if total else 0.0,
        sum(bool(LITERAL_LINE.match(line)) for line in long_lines) / len(long_lines) if long_lines else 0.0,
    ]


def text_of(raw: bytes | str | None) -> str:
    if raw is None:
        return ""
    if isinstance(raw, bytes):
        try:
            raw = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            raw = raw.decode("latin-1")
    return raw.replace("\r\n", "\n")


def evidence(files: DataFrame) -> DataFrame:
    """file_id, features, notice, holder, tree (the vendored package), code, data (literals nearly throughout)."""
    schema = pa.schema([("file_id", pa.int64()), ("features", pa.list_(pa.float64())), ("notice", pa.string()), ("holder", pa.string()), ("tree", pa.string()), ("code", pa.bool_()), ("data", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, role, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                path = path or ""
                text = text_of(raw.as_py())
                head, body = leading_comment(text)
                kind, holder = notice(head, text)
                features = [*shape(body), float(bool(WRITTEN_NAMES.search(path))), float(bool(MINIFIED_NAME.search(path))), float((role or "").strip().lower() == "generated"), float(path.count("/"))]
                tree = VENDORED.search(path)
                code = path.rsplit(".", 1)[-1].lower() in CODE and "\0" not in text
                data = code and len(body) > DATA_FROM and (features[LITERAL_LINES] >= 0.9 or features[LITERALS] >= 0.9)
                rows.append((key, features, kind, holder, tree[1].lower() if tree else None, code, data))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)

    return files.select(F.col("file_id").cast("bigint"), "rel_path", "role", "content").mapInArrow(run, "file_id bigint, features array<double>, notice string, holder string, tree string, code boolean, data boolean")


def marked(files: DataFrame) -> DataFrame:
    """The evidence with ``kind`` (the notice, ``own`` where it names a repository of the table) and ``foreign_tree``."""
    own = files.select(F.lower(F.trim("repo")).alias("name")).where("name is not null").distinct().withColumn("own", F.lit(True))
    seen = evidence(files)
    joined = seen.join(own.select(F.col("name").alias("holder"), F.col("own").alias("own_holder")), "holder", "left").join(own.select(F.col("name").alias("tree"), F.col("own").alias("own_tree")), "tree", "left")
    kind = F.when((F.col("notice") == "copied") & F.col("own_holder").isNotNull(), "own").otherwise(F.col("notice"))
    return joined.select("file_id", "features", "code", "data", kind.alias("kind"), (F.col("tree").isNotNull() & F.col("own_tree").isNull()).alias("foreign_tree"))


def forest(sample: DataFrame):
    """The forest of a bounded sample with ``vector``, ``kind``, or None without files of both classes."""
    label = F.col("kind").isin("generated", "copied", "minified").cast("double")
    rows = sample.select("file_id", "vector", label.alias("label"), F.when(F.col("kind") == "none", UNLABELLED_WEIGHT).otherwise(1.0).alias("trust"))
    sums = {r["label"]: r["trust"] for r in rows.groupBy("label").agg(F.sum("trust").alias("trust")).collect()}
    if len(sums) < 2:
        return None
    weight = F.col("trust") * F.when(F.col("label") == 1, 1 / sums[1.0]).otherwise(1 / sums[0.0]) * (sums[0.0] + sums[1.0]) / 2
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=32, minInstancesPerNode=5, seed=7).fit(rows.withColumn("weight", weight))


def probability(model, rows: DataFrame) -> DataFrame:
    """rows with ``score``."""
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    own = model.transform(rows)
    return own.withColumn("score", F.when(F.col("code"), vector_to_array("probability")[1]).otherwise(0.0)).drop("probability", "rawPrediction", "prediction")


def trained(rows: DataFrame, most: int = MOST_LABELLED):
    """The forest on reliable negatives of a bounded sample of code files with notices as labels."""
    sample = rows.where("code").orderBy(F.xxhash64("file_id"), "file_id").limit(most)
    model = forest(sample)
    for _ in range(CLEANINGS if model is not None else 0):
        model = forest(probability(model, sample).where(f"kind IN ('generated', 'copied', 'minified') OR score < {RELIABLE}"))
    return model


def scores(files: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """file_id, features, code, data, kind, foreign_tree, score: the forest's probability that a notice would name a maker other than the project's authors."""
    seen, _ = Stored(files.sparkSession).table(marked(files))
    rows = seen.withColumn("vector", array_to_vector("features"))
    return probability(trained(rows, most), rows).drop("vector")


def held_out(files: DataFrame, folds: int = 3, most: int = MOST_LABELLED) -> DataFrame:
    """kind, files, reported: how many code files of each kind of notice a forest fitted without them finds."""
    seen, _ = Stored(files.sparkSession).table(marked(files))
    rows = seen.withColumn("vector", array_to_vector("features"))
    fold = F.pmod(F.xxhash64("file_id"), F.lit(folds))
    parts = [probability(trained(rows.where(fold != k), most), rows.where((fold == k) & F.col("code"))) for k in range(folds)]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored.groupBy("kind", "foreign_tree", "data", (F.col("features")[TOOL_NAME] > 0).alias("tool_name")).agg(F.count("*").alias("files"), F.count_if(F.col("score") >= THRESHOLD).alias("reported"))


def classified(files: DataFrame) -> DataFrame:
    """file_id, reason (generated | third_party | machine_shaped | data | null for hand-written), score."""
    scored = scores(files)
    noticed = F.when(F.col("kind") == "generated", "generated").when(F.col("kind") == "copied", "third_party").when(F.col("kind") == "minified", "machine_shaped")
    exact = F.when(F.col("foreign_tree"), "third_party").when(F.col("data"), "data")
    return scored.select("file_id", F.coalesce(noticed, F.when(F.col("score") >= THRESHOLD, "machine_shaped"), exact).alias("reason"), "score")


def found(files: DataFrame) -> DataFrame:
    return classified(files).where("reason is not null").select("file_id")
