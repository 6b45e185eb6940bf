"""Schemas and sources: nodes, edges, journals, code files, and the node view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = (
    "id scope label content summary keywords:array<string> type category supertype domain source project subtask level:int parent_ids:array<string> tags:array<string> "
    "derived_from:array<string> embedding:array<float> embedding_segments:array<array<float>> created_ms:long updated_ms:long accessed_ms:long verified_ms:long expires_ms:long "
    "importance:double confidence:double usefulness:double access_count:int times_used:int times_helpful:int verification_count:int sticky:boolean status metadata"
).split()
#: Schemas as DDL, which readers and createDataFrame take.
NODE_SCHEMA = ", ".join(f"{f.split(':', 1)[0]} {f.split(':', 1)[1] if ':' in f else 'string'}" for f in _FIELDS)
EDGE_SCHEMA = "source string, target string, edge_type string, scope string, created_ms long, confidence double, metadata string"

#: What the type of a node says about it.
TYPE_CATEGORY = dict.fromkeys("event note session task plan exploration debug-investigation improvement review".split(), "episodic") | {"lesson": "semantic", "knowledge": "semantic"}
TYPE_SUPERTYPE = (
    dict.fromkeys("concept fact knowledge architecture convention research".split(), "declarative")
    | dict.fromkeys("lesson howto skill playbook".split(), "procedural")
    | dict.fromkeys("event note session task plan exploration debug-investigation improvement review bug".split(), "experiential")
    | dict.fromkeys("summary core fix".split(), "meta")
)
TYPE_DOMAIN = (
    dict.fromkeys("architecture knowledge".split(), "architecture")
    | dict.fromkeys("howto config technical".split(), "operations")
    | dict.fromkeys("concept fact research".split(), "knowledge")
    | dict.fromkeys("rule:mandatory rule:standard rule:suggestion convention best-practices".split(), "rules")
    | dict.fromkeys("event note session task plan exploration debug-investigation improvement review bug fix summary project-history".split(), "history")
    | dict.fromkeys("skill playbook lesson".split(), "patterns")
    | dict.fromkeys("preference pref".split(), "preferences")
)

#: The node view of `documents`: expressions that Spark and DuckDB read alike. Only ids drive them, so the view is the same at every size.
NODE_VIEW = {
    "id": "doc_id",
    "content": "text",
    "project": "source",
    "scope": "CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'project' END",
    "level": "CAST(doc_id % 6 AS INT)",
    "type": "CASE doc_id % 13 WHEN 0 THEN 'skill' WHEN 1 THEN 'lesson' WHEN 2 THEN 'note' WHEN 3 THEN 'fact' WHEN 4 THEN 'decision' WHEN 5 THEN 'event' WHEN 6 THEN 'howto' WHEN 7 THEN 'knowledge' WHEN 8 THEN 'bug' WHEN 9 THEN 'storedcontext' WHEN 10 THEN 'rule' WHEN 11 THEN 'concept' ELSE 'session' END",
    "label": "CASE doc_id % 11 WHEN 0 THEN concat('lesson:', doc_id) WHEN 1 THEN concat('Knowledge:', doc_id) WHEN 2 THEN concat('plan:', doc_id) WHEN 3 THEN concat('middle-term:', doc_id) WHEN 4 THEN 'persona' WHEN 5 THEN concat('fact:topic', doc_id % 50) ELSE concat('n', doc_id) END",
    "tag": "CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'bug' WHEN 2 THEN 'note' ELSE NULL END",
    "importance": "(doc_id * 37 % 101) / 100e0",
    "confidence": "(doc_id * 53 % 97) / 96e0",
    "usefulness": "(doc_id * 29 % 51) / 10e0",
    "access_count": "CAST(doc_id * 7 % 23 AS INT)",
    "created_ms": "1672531200000 + (doc_id * 131 % 390) * 86400000",
    "updated_ms": "1672531200000 + (doc_id * 131 % 390) * 86400000 + (doc_id % 24) * 3600000",
    "accessed_ms": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1690000000000 + (doc_id * 97 % 190) * 86400000 END",
    "verified_ms": "CASE WHEN doc_id % 7 = 0 THEN 1706000000000 + (doc_id % 9) * 86400000 ELSE NULL END",
    "expires_ms": "CASE WHEN doc_id % 6 = 1 THEN 1700000000000 + (doc_id * 11 % 150) * 86400000 ELSE NULL END",
    "sticky": "doc_id % 17 = 0",
    "status": "CASE WHEN doc_id % 19 = 0 THEN 'superseded' WHEN doc_id % 23 = 0 THEN NULL ELSE 'active' END",
}
AS_OF_MS = 1706745600000  # 2024-02-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(documents: DataFrame) -> DataFrame:
    """The documents as nodes, with the derived classes of their types."""
    base = documents.selectExpr(*[f"{e} AS {n}" for n, e in NODE_VIEW.items()])
    return with_classes(base)


def lookup(column, values: dict[str, str], other=None):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value in sorted(set(values.values())):
        out = out.when(column.isin(*sorted(k for k, v in values.items() if v == value)), value)
    return out.otherwise(F.lit(other))


def with_classes(df: DataFrame) -> DataFrame:
    """category (semantic for unknown types), supertype and domain of each type; null for a null type."""
    known = F.col("type").isNotNull()
    return df.withColumns({
        "category": F.when(known, lookup(F.col("type"), TYPE_CATEGORY, "semantic")),
        "supertype": F.when(known, lookup(F.col("type"), TYPE_SUPERTYPE)),
        "domain": F.when(known, lookup(F.col("type"), TYPE_DOMAIN)),
    })


#: Columns that older stores keep as JSON text, with their types, and what stands for a null in others.
JSON_TEXT = {"parent_ids": "array<string>", "tags": "array<string>", "derived_from": "array<string>", "embedding": "array<float>", "embedding_segments": "array<array<float>>"}
DEFAULTS = {"confidence": 0.5, "verification_count": 0, "usefulness": 0.0, "times_used": 0, "times_helpful": 0, "status": "active", "sticky": False}


def decoded(raw: DataFrame) -> DataFrame:
    """Stored rows as nodes: JSON text parsed (malformed text gives null), flags as booleans, defaults for nulls."""
    kinds = dict(raw.dtypes)
    out = {c: F.from_json(c, t) for c, t in JSON_TEXT.items() if kinds.get(c) == "string"}
    for c, v in DEFAULTS.items():
        if c in kinds:
            out[c] = F.coalesce(F.col(c).cast("boolean") if c == "sticky" else F.col(c), F.lit(v))
    return raw.withColumns(out)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter -> path, title, date, tags, body; newest first."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parted = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", 1)
    head = F.when(F.col("value").rlike(r"(?s)^---\r?\n.*?\r?\n---"), parted).otherwise("")
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    body = F.when(head != "", F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", 2)).otherwise(F.col("value"))
    tags = F.filter(F.transform(F.split(F.regexp_replace(field("tags"), r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda t: t != "")
    return raw.select("path", field("title").alias("title"), field("date").alias("date"), tags.alias("tags"), body.alias("body")).orderBy(F.desc("date"), "path")


def journal_search(entries: DataFrame, words: str = "", tags: tuple[str, ...] = (), page: int = 1, size: int = 10) -> DataFrame:
    """Entries with all the tags, by the share of the words they contain; a page of 1 to 50."""
    size = max(1, min(50, size))
    terms = [w for w in words.lower().split() if w]
    text = F.lower(F.concat_ws(" ", "title", "body"))
    hits = sum((text.contains(w).cast("int") for w in terms), F.lit(0))
    found = entries.filter(F.size(F.array_except(F.array(*map(F.lit, tags)).cast("array<string>"), "tags")) == 0).withColumn("score", hits / max(1, len(terms)))
    if terms:
        found = found.filter("score > 0")
    return found.orderBy(F.desc("score"), F.desc("date"), "path").offset((max(1, page) - 1) * size).limit(size)


#: Code files and folders that a scan passes over.
CODE = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "rb", "c", "h", "cpp", "cs", "php", "kt", "swift", "scala")
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor", "target", "__pycache__", ".venv", "coverage")


def code_files(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """path, length, content of code files with 0 < size < most, outside folders of products and libraries."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = rf"/(?:{'|'.join(s.replace('.', '[.]') for s in SKIPPED)})/"
    return files.filter((F.col("length") > 0) & (F.col("length") < most) & F.col("path").rlike(rf"\.(?:{'|'.join(CODE)})$") & ~F.col("path").rlike(inside)).select("path", "length", "content")


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Evaluation datasets: one JSON array or object per file; bad rows give nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dialogue sets, an array or an object of samples -> (sample, session, place, speaker, dia_id, text) and (sample, question, answer, evidence, category).

    Sessions are the parts of a conversation that are lists of turns; what else stands in it is passed over.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    samples = whole.selectExpr("explode(CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN from_json(to_json(v), 'array<variant>') ELSE map_values(from_json(to_json(v), 'map<string,variant>')) END) AS s")
    named = samples.select(F.try_variant_get("s", "$.sample_id", "string").alias("sample"), "s")
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    parts = named.select("sample", F.explode(F.from_json(F.to_json(F.try_variant_get("s", "$.conversation", "variant")), "map<string,variant>")).alias("session", "p"))
    listed = parts.filter(F.expr("schema_of_variant(p)").startswith("ARRAY")).select("sample", "session", F.posexplode(F.from_json(F.to_json("p"), turn)).alias("place", "t"))
    asked = named.select("sample", F.explode(F.from_json(F.to_json(F.try_variant_get("s", "$.qa", "variant")), "array<struct<question:string,answer:string,evidence:array<string>,category:int>>")).alias("q"))
    return listed.select("sample", "session", "place", "t.*"), asked.select("sample", "q.*")


EXPERIENCE = "instance_id string, repo string, summary string, problem_statement string, touched_files array<string>, reasoning string, tool_sequence array<struct<name:string,target:string>>"


def experiences(spark: SparkSession, path: str) -> DataFrame:
    """Tasks that were solved; what is missing is empty."""
    rows = json_rows(spark, path, EXPERIENCE)
    empty = {c: F.coalesce(c, F.lit("") if t == "string" else F.array().cast(t)) for c, t in rows.dtypes}
    return rows.withColumns(empty)


def experience_links(spark: SparkSession, path: str) -> DataFrame:
    """(related_instance_id, experience_instance_id), each pair once."""
    rows = json_rows(spark, path, "related_instance_id string, experience_instance_ids array<string>")
    return rows.select("related_instance_id", F.explode("experience_instance_ids").alias("experience_instance_id")).distinct()


def write_graph(nodes_: DataFrame, edges: DataFrame, path: str) -> None:
    nodes_.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, least: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """None when it has too few nodes to be a graph worth keeping."""
    n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    return (n, e) if n.limit(least).count() >= least else None
