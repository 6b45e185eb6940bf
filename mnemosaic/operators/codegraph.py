"""A graph of code kept up to date by file: facts of each file, and the edges that follow from the facts of the files there are.

Facts come from a table function over whole files: top-level definitions, calls and types of the file's own names with the
definition they stand in, and relative imports. A refresh reads only files whose content is new; facts of a changed or removed
file no longer count from then on. Edges are a view, so the target of an import is looked up again whenever files come or go.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Segments

#: What a definition without indentation looks like, by the ending of the file: its kind and its name.
_SCRIPT = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
_JVM = r"^(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open)\s+)*(class|interface|enum|record|object|fun)\s+([A-Za-z_]\w*)"
DEFINITIONS = {
    **dict.fromkeys(("js", "jsx", "ts", "tsx", "mjs", "cjs"), _SCRIPT),
    **dict.fromkeys(("java", "kt", "scala", "cs"), _JVM),
    "py": r"^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "rs": r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|type)\s+([A-Za-z_]\w*)",
    "rb": r"^(def|class|module)\s+([A-Za-z_]\w*)",
}
CALL, TYPE = r"([A-Za-z_$][\w$]*)\s*\(", r"\b([A-Z][\w$]*)\b"
IMPORT = r"""(?:from\s+|import\s+|require\(\s*|import\(\s*)["'](\.[^"']*|/[^"']*)["']"""
PYTHON_IMPORT = r"^from\s+(\.+)([\w.]*)\s+import\b"
#: Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch function class typeof instanceof new delete void return throw yield await import export super this".split())

_COMPILED = {k: re.compile(p, re.A) for k, p in DEFINITIONS.items()}
_CALL, _TYPE, _IMPORT, _PYTHON = re.compile(CALL, re.A), re.compile(TYPE, re.A), re.compile(IMPORT), re.compile(PYTHON_IMPORT, re.A)
FACT = "kind string, name string, line int, inside string, detail string"


def stem(path: str) -> str:
    """A path without its ending, as imports leave it out."""
    base, end = posixpath.splitext(path)
    return base if end[1:] in DEFINITIONS else path


@F.udtf(returnType=FACT, useArrow=True)
class CodeFacts:
    """(kind, name, line, inside, detail) of one file: def (detail: its kind), call and type (once for each definition they stand in), import (detail: the stem of the file meant)."""

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        end = (path or "").rpartition(".")[2]
        pattern = _COMPILED.get(end)
        if pattern is None or not content:
            return
        lines = content.split("\n")
        defs = [(m[2], m[1], i) for i, line in enumerate(lines, 1) if (m := pattern.match(line))]
        own = {d[0] for d in defs}
        seen: set[tuple] = set()
        for name, kind, i in defs:
            if (name,) not in seen:
                seen.add((name,))
                yield "def", name, i, None, kind
        starts = {i: name for name, _, i in defs}
        inside = None
        folder = posixpath.dirname(path)
        for i, line in enumerate(lines, 1):
            inside = starts.get(i, inside)
            for m in _IMPORT.finditer(line):
                yield "import", m[1], i, None, stem(posixpath.normpath(posixpath.join(folder, m[1])))
            if end == "py" and (m := _PYTHON.match(line)):
                up = posixpath.join(folder, *[".."] * (len(m[1]) - 1), m[2].replace(".", "/"))
                yield "import", m[1] + m[2], i, None, posixpath.normpath(up)
            if inside is None:
                continue
            for kind, what in (("call", _CALL), ("type", _TYPE)):
                for m in what.finditer(line):
                    fact = (kind, m[1], inside)
                    if m[1] in own and m[1] != inside and m[1] not in NO_CALLS and fact not in seen:
                        seen.add(fact)
                        yield kind, m[1], i, inside, None


def facts(files: DataFrame) -> DataFrame:
    """files(path, content) -> path and the facts of each. Files of no known language, null and empty ones have none; repeated rows repeat them."""
    return files.select("path", "content").lateralJoin(CodeFacts(F.col("path").outer(), F.col("content").outer())).select("path", "kind", "name", "line", "inside", "detail")


class CodeGraph:
    """Kept under a folder that all executors share. Paths are unique among the files given."""

    def __init__(self, spark: SparkSession, root: str, least: int = 100):
        self.spark, self.segments, self.least = spark, Segments(spark, root), least

    def refresh(self, files: DataFrame) -> int:
        """files(path, content) are all files there are: new and changed ones are read, those no longer there go. Gives how many were read.

        Files under so many characters count as not there.
        """
        now = files.filter(F.length("content") >= self.least).select("path", "content", F.sha2("content", 256).alias("hash"))
        known = self.files()
        return self._apply(now.join(known.select("path", "hash"), ["path", "hash"], "left_anti"), known.join(now.select("path"), "path", "left_anti").select("path"))

    def apply(self, changed: DataFrame, removed: DataFrame) -> int:
        """Some files(path, content) that are new or changed, and paths that are gone; all others stay."""
        return self._apply(changed.filter(F.length("content") >= self.least).select("path", "content", F.sha2("content", 256).alias("hash")), removed.select("path").unionByName(changed.filter(F.length("content") < self.least).select("path")))

    def _apply(self, changed: DataFrame, removed: DataFrame) -> int:
        state = self.segments.state()
        segment = self.segments.number(state)
        at = lambda table: self.segments.path(segment, table)
        changed.select("path", "hash").write.parquet(at("files"))
        facts(changed).write.parquet(at("facts"))
        read = self.spark.read.parquet(at("files"))
        removed.distinct().unionByName(read.select("path")).write.parquet(at("gone"))
        self.segments.publish({"live": [*state["live"], segment], "next": segment + 1})
        return read.count()

    def _live(self, table: str, schema: str) -> DataFrame:
        """Rows of segments in which nothing later has replaced their file; a segment's own rows are newer than what it takes away."""
        live = self.segments.state()["live"]
        rows = self.segments.read(table, live, schema)
        gone = self.segments.read("gone", live, "path string").groupBy(F.col("path").alias("_path")).agg(F.max("segment").alias("until"))
        return rows.join(gone, (rows["path"] == F.col("_path")) & (rows["segment"] < F.col("until")), "left_anti").drop("segment")

    def files(self) -> DataFrame:
        return self._live("files", "path string, hash string")

    def facts(self) -> DataFrame:
        return self._live("facts", f"path string, {FACT}")

    def compact(self) -> None:
        """One segment of what is live."""
        state = self.segments.state()
        segment = self.segments.number(state)
        self.files().write.parquet(self.segments.path(segment, "files"))
        self.facts().write.parquet(self.segments.path(segment, "facts"))
        self.segments.publish({"live": [segment], "next": segment + 1})

    def nodes(self) -> DataFrame:
        """(id, label, type, kind, file, line): a node for each file and each definition."""
        symbols = self.facts().filter("kind = 'def'").select(F.concat("path", F.lit("#"), "name").alias("id"), F.col("name").alias("label"), F.lit("symbol").alias("type"), F.col("detail").alias("kind"), F.col("path").alias("file"), "line")
        none = F.lit(None).cast("string")
        return self.files().select(F.col("path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("type"), none.alias("kind"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line")).unionByName(symbols)

    def edges(self) -> DataFrame:
        """(src, dst, edge_type): defined_in, calls and references within a file, imports between files. Imports of files that aren't there have no edge."""
        f = self.facts()
        symbol = lambda name: F.concat("path", F.lit("#"), name)
        defined = f.filter("kind = 'def'").select(symbol("name").alias("src"), F.col("path").alias("dst"), F.lit("defined_in").alias("edge_type"))
        uses = f.filter("kind IN ('call', 'type')").select(symbol("inside").alias("src"), symbol("name").alias("dst"), F.when(F.col("kind") == "call", "calls").otherwise("references").alias("edge_type"))
        ending = r"\.(" + "|".join(sorted(DEFINITIONS)) + ")$"
        there = self.files().select(F.col("path").alias("dst"), F.regexp_replace("path", ending, "").alias("detail"))
        imports = f.filter("kind = 'import'").join(there, "detail").filter("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("imports").alias("edge_type")).distinct()
        return defined.unionByName(uses).unionByName(imports)
