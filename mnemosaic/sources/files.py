"""Journals and code graphs as data sources: spark.read.format("journal") and format("codegraph"), once registered.

Files are listed on the driver by name, dealt to tasks, and read there; filters on the date that a file's name begins with leave files
unread, and filters on tags leave rows out where they are read. A graph is written as numbered versions: tasks write parts aside, and
the commit publishes them by one rename, or rejects a graph that is too small. Any file system that Arrow knows will do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

JOURNAL = "path string, title string, date string, tags string, body string"
NODE = "part string, id string, label string, type string, kind string, file string, line int, src string, dst string, edge_type string"
#: Files of a task, and nodes that make a graph worth keeping.
GROUP, LEAST = 256, 10

_HEAD = re.compile(r"^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", re.S)
_DATED = re.compile(r"^(\d{4}-\d{2}-\d{2})")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    files, inner = fs.FileSystem.from_uri(path)
    return files, inner.rstrip("/")


def entry(path: str, text: str) -> tuple[str, str, str, str, str]:
    """path, title, date, tags (comma-joined), body of one file; without front matter all is body."""
    m = _HEAD.match(text)
    head, body = (m[1], m[2]) if m else ("", text)
    field = lambda name: (x[1].strip() if (x := re.search(rf"(?m)^{name}:[ \t]*(.*)$", head)) else "")
    tags = [t for t in (x.strip() for x in re.sub(r"[\[\]\"']", "", field("tags")).split(",")) if t]
    return path, field("title"), field("date"), ",".join(tags), body


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class JournalReader(DataSourceReader):
    """Filters on date are taken by the names of files where these begin with it, those on tags by their text; Spark checks both again."""

    def __init__(self, path: str):
        self.path = path
        self.dates: list[tuple[type, str]] = []
        self.tags: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("date",):
                self.dates.append((type(f), str(f.value)))
            elif isinstance(f, StringContains) and f.attribute == ("tags",):
                self.tags.append(f.value)
            yield f

    def _may(self, name: str) -> bool:
        """Whether a file of this name may have a row that passes. Dates in names say nothing of files without one."""
        m = _DATED.match(name)
        if not m:
            return True
        tests = {EqualTo: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__}
        return all(tests[kind](m[1], value[:10]) or (kind in (GreaterThan, LessThan) and m[1] == value[:10] and len(value) > 10) for kind, value in self.dates)

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".md") and self._may(f.base_name))
        return [_Files(paths[i : i + GROUP]) for i in range(0, len(paths), GROUP)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _open(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as f:
                row = entry(path, f.read().decode("utf-8", "replace"))
            if all(t in row[3] for t in self.tags):
                yield row


class Journal(DataSource):
    """spark.read.format("journal").load(folder): path, title, date, tags (comma-joined), body of the Markdown files below it."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return JOURNAL

    def reader(self, schema: StructType) -> JournalReader:
        return JournalReader(self.options["path"])


def _versions(files: fs.FileSystem, root: str) -> list[int]:
    found = files.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if re.fullmatch(r"\d+\.json", f.base_name))


class GraphReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        known = _versions(files, root)
        if not known:
            return [_Files([])]
        with files.open_input_stream(f"{root}/versions/{known[-1]}.json") as f:
            return [_Files([p]) for p in json.loads(f.read())["parts"]] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.path)
        for name in partition.paths:
            with files.open_input_file(f"{root}/parts/{name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class _Part(WriterCommitMessage):
    def __init__(self, name: str, nodes: int):
        self.name, self.nodes = name, nodes


class GraphWriter(DataSourceArrowWriter):
    """A version is what all tasks wrote. Readers see the last version until the new one is published."""

    def __init__(self, path: str, least: int):
        self.path, self.least = path, least

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        files, root = _open(self.path)
        name, nodes, out, stream = f"{uuid.uuid4().hex}.parquet", 0, None, None
        try:
            for b in batches:
                if out is None:
                    files.create_dir(f"{root}/parts", recursive=True)
                    stream = files.open_output_stream(f"{root}/parts/{name}", compression=None)
                    out = pq.ParquetWriter(stream, b.schema)
                out.write_batch(b)
                nodes += sum(p == "node" for p in b.column("part").to_pylist())
        finally:
            if out is not None:
                out.close()
                stream.close()
        return _Part(name if out is not None else "", nodes)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.name]
        if sum(m.nodes for m in parts) < self.least:
            self.abort(messages)
            raise ValueError(f"a graph of fewer than {self.least} nodes is not kept")
        files, root = _open(self.path)
        files.create_dir(f"{root}/versions", recursive=True)
        aside = f"{root}/versions/{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(aside, compression=None) as f:
            f.write(json.dumps({"parts": [m.name for m in parts]}).encode())
        known = _versions(files, root)
        files.move(aside, f"{root}/versions/{(known[-1] if known else -1) + 1}.json")

    def abort(self, messages: list[_Part | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{root}/parts/{m.name}")


class Graph(DataSource):
    """format("codegraph"): rows of a graph, part "node" or "edge" with the columns of each; option least is the number of nodes that a graph must have."""

    @classmethod
    def name(cls) -> str:
        return "codegraph"

    def schema(self) -> str:
        return NODE

    def reader(self, schema: StructType) -> GraphReader:
        return GraphReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> GraphWriter:
        return GraphWriter(self.options["path"], int(self.options.get("least", LEAST)))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session; filters reach the reader of journals."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Journal)
    spark.dataSource.register(Graph)


def graph_rows(nodes, edges):
    """nodes(id, label, type, kind, file, line) and edges(src, dst, edge_type) as the rows of format("codegraph")."""
    from pyspark.sql import functions as F

    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    n = nodes.select(F.lit("node").alias("part"), *[F.col(c).cast("string").alias(c) for c in ("id", "label", "type", "kind", "file")], F.col("line").cast("int").alias("line"), none("src"), none("dst"), none("edge_type"))
    e = edges.select(F.lit("edge").alias("part"), *[none(c) for c in ("id", "label", "type", "kind", "file")], none("line", "int"), *[F.col(c).cast("string").alias(c) for c in ("src", "dst", "edge_type")])
    return n.unionByName(e)
