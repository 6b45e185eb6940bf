"""Tables and files in the folder that all executors share, and folders of numbered segments with a published manifest."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEARED: set[str] = set()
_OWNED: ContextVar[list | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        made = tempfile.mkdtemp(prefix="mnemosaic-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL[sc.applicationId] = "file://" + made
    return _LOCAL[sc.applicationId]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, name: str) -> None:
    fs, path = _path(spark, name)
    fs.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, path = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def put_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file that appears whole: it is written beside its place, then renamed. A name that is taken is an error."""
    fs, path = _path(spark, name)
    _, aside = _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(path) or not fs.rename(aside, path):
        fs.delete(aside, True)
        raise FileExistsError(name)


def get_text(spark: SparkSession, name: str) -> str:
    fs, path = _path(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def application_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/mnemosaic/{app}"
    if app not in _CLEARED:
        _CLEARED.add(app)
        fs, path = _path(spark, root)

        def clear() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                fs.delete(path, True)

        atexit.register(clear)
    return root


@contextlib.contextmanager
def owned() -> Iterator[list[Scratch]]:
    """The Scratch folders that are made inside, by this thread, which the caller is to empty."""
    made: list[Scratch] = []
    token = _OWNED.set(made)
    try:
        yield made
    finally:
        _OWNED.reset(token)


class Scratch:
    """Tables written to the shared folder. They outlive lost executors; drop() and drop_but() remove those no plan needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.live: set[str] = set()
        if (made := _OWNED.get()) is not None:
            made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n:03d}"
        self.n += 1
        df.write.parquet(path)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            remove(self.spark, df._scratch_path)
            self.live.discard(df._scratch_path)

    def drop_but(self, *needed: DataFrame) -> None:
        """Removes all tables but those that the caller's result still reads."""
        for name in self.live - {df._scratch_path for df in needed}:
            remove(self.spark, name)
            self.live.discard(name)


class Segments:
    """A folder of numbered segments, each a set of tables. The last manifest names the live ones; it appears whole or not at all.

    A writer fills a segment of a new number, then publishes. One that fails leaves files that no manifest names; of two that publish
    the same number one gets an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names(self.spark, f"{self.root}/manifests") if n.count(".") == 1 and n.endswith(".json"))

    def state(self) -> dict:
        """{"live": [segment, ...], "next": number} and what else was published; nothing live before the first."""
        found = self._manifests()
        return json.loads(get_text(self.spark, f"{self.root}/manifests/{found[-1]}.json")) if found else {"live": [], "next": 0}

    def publish(self, state: dict) -> None:
        found = self._manifests()
        put_text(self.spark, f"{self.root}/manifests/{(found[-1] if found else -1) + 1}.json", json.dumps(state))

    def number(self, state: dict) -> int:
        """The number for a new segment: behind all there are, those of writers that failed among them."""
        tables = [t for t in names(self.spark, self.root) if t != "manifests"]
        taken = [int(n.removeprefix("segment=")) for t in tables for n in names(self.spark, f"{self.root}/{t}") if n.startswith("segment=")]
        return max([state["next"] - 1, *taken]) + 1

    def path(self, segment: int, table: str) -> str:
        return f"{self.root}/{table}/segment={segment}"

    def read(self, table: str, live: list[int], schema: str, parts: list[str] | None = None) -> DataFrame:
        """Rows of the live segments' tables with their segment, in one scan; no rows if none has the table. With parts only these of its partitions are listed and read."""
        there = self.having(table, live)
        paths = [self.path(s, table) for s in there]
        if parts is not None:
            paths = [f"{p}/{part}" for p in paths for part in sorted(set(parts) & set(names(self.spark, p)))]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.root}/{table}").parquet(*paths)

    def having(self, table: str, live: list[int]) -> list[int]:
        """The live segments that have the table."""
        there = {n.removeprefix("segment=") for n in names(self.spark, f"{self.root}/{table}")}
        return [s for s in live if str(s) in there]
