"""The journal and the code graph as data sources."""

import pytest
from mnemosaic.sources import files
from mnemosaic.sources import nodes as src
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def registered(spark):
    files.register(spark)
    return spark


def test_journal_reads_what_filters_leave(registered, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for k in range(12):
        day = f"2024-01-{k + 1:02d}"
        (tmp_path / ("sub" if k % 2 else ".") / f"{day}-note.md").write_text(f"---\ntitle: T{k}\ndate: {day}T10:00\ntags: [x{k % 3}, 'all']\n---\nbody {k}\n")
    (tmp_path / "free.md").write_text("no head é")
    (tmp_path / "other.txt").write_text("not read")
    j = registered.read.format("journal").load(f"file://{tmp_path}")
    plain = {(r.title, r.date, tuple(r.tags), r.body) for r in src.journal(registered, f"{tmp_path}/*.md").union(src.journal(registered, f"{tmp_path}/sub/*.md")).collect()}
    assert {(r.title, r.date, tuple(t for t in r.tags.split(",") if t), r.body) for r in j.collect()} == plain and len(plain) == 13
    assert {r.title for r in j.filter("date >= '2024-01-09' AND contains(tags, 'x2')").collect()} == {"T8", "T11"}
    assert {r.title for r in j.filter("date > '2024-01-11T09:00'").collect()} == {"T10", "T11"} and j.filter("date = '2024-01-03T10:00'").count() == 1
    assert j.filter("date < '2024-01-02T11:00'").count() == 3  # the one without a date too, whose date is empty
    r = files.JournalReader(f"file://{tmp_path}")
    list(r.pushFilters([files.GreaterThanOrEqual(("date",), "2024-01-09"), files.EqualTo(("title",), "x")]))
    assert sum(len(p.paths) for p in r.partitions()) == 5  # four dated files and the free one
    assert registered.read.format("journal").load(f"file://{tmp_path}/none").count() == 0


def a_graph(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("L").alias("label"), F.lit("symbol").alias("type"), F.lit("def").alias("kind"), F.lit("f").alias("file"), F.col("id").cast("int").alias("line"))
    edges = spark.range(n - 1).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"), F.lit("calls").alias("edge_type"))
    return files.graph_rows(nodes, edges)


def test_graph_versions_are_published_whole_or_not_at_all(registered, tmp_path):
    path = f"file://{tmp_path}/g"
    write = lambda rows: rows.repartition(3).write.format("codegraph").mode("append").save(path)
    read = lambda: {tuple(r) for r in registered.read.format("codegraph").load(path).collect()}
    assert read() == set()
    write(a_graph(registered, 12))
    first = {tuple(r) for r in a_graph(registered, 12).collect()}
    assert read() == first
    with pytest.raises(Exception, match="fewer than 10 nodes"):
        write(a_graph(registered, 9))
    broken = a_graph(registered, 40).withColumn("line", F.when(F.col("line") == 33, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        write(broken)
    assert read() == first
    write(a_graph(registered, 30))
    assert read() == {tuple(r) for r in a_graph(registered, 30).collect()}
