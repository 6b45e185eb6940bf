"""Graph operators over edge tables (src, dst, ...): hops, scores, paths, hierarchy, degrees, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def symmetric(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def edges_of(edges: DataFrame, node, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    hit = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    out = edges.filter(hit)
    return out.filter(F.col("edge_type") == edge_type) if edge_type else out


def next_edges(turns: DataFrame, by: str, order: list[str], id_: str, kind: str = "NEXT", weight: float = 1.0) -> DataFrame:
    """An edge from each row to the one before it in its session."""
    w = Window.partitionBy(by).orderBy(*order)
    return turns.withColumn("dst", F.lag(id_).over(w)).filter("dst IS NOT NULL").select(F.col(id_).alias("src"), "dst", F.lit(kind).alias("edge_type"), F.lit(weight).alias("confidence"))


#: Shares into which the references to a label are dealt.
SHARES = 16


def reference_edges(nodes: DataFrame, refs: DataFrame, weight: float = 0.8) -> DataFrame:
    """refs(id, label): edges to the nodes of those labels, itself left out. Ids of nodes are unique.

    Both sides are made distinct, so the edges are, and don't go through an exchange; a label's references are dealt into shares.
    """
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    to = nodes.filter("label IS NOT NULL").select(F.col("id").alias("dst"), "label").distinct().withColumn("_share", share)
    said = refs.select("id", "label").distinct().withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    return said.join(to, ["label", "_share"]).filter("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("REFERENCES").alias("edge_type"), F.lit(weight).alias("confidence"))


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links(source_id, target_label) with target_id: the global node of the label before the project's; null if none."""
    best = nodes.filter("label IS NOT NULL").groupBy("label").agg(F.min_by("id", F.struct((F.col("scope") != "global").cast("int"), "id")).alias("target_id"))
    return links.join(best.withColumnRenamed("label", "target_label"), "target_label", "left").select("source_id", "target_label", "target_id")


def hops(edges: DataFrame, seeds: DataFrame, most: int, scratch: Scratch | None = None) -> DataFrame:
    """(id, hops): nodes at most so many undirected hops from any seed, seeds at zero.

    Only the frontier is joined to the edges, and what was seen before is left out of the next one. Each hop is written to the
    shared folder, so a plan has two joins, whatever the number of hops; an empty frontier ends the walk.
    """
    scratch = scratch or Scratch(edges.sparkSession, "hops")
    both = symmetric(edges.select("src", "dst"))
    front = scratch.keep(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    seen = front
    for h in range(1, most + 1):
        met = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        front = scratch.keep(met.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hop_scores(edges: DataFrame, seeds: DataFrame, most: int, factor: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """seeds(id, score) -> (id, score): the best product of confidences and factors over paths of at most so many hops.

    Each hop is written; all are put together once.
    """
    scratch = scratch or Scratch(edges.sparkSession, "hop_scores")
    both = symmetric(edges.select("src", "dst", "confidence")).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    front = scratch.keep(seeds.groupBy("id").agg(F.max("score").alias("score")))
    all_ = front
    for _ in range(most):
        front = scratch.keep(front.join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("score") * F.col("confidence") * factor).alias("score")))
        all_ = all_.unionByName(front)
    return all_.groupBy("id").agg(F.max("score").alias("score"))


def shortest_paths(edges: DataFrame, start, most: int, scratch: Scratch | None = None) -> DataFrame:
    """(id, hops, path): one directed shortest path from a node to each in reach, the smallest in order of its nodes.

    The frontier alone is joined to the edges: a node's first path is among the shortest, and the smallest of these begins with the
    smallest path of the node before it.
    """
    scratch = scratch or Scratch(edges.sparkSession, "paths")
    first = F.lit(start).cast(edges.schema["src"].dataType)
    step = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    front = scratch.keep(edges.sparkSession.range(1).select(first.alias("id"), F.lit(0).alias("hops"), F.array(first).alias("path")))
    seen = front
    for h in range(1, most + 1):
        met = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), F.concat("path", F.array("dst")).alias("path"))
        least = met.groupBy(F.col("to").alias("id")).agg(F.min("path").alias("path")).select("id", F.lit(h).alias("hops"), "path")
        front = scratch.keep(least.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def callers(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("edge_type") == "calls") & (F.col("dst") == node)).select(F.col("src").alias("id")).distinct()


def callees(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("edge_type") == "calls") & (F.col("src") == node)).select(F.col("dst").alias("id")).distinct()


def call_chain(edges: DataFrame, node, depth: int = 3, per_level: int = 100, most: int = 500) -> DataFrame:
    """(id, level, truncated): callers of callers, at most per_level a level and most in all: a report, cut by definition.

    truncated says whether the report leaves any out.
    """
    back = edges.filter(F.col("edge_type") == "calls").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    found = hops_directed(back, node, depth).filter("hops > 0")
    total = found.agg(F.count("*").alias("_all"))
    rank = F.row_number().over(Window.partitionBy("hops").orderBy("id"))
    some = found.withColumn("_r", rank).filter(F.col("_r") <= per_level).orderBy("hops", "id").limit(most)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # most rows at most
    return some.withColumn("_n", n).join(total).select("id", F.col("hops").alias("level"), (F.col("_n") < F.col("_all")).alias("truncated"))


def hops_directed(edges: DataFrame, start, most: int) -> DataFrame:
    return shortest_paths(edges, start, most).select("id", "hops")


def parent_path(nodes: DataFrame, most: int = 6, id_: str = "id", parent: str = "parent") -> DataFrame:
    """(id, depth, path): the chain of first parents up to a root, a missing parent, a cycle or the cap."""
    up = nodes.select(F.col(id_).alias("_id"), F.col(parent).alias("_up"))
    out = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("_at"), F.array(id_).alias("path"))
    for _ in range(most):
        more = F.col("_id").isNotNull() & ~F.array_contains("path", F.col("_id"))
        out = out.join(up, F.col("_at") == F.col("_id"), "left").select("id", F.when(more, F.col("_up")).alias("_at"), F.when(more, F.concat("path", F.array("_id"))).otherwise(F.col("path")).alias("path"))
    return out.select("id", (F.size("path") - 1).alias("depth"), "path")


def depths(links: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """links(id, parent) with any number of parents -> (id, depth): one over the deepest parent, at most the cap."""
    step = links.select("id", "parent").distinct().withColumn("_step", F.lit(1)).unionByName(nodes.select("id", F.col("id").alias("parent"), F.lit(0).alias("_step")).distinct())
    d = nodes.select(F.col("id").alias("parent"), F.lit(0).alias("depth")).distinct()
    for h in range(1, most + 1):
        # only a parent at depth h - 1 lifts its children to h
        up = F.when(F.col("_step") == 0, F.col("depth")).when(F.col("depth") == h - 1, F.lit(h)).otherwise(F.lit(0))
        d = d.join(step, "parent").groupBy("id").agg(F.max(up).alias("depth")).withColumnRenamed("id", "parent")
    return d.withColumnRenamed("parent", "id")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def surprising(edges: DataFrame, community: DataFrame, top: int = 15) -> DataFrame:
    """Edges between communities, extracted ones first."""
    a, b = (community.select(F.col("id").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    score = F.when(F.col("origin") == "EXTRACTED", 3).otherwise(1)
    return edges.join(a, "src").join(b, "dst").filter("c_src <> c_dst").withColumn("score", score).orderBy(F.desc("score"), "src", "dst").limit(top)


#: Edges that a task of label propagation counts labels over, about.
TASK_EDGES = 1 << 20


def label_propagation(edges: DataFrame, rounds: int = 5, least: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(id, community): in each round a node takes the commonest label around it, the smallest on ties. Labels are written between rounds.

    Edges go by node to as many tasks as they need before anything is counted, so a task's tables are as large over any number of edges.
    community.louvain() is the one that maximises modularity.
    """
    scratch = scratch or Scratch(edges.sparkSession, "labels")
    given = scratch.keep(edges.select("src", "dst"))
    tasks = 2 * given.count() // TASK_EDGES + 1
    both = scratch.keep(symmetric(given).repartition(tasks, "src").distinct())
    label = both.select(F.col("src").alias("id")).repartition(tasks, "id").distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("id", "dst"), "dst").select("src", "community").repartition(tasks, "src").groupBy("src", "community").agg(F.count("*").alias("n"))
        label = scratch.keep(seen.groupBy("src").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")).withColumnRenamed("src", "id"))
    size = label.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return label.join(size.select("community"), "community", "left_semi").select("id", "community")


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(id, relation): both ways, incoming ones as inverse."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.col("edge_type").alias("relation"))
    inn = edges.filter(F.col("dst") == node).select(F.col("src").alias("id"), F.concat(F.lit("inverse_"), "edge_type").alias("relation"))
    return out.unionByName(inn).distinct()


def symbol_search(symbols: DataFrame, words: str, top: int = 20) -> DataFrame:
    w = words.lower()
    return symbols.filter(F.lower("label").contains(w) | F.lower("file").contains(w)).orderBy("label", "file").limit(top)


def file_context(symbols: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """One row: symbols of a file by line (8), files it imports (5), files that depend on it (5)."""
    own = symbols.filter(F.col("file") == file).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("line", "label"))), lambda s: s["label"]), 1, 8).alias("symbols"))
    ties = edges.filter(F.col("edge_type") == "imports")
    uses = ties.filter(F.col("src") == file).agg(F.slice(F.sort_array(F.collect_set("dst")), 1, 5).alias("imports"))
    used = ties.filter(F.col("dst") == file).agg(F.slice(F.sort_array(F.collect_set("src")), 1, 5).alias("dependents"))
    return own.crossJoin(uses).crossJoin(used)


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and content hash are not known yet: what an incremental build has to read."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    return hashed.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).dropDuplicates(keys)


def explained(edges: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """(id, relation, label, community, degree): the neighbours of a node, what they are and how many edges they have.

    nodes(id, label, community); neighbours without a row have nulls.
    """
    near = neighbours(edges, node)
    ids = near.select("id").distinct()
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    return near.join(nodes.select("id", "label", "community"), "id", "left").join(degree, "id").select("id", "relation", "label", "community", "degree")


def node_links(nodes: DataFrame) -> DataFrame:
    """(source, target, kind) inside a set of nodes(id, label, content, parent_ids): parents, and labels in double brackets, each once."""
    ids = nodes.select(F.col("id").alias("target"))
    parents = nodes.select(F.col("id").alias("source"), F.explode("parent_ids").alias("target")).join(ids, "target", "left_semi").select("source", "target", F.lit("parent").alias("kind"))
    named = nodes.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("target"))
    said = nodes.select(F.col("id").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("label"))
    links = said.join(named, "label").filter("source <> target").select("source", "target", F.lit("link").alias("kind"))
    return parents.unionByName(links).distinct()
