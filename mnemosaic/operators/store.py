"""The node store: listings, lookups and changes. Changes return the new table; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scoring import is_dump


def alive(now_ms: int, expires: str = "expires_ms") -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now_ms)


def current() -> Column:
    return F.coalesce(F.col("status"), F.lit("active")) != "superseded"


def searchable() -> Column:
    """No transcript dumps and nothing superseded."""
    return ~is_dump(F.col("type"), F.col("label")) & current()


def filtered(nodes: DataFrame, *, types=None, categories=None, domains=None, min_level=None, max_level=None, scope=None, project=None, tags=None, tags_text=None) -> DataFrame:
    """A conjunction of filters. tags: each is an element; tags_text: each is part of the text of the tags."""
    out = nodes
    for column, wanted in (("type", types), ("category", categories), ("domain", domains)):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    if min_level is not None:
        out = out.filter(F.col("level") >= min_level)
    if max_level is not None:
        out = out.filter(F.col("level") <= max_level)
    if scope and scope != "all":
        out = out.filter(F.col("scope") == scope)
    if project:
        out = out.filter(F.col("project") == project)
    if tags:
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    for t in tags_text or ():
        out = out.filter(F.to_json("tags").contains(t))
    return out


def list_nodes(nodes: DataFrame, now_ms: int, limit: int = 50, offset: int = 0, include_expired: bool = False, **filters) -> DataFrame:
    """A page by importance, then age, then id."""
    out = filtered(nodes, **filters).filter(current())
    if not include_expired:
        out = out.filter(alive(now_ms))
    return out.orderBy(F.desc("importance"), F.desc("created_ms"), "id").offset(offset).limit(limit)


def distinct_projects(nodes: DataFrame) -> DataFrame:
    return nodes.filter("project IS NOT NULL").select("project").distinct().orderBy(F.lower("project"), "project")


def by_label(nodes: DataFrame, label: str, now_ms: int, include_expired: bool = False) -> DataFrame:
    out = nodes.filter(F.col("label") == label)
    return (out if include_expired else out.filter(alive(now_ms))).orderBy("id").limit(1)


def by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """The one node whose id starts so; an error if there are several."""
    out = nodes.filter(F.col("id").cast("string").startswith(prefix)).limit(2)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # two rows at most
    clear = F.when(n > 1, F.raise_error(F.lit(f"several ids start with {prefix}"))).otherwise(F.lit(True))
    return out.withColumn("_clear", clear.cast("boolean")).filter("_clear").drop("_clear")


def label_suggestions(nodes: DataFrame, label: str, scope: str | None = None, least: float = 0.25, top: int = 3) -> DataFrame:
    """Labels like the given one by trigrams, those of the preferred scope first."""
    like = tx.jaccard(tx.trigrams(F.lower("label")), tx.trigrams(F.lower(F.lit(label))))
    preferred = (F.col("scope") == F.lit(scope)).cast("int") if scope else F.lit(0)
    found = nodes.filter("label IS NOT NULL").groupBy("label").agg(F.max(preferred).alias("preferred")).withColumn("similarity", like)
    return found.filter(F.col("similarity") >= least).orderBy(F.desc("preferred"), F.desc("similarity"), "label").limit(top).select("label", "similarity")


def derived(new: DataFrame, now_ms: int) -> DataFrame:
    """New rows with what follows from them: classes, hash, summary, expiry of episodic ones, stickiness of skills, and the defaults."""
    from ..sources.nodes import with_classes

    new = with_classes(new) if "category" not in new.columns else new
    ttl = F.coalesce(F.col("expires_ms"), F.when(F.col("category") == "episodic", F.lit(now_ms + 30 * 86_400_000)))
    plain = {"status": "active", "confidence": 0.5, "access_count": 0, "level": 0, "importance": 0.5}
    known = {c: F.coalesce(c, F.lit(v)) for c, v in plain.items() if c in new.columns}
    return new.withColumns({
        **known,
        "expires_ms": ttl,
        "sticky": F.coalesce("sticky", F.lit(False)) | F.coalesce(F.col("type").isin("dot", "skill"), F.lit(False)),
        "summary": F.coalesce("summary", tx.auto_summary(F.col("content"))),
        "hash": tx.content_hash(F.coalesce("content", F.lit(""))),
        "created_ms": F.coalesce("created_ms", F.lit(now_ms)),
        "updated_ms": F.coalesce("updated_ms", F.lit(now_ms)),
    })


def insert(nodes: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """The nodes with the derived new rows, hash included."""
    return nodes.unionByName(derived(new, now_ms), allowMissingColumns=True)


def insertion(nodes: DataFrame, new: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """All that an insert changes: nodes (superseded ones marked), and the new rows' links (resolved where they can be) and postings."""
    from . import graph, lexical, lifecycle

    both = insert(nodes, new, now_ms)
    over = lifecycle.superseded(both).join(new.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi").select("id", F.lit("superseded").alias("_to"))
    marked = both.join(over, "id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")
    said = new.select(F.col("id").alias("source_id"), F.explode(tx.wiki_links(F.col("content"))).alias("target_label"))
    return {"nodes": marked, "links": graph.resolve_links(said, both), "postings": lexical.postings(new, "id", F.col("content"))}


def update(nodes: DataFrame, changes: DataFrame, now_ms: int, nulls: tuple[str, ...] = ()) -> DataFrame:
    """Overlay of the columns of changes: nulls leave a value as it is, but for the columns in nulls, which they clear.

    Of several rows of changes for an id the last by all their columns counts, so no node is multiplied.
    """
    cols = [c for c in changes.columns if c != "id"]
    one = changes.groupBy("id").agg(F.max(F.struct(*cols)).alias("_c"), F.lit(True).alias("_hit"))
    out = nodes.join(one, "id", "left")
    stamp = {"updated_ms": F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("updated_ms"))} if "updated_ms" in nodes.columns else {}
    new = {c: F.when(F.col("_hit"), F.col(f"_c.{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(f"_c.{c}", c) for c in cols}
    return out.withColumns({**new, **stamp}).select(*nodes.columns)


def reindexed(postings: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings with those of changed nodes made anew."""
    from . import lexical

    fresh = lexical.postings(nodes.join(ids.select("id").distinct(), "id", "left_semi"), "id", F.col("content"))
    return postings.join(ids.select("id").distinct(), "id", "left_anti").unionByName(fresh)


def upsert_by_label(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of equal scope and label; the others stay, and the rest of new is added."""
    cols = nodes.columns
    a, b = nodes.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.label") == F.col("b.label")), "full_outer")
    return both.select(*[(F.coalesce(f"a.{c}", f"b.{c}") if c == "id" else F.coalesce(f"b.{c}", f"a.{c}") if c in new.columns else F.col(f"a.{c}")).alias(c) for c in cols])


def delete(table: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys name none of the ids: nodes by id, edges by source and target, postings by node."""
    for k in keys:
        table = table.join(ids.select(F.col("id").alias(k)).distinct(), k, "left_anti")
    return table


def seed_absent(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    return nodes.unionByName(seeds.join(nodes.select("label", "scope"), ["label", "scope"], "left_anti"), allowMissingColumns=True)


def merge_absent(nodes: DataFrame, legacy: DataFrame) -> DataFrame:
    return nodes.unionByName(legacy.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def merge_store(tables: dict[str, DataFrame], legacy: dict[str, DataFrame], scope: str) -> dict[str, DataFrame]:
    """Two stores as one: nodes by id; links and postings of the legacy nodes that are new, under the scope given."""
    added = legacy["nodes"].join(tables["nodes"].select("id"), "id", "left_anti")
    out = {"nodes": tables["nodes"].unionByName(added.withColumn("scope", F.lit(scope)), allowMissingColumns=True)}
    for name, key in (("links", "source_id"), ("postings", "id")):
        if name in tables and name in legacy:
            out[name] = tables[name].unionByName(legacy[name].join(added.select(F.col("id").alias(key)), key, "left_semi"), allowMissingColumns=True).distinct()
    return out


def backfilled(nodes: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """What older stores lack, made anew for all rows: classes, summaries, hashes; links and postings."""
    from . import graph, lexical

    full = derived(nodes.drop("category", "supertype", "domain"), now_ms)
    said = full.select(F.col("id").alias("source_id"), F.explode(tx.wiki_links(F.col("content"))).alias("target_label"))
    return {"nodes": full, "links": graph.resolve_links(said, full), "postings": lexical.postings(full, "id", F.col("content"))}


def label_matches(nodes: DataFrame, part: str, top: int = 3) -> DataFrame:
    """Labels that contain a string, whatever the case, the first three."""
    return nodes.filter(F.lower("label").contains(part.lower())).select("label").distinct().orderBy("label").limit(top)
