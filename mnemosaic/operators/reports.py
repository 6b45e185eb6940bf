"""Reports that put single operators together: context use, tool statistics, archives, reflection, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_dump
from ..functions.text import char_token_estimate

#: A model's window, the share of it that is too much, and the most characters of a node that count.
WINDOW_TOKENS, TOO_MUCH, MOST_CHARS = 128_000, 0.8, 200_000


def bounded_tokens(content: Column) -> Column:
    return char_token_estimate(F.substring(content, 1, MOST_CHARS))


def context_check(nodes: DataFrame, window: int = WINDOW_TOKENS) -> DataFrame:
    """(level, nodes, tokens, share, over) by level and, with a null level, in all; transcript dumps left out."""
    kept = nodes.filter(~is_dump(F.col("type"), F.col("label"))).select("level", bounded_tokens(F.col("content")).alias("t"))
    sums = kept.rollup("level").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / window).withColumn("over", F.col("share") > TOO_MUCH)


def store_overview(nodes: DataFrame, embedded: str | None = None) -> DataFrame:
    """One row: nodes, characters, types, share with a vector, mean importance."""
    has = F.avg(F.col(embedded).isNotNull().cast("double")) if embedded else F.lit(0.0)
    return nodes.agg(F.count("*").alias("nodes"), F.sum(F.length("content")).cast("long").alias("chars"), F.count_distinct("type").alias("types"), has.alias("embedded"), F.avg("importance").alias("importance"))


def most(nodes: DataFrame, by: str, top: int = 5) -> DataFrame:
    return nodes.orderBy(F.desc(by), "id").limit(top).select("id", "label", by)


def tool_extremes(log: DataFrame, tool: str = "tool", duration: str = "duration_ms", tokens: str = "tokens") -> DataFrame:
    """Per tool: calls, slowest and heaviest call, failures, and whether more than a fifth fail."""
    stats = log.groupBy(F.col(tool).alias("tool")).agg(
        F.count("*").alias("calls"),
        F.max_by("id", F.struct(duration, -F.col("id"))).alias("slowest"),
        F.max_by("id", F.struct(tokens, -F.col("id"))).alias("heaviest"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    return stats.withColumn("failing", F.col("failed") > 0.2 * F.col("calls"))


def costly_messages(messages: DataFrame, text: str, tokens: str | None = None, contains: str = "", least: int = 0, top: int = 50) -> DataFrame:
    """Messages by tokens, counted or estimated, that contain a string; fifty at most."""
    estimate = char_token_estimate(F.coalesce(F.col(text), F.lit("")))
    cost = F.coalesce(F.col(tokens), estimate) if tokens else estimate
    out = messages.withColumn("cost", cost.cast("long")).filter(F.col("cost") >= least)
    if contains:
        out = out.filter(F.lower(text).contains(contains.lower()))
    return out.orderBy(F.desc("cost"), "id").limit(min(50, top))


def archived(nodes: DataFrame, session: str | None = None, words: str | None = None, top: int = 10) -> DataFrame:
    """Archived context: of a session (by label or metadata), with words in it, or the newest. Dumps are what is wanted here."""
    out = nodes.filter(F.col("type").isin("contexthistory", "storedcontext"))
    if session is not None:
        meta = F.coalesce(F.get_json_object("metadata", "$.sessionId") == session, F.lit(False)) if "metadata" in nodes.columns else F.lit(False)
        out = out.filter(F.col("label").contains(session) | meta)
    if words:
        out = out.filter(F.lower("content").contains(words.lower()))
    return out.orderBy(F.desc("created_ms"), "id").limit(top)


def snapshots(nodes: DataFrame, top: int = 20) -> DataFrame:
    """Middle-term snapshots with their session: from the JSON content, else from the label."""
    inside = F.try_variant_get(F.try_parse_json("content"), "$.sessionId", "string")
    named = F.regexp_extract("label", r"^middle-term:(.+)$", 1)
    return nodes.filter(F.col("label").startswith("middle-term:")).select("id", "label", F.coalesce(inside, named).alias("session_id"), "created_ms").orderBy(F.desc("created_ms"), "id").limit(top)


def reflect(calls: DataFrame, advice: dict[str, str], least: int = 2) -> DataFrame:
    """(kind, key, failures, advice): tools and files that failed often."""
    bad = calls.filter(~F.col("success"))
    rows = bad.select(F.explode(F.array(F.struct(F.lit("tool").alias("kind"), F.col("tool").alias("key")), F.struct(F.lit("file").alias("kind"), F.col("file").alias("key")))).alias("r")).select("r.*")
    text = F.when(F.lit(False), "")
    for key, what in sorted(advice.items()):
        text = text.when((F.col("kind") == "tool") & (F.col("key") == key), what)
    return rows.filter("key IS NOT NULL").groupBy("kind", "key").agg(F.count("*").alias("failures")).filter(F.col("failures") >= least).withColumn("advice", text.when(F.col("kind") == "file", "read the file again before it is changed").otherwise("look at the last failures of this tool"))


def liveness(registry: DataFrame, live: DataFrame) -> DataFrame:
    """registry(id, message_id, state): entries whose message is gone become compacted."""
    alive = live.select("message_id").distinct().withColumn("_live", F.lit(True))
    gone = F.col("_live").isNull() & (F.col("state") == "archived")
    return registry.join(alive, "message_id", "left").withColumn("state", F.when(gone, "compacted").otherwise(F.col("state"))).select(*registry.columns)


def message_sizes(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """messages(id, parts array<struct<kind, text>>) -> (id, kind, chars, tokens)."""
    one = messages.select("id", F.explode(parts).alias("p")).select("id", "p.kind", F.length("p.text").alias("n"))
    return one.groupBy("id", "kind").agg(F.sum("n").cast("long").alias("chars"), F.sum(F.ceil(F.col("n") / 4)).cast("long").alias("tokens"))


def unseen(found: DataFrame, seen: DataFrame, least: float, excluded: tuple[str, ...] = ("research",)) -> DataFrame:
    """Rows to inject: not shown yet, not of excluded types, important enough."""
    return found.filter((F.col("importance") >= least) & ~F.coalesce(F.col("type").isin(*excluded), F.lit(False))).join(seen.select("id").distinct(), "id", "left_anti")


def inject_size(history: DataFrame, base: int, ts: str = "ts") -> DataFrame:
    """One row (size): fewer the better the last twenty injections did; two to ten."""
    keys = [F.desc(ts), *[F.desc(c) for c in history.columns if c == "id"]]
    last = history.orderBy(*keys, "success").limit(20).agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.5)).alias("rate"))
    return last.select(F.greatest(F.lit(2), F.least(F.lit(10), F.floor(base * (1.2 - 0.5 * F.col("rate")) + 0.5).cast("int"))).alias("size"))


#: Columns that a node shows to callers, with what stands for a null.
SHOWN = {
    "id": None, "label": "", "content": None, "summary": None, "level": None, "type": None, "supertype": None, "domain": None, "tags": None, "source": None,
    "importance": None, "usefulness": None, "times_used": None, "times_helpful": None, "access_count": None, "sticky": False, "confidence": None,
    "verification_count": 0, "created_ms": None, "updated_ms": None, "accessed_ms": None, "parent_ids": None, "metadata": None, "project": None,
    "derived_from": None, "status": "active",
}


def shown(nodes: DataFrame) -> DataFrame:
    """Nodes as callers get them: the shown columns that there are, nulls of some replaced, metadata parsed."""
    one = lambda c, other: F.coalesce(c, F.lit(other)).alias(c) if other is not None else F.try_parse_json(c).alias(c) if c == "metadata" else F.col(c)
    return nodes.select(*[one(c, other) for c, other in SHOWN.items() if c in nodes.columns])


def hub_network(nodes: DataFrame, hub: str, most: int = 15) -> DataFrame:
    """(id, label, children): nodes whose parents name a hub by id or label, the first fifteen by label; children counts all."""
    hubs = nodes.filter(F.col("label") == hub).select(F.explode(F.array(F.col("id").cast("string"), "label")).alias("_hub"))
    found = nodes.select("id", "label", F.explode("parent_ids").alias("_hub")).join(F.broadcast(hubs), "_hub").select("id", "label").distinct()
    n = found.agg(F.count("*").alias("children"))
    return found.orderBy("label", "id").limit(most).join(n)
