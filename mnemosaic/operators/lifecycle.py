"""Lifecycle: supersession, expiry, pruning, decay, verification, rating. Each returns rows; none changes a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.text import clamp

#: Fixed values.
SUPERSEDING = ("fact", "decision", "knowledge", "convention", "lesson")
PROTECTED = ("skill", "lesson", "rule", "playbook")
CORE_LABELS = ("persona", "human", "current-state", "project")


def superseded(nodes: DataFrame, tags: str = "tags") -> DataFrame:
    """(id, superseded_by): nodes that a later one of a superseding type with equal label and scope replaces.

    Their tags must share one or both be null. The earliest such later node counts. Each tag (or none) has its rows in one
    order of time, newest first, and a row takes the last superseding one before it: rows are not paired.
    """
    tag = F.explode(F.when(F.col(tags).isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(tags))).alias("_tag")
    rows = nodes.filter("label IS NOT NULL").select("label", "scope", "id", "created_ms", "type", F.coalesce("status", F.lit("active")).alias("_s"), F.col(tags).isNull().alias("_none"), tag)
    by = F.when(F.col("type").isin(*SUPERSEDING), F.struct(F.col("created_ms").alias("at"), F.col("id").alias("by")))
    w = Window.partitionBy("label", "scope", "_none", "_tag").orderBy(F.desc("created_ms"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_by", F.last(by, ignorenulls=True).over(w)).filter("_s = 'active' AND _by IS NOT NULL")
    return found.groupBy("id").agg(F.min("_by").alias("m")).select("id", F.col("m.by").alias("superseded_by"))


def latest_by_key(rows: DataFrame, key, order: str, id_: str) -> DataFrame:
    """(id, kept_id): each row and the newest row of its key, without a window over a whole key group."""
    keyed = rows.select(F.col(id_).alias("id"), key.alias("_k"), F.col(order).alias("_o"))
    newest = keyed.groupBy("_k").agg(F.max(F.struct("_o", "id")).alias("m")).select("_k", F.col("m.id").alias("kept_id"))
    return keyed.join(newest, "_k").select("id", "kept_id")


def expired(nodes: DataFrame, now_ms: int) -> DataFrame:
    return nodes.filter((F.col("expires_ms") <= now_ms) & (F.coalesce("type", F.lit("")) != "skill"))


def without_expired(nodes: DataFrame, now_ms: int) -> DataFrame:
    gone = F.coalesce(F.col("expires_ms") <= now_ms, F.lit(False)) & (F.coalesce("type", F.lit("")) != "skill")
    return nodes.filter(~gone)


def prunable(nodes: DataFrame, now_ms: int, min_access: int = 0, max_age_days: int = 90, min_importance: float = 0.0, exclude_sticky: bool = True, exclude_core: bool = True) -> DataFrame:
    """Unimportant nodes that are little used or stale. The defaults match none, as importance is never below zero."""
    out = nodes
    if exclude_sticky:
        out = out.filter(~F.coalesce("sticky", F.lit(False)))
    if exclude_core:
        out = out.filter(~F.coalesce(F.col("label").isin(*CORE_LABELS), F.lit(False)))
    stale = F.col("updated_ms") < now_ms - max_age_days * sc.DAY_MS
    return out.filter((F.col("importance") < 0.9) & (F.col("importance") < min_importance) & ((F.col("access_count") <= min_access) | stale))


def decayed(nodes: DataFrame, now_ms: int, decay_days: int = 30) -> DataFrame:
    """All rows; usefulness of those long untouched halves by the half-life of their category, to 0.1 at least."""
    last = F.coalesce("accessed_ms", "updated_ms")
    due = (last < now_ms - decay_days * sc.DAY_MS) & (F.col("usefulness") > 0.1) & ~F.coalesce(F.col("type").isin(*PROTECTED), F.lit(False))
    return nodes.withColumns({"decayed": due, "usefulness": F.when(due, sc.decayed_usefulness(F.col("usefulness"), F.col("category"), last, now_ms, decay_days)).otherwise(F.col("usefulness"))})


def confidence(nodes: DataFrame, now_ms: int) -> DataFrame:
    return nodes.withColumn("confidence", sc.decayed_confidence(F.col("confidence"), F.col("type"), F.col("updated_ms"), F.col("verified_ms"), now_ms))


def _bumped(nodes: DataFrame, ids: DataFrame, changes: dict) -> DataFrame:
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumns({c: F.when(F.col("_hit"), e).otherwise(F.col(c)) for c, e in changes.items()}).select(*nodes.columns)


def accessed(nodes: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    return _bumped(nodes, ids, {"access_count": F.col("access_count") + 1, "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.01), "accessed_ms": F.lit(now_ms)})


def verified(nodes: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    gain = 0.2 / (1 + F.coalesce("verification_count", F.lit(0)))
    return _bumped(nodes, ids, {"confidence": F.least(F.lit(1.0), F.col("confidence") + gain), "verification_count": F.coalesce("verification_count", F.lit(0)) + 1, "verified_ms": F.lit(now_ms)})


def rated(nodes: DataFrame, votes: DataFrame) -> DataFrame:
    """votes(id, helpful): helpful counts a use as helpful; unhelpful lowers usefulness by a half, to zero at least."""
    v = votes.groupBy("id").agg(F.count_if("helpful").alias("_up"), F.count_if(~F.col("helpful")).alias("_down"))
    out = nodes.join(v, "id", "left").withColumns({
        "times_helpful": F.coalesce("times_helpful", F.lit(0)) + F.coalesce("_up", F.lit(0)).cast("int"),
        "usefulness": F.when(F.col("_down") > 0, F.greatest(F.lit(0.0), F.col("usefulness") - 0.5 * F.col("_down"))).otherwise(F.col("usefulness")),
    })
    return out.select(*nodes.columns)


def judged(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """used(id, was_used, was_helpful, idle_turns): used adds 0.5, helpful use 1; ignored for three turns takes 0.25."""
    step = F.when(F.col("was_used") & F.col("was_helpful"), 1.0).when(F.col("was_used"), 0.5).when(F.col("idle_turns") >= 3, -0.25).otherwise(0.0)
    s = used.groupBy("id").agg(F.sum(step).alias("_step"))
    return nodes.join(s, "id", "left").withColumn("usefulness", clamp(F.col("usefulness") + F.coalesce("_step", F.lit(0.0)), 0.0, 5.0)).select(*nodes.columns)


def sweep(nodes: DataFrame, now_ms: int, most_deleted: int = 20) -> DataFrame:
    """(id, action, usefulness): raised, lowered, or deleted after thirty unused days, the least important first."""
    ratio = F.col("times_helpful") / F.greatest(F.col("times_used"), F.lit(1))
    act = F.when((ratio > 0.8) & (F.col("times_used") > 10), "raise").when((ratio < 0.15) & (F.col("times_used") > 20), "lower").when((F.col("times_used") == 0) & (F.coalesce("accessed_ms", "created_ms") < now_ms - 30 * sc.DAY_MS), "delete")
    marked = nodes.withColumn("action", act).filter("action IS NOT NULL")
    gone = marked.filter("action = 'delete'").orderBy("importance", "id").limit(most_deleted)
    new = F.when(F.col("action") == "raise", F.least(F.lit(5.0), F.col("usefulness") + 0.1)).when(F.col("action") == "lower", F.greatest(F.lit(0.0), F.col("usefulness") - 0.05)).otherwise(F.col("usefulness"))
    return marked.filter("action <> 'delete'").unionByName(gone).select("id", "action", new.alias("usefulness"))


def compression_candidates(nodes: DataFrame, level: int, now_ms: int) -> DataFrame:
    """Nodes of a level old enough to be summarised, long and not sticky, most important first."""
    days = {0: 7, 1: 30, 2: 90, 3: 365}[level]
    return nodes.filter((F.col("level") == level) & (F.col("created_ms") <= now_ms - days * sc.DAY_MS) & (F.length("content") > 100) & ~F.coalesce("sticky", F.lit(False))).orderBy(F.desc("importance"), "id")


def predicted(nodes: DataFrame, calls: DataFrame, boost: float = 0.1, penalty: float = 0.1) -> DataFrame:
    """calls(id, tool, success, helpful): usefulness after calls that name a node, between 0 and 5.

    A rating that says helpful adds, and counts; one that says not helpful takes, if the call succeeded. Other calls add when they succeed, else take.
    """
    rated, helpful = F.col("tool") == "rate", F.coalesce(F.col("helpful"), F.lit(False))
    step = F.when(rated & helpful, boost).when(rated & F.col("success") & F.col("helpful").isNotNull(), -penalty).when(rated, 0.0).when(F.col("success"), boost).otherwise(-penalty)
    s = calls.groupBy("id").agg(F.sum(step).alias("_step"), F.count_if(rated & helpful).alias("_up"))
    out = nodes.join(s, "id", "left")
    changed = {"usefulness": clamp(F.coalesce("usefulness", F.lit(0.0)) + F.coalesce("_step", F.lit(0.0)), 0.0, 5.0), "times_helpful": (F.coalesce("times_helpful", F.lit(0)) + F.coalesce("_up", F.lit(0))).cast("int")}
    return out.withColumns({c: e for c, e in changed.items() if c in nodes.columns}).select(*nodes.columns)
