"""Ranking: features, fusion, reciprocal ranks, reranking, gate, packing, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.text import clamp, word_token_estimate
from . import dense, lexical, store


def candidates(semantic: DataFrame, raw: DataFrame, pool: int, lexical_pool: int) -> DataFrame:
    """(id, semantic, bm25): the best of either leg, zero where a leg doesn't have the id.

    semantic(id, score) and raw(id, raw) are what dense and lexical searches give, raw by a scan of the texts or by an InvertedIndex.
    Both legs are cut to top lists of bounded length, so the outer join and what follows is small.
    """
    s = semantic.select("id", F.col("score").alias("semantic")).orderBy(F.desc("semantic"), "id").limit(pool)
    b = lexical.bm25_candidates(raw, s, pool, lexical_pool).select("id", F.col("score").alias("bm25"))
    zero = F.lit(0.0)
    return s.join(b, "id", "full_outer").select("id", F.coalesce("semantic", zero).alias("semantic"), F.coalesce("bm25", zero).alias("bm25"))


def features(found: DataFrame) -> DataFrame:
    """Adds f_semantic .. f_intent to candidates that carry the columns of their nodes."""
    cost = clamp(1 - F.least(F.coalesce(F.col("total_calls"), F.lit(5)) / 30, F.lit(1.0)), 0.0, 1.0) if "total_calls" in found.columns else F.lit(1 - 5 / 30)
    return found.withColumns({
        "f_semantic": clamp(F.col("semantic"), 0.0, 1.0),
        "f_bm25": clamp(F.col("bm25"), 0.0, 1.0),
        "f_quality": sc.quality_feature(F.col("type"), F.col("label"), F.col("importance"), F.col("usefulness"), F.col("access_count")),
        "f_confidence": clamp(F.coalesce("confidence", F.lit(0.5)), 0.0, 1.0),
        "f_usefulness": clamp(F.coalesce("usefulness", F.lit(0.0)) / 5, 0.0, 1.0),
        "f_cost": cost,
        "f_intent": F.col("affinity") if "affinity" in found.columns else F.lit(0.0),
    })


def linear_rank(found: DataFrame, limit: int, weights: dict[str, float] = sc.WEIGHTS, intent: str | None = None, subtask: str | None = None, levels: dict[int, float] | None = None) -> DataFrame:
    """Candidates by fused score times the weights of intent, subtask and level; ties by recency, then id."""
    fused = sc.linear_fusion({k: F.col(f"f_{k}") for k in weights}, weights)
    if intent is not None:
        fused = fused * sc.intent_weight(intent, F.col("category"), F.col("type"), F.col("supertype"))
    if subtask is not None and "subtask" in found.columns:
        fused = fused * sc.subtask_weight(subtask, F.col("subtask"))
    if levels:
        weight = F.when(F.lit(False), 1.0)
        for level, value in sorted(levels.items()):
            weight = weight.when(F.col("level") == level, value)
        fused = fused * weight.otherwise(1.0)
    fresh = F.when(F.col("level") >= 1, F.col("created_ms")).otherwise(F.coalesce("accessed_ms", "created_ms"))
    return features(found).withColumn("score", fused).orderBy(F.desc("score"), F.desc(fresh), "id").limit(limit)


def reciprocal_ranks(found: DataFrame, now_ms: int, k: int = 60, then: str = "accessed_ms") -> DataFrame:
    """Adds rrf and score to a bounded candidate list: ranks by either leg, scaled to 0..1, and recency.

    The windows have no partition: the list must be bounded, as candidates() makes it.
    """
    k = max(1, k)
    ranked = found.withColumns({
        "rank_semantic": F.row_number().over(Window.orderBy(F.desc("semantic"), "id")),
        "rank_bm25": F.row_number().over(Window.orderBy(F.desc("bm25"), "id")),
    })
    rrf = 1 / (k + F.col("rank_semantic")) + F.when(F.col("bm25") > 0, 1 / (k + F.col("rank_bm25"))).otherwise(0.0)
    ranked = ranked.withColumn("rrf", rrf)
    bounds = ranked.agg(F.min("rrf").alias("low"), F.max("rrf").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("rrf") - F.col("low")) / (F.col("high") - F.col("low")))
    return ranked.crossJoin(F.broadcast(bounds)).withColumn("score", scaled * (0.3 + 0.7 * sc.recency(F.col(then), now_ms))).drop("low", "high")


def keyword_rerank(pool: DataFrame, query: str, top: int, content: str = "content", label: str = "label", score: str = "importance") -> DataFrame:
    """0.7 of the given score and 0.3 of shared words, their density and the query in the first line. Adds `final`."""
    terms = sorted({t for t in query.lower().split() if len(t) > 2})
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    words = F.array_distinct(F.split(low, r"\s+"))
    name = F.lower(F.coalesce(F.col(label), F.lit("")))
    hits = sum((F.array_contains("_w", t).cast("double") + F.when(name.contains(t), 0.5).otherwise(0.0) for t in terms), F.lit(0.0))
    kw = F.least(F.lit(1.0), hits / float(max(1, len(terms))))
    place = F.when(F.substring_index(low, "\n", 1).contains(query.lower()), 0.3).otherwise(0.0)
    dense = F.least(F.lit(0.4), F.col("_k") * 100 / F.greatest(F.lit(1.0), word_token_estimate(F.col(content)) / 10) * 0.1)
    scored = pool.withColumn("_w", words).withColumn("_k", kw).withColumn("final", F.col(score) * 0.7 + (F.col("_k") * 0.4 + place + dense) * 0.3)
    return scored.drop("_w", "_k").orderBy(F.desc("final"), "id").limit(top)


def fallback_rerank(pool: DataFrame, words, query_words: list[str], score: str = "importance"):
    """0.7 of the given score and 0.3 of the query's words that a row has."""
    share = F.size(F.array_intersect(words, F.array(*map(F.lit, query_words)))) / float(max(1, len(set(query_words))))
    return pool.withColumn("final", 0.7 * F.col(score) + 0.3 * F.least(F.lit(1.0), share))


def gate(scored: DataFrame, type_: str = "type", score: str = "score") -> DataFrame:
    """Adds passed, uncertain and gated to one query's bounded list of candidates."""
    ordered = Window.orderBy(F.desc(score), "id")
    n = F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.row_number().over(ordered)
    marked = scored.withColumns({"passed": F.col(score) >= sc.gate_threshold(F.col(type_)), "_at": at, "_n": n})
    agg = marked.agg(F.max(score).alias("_top"), F.max(F.when(F.col("_at") == F.least("_n", F.lit(sc.GATE_TOP)), F.col(score))).alias("_low"), F.bool_or("passed").alias("_any"))
    out = marked.crossJoin(F.broadcast(agg))
    close = (F.col("_n") > 1) & (F.col("_top") - F.col("_low") < sc.GATE_DELTA)
    return out.withColumns({"uncertain": ~F.col("_any") | close, "gated": ~F.col("_any")}).drop("_at", "_n", "_top", "_low", "_any")


def pack(scored: DataFrame, budget: int, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """scored(id, score, cost): taken greedily by score into the budget; what doesn't fit is skipped, later rows still may.

    For a bounded candidate list (of each group). The walk is one fold over the ordered list in the JVM.
    """
    by = by or []
    item = F.struct((-F.col("score")).alias("k"), "id", F.col("cost").cast("long").alias("cost"))
    lists = scored.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{scored.schema['id'].dataType.simpleString()}>").alias("ids"))
    fits = lambda s, x: (s["used"] + x["cost"] <= budget) & (F.size(s["ids"]) < (most if most is not None else 1 << 30))
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s)
    walked = lists.select(*by, F.aggregate("items", empty, step).alias("w"))
    return walked.select(*by, F.posexplode("w.ids").alias("place", "id"), F.col("w.used").alias("used"))


def band_preserving(scored: DataFrame, per_level: int, top: int) -> DataFrame:
    """At most so many of each level, then the best of those."""
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "id"))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= per_level).drop("_r").orderBy(F.desc("score"), "id").limit(top)


def first_band(bands: list[DataFrame], limit: int) -> DataFrame:
    """Bounded lists (id, score) in order of preference: an id keeps the score of the first list that has it."""
    out = None
    for i, b in enumerate(bands):
        b = b.select("id", "score", F.lit(i).alias("band"))
        out = b if out is None else out.unionByName(b)
    first = out.groupBy("id").agg(F.min_by("score", "band").alias("score"), F.min("band").alias("band"))
    return first.orderBy(F.desc("score"), "id").limit(limit)


def expand_by_links(found: DataFrame, links: DataFrame, limit: int, factor: float = 0.8, more: int = 5) -> DataFrame:
    """found(id, score) and the nodes they link to at a factor of the score; the best limit + more, once each."""
    added = found.join(links.filter("target_id IS NOT NULL").withColumnRenamed("source_id", "id"), "id").select(F.col("target_id").alias("id"), (F.col("score") * factor).alias("score"))
    both = found.select("id", "score").unionByName(added).groupBy("id").agg(F.max("score").alias("score"))
    return both.orderBy(F.desc("score"), "id").limit(limit + more)


def search(nodes: DataFrame, query: str, mode: str = "hybrid", limit: int = 10, now_ms: int = 0, vector=None, vec: str = "embedding", rrf_k: int | None = None, **options) -> DataFrame:
    """The three modes over nodes that are alive and searchable. hybrid without a vector is bm25."""
    pool = nodes.filter(store.alive(now_ms) & store.searchable())
    if mode == "text":
        return lexical.text_search(pool, query, limit)
    if mode == "bm25" or vector is None:
        return lexical.bm25_topk(pool, "id", F.col("content"), query, limit).join(pool, "id").orderBy(F.desc("score"), "id")
    near = dense.knn(pool.filter(F.col(vec).isNotNull()), "id", vec, vector, 5 * limit)
    both = candidates(near, lexical.bm25_raw(pool, "id", F.col("content"), query), 5 * limit, 3 * limit).join(pool, "id")
    if rrf_k is not None:
        return reciprocal_ranks(both, now_ms, rrf_k).orderBy(F.desc("score"), "id").limit(limit)
    return linear_rank(both, limit, **options)


#: From which pressure (percent) rules need what score, and which kinds go.
RULE_SCORES = ((95, 0.50), (85, 0.30), (75, 0.20))
RULE_LEAST, STANDARD_UNTIL, SUGGESTIONS_UNTIL = 0.15, 85, 75


def applicable_rules(rules: DataFrame, words: list[str], pressure: float) -> DataFrame:
    """rules(label, content, type) -> label, type, score of those to show at a pressure of the context window.

    Scores are shared words with the message (all one without words). Mandatory rules and those marked never to be left out
    always stay; the others by kind and score. Of rules of one label one counts.
    """
    from ..functions.text import ochiai, tokens

    once = rules.groupBy("label").agg(F.min_by(F.struct("content", "type"), F.struct("type", "content")).alias("r")).select("label", "r.*")
    score = ochiai(tokens(F.col("content"), 3), F.array(*map(F.lit, sorted(set(words))))) if words else F.lit(1.0)
    scored = once.filter(F.col("type").isin("mandatory", "standard", "suggestion", "info")).withColumn("score", score)
    least = max([RULE_LEAST, *[v for p, v in RULE_SCORES if pressure >= p]])
    kind = ((F.col("type") == "standard") & F.lit(pressure < STANDARD_UNTIL)) | (F.col("type").isin("suggestion", "info") & F.lit(pressure < SUGGESTIONS_UNTIL))
    always = (F.col("type") == "mandatory") | F.col("content").contains("never_strip: true")
    return scored.filter(always | (kind & (F.col("score") >= least))).select("label", "type", "score")
