"""Scores of nodes as expressions. Times are epoch milliseconds and `now` is always given, never read from a clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp, js_round

DAY_MS = 86_400_000

#: Fixed values of the ranking model.
WEIGHTS = {"semantic": 0.45, "bm25": 0.22, "quality": 0.13, "confidence": 0.05, "usefulness": 0.05, "cost": 0.10, "intent": 0.0}
GATES = {"rule": 0.5, "fact": 0.4, "howto": 0.4, "concept": 0.35, "note": 0.2, "event": 0.15}
GATE_DEFAULT, GATE_DELTA, GATE_TOP = 0.3, 0.15, 5
#: Label prefixes and types that raise the quality of a node.
PREFIXES = (
    (1.3, ("lesson:", "decision:", "convention:", "fact:", "workflow:")),
    (1.25, ("knowledge:", "rule:", "skill:", "dot:")),
    (1.1, ("plan:", "task:")),
)
DUMP_TYPES, DUMP_LABELS = ("storedcontext", "contexthistory"), ("middle-term:", "[history]")


def is_dump(type_: Column, label: Column) -> Column:
    name = F.coalesce(label, F.lit(""))
    return F.coalesce(type_.isin(*DUMP_TYPES), F.lit(False)) | reduce(lambda a, b: a | b, [name.startswith(p) for p in DUMP_LABELS])


def recency(then_ms: Column, now_ms: int) -> Column:
    """One for null, else halving with a scale of a day."""
    return F.when(then_ms.isNull(), F.lit(1.0)).otherwise(F.exp(-(F.lit(now_ms) - then_ms) / 3_600_000.0 / 24.0))


def quality_multiplier(type_: Column, label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.when(is_dump(type_, label), F.when(type_.isin(*DUMP_TYPES), 0.5).otherwise(0.6))
    for value, starts in PREFIXES:
        out = out.when(reduce(lambda a, b: a | b, [low.startswith(s) for s in starts]), value)
    return out.when(type_.isin("skill", "playbook", "core"), 1.15).otherwise(1.0)


def adaptive_multiplier(importance: Column, usefulness: Column, access: Column) -> Column:
    base = clamp(F.coalesce(importance, F.lit(0.5)), 0.0, 1.0) / 0.5
    return clamp(base * (1 + F.coalesce(usefulness, F.lit(0.0)) / 5) / (1 + F.coalesce(access, F.lit(0)) / 5), 0.4, 1.5)


def quality_feature(type_: Column, label: Column, importance: Column, usefulness: Column, access: Column) -> Column:
    plain = clamp((quality_multiplier(type_, label) - 0.5) / (1.3 - 0.5), 0.0, 1.0)
    return clamp(plain * adaptive_multiplier(importance, usefulness, access), 0.0, 1.0)


def intent_affinity(vector: Column, intent: str) -> Column:
    """Share of a map of counts that one intent has."""
    total = F.aggregate(F.map_values(vector), F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = F.coalesce(F.try_element_at(vector, F.lit(intent)).cast("double"), F.lit(0.0)) / total
    return F.when(vector.isNull() | (total <= 0), F.lit(0.0)).otherwise(clamp(share, 0.0, 1.0))


def linear_fusion(features: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the features, in absolute terms: never scaled to the query."""
    total = sum(weights.values())
    return clamp(reduce(lambda a, b: a + b, [features[k] * w for k, w in weights.items()]) / total, 0.0, 1.0)


def intent_weight(intent: str | None, category: Column, type_: Column, supertype: Column) -> Column:
    """How an intent of reading, editing, debugging or discovery weighs a node."""
    #: Types that serve an intent best.
    served = {"read": ("knowledge", "concept", "architecture"), "edit": ("convention", "decision", "preference"), "debug": ("lesson", "bug", "fix", "debug-investigation")}
    out = F.when(F.coalesce(type_.isin(*served[intent]), F.lit(False)), 1.4) if intent in served else F.when(F.lit(False), 1.0)
    made, lived = F.coalesce(supertype.isin("procedural", "declarative"), F.lit(False)), F.coalesce(supertype == "experiential", F.lit(False))
    episodic = F.coalesce(category == "episodic", F.lit(False))
    if intent in ("read", "edit"):
        return out.when(supertype.isNotNull(), F.when(made, 1.3).when(lived, 0.6).otherwise(1.0)).otherwise(F.when(episodic, 0.6).otherwise(1.2))
    if intent == "debug":
        return out.when(supertype.isNotNull(), F.when(lived, 1.3).when(made, 0.8).otherwise(1.0)).otherwise(F.when(episodic, 1.2).otherwise(0.8))
    if intent == "discovery":
        return F.lit(1.0)
    return out.when(supertype.isNotNull(), F.when(lived, 0.5).otherwise(1.0)).otherwise(F.when(episodic, 0.5).otherwise(1.0))


def subtask_weight(wanted: str | None, subtask: Column) -> Column:
    return F.when(F.coalesce(subtask == F.lit(wanted), F.lit(False)), 1.3).otherwise(1.0)


def gate_threshold(type_: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, value in GATES.items():
        out = out.when(type_ == name, value)
    return out.otherwise(GATE_DEFAULT)


def decayed_usefulness(usefulness: Column, category: Column, last_ms: Column, now_ms: int, decay_days: float) -> Column:
    half = F.when(category == "episodic", 7.0 * DAY_MS).when(category == "semantic", 365.0 * DAY_MS).otherwise(decay_days * DAY_MS)
    return F.greatest(F.lit(0.1), usefulness * F.pow(F.lit(0.5), (F.lit(now_ms) - last_ms) / half))


def decayed_confidence(confidence: Column, type_: Column, updated_ms: Column, verified_ms: Column, now_ms: int) -> Column:
    aged = confidence * F.exp(-(F.lit(now_ms) - updated_ms) / float(DAY_MS) / 365)
    bonus = F.when(verified_ms.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 0.1 - (F.lit(now_ms) - verified_ms) / (DAY_MS * 30.0)))
    return F.when(type_ == "skill", confidence).otherwise(js_round(clamp(aged + bonus, 0.0, 1.0) * 100) / 100)


def hybrid_score(cosine: Column, importance: Column, confidence: Column, updated_ms: Column, now_ms: int, shared: Column, terms: int) -> Column:
    """The scorer that packing uses: similarity, importance, confidence, a boost for recent and for shared words."""
    age = (F.lit(now_ms) - updated_ms) / float(DAY_MS)
    recent = F.when(age < 1, 0.1).when(age < 7, 0.05).otherwise(0.0)
    words = F.least(F.lit(0.15), shared / float(max(1, terms)) * 0.15)
    return 0.5 * cosine + 0.3 * F.coalesce(importance, F.lit(0.5)) + 0.2 * F.coalesce(confidence, F.lit(0.5)) + recent + words
