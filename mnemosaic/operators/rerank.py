"""Fitted weights for the linear fusion, and a registry of rerankers with a chain of fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import hybrid


def preferences(lists: DataFrame, features: list[str], query: str = "query_id", chosen: str = "chosen") -> DataFrame:
    """lists(query, chosen, features) -> one row of differences for each chosen and not chosen row of a query's bounded list."""
    won = lists.filter(F.col(chosen)).select(query, *[F.col(f).alias(f"_{f}") for f in features])
    lost = lists.filter(~F.col(chosen)).select(query, *features)
    return won.join(lost, query).select(*[(F.col(f"_{f}") - F.col(f)).cast("double").alias(f) for f in features])


def fit_weights(pairs: DataFrame, features: list[str], l2: float = 1e-3, rounds: int = 25, tolerance: float = 1e-9) -> dict[str, float]:
    """Weights by pairwise logistic regression over rows of feature differences: Newton's steps on sums that Spark adds up.

    A round is one aggregation; what reaches the driver is a gradient and a matrix of so many features. Rows with a null are left
    out. Without rows all weights are zero. l2 is per row, so the fit doesn't depend on the number of rows.
    """
    k = len(features)
    rows = pairs.select(*features).dropna()
    w = np.zeros(k)
    n = rows.count()
    for _ in range(rounds if n else 0):
        z = F.lit(0.0)
        for f, x in zip(features, w.tolist()):
            z = z + F.col(f) * x
        p = 1 / (1 + F.exp(z))  # of the preference being the other way
        sums = [F.sum(F.col("_p") * F.col(f)) for f in features] + [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(features[i]) * F.col(features[j])) for i in range(k) for j in range(i, k)]
        got = np.array(rows.withColumn("_p", p).agg(*sums).first(), float) / n
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = got[k:]
        hessian = hessian + np.triu(hessian, 1).T + l2 * np.eye(k)
        step = np.linalg.solve(hessian, got[:k] - l2 * w)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(features, w.tolist()))


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights as linear_rank takes them: none below zero, one in sum. All equal if none is above zero."""
    kept = {f: max(0.0, w) for f, w in weights.items()}
    total = sum(kept.values())
    return {f: (w / total if total else 1 / len(kept)) for f, w in kept.items()}


Scorer = Callable[[str, list[str]], list[float | None]]
_SCORERS: dict[str, tuple[Callable[[], Scorer], Callable[[], bool]]] = {}


def register(name: str, load: Callable[[], Scorer], available: Callable[[], bool] = lambda: True) -> None:
    """A scorer of texts for a query. load() is called once in each task, available() on the driver when a list is reranked."""
    _SCORERS[name] = (load, available)


def registered() -> list[str]:
    return sorted(_SCORERS)


def _overlap() -> Scorer:
    def score(query: str, texts: list[str]) -> list[float | None]:
        own = set(query.lower().split())
        return [len(own & set(t.lower().split())) / max(1, len(own)) for t in texts]

    return score


register("overlap", _overlap)


def _scored(pool: DataFrame, query: str, name: str, content: str) -> DataFrame:
    load = _SCORERS[name][0]
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pool.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for b in batches:
            try:
                got = score(query, [t or "" for t in b.column(content).to_pylist()])
            except Exception:  # a scorer that fails has no score for the batch; the next one of the chain has
                got = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "_model"])

    return pool.mapInArrow(run, f"{fields}, _model double")


def rerank(pool: DataFrame, query: str, top: int, chain: tuple[str, ...] = (), content: str = "content", score: str = "score", share: float = 0.7) -> DataFrame:
    """A bounded list by share of the given score and the rest of the first scorer of the chain that is registered, available and has a score.

    Rows without a score from any, and all rows if there is no scorer, get the words of the query that they have. Adds final and by (the scorer).
    """
    left, final, by = pool, F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, name in enumerate(chain):
        if name in _SCORERS and _SCORERS[name][1]():
            left = _scored(left, query, name, content).withColumnRenamed("_model", f"_model{i}")
            final, by = F.coalesce(final, F.col(f"_model{i}")), F.coalesce(by, F.when(F.col(f"_model{i}").isNotNull(), name))
    words = sorted({w for w in query.lower().split() if w})
    plain: Column = F.size(F.array_intersect(tokens(F.coalesce(content, F.lit(""))), F.array(*map(F.lit, words)).cast("array<string>"))) / float(max(1, len(words)))
    out = left.withColumns({"final": share * F.col(score) + (1 - share) * F.coalesce(final, plain), "by": F.coalesce(by, F.lit("words"))})
    return out.select(*pool.columns, "final", "by").orderBy(F.desc("final"), "id").limit(top)


def fitted_rank(found: DataFrame, weights: dict[str, float], limit: int, **options) -> DataFrame:
    """linear_rank() with fitted weights, which name features without their f_."""
    return hybrid.linear_rank(found, limit, normalised(weights), **options)
