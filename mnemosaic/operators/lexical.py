"""Lexical search: postings, statistics, term frequency and BM25.

Nothing here makes a list of all tokens of a row where a count will do: lengths and the query's terms are counted
by two regular expressions in generated code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import found_terms, token_count, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_: str, text: Column) -> DataFrame:
    """(id, term, frequency). The tokens of a row are counted before anything is shuffled."""
    words = docs.select(F.col(id_).alias("id"), F.explode(tokens(text)).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("frequency"))


def node_text(content: str = "content", label: str = "label", summary: str = "summary", keywords: str = "keywords") -> Column:
    """What the index of a node is made from: its keywords count twice."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = F.coalesce(F.array_join(keywords, " "), F.lit(""))
    return F.concat_ws(" ", empty(content), empty(label), empty(summary), words, words)


def doc_stats(docs: DataFrame, id_: str, text: Column) -> DataFrame:
    return docs.select(F.col(id_).alias("id"), token_count(text).cast("long").alias("token_count"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str, least: int = 2) -> list[str]:
    """Terms of a query as tokens() makes them, repeats included."""
    return [t for t in re.findall(r"\w+", query.lower(), flags=re.A) if len(t) >= least]


def _term_counts(docs: DataFrame, id_: str, text: Column, terms: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per document: length and the frequency of each query term, from one pass over its tokens."""
    found = docs.select(F.col(id_).alias("id"), *(by or []), tokens(F.coalesce(text, F.lit(""))).alias("_t"))
    sure = lambda n: F.coalesce(n, F.lit(0))  # noqa: E731  what may be null gets a filter, computed anew, below the exchange
    return found.select("id", *(by or []), sure(F.size("_t")).alias("dl"), *[sure(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"tf{i}") for i, t in enumerate(terms)])


def lexical_tf(docs: DataFrame, id_: str, text: Column, query: str, limit: int) -> DataFrame:
    """Sum of frequencies of the distinct query terms, zeros left out."""
    terms = sorted(set(query_terms(query)))
    if not terms:
        return docs.select(F.col(id_).alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = docs.select(F.col(id_).alias("id"), F.size(found_terms(text, terms)).cast("long").alias("score"))
    return found.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def lexical_from_postings(nodes: DataFrame, post: DataFrame, query: str, limit: int) -> DataFrame:
    """The same from a postings table (id, term, frequency): only the terms' rows are read, and joined to nodes that pass."""
    terms = sorted(set(query_terms(query)))
    hits = post.filter(F.col("term").isin(*terms)) if terms else post.limit(0)
    scores = hits.groupBy("id").agg(F.sum("frequency").alias("score"))
    return nodes.select("id").join(scores, "id").orderBy(F.desc("score"), "id").limit(limit)


def bm25_raw(docs: DataFrame, id_: str, text: Column, query: str, by: list[str] | None = None) -> DataFrame:
    """(id, by..., raw): sums of the terms' scores, not divided by the largest; a repeated term counts as often.

    Statistics are those of the row's group (the scope, say), or of all rows. The texts are read once: the counts, a few
    numbers a row, go through one exchange that the statistics and the scores share. Statistics are a row for each group.
    """
    wanted = query_terms(query)
    terms = sorted(set(wanted))
    group = by or ["_all"]
    docs = docs if by else docs.withColumn("_all", F.lit(0))
    if not terms:
        return docs.select(F.col(id_).alias("id"), *(by or []), F.lit(0.0).alias("raw")).limit(0)
    counts = _term_counts(docs, id_, text, terms, group).repartition("id")
    stats = counts.groupBy(*group).agg(F.count("id").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])

    def part(i: int, term: str):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return wanted.count(term) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    raw = reduce(lambda a, b: a + b, [part(i, t) for i, t in enumerate(terms)])
    # the score is compared, not the counts: a filter on these would part the two readers of the exchange
    own = F.broadcast(stats.withColumnsRenamed({g: f"_of_{g}" for g in group}))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group])
    return counts.join(own, same).select("id", *(by or []), raw.alias("raw")).filter("raw > 0")


def bm25_topk(docs: DataFrame, id_: str, text: Column, query: str, limit: int) -> DataFrame:
    """(id, score): the best by BM25, divided by the largest if that is over one. Only the list of the best is divided."""
    best = bm25_raw(docs, id_, text, query).orderBy(F.desc("raw"), "id").limit(limit)
    top = F.max("raw").over(Window.partitionBy(F.lit(0)))  # limit rows at most
    return best.select("id", (F.col("raw") / F.greatest(top, F.lit(1.0))).alias("score")).orderBy(F.desc("score"), "id")


def bm25_scoped(docs: DataFrame, id_: str, text: Column, query: str, limit: int, scope: str = "scope") -> DataFrame:
    """(id, scope, score): statistics and division by the largest are those of each scope; the lists of scopes are merged and cut."""
    raw = bm25_raw(docs, id_, text, query, [scope])
    best = raw.withColumn("_r", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("raw"), "id"))).filter(F.col("_r") <= limit)
    top = F.max("raw").over(Window.partitionBy(scope))
    return best.select("id", scope, (F.col("raw") / F.greatest(top, F.lit(1.0))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def bm25_candidates(raw: DataFrame, pool: DataFrame, most: int, limit: int) -> DataFrame:
    """raw(id, raw) of all rows -> (id, score, inside): scores of all ids of pool (most rows at most) and of the best limit others."""
    ids = F.broadcast(pool.select("id", F.lit(1).alias("_in")))
    marked = raw.join(ids, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    raw = marked.orderBy(F.desc("_in"), F.desc("raw"), "id").limit(most + limit)
    all_ = Window.partitionBy(F.lit(0))  # most + limit rows at most
    rank = F.row_number().over(Window.partitionBy("_in").orderBy(F.desc("raw"), "id"))
    scored = raw.select("id", (F.col("raw") / F.greatest(F.max("raw").over(all_), F.lit(1.0))).alias("score"), (F.col("_in") == 1).alias("inside"), rank.alias("_r"))
    return scored.filter(F.col("inside") | (F.col("_r") <= limit)).select("id", "score", "inside")


def text_search(nodes: DataFrame, query: str, limit: int, label: str = "label", content: str = "content") -> DataFrame:
    """Nodes that contain the query literally in label or content, by stored importance."""
    q = query.lower()
    hit = F.lower(F.coalesce(F.col(label), F.lit(""))).contains(q) | F.lower(F.coalesce(F.col(content), F.lit(""))).contains(q)
    return nodes.filter(hit).orderBy(F.desc("importance"), "id").limit(limit)
