"""The registered queries: each applies one operator to a table, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions import vector as vx
from ..operators import compress, consolidate, dense, evaluate, graph, hybrid, lexical, lifecycle, mining, reports, store, telemetry
from ..sources import nodes as src
from . import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = src.AS_OF_MS
NODES = "nodes AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in src.NODE_VIEW.items()) + " FROM documents)"
CATEGORY = "CASE WHEN type IN ('event','note','session','task','plan','exploration','debug-investigation','improvement','review') THEN 'episodic' ELSE 'semantic' END"
TOK = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"
QUERY = "the of and data"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def docs(spark, sf):
    return src.table(spark, sf, "documents")


def nodes(spark, sf):
    return src.nodes(docs(spark, sf))


def vectors(spark, sf):
    return src.table(spark, sf, "embeddings")


def events(spark, sf):
    return src.table(spark, sf, "events")


def calls(spark, sf):
    """Events as tool calls: the session is the user, errors fail, files come from the props."""
    k = F.get_json_object("props", "$.k")
    return events(spark, sf).select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), "value", (F.col("event_type") != "error").alias("success"), F.concat(F.lit("f"), k).alias("file"))


CALLS = "calls AS (SELECT event_id AS id, ts, user_id AS session_id, event_type AS tool, value, event_type <> 'error' AS success, concat('f', json_extract_string(props, '$.k')) AS file FROM events)"

# ---- store ----


@query("list_page", f"WITH {NODES} SELECT id, importance, created_ms FROM nodes WHERE coalesce(status, 'active') <> 'superseded' AND (expires_ms IS NULL OR expires_ms > {NOW}) AND scope = 'project' AND level = 2 ORDER BY importance DESC, created_ms DESC, id LIMIT 50 OFFSET 20")
def list_page(spark, sf):
    return store.list_nodes(nodes(spark, sf), NOW, 50, 20, scope="project", min_level=2, max_level=2).select("id", "importance", "created_ms")


@query("distinct_projects", f"WITH {NODES} SELECT DISTINCT project FROM nodes WHERE project IS NOT NULL")
def distinct_projects(spark, sf):
    return store.distinct_projects(nodes(spark, sf))


@query("label_lookup", f"WITH {NODES} SELECT id, label FROM nodes WHERE label = 'persona' AND (expires_ms IS NULL OR expires_ms > {NOW}) ORDER BY id LIMIT 1")
def label_lookup(spark, sf):
    return store.by_label(nodes(spark, sf), "persona", NOW).select("id", "label")


@query("prefix_lookup", f"WITH {NODES} SELECT id, label FROM nodes WHERE CAST(id AS VARCHAR) LIKE (SELECT CAST(max(id) AS VARCHAR) || '%' FROM nodes)")
def prefix_lookup(spark, sf):
    """By the largest id, which no other id begins with."""
    n = nodes(spark, sf)
    return store.by_prefix(n, str(n.agg(F.max("id")).first()[0])).select("id", "label")


_TRI = "list_distinct(CASE WHEN length({x}) >= 3 THEN [substr({x}, i, 3) FOR i IN range(1, length({x}) - 1)] ELSE [{x}] END)"
_A, _B = _TRI.format(x="lower(label)"), _TRI.format(x="'fact:topik12'")


@query("label_suggestions", f"WITH {NODES}, l AS (SELECT DISTINCT label FROM nodes WHERE label IS NOT NULL), s AS (SELECT label, len(list_intersect({_A}, {_B})) / CAST(len(list_distinct(list_concat({_A}, {_B}))) AS DOUBLE) AS j FROM l) SELECT label, round(j, 6) AS similarity FROM s WHERE j >= 0.25 ORDER BY j DESC, label LIMIT 3")
def label_suggestions(spark, sf):
    return store.label_suggestions(nodes(spark, sf), "fact:topik12").select("label", F.round("similarity", 6).alias("similarity"))


@query("filter_set", f"WITH {NODES} SELECT id FROM nodes WHERE type IN ('fact', 'rule', 'howto') AND level BETWEEN 1 AND 4 AND project = 'src1' AND NOT (type IN ('storedcontext', 'contexthistory') OR label LIKE 'middle-term:%') AND coalesce(status, 'active') <> 'superseded'")
def filter_set(spark, sf):
    return store.filtered(nodes(spark, sf), types=["fact", "rule", "howto"], min_level=1, max_level=4, project="src1").filter(store.searchable()).select("id")


@query("type_classes", f"WITH {NODES} SELECT type, {CATEGORY} AS category, CASE WHEN type IN ('concept', 'fact', 'knowledge') THEN 'declarative' WHEN type IN ('lesson', 'howto', 'skill') THEN 'procedural' WHEN type IN ('event', 'note', 'session', 'bug') THEN 'experiential' END AS supertype, CASE WHEN type IN ('knowledge') THEN 'architecture' WHEN type = 'howto' THEN 'operations' WHEN type IN ('concept', 'fact') THEN 'knowledge' WHEN type IN ('event', 'note', 'session', 'bug') THEN 'history' WHEN type IN ('skill', 'lesson') THEN 'patterns' END AS domain, count(*) AS n FROM nodes GROUP BY ALL")
def type_classes(spark, sf):
    return nodes(spark, sf).groupBy("type", "category", "supertype", "domain").agg(F.count("*").alias("n"))


@query("derived_columns", r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda x: trim(x)), lambda x: length(x) > 20) AS parts, text FROM documents) SELECT doc_id, substr(parts[1], 1, 220) AS summary, sha256(text) AS hash, CAST(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.5) AS BIGINT) AS tokens FROM p")
def derived_columns(spark, sf):
    return docs(spark, sf).select("doc_id", tx.auto_summary(F.col("text")).alias("summary"), tx.content_hash(F.col("text")).alias("hash"), tx.word_token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("upsert_by_label", "WITH a AS (SELECT s_suppkey AS id, 'global' AS scope, concat('k', s_suppkey) AS label, s_acctbal AS v FROM supplier), b AS (SELECT c_custkey + 1000000 AS id, 'global' AS scope, concat('k', c_custkey * 3) AS label, c_acctbal AS v FROM customer) SELECT coalesce(a.id, b.id) AS id, coalesce(a.scope, b.scope) AS scope, coalesce(a.label, b.label) AS label, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.label = b.label AND a.scope = b.scope")
def upsert_by_label(spark, sf):
    old = src.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "'global' AS scope", "concat('k', s_suppkey) AS label", "s_acctbal AS v")
    new = src.table(spark, sf, "customer").selectExpr("c_custkey + 1000000 AS id", "'global' AS scope", "concat('k', c_custkey * 3) AS label", "c_acctbal AS v")
    return store.upsert_by_label(old, new)


# ---- lexical ----

_T = f"t AS (SELECT doc_id, {TOK.format(x='text')} AS toks FROM documents)"


@query("text_search", f"WITH {NODES} SELECT id, importance FROM nodes WHERE contains(lower(coalesce(label, '')), 'license') OR contains(lower(coalesce(content, '')), 'license') ORDER BY importance DESC, id LIMIT 25")
def text_search(spark, sf):
    return lexical.text_search(nodes(spark, sf), "License", 25).select("id", "importance")


@query("lexical_tf", f"WITH {_T} SELECT doc_id AS id, CAST(len(list_filter(toks, lambda x: x IN ('the', 'of', 'and', 'data'))) AS BIGINT) AS score FROM t ORDER BY score DESC, id LIMIT 20")
def lexical_tf(spark, sf):
    return lexical.lexical_tf(docs(spark, sf), "doc_id", F.col("text"), QUERY, 20)


@query("bm25_doc_stats", f"WITH {_T} SELECT doc_id AS id, CAST(len(toks) AS BIGINT) AS token_count FROM t")
def bm25_doc_stats(spark, sf):
    return lexical.doc_stats(docs(spark, sf), "doc_id", F.col("text"))


@query("postings", f"WITH {_T}, u AS (SELECT doc_id, unnest(toks) AS term FROM t) SELECT doc_id AS id, term, count(*) AS frequency FROM u GROUP BY ALL")
def postings(spark, sf):
    return lexical.postings(docs(spark, sf), "doc_id", F.col("text"))


@query("term_df", f"WITH {_T}, u AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t) SELECT term, count(*) AS df FROM u GROUP BY term")
def term_df(spark, sf):
    return lexical.document_frequency(lexical.postings(docs(spark, sf), "doc_id", F.col("text")))


_BM25 = f"""{_T},
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
q AS (SELECT unnest(['the', 'of', 'and', 'data']) AS term),
tf AS (SELECT t.doc_id, q.term, len(t.toks) AS dl, len(list_filter(t.toks, lambda x: x = q.term)) AS tf FROM t CROSS JOIN q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
raw AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS raw FROM tf JOIN df USING (term) CROSS JOIN s GROUP BY doc_id),
bm AS (SELECT doc_id AS id, raw / greatest((SELECT max(raw) FROM raw), 1) AS score FROM raw WHERE raw > 0)"""


_BM25_BEST = f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 20)"


@query("bm25_topk", _BM25_BEST)
def bm25_topk(spark, sf):
    return kept.texts(spark, sf).bm25_topk(QUERY, 20).select("id", F.round("score", 6).alias("score"))


@query("bm25_scan", _BM25_BEST)
def bm25_scan(spark, sf):
    return lexical.bm25_topk(docs(spark, sf), "doc_id", F.col("text"), QUERY, 20).select("id", F.round("score", 6).alias("score"))


_BM25_SCOPED = f"""WITH {NODES}, t AS (SELECT id, scope, {TOK.format(x='content')} AS toks FROM nodes),
s AS (SELECT scope, count(*) AS n, avg(len(toks)) AS avgdl FROM t GROUP BY scope),
q AS (SELECT unnest(['the', 'of', 'license', 'data']) AS term),
tf AS (SELECT t.id, t.scope, q.term, len(t.toks) AS dl, len(list_filter(t.toks, lambda x: x = q.term)) AS tf FROM t CROSS JOIN q),
df AS (SELECT scope, term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY ALL),
raw AS (SELECT id, tf.scope, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS raw FROM tf JOIN df ON df.term = tf.term AND df.scope = tf.scope JOIN s ON s.scope = tf.scope GROUP BY ALL)
SELECT id, scope, round(score, 6) AS score FROM (SELECT id, scope, raw / greatest(max(raw) OVER (PARTITION BY scope), 1) AS score FROM raw WHERE raw > 0 ORDER BY score DESC, id LIMIT 30)"""


@query("bm25_scoped", _BM25_SCOPED)
def bm25_scoped(spark, sf):
    return kept.scoped_texts(spark, sf).bm25_scoped("the license of data", 30).withColumn("score", F.round("score", 6))


@query("bm25_scoped_scan", _BM25_SCOPED)
def bm25_scoped_scan(spark, sf):
    return lexical.bm25_scoped(nodes(spark, sf), "id", F.col("content"), "the license of data", 30).withColumn("score", F.round("score", 6))


@query("lexical_from_postings", f"WITH {_T}, u AS (SELECT doc_id AS id, unnest(toks) AS term FROM t) SELECT id, count(*) AS score FROM u WHERE term IN ('the', 'license') AND id % 3 <> 0 GROUP BY id ORDER BY score DESC, id LIMIT 25")
def lexical_from_postings(spark, sf):
    post = lexical.postings(docs(spark, sf), "doc_id", F.col("text"))
    return lexical.lexical_from_postings(nodes(spark, sf).filter("scope = 'project'"), post, "the license", 25)


# ---- dense ----

QVEC = [round(((i * 37) % 19 - 9) / 10, 2) for i in range(64)]
_Q = "[" + ", ".join(map(str, QVEC)) + "]::DOUBLE[]"
_COS = "list_cosine_similarity(embedding::DOUBLE[], {q})"


@query("knn_topk", f"SELECT vec_id AS id, round({_COS.format(q=_Q)}, 6) AS score FROM embeddings ORDER BY {_COS.format(q=_Q)} DESC, vec_id LIMIT 20")
def knn_topk(spark, sf):
    return dense.knn(vectors(spark, sf), "vec_id", "embedding", QVEC, 20).select("id", F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT vec_id AS id, round({_COS.format(q=_Q)}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY {_COS.format(q=_Q)} DESC, vec_id LIMIT 20")
def knn_filtered(spark, sf):
    return dense.knn(vectors(spark, sf).filter(F.col("label").isin(1, 3, 5)), "vec_id", "embedding", QVEC, 20).select("id", F.round("score", 6).alias("score"))


@query("max_segment_knn", f"SELECT CAST(label AS BIGINT) AS id, round(max({_COS.format(q=_Q)}), 6) AS score FROM embeddings GROUP BY label ORDER BY score DESC, id LIMIT 5")
def max_segment_knn(spark, sf):
    return dense.max_segment_knn(vectors(spark, sf).withColumn("label", F.col("label").cast("long")), "label", "embedding", QVEC, 5).select("id", F.round("score", 6).alias("score"))


@query("knn_queries", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def knn_queries(spark, sf):
    v = vectors(spark, sf)
    return dense.knn_queries(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query("similar_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def similar_pairs(spark, sf):
    return dense.similar_pairs(vectors(spark, sf), "vec_id", "embedding", 0.3).withColumn("cosine", F.round("cosine", 6))


@query("topic_boundaries", "WITH c AS (SELECT label, vec_id, coalesce(CAST(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w) < 0 AS INT), 0) AS cut FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)), r AS (SELECT label, vec_id, CAST(sum(cut) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS run FROM c) SELECT label, run, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS size FROM r GROUP BY label, run HAVING count(*) >= 2")
def topic_boundaries(spark, sf):
    return dense.topic_runs(vectors(spark, sf), "vec_id", "embedding", ["label"], 0.0)


@query("l2_normalise", "SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first, round(list_dot_product(embedding::DOUBLE[], " + _Q + ") / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS d FROM embeddings")
def l2_normalise(spark, sf):
    """Vectors of other lengths, made to unit length again."""
    v = vx.l2_normalised(F.transform("embedding", lambda x: x * 3 + 0))
    return vectors(spark, sf).select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(vx.dot(F.col("v"), vx.literal(QVEC)), 6).alias("d"))


@query("mean_pooling", "WITH u AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT label, round(avg(a), 6) AS first, round(avg(b), 6) AS second FROM u GROUP BY label")
def mean_pooling(spark, sf):
    g = vectors(spark, sf).groupBy("label").agg(F.collect_list("embedding").alias("vs"))  # ten labels of test vectors
    return g.select("label", vx.mean_pooled(F.col("vs")).alias("m")).select("label", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.get("m", F.lit(1)), 6).alias("second"))


@query("mmr_select")
def mmr_select(spark, sf):
    v = vectors(spark, sf)
    pool = v.select((F.col("label") % 3).cast("long").alias("q"), F.col("vec_id").alias("id"), vx.cosine(F.col("embedding"), vx.literal(QVEC)).alias("importance"), F.col("embedding").alias("vec"))
    return dense.mmr(pool, "q", 10)


_ONE_PASS = "list_reduce(list([{'id': vec_id, 'v': embedding::DOUBLE[], 'leader': vec_id}] ORDER BY vec_id), lambda a, x: a || [{'id': x[1].id, 'v': x[1].v, 'leader': coalesce(list_filter(a, lambda y: y.leader = y.id AND list_cosine_similarity(y.v, x[1].v) >= 0.3e0)[1].id, x[1].id)}])"


@query("leader_clusters", f"WITH w AS (SELECT label, unnest({_ONE_PASS}) AS r FROM embeddings GROUP BY label), o AS (SELECT CAST(label AS BIGINT) AS label, r.id AS id, r.leader AS leader FROM w) SELECT * FROM o WHERE leader IN (SELECT leader FROM o GROUP BY leader HAVING count(*) >= 2)")
def leader_clusters(spark, sf):
    return dense.leader_clusters(vectors(spark, sf).withColumn("label", F.col("label").cast("long")), "label", "vec_id", "embedding")


# ---- ranking ----

_QM = "CASE WHEN type IN ('storedcontext', 'contexthistory') THEN 0.5e0 WHEN label LIKE 'middle-term:%' THEN 0.6e0 WHEN regexp_matches(lower(label), '^(lesson|decision|convention|fact|workflow):') THEN 1.3e0 WHEN regexp_matches(lower(label), '^(knowledge|rule|skill|dot):') THEN 1.25e0 WHEN regexp_matches(lower(label), '^(plan|task):') THEN 1.1e0 WHEN type IN ('skill', 'playbook', 'core') THEN 1.15e0 ELSE 1e0 END"
_AM = "least(1.5e0, greatest(0.4e0, importance / 0.5e0 * (1 + usefulness / 5) / (1 + access_count / 5e0)))"


@query("quality_multiplier", f"WITH {NODES} SELECT id, {_QM} AS multiplier, round({_AM}, 6) AS adaptive FROM nodes")
def quality_multiplier(spark, sf):
    return nodes(spark, sf).select("id", sc.quality_multiplier(F.col("type"), F.col("label")).alias("multiplier"), F.round(sc.adaptive_multiplier(F.col("importance"), F.col("usefulness"), F.col("access_count")), 6).alias("adaptive"))


_FEAT = f"""{_BM25},
v AS (SELECT vec_id AS id, {_COS.format(q=_Q)} AS semantic FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50),
b0 AS (SELECT id, score AS bm25 FROM bm),
b1 AS (SELECT * FROM b0 WHERE id NOT IN (SELECT id FROM v) ORDER BY bm25 DESC, id LIMIT 30),
c AS (SELECT coalesce(v.id, b.id) AS id, coalesce(semantic, 0e0) AS semantic, coalesce(bm25, 0e0) AS bm25 FROM v FULL JOIN (SELECT * FROM b0 WHERE id IN (SELECT id FROM v) UNION ALL SELECT * FROM b1) b ON v.id = b.id),
f AS (SELECT n.*, c.semantic, c.bm25, {_QM} AS qm, {_AM} AS am FROM c JOIN nodes n USING (id)),
r AS (SELECT *, least(1e0, greatest(0e0, (0.45e0 * least(1e0, greatest(0e0, semantic)) + 0.22e0 * bm25 + 0.13e0 * least(1e0, greatest(0e0, least(1e0, greatest(0e0, (qm - 0.5e0) / 0.8e0)) * am)) + 0.05e0 * confidence + 0.05e0 * least(1e0, usefulness / 5) + 0.10e0 * (1 - 5 / 30e0)) / 1.0e0)) AS score FROM f)"""


def _candidates(spark, sf):
    near = dense.knn(vectors(spark, sf), "vec_id", "embedding", QVEC, 50)
    return hybrid.candidates(near, kept.texts(spark, sf).raw(QUERY), 50, 30).join(nodes(spark, sf).drop("content"), "id")


@query("rank_features", f"WITH {NODES}, {_FEAT} SELECT id, round(semantic, 9) AS semantic, round(bm25, 9) AS bm25, round(least(1e0, greatest(0e0, least(1e0, greatest(0e0, (qm - 0.5e0) / 0.8e0)) * am)), 9) AS quality, round(confidence, 9) AS confidence, round(least(1e0, usefulness / 5), 9) AS usefulness, round(1 - least((id % 40) / 30e0, 1e0), 9) AS cost, round((id % 5) / CAST(id % 5 + 2 AS DOUBLE), 9) AS intent FROM r")
def rank_features(spark, sf):
    """All seven; total calls and the counts of intents follow from the id."""
    counts = F.create_map(F.lit("debug"), F.col("id") % 5, F.lit("plan"), F.lit(2).cast("long"))
    found = _candidates(spark, sf).withColumns({"total_calls": F.col("id") % 40, "affinity": sc.intent_affinity(counts, "debug")})
    f = hybrid.features(found)
    return f.select("id", F.round("semantic", 9).alias("semantic"), F.round("bm25", 9).alias("bm25"), *[F.round(f"f_{c}", 9).alias(c) for c in ("quality", "confidence", "usefulness", "cost", "intent")])


@query("hybrid_linear", f"WITH {NODES}, {_FEAT} SELECT id, round(score, 6) AS score FROM (SELECT * FROM r ORDER BY score DESC, CASE WHEN level >= 1 THEN created_ms ELSE coalesce(accessed_ms, created_ms) END DESC, id LIMIT 10)")
def hybrid_linear(spark, sf):
    return hybrid.linear_rank(_candidates(spark, sf), 10).select("id", F.round("score", 6).alias("score"))


@query("hybrid_rrf", f"WITH {NODES}, {_FEAT}, k AS (SELECT *, row_number() OVER (ORDER BY semantic DESC, id) AS rs, row_number() OVER (ORDER BY bm25 DESC, id) AS rb FROM f), x AS (SELECT *, 1e0 / (60 + rs) + CASE WHEN bm25 > 0 THEN 1e0 / (60 + rb) ELSE 0 END AS rrf FROM k), y AS (SELECT id, (rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()) * (0.3e0 + 0.7e0 * CASE WHEN accessed_ms IS NULL THEN 1e0 ELSE exp(-({NOW} - accessed_ms) / 3600000e0 / 24) END) AS score FROM x) SELECT id, round(score, 6) AS score FROM (SELECT * FROM y ORDER BY score DESC, id LIMIT 10)")
def hybrid_rrf(spark, sf):
    return hybrid.reciprocal_ranks(_candidates(spark, sf), NOW).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@query("gate", f"WITH {NODES}, s AS (SELECT id, type, importance AS score FROM nodes WHERE level = 3 ORDER BY importance DESC, id LIMIT 40), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n, score >= CASE type WHEN 'rule' THEN 0.5 WHEN 'fact' THEN 0.4 WHEN 'howto' THEN 0.4 WHEN 'concept' THEN 0.35 WHEN 'note' THEN 0.2 WHEN 'event' THEN 0.15 ELSE 0.3 END AS passed FROM s), g AS (SELECT max(score) - max(CASE WHEN r = least(n, 5) THEN score END) AS delta, max(n) AS n, bool_or(passed) AS any_passed FROM t) SELECT id, score, passed, (NOT any_passed) OR (g.n > 1 AND delta < 0.15) AS uncertain, NOT any_passed AS gated FROM t CROSS JOIN g")
def gate(spark, sf):
    pool = nodes(spark, sf).filter("level = 3").select("id", "type", F.col("importance").alias("score")).orderBy(F.desc("score"), "id").limit(40)
    return hybrid.gate(pool).select("id", "score", "passed", "uncertain", "gated")


_KW = "list_distinct(string_split_regex(lower(content), '\\s+'))"


@query("keyword_rerank", rf"WITH {NODES}, p AS (SELECT * FROM nodes WHERE level = 1 ORDER BY importance DESC, id LIMIT 100), w AS (SELECT id, importance, lower(content) AS low, {_KW} AS words, ceil(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) * 1.5) AS est, lower(label) AS name FROM p), k AS (SELECT *, least(1e0, (CAST(list_contains(words, 'the') AS DOUBLE) + CASE WHEN contains(name, 'the') THEN 0.5 ELSE 0 END + CAST(list_contains(words, 'and') AS DOUBLE) + CASE WHEN contains(name, 'and') THEN 0.5 ELSE 0 END + CAST(list_contains(words, 'fact') AS DOUBLE) + CASE WHEN contains(name, 'fact') THEN 0.5 ELSE 0 END) / 3e0) AS kw FROM w), s AS (SELECT id, importance * 0.7e0 + (kw * 0.4e0 + CASE WHEN contains(string_split(low, chr(10))[1], 'the and fact') THEN 0.3e0 ELSE 0 END + least(0.4e0, kw * 100 / greatest(1e0, est / 10e0) * 0.1e0)) * 0.3e0 AS final FROM k) SELECT id, round(final, 6) AS final FROM (SELECT * FROM s ORDER BY final DESC, id LIMIT 10)")
def keyword_rerank(spark, sf):
    pool = nodes(spark, sf).filter("level = 1").orderBy(F.desc("importance"), "id").limit(100)
    return hybrid.keyword_rerank(pool, "the and fact", 10).select("id", F.round("final", 6).alias("final"))


_PACK = "list_reduce(list([{'id': id, 'cost': cost, 'used': CASE WHEN cost <= 8000 THEN cost ELSE 0 END, 'taken': cost <= 8000}] ORDER BY r), lambda a, x: a || [{'id': x[1].id, 'cost': x[1].cost, 'used': a[-1].used + CASE WHEN a[-1].used + x[1].cost <= 8000 THEN x[1].cost ELSE 0 END, 'taken': a[-1].used + x[1].cost <= 8000}])"


@query("budget_pack", f"WITH {NODES}, c AS (SELECT project, id, CAST(ceil(length(content) / 4e0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY project ORDER BY importance DESC, id) AS r FROM nodes), w AS (SELECT project, {_PACK} AS w FROM c WHERE r <= 100 GROUP BY project), u AS (SELECT project, w[-1].used AS used, unnest(list_filter(w, lambda y: y.taken)) AS x, generate_subscripts(list_filter(w, lambda y: y.taken), 1) - 1 AS place FROM w) SELECT project, CAST(place AS INT) AS place, x.id AS id, used FROM u")
def budget_pack(spark, sf):
    """The hundred best of each project, which is what a search hands over, into a budget."""
    scored = nodes(spark, sf).select("project", "id", F.col("importance").alias("score"), F.ceil(F.length("content") / 4).alias("cost"))
    best = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return hybrid.pack(scored.withColumn("_r", best).filter("_r <= 100").drop("_r"), 8000, ["project"])


@query("band_top", f"WITH {NODES}, r AS (SELECT id, level, importance AS score, row_number() OVER (PARTITION BY level ORDER BY importance DESC, id) AS k FROM nodes) SELECT id, level, score FROM r WHERE k <= 3 ORDER BY score DESC, id LIMIT 12")
def band_top(spark, sf):
    return hybrid.band_preserving(nodes(spark, sf).select("id", "level", F.col("importance").alias("score")), 3, 12)


@query("legacy_hybrid_score", f"WITH {NODES}, w AS (SELECT id, CAST(contains(label, 'fact') AS INT) + CAST(contains(label, 'topic') AS INT) + CAST(contains(label, '1') AS INT) AS shared FROM nodes) SELECT n.id, round(0.5e0 * {_COS.format(q=_Q)} + 0.3e0 * importance + 0.2e0 * confidence + CASE WHEN ({NOW} - updated_ms) / 86400000e0 < 1 THEN 0.1e0 WHEN ({NOW} - updated_ms) / 86400000e0 < 7 THEN 0.05e0 ELSE 0 END + least(0.15e0, shared / 3e0 * 0.15e0), 6) AS score FROM nodes n JOIN w USING (id) JOIN embeddings e ON e.vec_id = n.id")
def legacy_hybrid_score(spark, sf):
    both = nodes(spark, sf).drop("content").join(vectors(spark, sf).select("vec_id", "embedding"), F.col("id") == F.col("vec_id"))
    shared = sum((F.col("label").contains(w).cast("int") for w in ("fact", "topic", "1")), F.lit(0))
    score = sc.hybrid_score(vx.cosine(F.col("embedding"), vx.literal(QVEC)), F.col("importance"), F.col("confidence"), F.col("updated_ms"), NOW, shared, 3)
    return both.select("id", F.round(score, 6).alias("score"))


# ---- lifecycle ----


@query("expired", f"WITH {NODES} SELECT id, expires_ms FROM nodes WHERE expires_ms <= {NOW} AND type <> 'skill'")
def expired(spark, sf):
    return lifecycle.expired(nodes(spark, sf), NOW).select("id", "expires_ms")


@query("prunable", f"WITH {NODES} SELECT id FROM nodes WHERE NOT sticky AND label NOT IN ('persona', 'human', 'current-state', 'project') AND importance < 0.9 AND importance < 0.4 AND (access_count <= 5 OR updated_ms < {NOW - 90 * sc.DAY_MS})")
def prunable(spark, sf):
    return lifecycle.prunable(nodes(spark, sf), NOW, 5, 90, 0.4).select("id")


@query("score_decay", f"WITH {NODES}, d AS (SELECT *, coalesce(accessed_ms, updated_ms) AS last, {CATEGORY} AS category FROM nodes) SELECT id, (last < {NOW - 30 * sc.DAY_MS} AND usefulness > 0.1 AND type NOT IN ('skill', 'lesson', 'rule', 'playbook')) AS decayed, round(CASE WHEN last < {NOW - 30 * sc.DAY_MS} AND usefulness > 0.1 AND type NOT IN ('skill', 'lesson', 'rule', 'playbook') THEN greatest(0.1e0, usefulness * pow(0.5e0, ({NOW} - last) / (CASE category WHEN 'episodic' THEN 7 * 86400000e0 ELSE 365 * 86400000e0 END))) ELSE usefulness END, 6) AS usefulness FROM d")
def score_decay(spark, sf):
    return lifecycle.decayed(nodes(spark, sf), NOW).select("id", "decayed", F.round("usefulness", 6).alias("usefulness"))


@query("confidence_decay", f"WITH {NODES} SELECT id, CASE WHEN type = 'skill' THEN round(confidence, 6) ELSE floor(least(1e0, greatest(0e0, confidence * exp(-({NOW} - updated_ms) / 86400000e0 / 365) + CASE WHEN verified_ms IS NULL THEN 0e0 ELSE greatest(0e0, 0.1e0 - ({NOW} - verified_ms) / (86400000 * 30e0)) END)) * 100 + 0.5e0) / 100e0 END AS confidence FROM nodes")
def confidence_decay(spark, sf):
    return lifecycle.confidence(nodes(spark, sf), NOW).select("id", F.round("confidence", 6).alias("confidence"))


@query("supersession", f"WITH {NODES}, l AS (SELECT label, scope, id AS by_id, created_ms AS at, tag FROM nodes WHERE type IN ('fact', 'decision', 'knowledge', 'convention', 'lesson')) SELECT n.id, arg_min(l.by_id, (l.at, l.by_id)) AS superseded_by FROM nodes n JOIN l ON n.label = l.label AND n.scope = l.scope WHERE coalesce(n.status, 'active') = 'active' AND (l.at > n.created_ms OR (l.at = n.created_ms AND l.by_id > n.id)) AND (l.tag = n.tag OR (l.tag IS NULL AND n.tag IS NULL)) GROUP BY n.id")
def supersession(spark, sf):
    tagged = nodes(spark, sf).drop("content").withColumn("tags", F.when(F.col("tag").isNotNull(), F.array("tag")))
    return lifecycle.superseded(tagged)


@query("latest_by_hash", "SELECT doc_id AS id, max(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id FROM documents")
def latest_by_hash(spark, sf):
    return lifecycle.latest_by_key(docs(spark, sf), F.sha2("text", 256), "doc_id", "doc_id")


@query("rating_sweep", f"WITH {NODES}, u AS (SELECT id, importance, usefulness, coalesce(accessed_ms, created_ms) AS seen, access_count AS used, CAST(id % 23 AS INT) AS helpful FROM nodes), a AS (SELECT *, CASE WHEN helpful / CAST(greatest(used, 1) AS DOUBLE) > 0.8 AND used > 10 THEN 'raise' WHEN helpful / CAST(greatest(used, 1) AS DOUBLE) < 0.15 AND used > 20 THEN 'lower' WHEN used = 0 AND seen < {NOW - 30 * sc.DAY_MS} THEN 'delete' END AS action FROM u), d AS (SELECT * FROM a WHERE action = 'delete' ORDER BY importance, id LIMIT 20) SELECT id, action, round(CASE action WHEN 'raise' THEN least(5e0, usefulness + 0.1e0) WHEN 'lower' THEN greatest(0e0, usefulness - 0.05e0) ELSE usefulness END, 6) AS usefulness FROM (SELECT * FROM a WHERE action IN ('raise', 'lower') UNION ALL SELECT * FROM d)")
def rating_sweep(spark, sf):
    used = nodes(spark, sf).drop("content").withColumns({"times_used": F.col("access_count"), "times_helpful": (F.col("id") % 23).cast("int")})
    return lifecycle.sweep(used, NOW).withColumn("usefulness", F.round("usefulness", 6))


@query("compression_candidates", f"WITH {NODES} SELECT id, importance FROM nodes WHERE level = 1 AND created_ms <= {NOW - 30 * sc.DAY_MS} AND length(content) > 100 AND NOT sticky")
def compression_candidates(spark, sf):
    return lifecycle.compression_candidates(nodes(spark, sf), 1, NOW).select("id", "importance")


# ---- graph ----

_TURN = "conv_id * 1000 + turn"
_NEXT = f"e AS (SELECT {_TURN} AS src, lag({_TURN}) OVER (PARTITION BY conv_id ORDER BY turn, {_TURN}) AS dst FROM conversations)"


def _next(spark, sf):
    turns = src.table(spark, sf, "conversations").withColumn("id", F.expr(_TURN))
    return graph.next_edges(turns, "conv_id", ["turn", "id"], "id")


@query("next_edges", f"WITH {_NEXT} SELECT src, dst, 'NEXT' AS edge_type, 1e0 AS confidence FROM e WHERE dst IS NOT NULL")
def next_edges(spark, sf):
    return _next(spark, sf)


_ER = "er(src, dst, confidence) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey, 0.9e0 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.8e0 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1e0 FROM nation)"
_SYM = "sym AS (SELECT src, dst, confidence FROM er UNION SELECT dst, src, confidence FROM er)"


def _places(spark, sf):
    t = lambda n: src.table(spark, sf, n)
    e = t("customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst", "0.9e0 AS confidence")
    e = e.union(t("supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)", "0.8e0"))
    return e.union(t("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "1e0"))


def _seed(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


@query("bfs_hops", f"WITH RECURSIVE {_ER}, {_SYM}, w(id, hops) AS (SELECT 'r2', 0 UNION SELECT s.dst, w.hops + 1 FROM w JOIN sym s ON s.src = w.id WHERE w.hops < 3) SELECT id, min(hops) AS hops FROM w GROUP BY id")
def bfs_hops(spark, sf):
    return graph.hops(_places(spark, sf), _seed(spark, id="r2"), 3)


@query("hop_scores", f"WITH RECURSIVE {_ER}, {_SYM}, w(id, hops, score) AS (SELECT 'n3', 0, 1e0 UNION SELECT s.dst, w.hops + 1, w.score * s.confidence * 0.8e0 FROM w JOIN sym s ON s.src = w.id WHERE w.hops < 2) SELECT id, round(max(score), 6) AS score FROM w GROUP BY id")
def hop_scores(spark, sf):
    return graph.hop_scores(_places(spark, sf), _seed(spark, id="n3", score=1.0), 2).withColumn("score", F.round("score", 6))


@query("shortest_path", f"WITH RECURSIVE {_ER}, w(id, hops, path) AS (SELECT 'c1', 0, 'c1' UNION ALL SELECT e.dst, w.hops + 1, w.path || '>' || e.dst FROM w JOIN er e ON e.src = w.id WHERE w.hops < 4) SELECT id, min(hops) AS hops, arg_min(path, (hops, path)) AS path FROM w GROUP BY id")
def shortest_path(spark, sf):
    return graph.shortest_paths(_places(spark, sf), "c1", 4).withColumn("path", F.array_join("path", ">"))


@query("degree_topk", f"WITH {_ER}, d AS (SELECT src AS id FROM er UNION ALL SELECT dst FROM er) SELECT id, count(*) AS degree FROM d GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def degree_topk(spark, sf):
    return graph.degrees(_places(spark, sf)).orderBy(F.desc("degree"), "id").limit(10)


@query("cross_community_edges", "WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT 'c' || c_custkey AS id, n_regionkey AS community FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT src, dst, CASE WHEN dst LIKE '%1' THEN 3 ELSE 1 END AS score FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.community <> b.community ORDER BY score DESC, src, dst LIMIT 15")
def cross_community_edges(spark, sf):
    t = lambda n: src.table(spark, sf, n)
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("concat('c', o_custkey) AS src", "concat('s', l_suppkey) AS dst").distinct()
    e = e.withColumn("origin", F.when(F.col("dst").like("%1"), "EXTRACTED").otherwise("INFERRED"))
    nation = t("nation").select("n_nationkey", F.col("n_regionkey").alias("community"))
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), "community")
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "community")
    return graph.surprising(e, c.union(s)).select("src", "dst", "score")


@query("parent_path", "SELECT 'c' || c_custkey AS id, 2 AS depth, 'c' || c_custkey || '>n' || c_nationkey || '>r' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 1, 'n' || n_nationkey || '>r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 0, 'r' || r_regionkey FROM region")
def parent_path(spark, sf):
    t = lambda n: src.table(spark, sf, n)
    n = t("customer").selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent")
    n = n.union(t("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")).union(t("region").selectExpr("concat('r', r_regionkey)", "CAST(NULL AS STRING)"))
    return graph.parent_path(n, 4).withColumn("path", F.array_join("path", ">"))


@query("hierarchy_depth", "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS depth FROM customer UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def hierarchy_depth(spark, sf):
    """Customers lie under a region, a nation, and a supplier of it: the deepest parent counts."""
    t = lambda n: src.table(spark, sf, n)
    one = t("supplier").agg(F.min("s_suppkey")).first()[0]
    links = t("customer").filter("c_custkey % 3 = 0 OR c_custkey % 2 = 1").selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent")
    links = links.union(t("customer").filter("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey)", "'r1'"))
    links = links.union(t("customer").filter("c_custkey % 3 = 0").selectExpr("concat('c', c_custkey)", f"'s{one}'"))
    links = links.union(t("supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)")).union(t("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    ids = links.select("id").union(t("region").selectExpr("concat('r', r_regionkey)")).distinct()
    return graph.depths(links, ids, 4)


@query("link_resolve", f"WITH {NODES}, b AS (SELECT label, arg_min(id, (CAST(scope <> 'global' AS INT), id)) AS target_id FROM nodes GROUP BY label), l AS (SELECT doc_id AS source_id, concat('fact:topic', doc_id % 70) AS target_label FROM documents) SELECT source_id, target_label, target_id FROM l LEFT JOIN b ON b.label = l.target_label")
def link_resolve(spark, sf):
    links = docs(spark, sf).selectExpr("doc_id AS source_id", "concat('fact:topic', doc_id % 70) AS target_label")
    return graph.resolve_links(links, nodes(spark, sf).drop("content"))


def _propagation_sql(rounds: int, least: int) -> str:
    parts = ["e AS (SELECT DISTINCT o_custkey AS src, 10000000 + l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "l0 AS (SELECT DISTINCT src AS id, src AS c FROM b)"]
    for k in range(rounds):
        parts.append(f"s{k} AS (SELECT b.src, l.c, count(*) AS n FROM b JOIN l{k} l ON l.id = b.dst GROUP BY ALL), l{k + 1} AS (SELECT src AS id, arg_max(c, (n, -c)) AS c FROM s{k} GROUP BY src)")
    return f"WITH {', '.join(parts)} SELECT id, c AS community FROM l{rounds} WHERE c IN (SELECT c FROM l{rounds} GROUP BY c HAVING count(*) >= {least})"


@query("label_communities", _propagation_sql(4, 3))
def label_communities(spark, sf):
    e = src.table(spark, sf, "lineitem").join(src.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.label_propagation(e.select(F.col("o_custkey").alias("src"), (10000000 + F.col("l_suppkey")).alias("dst")), 4)


# ---- telemetry ----


@query("tool_patterns", "SELECT event_type AS tool, count(*) AS calls, CAST(floor(avg(value) + 0.5) AS BIGINT) AS avg_tokens, CAST(floor(avg(value * 10) + 0.5) AS BIGINT) AS avg_duration_ms, CAST(floor(avg(CAST(value > 50 AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS warning_rate, CAST(floor(avg(CAST(event_type <> 'error' AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS success_rate FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type")
def tool_patterns(spark, sf):
    log = calls(spark, sf).withColumns({"tokens": F.col("value"), "duration_ms": F.col("value") * 10, "warning": F.col("value") > 50})
    return telemetry.tool_patterns(log, F.lit("2024-01-05").cast("timestamp"))


@query("tool_sequences", "WITH p AS (SELECT event_type AS first, lead(event_type) OVER (ORDER BY ts, event_id) AS second FROM events) SELECT first, second, count(*) AS n FROM p WHERE second IS NOT NULL AND first <> second GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, first, second LIMIT 10")
def tool_sequences(spark, sf):
    return telemetry.tool_sequences(calls(spark, sf).select("tool", "ts", "id"))


@query("session_counters", f"WITH {CALLS} SELECT session_id, count(*) AS calls, count(*) FILTER (WHERE tool IN ('read', 'view')) AS reads, count(*) FILTER (WHERE tool IN ('edit', 'write', 'purchase')) AS edits, count(*) FILTER (WHERE tool IN ('bash', 'shell', 'click')) AS shell, count(*) FILTER (WHERE NOT success) AS failed, count(DISTINCT file) AS files FROM calls GROUP BY session_id")
def session_counters(spark, sf):
    return telemetry.session_counters(calls(spark, sf))


@query("failure_signature", f"WITH {CALLS} SELECT session_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS signature, count(*) AS failures FROM calls WHERE NOT success GROUP BY session_id")
def failure_signature(spark, sf):
    return telemetry.failure_signatures(calls(spark, sf))


@query("usage_totals", "SELECT count(DISTINCT user_id) AS sessions, count(*) AS turns, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events")
def usage_totals(spark, sf):
    return telemetry.usage_totals(events(spark, sf), "user_id", "value").select("sessions", "turns", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("usage_by_session_topk", "SELECT user_id AS session_id, count(*) AS turns, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id ORDER BY turns DESC, session_id LIMIT 20")
def usage_by_session_topk(spark, sf):
    return telemetry.usage_by_session(events(spark, sf), "user_id", "value", 20).withColumn("total", F.round("total", 4))


@query("dashboard_levels", f"WITH {NODES} SELECT level, type, CAST(CASE WHEN grouping(level) = 0 THEN 1 WHEN grouping(type) = 0 THEN 2 ELSE 3 END AS BIGINT) AS set_id, count(*) AS nodes, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(floor(length(content) / 4.0)) AS BIGINT) AS tokens FROM nodes GROUP BY GROUPING SETS ((level), (type), ())")
def dashboard_levels(spark, sf):
    return telemetry.dashboard(nodes(spark, sf))


@query("node_histograms", f"WITH {NODES} SELECT 'type' AS dimension, type AS value, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'project', project, count(*) FROM nodes GROUP BY project UNION ALL SELECT 'tag', coalesce(tag, 'none'), count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, 'none'), count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'scope', scope, count(*) FROM nodes GROUP BY scope")
def node_histograms(spark, sf):
    return telemetry.histograms(nodes(spark, sf), ["type", "project", "tag", "status", "scope"])


@query("confidence_histogram", f"WITH {NODES}, c AS (SELECT CAST(floor(confidence * 10 + 0.5) AS BIGINT) AS k FROM nodes) SELECT printf('%.1f-%.1f', k / 10e0, (k + 1) / 10e0) AS band, count(*) AS n FROM c GROUP BY k")
def confidence_histogram(spark, sf):
    return telemetry.confidence_histogram(nodes(spark, sf))


@query("recent_feed", "SELECT event_id AS id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts DESC, id DESC LIMIT 50")
def recent_feed(spark, sf):
    return telemetry.recent(calls(spark, sf).select("id", "ts"), F.lit("2024-01-10").cast("timestamp"), 50)


@query("latest_per_session", f"WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS k FROM calls) SELECT id, session_id, ts, tool FROM r WHERE k = 1")
def latest_per_session(spark, sf):
    return telemetry.latest_per(calls(spark, sf).select("id", "session_id", "ts", "tool"), "session_id", "ts", "id")


@query("level_ratios", f"WITH {NODES}, c AS (SELECT level, count(*) AS n FROM nodes GROUP BY level) SELECT level, n, round(n / CAST(lead(n) OVER (ORDER BY level) AS DOUBLE), 6) AS ratio FROM c")
def level_ratios(spark, sf):
    return telemetry.level_ratios(nodes(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query("json_props_stats", "WITH p AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, round(avg(k), 6) AS mean FROM p GROUP BY event_type")
def json_props_stats(spark, sf):
    return telemetry.json_stats(events(spark, sf), "props", "k", "event_type").withColumn("mean", F.round("mean", 6))


@query("pressure_phases", "WITH u AS (SELECT event_id, user_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 3000 AS used FROM events), p AS (SELECT *, CASE WHEN used >= 0.95 THEN 'critical' WHEN used >= 0.85 THEN 'aggressive' WHEN used >= 0.7 THEN 'warn' ELSE 'normal' END AS phase FROM u) SELECT event_id AS id, phase, coalesce(phase <> lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS first FROM p")
def pressure_phases(spark, sf):
    turns = calls(spark, sf).withColumn("tokens", F.col("value"))
    return telemetry.pressure(turns, 3000).select("id", "phase", "first")


@query("feedback_attribution", "WITH f AS (SELECT event_id AS node_id, ts AS at_ts FROM events WHERE event_type = 'purchase'), l AS (SELECT event_id AS id, ts, event_id % 97 AS g FROM events WHERE event_type = 'view') SELECT f.g AS node_id, f.at_ts AS \"at\", arg_max(l.id, (l.ts, l.id)) AS log_id FROM (SELECT DISTINCT node_id % 97 AS g, at_ts FROM f) f JOIN l ON l.g = f.g AND l.ts <= f.at_ts GROUP BY f.g, f.at_ts")
def feedback_attribution(spark, sf):
    e = events(spark, sf)
    log = e.filter("event_type = 'view'").select(F.col("event_id").alias("id"), "ts", F.array(F.col("event_id") % 97).alias("ids"))
    feedback = e.filter("event_type = 'purchase'").select((F.col("event_id") % 97).alias("node_id"), F.col("ts").alias("at")).distinct()
    return telemetry.attribution(log, feedback).filter("log_id IS NOT NULL")


# ---- mining ----

def _intent_sql() -> str:
    cols, score = [], []
    for name, patterns in mining.INTENTS:
        q = [p.replace("'", "''") for p, _ in patterns]
        s = " + ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {w} ELSE 0 END" for p, (_, w) in zip(q, patterns))
        at = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN strpos(t, regexp_extract(t, '(?i){p}')) ELSE 1000000000 END" for p in q)
        first = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN length(regexp_extract(t, '(?is)^(.*?)(?:{p})', 1)) ELSE 1000000000 END" for p in q)
        cols.append(f"{s} AS s_{name}, least({first}, 1000000000) AS f_{name}")
        score.append(name)
    best = ", ".join(f"{{'neg': -s_{n}, 'first': f_{n}, 'rank': {i}, 'intent': '{n}'}}" for i, n in enumerate(score))
    total = " + ".join(f"s_{n}" for n in score)
    return f"WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), y AS (SELECT conv_id, turn, {', '.join(cols)} FROM x), z AS (SELECT conv_id, turn, list_min([{best}]) AS b, {total} AS total FROM y)"


@query("intent_classify", _intent_sql() + " SELECT conv_id, turn, CASE WHEN total = 0 THEN 'implement' ELSE b.intent END AS intent, CASE WHEN total = 0 THEN 0e0 ELSE floor(-b.neg / CAST(total AS DOUBLE) * 100 + 0.5e0) / 100e0 END AS confidence FROM z")
def intent_classify(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", mining.classify_intent(F.col("text")).alias("c")).select("conv_id", "turn", "c.intent", "c.confidence")


_SAID = "CASE event_id % 9 WHEN 0 THEN 'please fix the broken build' WHEN 1 THEN 'add a feature' WHEN 2 THEN 'explain how does it work' WHEN 3 THEN 'plan the roadmap' WHEN 4 THEN 'run the tests to verify' WHEN 5 THEN 'search the docs' WHEN 6 THEN 'choose between the options' WHEN 7 THEN 'summarize the lessons' ELSE 'hello' END || CASE WHEN user_id % 4 = 0 THEN ' and test it' ELSE '' END"


@query("intent_distribution", _intent_sql().replace("SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations", f"SELECT event_id AS conv_id, 0 AS turn, {_SAID} AS t FROM events") + ", i AS (SELECT CASE WHEN total = 0 THEN 'implement' ELSE b.intent END AS intent, CASE WHEN total = 0 THEN 0e0 ELSE floor(-b.neg / CAST(total AS DOUBLE) * 100 + 0.5e0) / 100e0 END AS c FROM z) SELECT intent, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM i) AS DOUBLE), 6) AS share, count(*) FILTER (WHERE c < 0.5) AS low FROM i GROUP BY intent")
def intent_distribution(spark, sf):
    return mining.intent_distribution(events(spark, sf).select(F.expr(_SAID).alias("text")), F.col("text")).withColumn("share", F.round("share", 6))


_LINES = "ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("fact_lines", rf"WITH {_LINES}, f AS (SELECT source, doc_id, line_no, trim(regexp_replace(line, '^[-*\s]+', '')) AS fact FROM ln), g AS (SELECT source, fact, min((doc_id, line_no)) AS place FROM f WHERE length(fact) >= 20 AND regexp_matches(fact, '{mining.FACT}') GROUP BY ALL), r AS (SELECT source, fact, CAST(row_number() OVER (PARTITION BY source ORDER BY place) AS INT) AS rank FROM g) SELECT source, fact, rank FROM r WHERE rank <= 10")
def fact_lines(spark, sf):
    return mining.fact_lines(docs(spark, sf), "doc_id", "text", "source", 10)


_NOTE = "concat('edit src/file', event_id % 40, '.py with git', chr(10), '- always use tool', event_id % 7, chr(10), 'the user prefers option ', user_id % 9, chr(10), CASE WHEN event_id % 3 = 0 THEN 'we decided to ship it' ELSE 'run pip and node' END)"
_NOTED = f"ln AS (SELECT event_id AS doc_id, unnest(string_split({_NOTE}, chr(10))) AS line FROM events)"
_KEYS = "k AS (SELECT DISTINCT doc_id, 'file' AS category, unnest(regexp_extract_all(line, '" + mining.FILES + "')) AS key FROM ln UNION SELECT DISTINCT doc_id, 'tool', unnest(regexp_extract_all(line, '" + mining.TOOLS + "')) FROM ln " + " ".join(rf"UNION SELECT DISTINCT doc_id, '{c}', substr(regexp_replace(line, '^[-*#\s]+', ''), 1, 80) FROM ln WHERE regexp_matches(line, '{p}')" for c, p in mining.SAYINGS.items()) + ")"


def _notes(spark, sf):
    return events(spark, sf).select(F.col("event_id").alias("doc_id"), F.expr(_NOTE).alias("text"))


@query("pattern_mining", f"WITH {_NOTED}, {_KEYS}, c AS (SELECT category, key, count(DISTINCT doc_id) AS nodes FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY nodes DESC, key) AS x FROM c) SELECT category, key, nodes FROM r WHERE x <= 10")
def pattern_mining(spark, sf):
    return mining.patterns(_notes(spark, sf), "doc_id", "text")


@query("pattern_nodes", f"WITH {_NOTED}, {_KEYS}, c AS (SELECT category, key, count(DISTINCT doc_id) AS nodes FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY nodes DESC, key) AS x FROM c) SELECT DISTINCT r.category, r.key, k.doc_id AS id FROM r JOIN k ON k.category = r.category AND k.key = r.key WHERE x <= 10")
def pattern_nodes(spark, sf):
    return mining.pattern_nodes(_notes(spark, sf), "doc_id", "text")


@query("line_runs", f"WITH {_LINES}, m AS (SELECT *, coalesce(CAST(lag(line) OVER w <> line AS INT), 1) AS new FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m) SELECT doc_id AS id, CAST(min(line_no) AS INT) AS start, any_value(line) AS line, count(*) AS n FROM g GROUP BY doc_id, run HAVING count(*) >= 2")
def line_runs(spark, sf):
    return mining.line_runs(docs(spark, sf), "doc_id", "text")


@query("error_context", f"WITH {_LINES}, m AS (SELECT *, regexp_matches(line, '(?i)(license|password|trash)') AS is_error FROM ln), n AS (SELECT *, bool_or(is_error) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM m) SELECT doc_id AS id, CAST(line_no AS INT) AS line_no, line, is_error FROM n WHERE near")
def error_context(spark, sf):
    return mining.error_context(docs(spark, sf), "doc_id", "text", 3, "(?i)(license|password|trash)")


_SCORE = " + ".join([f"CASE WHEN contains(lower(line), '{w}') THEN 5 ELSE 0 END" for w in mining.SIGNALS] + [f"CASE WHEN contains(lower(line), '{w}') THEN 3 ELSE 0 END" for w in ("license", "the")])


@query("relevance_trim", f"WITH {_LINES}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ln), s AS (SELECT doc_id, line_no, line, n, {_SCORE} + CASE WHEN line_no < 3 THEN 4 - line_no ELSE 0 END + CASE WHEN line_no + 3 >= n THEN 1 ELSE 0 END - CASE WHEN trim(line) = '' THEN 1 ELSE 0 END AS score FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (line_no < 3 OR score >= 15) DESC, score DESC, line_no) AS r FROM s) SELECT doc_id AS id, CAST(line_no AS INT) AS line_no, line, CAST(score AS INT) AS score FROM r WHERE line_no < 3 OR score >= 15 OR r <= 5 OR n <= 8")
def relevance_trim(spark, sf):
    return mining.relevance_trim(docs(spark, sf), "doc_id", "text", ["license", "the"])


@query("exact_dups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf):
    return mining.exact_duplicates(docs(spark, sf), "doc_id", "text")


_G = "list_distinct([substr(text, i, 3) FOR i IN range(1, greatest(2, length(text) - 1))])"


@query("trigram_dups", f"WITH o AS (SELECT conv_id, text, min(turn) AS id FROM conversations WHERE length(text) >= 3 GROUP BY ALL), g AS (SELECT conv_id, id, {_G} AS g FROM o), p AS (SELECT a.id AS a, b.id AS b, a.conv_id, len(list_intersect(a.g, b.g)) AS met, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.id < b.id) SELECT a, b, round(met / CAST(na + nb - met AS DOUBLE), 6) AS similarity FROM p WHERE met / CAST(na + nb - met AS DOUBLE) >= 0.3")
def trigram_dups(spark, sf):
    turns = src.table(spark, sf, "conversations")
    return compress.near_outputs(turns, "turn", "text", "conv_id", 0.3).withColumn("similarity", F.round("similarity", 6))


_LOG = "concat('2024-01-01 10:00:00 ', CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'debugger' ELSE 'TRACE' END, ' user ', user_id, chr(10), CASE WHEN event_id % 5 = 0 THEN 'DEBUG done' ELSE '' END)"


@query("log_severity", rf"WITH l AS (SELECT upper(unnest(string_split({_LOG}, chr(10)))) AS u FROM events) SELECT CASE WHEN regexp_matches(u, '\bERROR\b') THEN 'ERROR' WHEN regexp_matches(u, '\b(WARNING|WARN)\b') THEN 'WARN' WHEN regexp_matches(u, '\bINFO\b') THEN 'INFO' WHEN regexp_matches(u, '\bDEBUG\b') THEN 'DEBUG' WHEN regexp_matches(u, '\bTRACE\b') THEN 'TRACE' ELSE 'unknown' END AS severity, count(*) AS n FROM l WHERE u <> '' GROUP BY 1")
def log_severity(spark, sf):
    return compress.log_severity(events(spark, sf).select("event_id", F.expr(_LOG).alias("text")), "event_id", "text")


# ---- evaluation ----

_RANKED = "q AS (SELECT vec_id AS query_id, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.query_id, q.ql, e.vec_id AS id, e.label, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.query_id), need AS (SELECT query_id, count(*) AS need FROM s WHERE label = ql GROUP BY query_id)"


@query("eval_hitrate_mrr", f"WITH {_RANKED}, k AS (SELECT unnest([3, 5, 10]) AS k), h AS (SELECT need.query_id, k.k, need.need, (SELECT count(*) FROM s WHERE s.query_id = need.query_id AND s.label = s.ql AND s.rank <= k.k) AS h, (SELECT min(s.rank) FROM s WHERE s.query_id = need.query_id AND s.label = s.ql AND s.rank <= k.k) AS f FROM need CROSS JOIN k) SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate, round(avg(h / CAST(need AS DOUBLE)), 6) AS recall, round(avg(h / CAST(k AS DOUBLE)), 6) AS precision, round(avg(coalesce(1e0 / f, 0e0)), 6) AS mrr FROM h GROUP BY k")
def eval_hitrate_mrr(spark, sf):
    v = vectors(spark, sf)
    queries = v.filter("vec_id % 20 = 0")
    ranked = dense.knn_queries(v, queries, "vec_id", "embedding", 10)
    m = evaluate.label_metrics(ranked, queries.select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("id"), "label"))
    return m.select("k", *[F.round(c, 6).alias(c) for c in ("hit_rate", "recall", "precision", "mrr")])


_TOK1 = TOK.replace(">= 2", ">= 1")


@query("token_f1", f"WITH t AS (SELECT conv_id, turn, {_TOK1.format(x='text')} AS p, lead({_TOK1.format(x='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations), s AS (SELECT conv_id % 5 AS category, CASE WHEN len(p) = 0 OR len(e) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(list_distinct(p), list_distinct(e))) / (len(p) + len(e)) END AS f1 FROM t WHERE e IS NOT NULL) SELECT CAST(category AS VARCHAR) AS category, count(*) AS n, round(avg(f1), 6) AS f1 FROM s GROUP BY category UNION ALL SELECT 'overall', count(*), round(avg(f1), 6) FROM s")
def token_f1(spark, sf):
    from pyspark.sql import Window

    turns = src.table(spark, sf, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next IS NOT NULL")
    return evaluate.f1_report(turns.withColumn("category", F.col("conv_id") % 5), "category", "text", "next").withColumn("f1", F.round("f1", 6))


@query("replay_scores", "WITH sh AS (SELECT DISTINCT 'even' AS strategy, user_id AS query_id, event_id % 50 AS id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT DISTINCT 'odd', user_id, event_id % 50 FROM events WHERE event_id % 2 = 1), ev AS (SELECT DISTINCT user_id AS query_id, event_id % 50 AS id FROM events WHERE event_type = 'purchase'), p AS (SELECT strategy, sh.query_id, count(ev.id) / CAST(count(*) AS DOUBLE) AS a FROM sh LEFT JOIN ev ON ev.query_id = sh.query_id AND ev.id = sh.id GROUP BY ALL) SELECT strategy, count(*) AS queries, round(avg(a), 6) AS score FROM p GROUP BY strategy")
def replay_scores(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("id"), "event_type", (F.col("event_id") % 2).alias("odd"))
    shown = e.select(F.when(F.col("odd") == 0, "even").otherwise("odd").alias("strategy"), "query_id", "id")
    return evaluate.replay(shown, e.filter("event_type = 'purchase'").select("query_id", "id")).withColumn("score", F.round("score", 6))


# ---- reports and consolidation ----


@query("context_check", f"WITH {NODES}, k AS (SELECT level, ceil(length(substr(content, 1, 200000)) / 4e0) AS t FROM nodes WHERE NOT (type IN ('storedcontext', 'contexthistory') OR label LIKE 'middle-term:%')) SELECT level, count(*) AS nodes, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) / 128000e0, 6) AS share, sum(t) / 128000e0 > 0.8 AS over FROM k GROUP BY ROLLUP (level)")
def context_check(spark, sf):
    return reports.context_check(nodes(spark, sf)).withColumn("share", F.round("share", 6))


@query("store_overview", f"WITH {NODES} SELECT count(*) AS nodes, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT type) AS types, round(avg(CASE WHEN embedding IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS embedded, round(avg(importance), 6) AS importance FROM nodes LEFT JOIN embeddings ON vec_id = id")
def store_overview(spark, sf):
    both = nodes(spark, sf).join(vectors(spark, sf), F.col("id") == F.col("vec_id"), "left")
    return reports.store_overview(both, "embedding").withColumns({c: F.round(c, 6) for c in ("embedded", "importance")})


@query("top_accessed", f"WITH {NODES} SELECT id, label, access_count FROM nodes ORDER BY access_count DESC, id LIMIT 5")
def top_accessed(spark, sf):
    return reports.most(nodes(spark, sf), "access_count")


@query("tool_extremes", "SELECT event_type AS tool, count(*) AS calls, arg_max(event_id, (value, -event_id)) AS slowest, arg_max(event_id, (length(props), -event_id)) AS heaviest, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error') > 0.2 * count(*) AS failing FROM events GROUP BY event_type")
def tool_extremes(spark, sf):
    log = events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), F.length("props").alias("tokens"), (F.col("event_type") != "error").alias("success"))
    return reports.tool_extremes(log)


@query("costly_messages", f"WITH m AS (SELECT {_TURN} AS id, CAST(ceil(length(coalesce(text, '')) / 4e0) AS BIGINT) AS cost FROM conversations WHERE contains(lower(text), 'the')) SELECT id, cost FROM m WHERE cost >= 20 ORDER BY cost DESC, id LIMIT 50")
def costly_messages(spark, sf):
    turns = src.table(spark, sf, "conversations").withColumn("id", F.expr(_TURN))
    return reports.costly_messages(turns, "text", contains="the", least=20).select("id", "cost")


@query("archived_context", f"WITH {NODES} SELECT id, created_ms FROM nodes WHERE type IN ('contexthistory', 'storedcontext') AND contains(lower(content), 'the') ORDER BY created_ms DESC, id LIMIT 10")
def archived_context(spark, sf):
    return reports.archived(nodes(spark, sf), words="the").select("id", "created_ms")


@query("snapshots", f"WITH {NODES} SELECT id, label, substr(label, 13) AS session_id, created_ms FROM nodes WHERE label LIKE 'middle-term:%' ORDER BY created_ms DESC, id LIMIT 20")
def snapshots(spark, sf):
    return reports.snapshots(nodes(spark, sf))


@query("reflect", f"WITH {CALLS}, b AS (SELECT 'tool' AS kind, tool AS key FROM calls WHERE NOT success UNION ALL SELECT 'file', file FROM calls WHERE NOT success) SELECT kind, key, count(*) AS failures, CASE WHEN kind = 'tool' AND key = 'error' THEN 'stop and read' WHEN kind = 'file' THEN 'read the file again before it is changed' ELSE 'look at the last failures of this tool' END AS advice FROM b WHERE key IS NOT NULL GROUP BY kind, key HAVING count(*) >= 2")
def reflect(spark, sf):
    return reports.reflect(calls(spark, sf), {"error": "stop and read"})


@query("registry_liveness", "SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 AND event_type = 'click' THEN 'compacted' WHEN event_type = 'click' THEN 'archived' ELSE 'live' END AS state FROM events")
def registry_liveness(spark, sf):
    e = events(spark, sf)
    registry = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "click", "archived").otherwise("live").alias("state"))
    return reports.liveness(registry, e.filter("event_id % 7 = 0").select(F.col("event_id").alias("message_id"))).select("id", "state")


@query("unseen_nodes", f"WITH {NODES} SELECT id FROM nodes WHERE importance >= 0.6 AND type <> 'note' AND id % 5 <> 0")
def unseen_nodes(spark, sf):
    n = nodes(spark, sf)
    return reports.unseen(n, n.filter("id % 5 = 0").select("id"), 0.6, ("note",)).select("id")



@query("compressed_clusters", rf"WITH {NODES}, m AS (SELECT project AS cluster, level, importance, id, content, list_filter(list_transform(string_split_regex(content, '[.!?\n]'), lambda x: trim(x)), lambda x: length(x) > 20) AS parts FROM nodes), l AS (SELECT cluster, concat('- ', coalesce(substr(parts[1], 1, 220), substr(content, 1, 220))) AS line, row_number() OVER (PARTITION BY cluster ORDER BY importance DESC, id) AS r FROM m), t AS (SELECT cluster, string_agg(line, chr(10) ORDER BY r) AS content FROM l WHERE r <= 50 GROUP BY cluster) SELECT m.cluster, max(level) + 1 AS level, round(max(importance) * 0.9e0, 6) AS importance, count(*) AS size, sha256(any_value(t.content)) AS content FROM m JOIN t ON t.cluster = m.cluster GROUP BY m.cluster HAVING count(*) > 1")
def compressed_clusters(spark, sf):
    n = nodes(spark, sf)
    made = consolidate.compress_clusters(n.select("id", F.col("project").alias("cluster")), n)
    return made.select("cluster", "level", F.round("importance", 6).alias("importance"), "size", F.sha2("content", 256).alias("content"))


@query("theme_digest", f"WITH {NODES} SELECT type AS theme, count(*) AS nodes, round(avg(importance), 6) AS importance FROM nodes GROUP BY type")
def theme_digest(spark, sf):
    return consolidate.by_theme(nodes(spark, sf)).withColumn("importance", F.round("importance", 6))


@query("monthly_trend", f"WITH {NODES} SELECT strftime(make_timestamp(created_ms * 1000), '%Y-%m') AS month, count(*) AS nodes, round(avg(importance), 6) AS importance FROM nodes GROUP BY 1")
def monthly_trend(spark, sf):
    return consolidate.trend(nodes(spark, sf)).withColumn("importance", F.round("importance", 6))


@query("structured_summary")
def structured_summary(spark, sf):
    return consolidate.structured_summary(docs(spark, sf), "doc_id", "text")


from . import operations as _operations, outputs as _outputs  # noqa: E402, F401  they register their queries here
