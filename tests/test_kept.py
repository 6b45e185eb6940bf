"""Kept indexes, communities and walks against plain versions."""

import math
import random
from collections import Counter

import pytest
from mnemosaic.operators import annindex, community, dense, graph, inverted, lexical
from mnemosaic.sources.shared import Scratch, Segments, names
from pyspark.sql import functions as F

WORDS = "the data of quick brown fox jumps over lazy dog index block term".split()


def some_rows(rng, n, start=0):
    return [(start + i, rng.choice([None, "a", "b"]), " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(0, 30)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, scope string, text string")


def same_scores(got, want):
    got, want = ({r[0]: r[-1] for r in x} for x in (got, want))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_entries_of_an_index_carry_their_bounds(spark):
    rows = some_rows(random.Random(3), 300)
    index = inverted.InvertedIndex(spark, f"{Scratch(spark, 'i').root}/x")
    index.insert(frame(spark, rows).repartition(2), "id", F.col("text"), "scope")
    kept = spark.read.parquet(index.segments.path(0, "entries")).collect()
    words = {i: Counter(w for w in t.split() if len(w) > 1) for i, _, t in rows}
    scope, length = {r[0]: r[1] for r in rows}, {i: sum(c.values()) for i, c in words.items()}
    assert sorted((i, r.term, tf, dl) for r in kept for i, tf, dl in zip(r.ids, r.tfs, r.dls)) == sorted((i, w, n, length[i]) for i, c in words.items() for w, n in c.items())
    assert all((r.n, r.max_tf, r.min_dl) == (len(r.ids), max(r.tfs), min(r.dls)) and r.ids == sorted(r.ids) and {scope[i] for i in r.ids} == {r.scope} for r in kept)


@pytest.mark.parametrize("bits", [1, 8])
def test_index_equals_a_rebuild_after_any_changes(spark, monkeypatch, bits):
    monkeypatch.setattr(inverted, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = {r[0]: r for r in [*some_rows(rng, 120), (500, "a", None), (501, None, "")]}
    index = inverted.InvertedIndex(spark, f"{Scratch(spark, 'i').root}/x")
    assert index.bm25_topk("the data", 5).count() == 0
    index.insert(frame(spark, list(rows.values())), "id", F.col("text"), "scope")
    for step in range(3):
        gone = rng.sample(sorted(rows), 15)
        index.delete(frame(spark, [rows.pop(i) for i in gone] + [(9999, "a", "never there")]))
        changed = [(i, rng.choice(["a", "c"]), "data data " + (rows[i][2] or "")) for i in rng.sample(sorted(rows), 10)]
        rows |= {r[0]: r for r in changed}
        index.update(frame(spark, changed), "id", F.col("text"), "scope")
        added = some_rows(rng, 12, 1000 * (step + 1)) + [(gone[0], "b", "the fox index")]
        rows |= {r[0]: r for r in added}
        index.insert(frame(spark, added), "id", F.col("text"), "scope")
        if step == 1:
            index.merge()
    whole = frame(spark, list(rows.values()))
    for q in ("the data of", "term index the the", "absent", "fox"):
        same_scores(index.bm25_topk(q, 10).collect(), lexical.bm25_topk(whole, "id", F.col("text"), q, 10).collect())
        same_scores(index.raw(q).collect(), lexical.bm25_raw(whole, "id", F.col("text"), q).collect())
    scan = {(r.id, r.scope): round(r.score, 9) for r in lexical.bm25_scoped(whole, "id", F.col("text"), "the data fox", 12).collect()}
    assert {(r.id, r.scope): round(r.score, 9) for r in index.bm25_scoped("the data fox", 12).collect()} == scan
    assert {tuple(r) for r in index.postings().collect()} == {tuple(r) for r in lexical.postings(whole, "id", F.coalesce("text", F.lit(""))).collect()}


def test_blocks_that_cannot_hold_the_best_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_BITS", 4)
    rows = [(i, None, "the " + "filler " * 40) for i in range(2000)] + [(5000 + i, None, "the the the the") for i in range(20)]
    index = inverted.InvertedIndex(spark, f"{Scratch(spark, 'i').root}/x")
    index.insert(frame(spark, rows).coalesce(1), "id", F.col("text"))
    read = []
    whole = index._scored
    monkeypatch.setattr(index, "_scored", lambda live, entries, *a: read.append(entries.count()) or whole(live, entries, *a))
    assert {r.id for r in index.bm25_topk("the", 10).collect()} <= set(range(5000, 5020)) and max(read) < 20 < index._of_terms("bounds", inverted.BOUND, [0], ["the"]).count()


def test_a_failed_writer_leaves_the_last_state(spark):
    segments = Segments(spark, f"{Scratch(spark, 's').root}/x")
    segments.publish({"live": [0], "next": 1})
    spark.range(3).write.parquet(segments.path(1, "t"))  # and no publication
    assert segments.state() == {"live": [0], "next": 1} and segments.read("t", [0], "id bigint").count() == 0
    assert names(spark, f"{segments.root}/manifests") == ["0.json"] and segments.number(segments.state()) == 2


def test_vector_index_inserts_deletes_and_finds(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = annindex.VectorIndex(spark, f"{Scratch(spark, 'v').root}/x")
    index.insert(v.filter("id % 3 <> 0"), "id", "embedding")  # builds it
    index.insert(v.filter("id % 3 = 0").unionByName(spark.createDataFrame([(7777, None)], "id long, embedding array<float>")), "id", "embedding")
    index.delete(v.filter("id % 4 = 0"))
    index.insert(v.filter("id % 8 = 0"), "id", "embedding")
    left = v.filter("id % 4 <> 0 OR id % 8 = 0")
    q = v.filter("id = 5").first().embedding
    exact = [(r.id, round(r.score, 6)) for r in dense.knn(left, "id", "embedding", q, 10).collect()]
    assert [(r.id, round(r.score, 6)) for r in index.search(q, 10, probes=1000).collect()] == exact
    index.rebuild()
    assert index.points().count() == left.count()
    assert [(r.id, round(r.score, 6)) for r in index.search(q, 10, probes=1000).collect()] == exact
    plan = index.points([0])._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters:")[1].split("\n")[0]
    asked = left.filter("id % 20 = 1")
    want = {(r.query_id, r.id) for r in dense.knn_queries(left, asked, "id", "embedding", 10).collect()}
    some = {(r.query_id, r.id) for r in index.search_many(asked, "id", "embedding", 10, block=16).collect()}
    state = index.segments.state()
    assert len(some & want) >= 0.9 * len(want) and state["probes"] < len(index._centres(state))


def test_a_node_counts_by_its_best_segment(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7]), (3, [0.0, 0.0]), (3, [-1.0, 0.0])]
    index = annindex.VectorIndex(spark, f"{Scratch(spark, 'v').root}/x")
    index.build(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", cells=2)
    got = [(r.id, round(r.score, 3)) for r in index.search([0.0, 2.0], 5, probes=2).collect()]
    assert got == [(1, 1.0), (2, 0.707), (3, 0.0)]


def test_blocks_of_any_size_give_the_same_pairs(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 120")
    for least in (-1.0, 0.2):
        pairs = [sorted((r.a, r.b, round(r.cosine, 9)) for r in dense.similar_pairs(v, "vec_id", "embedding", least, block=b).collect()) for b in (1000, 17)]
        assert pairs[0] == pairs[1] and pairs[0]
    asked = v.filter("vec_id % 7 = 0")
    best = [sorted((r.query_id, r.rank, r.id) for r in dense.knn_queries(v, asked, "vec_id", "embedding", 4, block=b).collect()) for b in (1000, 11)]
    assert best[0] == best[1] and len(best[0]) == 4 * asked.count()


def plain_louvain(edges):
    """One node at a time, until nothing gains; then contraction."""
    w = Counter()
    for a, b in edges:
        w[a, b] += 1
        w[b, a] += 1
    total, names_ = sum(w.values()), sorted({a for a, _ in w})
    member = {n: n for n in names_}
    while True:
        k = Counter()
        for (a, _), x in w.items():
            k[a] += x
        at, moved = {n: n for n in k}, False
        tot = Counter(k)
        again = True
        while again:
            again = False
            for n in sorted(k):
                ties = Counter({at[n]: 0})
                for (a, b), x in w.items():
                    if a == n and b != n:
                        ties[at[b]] += x
                tot[at[n]] -= k[n]
                best = max(sorted(ties), key=lambda c: (ties[c] - k[n] * tot[c] / total))
                if ties[best] - k[n] * tot[best] / total > ties[at[n]] - k[n] * tot[at[n]] / total + 1e-9:
                    at[n], again, moved = best, True, True
                tot[at[n]] += k[n]
        if not moved:
            return member
        member = {n: at[c] for n, c in member.items()}
        up = Counter()
        for (a, b), x in w.items():
            up[at[a], at[b]] += x
        w = up


def test_louvain_is_as_good_as_a_plain_one(spark):
    rng = random.Random(3)
    planted = [(a, b) for a in range(48) for b in range(a) if rng.random() < (0.5 if a // 12 == b // 12 else 0.03)]
    ring = [(i, (i + 1) % 30) for i in range(30)]
    cliques = [(6 * c + i, 6 * c + j) for c in range(6) for i in range(6) for j in range(i)] + [(6 * c, (6 * c + 6) % 36) for c in range(6)]
    for edges in (planted, ring, cliques):
        e = spark.createDataFrame(edges, "src long, dst long")
        found = community.louvain(e, Scratch(spark, "l"))
        plain = spark.createDataFrame(sorted(plain_louvain(edges).items()), "id long, community long")
        assert found.count() == len({x for p in edges for x in p})
        assert community.modularity(e, found) >= community.modularity(e, plain) - 0.02


def test_louvain_on_a_star_and_on_nothing(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(None, 3)], "src long, dst long")
    assert community.louvain(star, Scratch(spark, "l")).select("community").distinct().count() == 1
    assert community.louvain(star.limit(0), Scratch(spark, "l")).count() == 0


def test_walks_have_linear_plans_and_plain_results(spark):
    rng = random.Random(9)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(90)})
    e = spark.createDataFrame([(*x, 0.5 + (x[0] + x[1]) % 5 / 10) for x in edges], "src long, dst long, confidence double")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front = {0: 0}, {0}
    for h in range(1, 9):
        front = {b for a in front for b in near.get(a, ())} - set(seen)
        seen |= {b: h for b in front}
    found = graph.hops(e, spark.createDataFrame([(0,)], "id long"), 8)
    assert {r.id: r.hops for r in found.collect()} == seen
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    score, best = {0: 1.0}, {0: 1.0}
    for _ in range(8):
        new = {}
        for a, s in score.items():
            for x, y in edges:
                for p, q in ((x, y), (y, x)):
                    if p == a:
                        new[q] = max(new.get(q, 0), s * (0.5 + (x + y) % 5 / 10) * 0.8)
        score = new
        best |= {k: max(v, best.get(k, 0)) for k, v in new.items()}
    got = {r.id: r.score for r in graph.hop_scores(e, spark.createDataFrame([(0, 1.0)], "id long, score double"), 8).collect()}
    assert got.keys() == best.keys() and all(math.isclose(got[k], best[k], rel_tol=1e-12) for k in got)
    paths, front = {0: [0]}, {0: [0]}
    for _ in range(6):
        met = {}
        for a, p in front.items():
            for x, y in edges:
                if x == a and y not in paths:
                    met[y] = min(met.get(y, [1 << 60]), [*p, y])
        paths |= met
        front = met
    assert {r.id: r.path for r in graph.shortest_paths(e, 0, 6).collect()} == paths
