"""Fitted weights, the chain of rerankers, leaders in rounds, and schemas of JSON output."""

import numpy as np
import pytest
from mnemosaic.operators import dense, jsonschema, rerank

NAMES = ["a", "b", "c"]


def test_known_weights_are_recovered_from_preferences(spark):
    rng, true = np.random.default_rng(5), np.array([2.0, -1.0, 0.5])
    rows = []
    for q in range(1500):
        x = rng.normal(size=(2, 3))
        p = 1 / (1 + np.exp(-(x[0] - x[1]) @ true))
        won = int(rng.random() >= p)
        rows += [(q, k == won, *map(float, x[k])) for k in range(2)]
    lists = spark.createDataFrame(rows, "query_id long, chosen boolean, a double, b double, c double")
    pairs = rerank.preferences(lists, NAMES)
    got = rerank.fit_weights(pairs, NAMES, l2=1e-6)
    assert np.allclose([got[n] for n in NAMES], true, atol=0.25)
    d = np.array([[r.a, r.b, r.c] for r in pairs.collect()])
    w = np.array([got[n] for n in NAMES])
    assert np.abs((1 / (1 + np.exp(d @ w))) @ d / len(d) - 1e-6 * w).max() < 1e-7  # where the gradient is zero
    assert rerank.fit_weights(pairs.limit(0), NAMES) == dict.fromkeys(NAMES, 0.0)
    assert rerank.normalised({"a": 3.0, "b": -1.0, "c": 1.0}) == {"a": 0.75, "b": 0.0, "c": 0.25} and sum(rerank.normalised({"a": -1.0, "b": 0.0}).values()) == 1


def test_a_chain_of_rerankers_falls_back(spark):
    def fails():
        return lambda query, texts: 1 / 0

    def knows_some():
        return lambda query, texts: [1.0 if "fox" in t else None for t in texts]

    rerank.register("fails", fails)
    rerank.register("some", knows_some)
    rerank.register("absent", fails, available=lambda: False)
    pool = spark.createDataFrame([(1, "the quick fox", 0.1), (2, "lazy dog", 0.5), (3, None, 0.9)], "id long, content string, score double")
    got = {r.id: (round(r.final, 6), r.by) for r in rerank.rerank(pool, "quick dog", 3, ("absent", "unknown", "fails", "some")).collect()}
    assert got == {1: (0.37, "some"), 2: (0.5, "words"), 3: (0.63, "words")}
    got = [(r.id, r.by) for r in rerank.rerank(pool, "quick dog", 2, ("overlap",)).collect()]
    assert got == [(3, "overlap"), (2, "overlap")] and "overlap" in rerank.registered()


@pytest.mark.parametrize("block", [4096, 7])
def test_leaders_in_rounds_are_those_of_one_pass(spark, block):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3, [None, "x", "y"][i % 3] if i % 10 else None, rng.normal(size=4).tolist()) for i in rng.permutation(150)] + [(999, "x", None)]
    frame = spark.createDataFrame(rows, "id long, g string, v array<double>")
    want = {}
    for g in (None, "x", "y"):
        leaders = []
        for i, _, v in sorted(r for r in rows if r[1] == g and r[2] is not None):
            u = np.array(v) / np.linalg.norm(v)
            want[i] = next((j for j, w in leaders if u @ w >= 0.6), i)
            if want[i] == i:
                leaders.append((i, u))
    got = {r.id: r.leader for r in dense.leader_clusters(frame, "g", "id", "v", 0.6, shortest=1, block=block).collect()}
    assert got == want
    assert dense.leader_clusters(frame.limit(0), "g", "id", "v").count() == 0


def test_schemas_merge_types_and_count_what_is_no_json(spark):
    rows = [("t", '{"a": 1}'), ("t", '{"a": "x", "b": [1]}'), ("t", "nope"), ("t", None), ("u", "broken {")]
    got = {r.tool: (r.schema, r.n, r.broken) for r in jsonschema.schemas(spark.createDataFrame(rows, "tool string, text string"), ["tool"], "text").collect()}
    assert got == {"t": ("OBJECT<a: VARIANT, b: ARRAY<BIGINT>>", 2, 1), "u": ("VOID", 0, 1)}
