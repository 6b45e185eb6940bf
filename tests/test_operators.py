"""Small cases of single operators."""

import datetime as dt

import pytest
from mnemosaic.functions import scoring as sc
from mnemosaic.functions import text as tx
from mnemosaic.functions import vector as vx
from mnemosaic.operators import compress, consolidate, dense, evaluate, graph, hybrid, lexical, lifecycle, mining, reports, store, telemetry
from mnemosaic.sources import nodes as src
from mnemosaic.streaming import sessions
from pyspark.sql import functions as F

DAY = sc.DAY_MS


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_recency(spark):
    got = [r.x for r in spark.createDataFrame([(None,), (10 * DAY,), (0,)], "t long").select(sc.recency(F.col("t"), 10 * DAY).alias("x")).collect()]
    assert got[0] == got[1] == 1.0 and 0 < got[2] < 0.001


def test_quality(spark):
    rows = [("storedcontext", "x", 0.5), ("note", "middle-term:1", 0.6), ("x", "Knowledge:a", 1.25), ("x", "rule:a", 1.25), ("x", "lesson:a", 1.3), ("x", "plan:a", 1.1), ("skill", "z", 1.15), (None, None, 1.0)]
    got = spark.createDataFrame(rows, "type string, label string, want double").withColumn("got", sc.quality_multiplier(F.col("type"), F.col("label"))).collect()
    assert all(r.got == r.want for r in got)


def test_adaptive_multiplier_is_one_by_default_and_bounded(spark):
    f = lambda i, u, a: value(spark, sc.adaptive_multiplier(F.lit(i), F.lit(u), F.lit(a)))
    assert f(0.5, 0.0, 0) == 1.0 and f(1.0, 5.0, 0) == 1.5 and f(0.0, 0.0, 90) == 0.4


def test_intent_and_subtask_weights(spark):
    w = lambda i, c, t, s: value(spark, sc.intent_weight(i, F.lit(c), F.lit(t), F.lit(s).cast("string")))
    assert w("debug", "semantic", "bug", "experiential") == 1.4 and w("read", "episodic", "note", "experiential") == 0.6
    assert w(None, "episodic", "note", None) == 0.5 and w("discovery", "episodic", "note", None) == 1.0 and w("edit", "semantic", "x", None) == 1.2
    assert value(spark, sc.subtask_weight("editing", F.lit("editing"))) == 1.3 and value(spark, sc.subtask_weight(None, F.lit("editing"))) == 1.0


def test_affinity(spark):
    m = F.create_map(F.lit("debug"), F.lit(3), F.lit("plan"), F.lit(1))
    assert value(spark, sc.intent_affinity(m, "debug")) == 0.75 and value(spark, sc.intent_affinity(m, "decide")) == 0.0


def test_vectors(spark):
    a, b = vx.literal([3, 4]), vx.literal([4, 3])
    assert value(spark, vx.cosine(a, b)) == pytest.approx(0.96) and value(spark, vx.cosine(a, vx.literal([0, 0]))) == 0
    assert value(spark, vx.cosine_lenient(a, vx.literal([3, 4, 9]))) == pytest.approx(1) and value(spark, vx.l2_normalised(a)) == [0.6, 0.8]
    assert value(spark, vx.mean_pooled(F.array(a, b))) == [3.5, 3.5]
    with pytest.raises(Exception, match="differ in length"):
        value(spark, vx.cosine(a, vx.literal([1])))


def test_text_functions(spark):
    assert value(spark, tx.wiki_links(F.lit("see [[a b]] and [[a b]] [[c]]"))) == ["a b", "c"]
    assert value(spark, tx.label_refs(F.lit("fix bug:x-1 via decision:y, xbug:z"))) == ["bug:x-1", "decision:y"]
    assert value(spark, tx.js_round(F.lit(-2.5))) == -2 and value(spark, tx.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 1.0
    assert value(spark, tx.valid_label(F.lit("ok:Label.1"))) is True and value(spark, tx.valid_label(F.lit("-no"))) is False
    assert value(spark, tx.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"


NODE = "id long, scope string, label string, content string, type string, category string, level int, tags array<string>, importance double, usefulness double, confidence double, access_count int, created_ms long, updated_ms long, accessed_ms long, verified_ms long, expires_ms long, sticky boolean, status string, times_used int, times_helpful int, verification_count int, project string"


def node(i, **kw):
    base = dict(id=i, scope="project", label=f"n{i}", content=f"text {i}", type="note", category="episodic", level=0, tags=None, importance=0.5, usefulness=1.0, confidence=0.5, access_count=0, created_ms=0, updated_ms=0, accessed_ms=None, verified_ms=None, expires_ms=None, sticky=False, status="active", times_used=0, times_helpful=0, verification_count=0, project="p")
    return tuple({**base, **kw}.values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_expiry_and_prune(spark):
    t = table(spark, node(1, expires_ms=5), node(2, expires_ms=5, type="skill"), node(3, expires_ms=50), node(4))
    assert ids(lifecycle.expired(t, 10)) == [1] and ids(lifecycle.without_expired(t, 10)) == [2, 3, 4]
    p = table(spark, node(1, importance=0.1), node(2, importance=0.1, sticky=True), node(3, importance=0.1, label="persona"), node(4, importance=0.95), node(5, importance=0.3, access_count=9, updated_ms=100 * DAY))
    assert ids(lifecycle.prunable(p, 100 * DAY, min_importance=0.5)) == [1] and ids(lifecycle.prunable(p, 100 * DAY)) == []


def test_decay(spark):
    t = table(spark, node(1, usefulness=4.0), node(2, usefulness=4.0, type="skill"), node(3, usefulness=0.0), node(4, usefulness=4.0, accessed_ms=99 * DAY))
    got = {r.id: r.usefulness for r in lifecycle.decayed(t, 100 * DAY).collect()}
    assert got[1] == 0.1 and got[2] == 4.0 and got[3] == 0.0 and got[4] == 4.0


def test_supersession(spark):
    t = table(spark, node(1, label="a", type="fact", tags=["x"]), node(2, label="a", type="fact", tags=["x", "y"], created_ms=5), node(3, label="a", type="fact", tags=["z"], created_ms=9), node(4, label="a", scope="global"), node(5, label="b", type="note", created_ms=1), node(6, label="b", type="note", created_ms=2))
    assert {(r.id, r.superseded_by) for r in lifecycle.superseded(t).collect()} == {(1, 2)}


def test_changes_of_nodes(spark):
    t = table(spark, node(1), node(2, usefulness=0.2))
    one = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r for r in lifecycle.accessed(t, one, 7).collect()}
    assert got[1].access_count == 1 and got[1].confidence == 0.51 and got[2].access_count == 0
    assert {r.id: r.confidence for r in lifecycle.verified(t, one, 7).collect()}[1] == 0.7
    votes = spark.createDataFrame([(1, True), (2, False)], "id long, helpful boolean")
    got = {r.id: r for r in lifecycle.rated(t, votes).collect()}
    assert got[1].times_helpful == 1 and got[2].usefulness == 0.0
    used = spark.createDataFrame([(1, True, True, 0), (2, False, False, 3)], "id long, was_used boolean, was_helpful boolean, idle_turns int")
    got = {r.id: r.usefulness for r in lifecycle.judged(t, used).collect()}
    assert got == {1: 2.0, 2: 0.0}
    assert {r.id: r.label for r in store.update(t, spark.createDataFrame([(1, "new")], "id long, label string"), 9).collect()} == {1: "new", 2: "n2"}
    assert ids(store.delete(t, one, "id")) == [2]
    assert ids(store.seed_absent(t, table(spark, node(9, label="n1"), node(8, label="q")))) == [1, 2, 8]
    assert ids(store.merge_absent(t, table(spark, node(1), node(5)))) == [1, 2, 5]
    new = store.insert(t, table(spark, node(3, category="episodic", type="skill")).withColumn("summary", F.lit(None).cast("string")), 0).filter("id = 3").first()
    assert new.expires_ms == 30 * DAY and new.sticky


def test_filters(spark):
    t = table(spark, node(1, tags=["a", "b"]), node(2, tags=["ab"]), node(3, type="storedcontext"), node(4, status="superseded"))
    assert ids(store.filtered(t, tags=["a"])) == [1] and ids(store.filtered(t, tags_text=["a"])) == [1, 2] and ids(t.filter(store.searchable())) == [1, 2]


def test_prefix_must_be_clear(spark):
    t = table(spark, node(12), node(13), node(20))
    assert ids(store.by_prefix(t, "20")) == [20] and ids(store.by_prefix(t, "9")) == []
    with pytest.raises(Exception, match="several"):
        store.by_prefix(t, "1").collect()


def test_bm25(spark):
    d = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "common common")], "id long, text string")
    got = {r.id: r.score for r in lexical.bm25_topk(d, "id", F.col("text"), "rare common", 9).collect()}
    assert got[1] > got[2] > 0 and lexical.bm25_topk(d, "id", F.col("text"), "", 9).count() == 0
    assert lexical.bm25_topk(d, "id", F.col("text"), "absent", 9).count() == 0


def test_bm25_reads_the_texts_once_or_not_at_all(spark, sf):
    from mnemosaic.plans import catalogue

    for name, times in (("bm25_scan", 1), ("bm25_scoped_scan", 1), ("bm25_topk", 0), ("bm25_scoped", 0), ("hybrid_linear", 0)):
        frame = catalogue.QUERIES[name](spark, sf)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "text" in x.partition("[")[2].partition("]")[0]]
        assert len(scans) == times and ("ReusedExchange" in plan or not times), name


def test_rrf(spark):
    c = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.8, 0.0), (3, 0.1, 0.5)], "id long, semantic double, bm25 double").withColumn("accessed_ms", F.lit(None).cast("long"))
    got = {r.id: r for r in hybrid.reciprocal_ranks(c, 0).collect()}
    assert got[1].score == 1.0 and got[3].rrf > got[2].rrf
    assert {r.id: r.rrf for r in hybrid.reciprocal_ranks(c, 0, 0).collect()} == {r.id: r.rrf for r in hybrid.reciprocal_ranks(c, 0, 1).collect()}


def test_packing_skips_what_does_not_fit(spark):
    s = spark.createDataFrame([(1, 0.9, 60), (2, 0.8, 50), (3, 0.7, 40)], "id long, score double, cost int")
    assert [r.id for r in hybrid.pack(s, 100).orderBy("place").collect()] == [1, 3]
    assert [r.id for r in hybrid.pack(s, 500, most=1).collect()] == [1]


def test_bands_and_links(spark):
    a, b = (spark.createDataFrame(x, "id long, score double") for x in ([(1, 0.2)], [(1, 0.9), (2, 0.5)]))
    assert [(r.id, r.score) for r in hybrid.first_band([a, b], 5).collect()] == [(2, 0.5), (1, 0.2)]
    links = spark.createDataFrame([(1, 7), (1, None)], "source_id long, target_id long")
    assert {r.id: r.score for r in hybrid.expand_by_links(a, links, 3).collect()} == {1: 0.2, 7: pytest.approx(0.16)}


def test_search_modes(spark):
    t = table(spark, node(1, content="alpha beta"), node(2, content="alpha"), node(3, content="alpha", type="storedcontext"), node(4, content="alpha", expires_ms=1))
    t = src.with_classes(t.drop("category")).withColumn("embedding", F.array(F.col("id").cast("double"), F.lit(1.0)))
    for mode in ("text", "bm25", "hybrid"):
        assert {r.id for r in hybrid.search(t, "alpha", mode, now_ms=10).collect()} == {1, 2}
    assert len(hybrid.search(t, "alpha", now_ms=10, vector=[1.0, 0.0]).collect()) == 2
    assert len(hybrid.search(t, "alpha", now_ms=10, vector=[1.0, 0.0], rrf_k=60).collect()) == 2
    assert len(hybrid.search(t, "alpha", now_ms=10, vector=[1.0, 0.0], intent="debug", subtask="editing").collect()) == 2


def test_mmr_without_weight_is_plain_top(spark):
    v = spark.createDataFrame([(0, i, i / 10, [1.0, i / 10]) for i in range(10)], "q long, id long, importance double, vec array<double>")
    assert [r.id for r in dense.mmr(v, "q", 4, 0.0).orderBy("pick").collect()] == [9, 8, 7, 6]


def test_knn_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(60)], "id long, v array<double>")
    whole = sorted(map(tuple, dense.knn_queries(v, v, "id", "v", 3).collect()))
    assert sorted(map(tuple, dense.knn_queries(v, v, "id", "v", 3, block=7).collect())) == whole
    assert dense.similar_pairs(v, "id", "v", 0.9, block=7).count() == dense.similar_pairs(v, "id", "v", 0.9).count()
    assert dense.knn_queries(v.limit(0), v.limit(0), "id", "v", 3).count() == 0


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, "calls", 1.0) for a, b in rows], "src string, dst string, edge_type string, confidence double")


def test_graphs(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"))
    assert ids(graph.callers(e, "c")) == ["b", "d"] and ids(graph.callees(e, "a")) == ["b"]
    assert {(r.id, r.level) for r in graph.call_chain(e, "c", 2).collect()} == {("b", 1), ("d", 1), ("a", 2)}
    assert {r.id: r.hops for r in graph.shortest_paths(e, "a", 5).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.call_chain(e, "nobody").count() == 0
    n = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "gone"), ("r", None)], "id string, parent string")
    assert {r.id: r.path for r in graph.parent_path(n).collect()} == {"x": ["x", "y"], "y": ["y", "x"], "z": ["z"], "r": ["r"]}
    assert {(r.id, r.relation) for r in graph.neighbours(e, "a").collect()} == {("b", "calls"), ("c", "inverse_calls")}
    refs = spark.createDataFrame([(1, "n1"), (1, "n2")], "id long, label string")
    assert [(r.src, r.dst) for r in graph.reference_edges(table(spark, node(1), node(2)), refs).collect()] == [(1, 2)]


def test_tool_sequences_cross_partitions(spark):
    rows = [(i, i, "abc"[i % 3] if i % 10 else "a") for i in range(500)]
    t = spark.createDataFrame(rows, "id long, ts long, tool string")
    want = {}
    for x, y in zip(rows, rows[1:]):
        if x[2] != y[2]:
            want[x[2], y[2]] = want.get((x[2], y[2]), 0) + 1
    assert {(r["first"], r["second"]): r["n"] for r in telemetry.tool_sequences(t, 1, 100).collect()} == want


def test_subtask_and_signatures(spark):
    c = spark.createDataFrame([(1, "edit", None, True, "f"), (1, "bash", "pytest x", True, "f"), (2, "read", None, False, "g"), (2, "bash", "ls", False, "g")], "session_id long, tool string, command string, success boolean, file string")
    assert {r.session_id: r.subtask for r in telemetry.subtask(c).collect()} == {1: "validation", 2: "localization"}
    assert {r.session_id: r.signature for r in telemetry.failure_signatures(c).collect()} == {2: "bash,read"}
    none = spark.createDataFrame([], "signature string")
    assert [r.signature for r in mining.failed_lessons(c, none).collect()] == ["bash,read"]
    assert mining.work_captured(c, 1).first().edits == 1


def test_intents(spark):
    rows = [("fix the error", "debug"), ("", "implement"), ("plan then test", "plan"), ("test then plan", "verify"), (None, "implement"), ("éfixé thing", "debug")]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("c", mining.classify_intent(F.col("t"))).select("want", "c.*").collect()
    assert all(r.intent == r.want and 0 <= r.confidence <= 1 for r in got)


def test_distilled_rules(spark):
    lessons = spark.createDataFrame([(1, "lesson:a", 5)], "id long, label string, created_ms long")
    fixes = spark.createDataFrame([("lesson:a:fix", "- do it\nno\n- do it")], "label string, content string")
    assert [r.rule for r in mining.distilled_rules(lessons, fixes).collect()] == ["do it"]


OUTPUTS = {
    "compiler-diagnostics": "\n".join(f"src/a{i % 3}.ts:{i}:2: error TS1: bad thing happened here again and again and again" for i in range(1, 40)),
    "test-output": "\n".join(["PASS a.test.ts"] * 60 + ["FAIL b.test.ts", "Tests: 61 total"]),
    "log-stream": "\n".join(f"2024-01-01T00:00:0{i}Z service INFO {'step of a long list ' * 20}" for i in range(4)),
    "npm-install": "npm install x\n" + "\n".join(f"+ package-{i}@1.0.{i} with a long line of text" for i in range(30)) + "\nadded 30 packages\naudited 31 packages",
    "source-code": "import os\nimport sys\n" + "\n".join(f"def f{i}(x):\n    value = x + {i}\n    return value" for i in range(30)),
    "config-content": "[a]\n" + "\n".join(f"key{i} = {'a value of some length ' * 20}" for i in range(2)) + "\n[b]",
    "build-log": "webpack 5 compiled\nvite build\n" + "\n".join(f"chunk {i} of the bundle is done now" for i in range(30)),
    "coverage-log": "File | % Stmts\nAll files | 71.2 |\n" + "\n".join(f"src/file{i}.ts | {i}.5 | 10 | 20" for i in range(30)),
    "dep-tree": "root@1.0.0\n" + "\n".join(f"├── pkg{i}@1.{i}.0 and more text here" for i in range(60)),
    "raw-text": "plain words\n" * 200,
}


def test_output_types(spark):
    t = spark.createDataFrame([(k, "run", o, False) for k, o in OUTPUTS.items()], "id string, command string, output string, failed boolean")
    rows = compress.compress_outputs(t).collect()
    assert {r.id: r.type for r in rows} == {k: k for k in OUTPUTS}
    assert all(r.strategy != "none" and len(r.output) < 0.9 * len(OUTPUTS[r.id]) and abs(r.saved - (1 - len(r.output) / len(OUTPUTS[r.id]))) < 1e-9 for r in rows)
    by = {r.id: r.output for r in rows}
    assert "FAIL b.test.ts" in by["test-output"] and "failed 1, passed 60" in by["test-output"] and by["raw-text"].startswith("plain words (200 times)")


def test_compression_by_command_and_failure(spark):
    long = "\n".join(f"line {i}" for i in range(200))
    failing = long + "\nERROR boom\n" + long
    cases = [
        (1, "make", failing, True, "error-first"), (2, None, None, None, "none"), (3, "rg x", "\n".join(f"a.py:{i}: something found" for i in range(100)), False, "grep"),
        (4, "git log", "\n".join(f"commit {i:040x}\nAuthor: A <a@b.c>\nDate: now\n\n    subject {i}\n" for i in range(30)), False, "git"), (5, "x", "short", True, "none"),
        (6, "pytest -q", "\n".join(["ok"] * 300 + ["1 failed"]), False, "test"), (7, "x", "a,b,c\n" + "\n".join(f"{i},two,three and more" for i in range(90)), False, "shape"),
    ]
    t = spark.createDataFrame([c[:4] for c in cases], "id long, command string, output string, failed boolean")
    got = {r.id: r for r in compress.compress_outputs(t).collect()}
    assert {k: r.strategy for k, r in got.items()} == {c[0]: c[4] for c in cases}
    assert "ERROR boom" in got[1].output and "line 199" in got[1].output and "... 177 lines" in got[1].output and got[2].output == ""
    assert value(spark, compress.shape(F.lit('{"a": [1]}'))) == "json" and value(spark, compress.shape(F.lit("a,b\n1,2\n3,4"))) == "csv"
    assert value(spark, compress.tool_output(F.lit("glob"), F.lit("a/x.py\na/y.py\nb/z.py"))) == "a/ 2\nb/ 1"
    assert value(spark, compress.tool_output(F.lit("read"), F.lit("x\n\n\n\ny "))) == "x\n\ny"
    assert value(spark, compress.without_noise(F.lit("2024-01-01T10:00:00Z start\n\n-----\n[10:00:01] go"))) == "start\ngo"
    runs = spark.createDataFrame([(1, 1, "c", "a\nb"), (2, 2, "c", "a\nb"), (3, 3, "c", "a\nd")], "id long, ts long, command string, output string")
    got = {r.id: r for r in compress.deltas(runs).collect()}
    assert got[2].same and got[3].added == ["d"] and got[3].removed == ["b"]
    args = F.create_map(F.lit("k"), F.lit("x" * 30))
    assert value(spark, compress.pruned_inputs(args, F.lit(True))) == {"k": "[input pruned]"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 4)], "query_id long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (2, 13), (3, 99)], "query_id long, id long")
    got = {r.k: r for r in evaluate.ranking_metrics(ranked, relevant).collect()}
    assert got[3].hit_rate == pytest.approx(1 / 3) and got[5].recall == pytest.approx(2 / 3) and got[5].mrr == pytest.approx((0.5 + 0.25) / 3)
    scores = spark.createDataFrame([("a", 0.50), ("b", 0.53)], "strategy string, score double")
    assert evaluate.chosen_strategy(scores, "a").first().strategy == "a" and evaluate.chosen_strategy(scores, "b").first().strategy == "b"
    assert value(spark, evaluate.token_f1(F.lit("a b c"), F.lit("a b d"))) == pytest.approx(2 / 3)


def test_metrics_of_labels_make_no_pairs(spark, sf):
    from mnemosaic.plans import catalogue

    points = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "c")], "id long, label string")
    queries = points.filter("id IN (1, 3, 4, 6)").withColumnRenamed("id", "query_id")
    ranked = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 5, 4), (3, 1, 1), (4, 1, 1), (6, 1, 1)], "query_id long, id long, rank int")
    relevant = queries.join(points, "label").filter("id <> query_id").select("query_id", "id")
    rows = lambda m: sorted(map(tuple, m.collect()))
    assert rows(evaluate.label_metrics(ranked, queries, points)) == rows(evaluate.ranking_metrics(ranked, relevant))
    plan = catalogue.QUERIES["eval_hitrate_mrr"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan  # of pairs of a query and each row of its label


def test_edges_of_references_are_not_dealt_again(spark):
    nodes = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id long, label string")
    refs = spark.createDataFrame([(1, "x"), (1, "x"), (3, "x"), (4, "x"), (4, "y"), (3, None)], "id long, label string")
    made = graph.reference_edges(nodes, refs)
    assert sorted((r.src, r.dst) for r in made.collect()) == [(1, 2), (3, 1), (3, 2), (4, 1), (4, 2)]
    top = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not top[0].startswith("Aggregate")


def test_similar_pairs_go_by_small_blocks():
    import inspect

    most = inspect.signature(dense.similar_pairs).parameters["block"].default
    assert most**2 * 24 * 0.04 < 300e6  # bytes of the pairs of two blocks, if a twenty-fifth of all are similar


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.md").write_text("---\ntitle: One\ndate: 2024-01-02\ntags: [x, y]\n---\nbody about spark\n")
    (tmp_path / "j" / "b.md").write_text("no head")
    j = src.journal(spark, str(tmp_path / "j"))
    assert {(r.title, tuple(r.tags)) for r in j.collect()} == {("One", ("x", "y")), ("", ())}
    assert [r.title for r in src.journal_search(j, "spark", ("x",)).collect()] == ["One"]
    (tmp_path / "c" / "node_modules").mkdir(parents=True)
    for name in ("a.py", "b.txt", "node_modules/c.py"):
        (tmp_path / "c" / name).write_text("x = 1")
    assert [r.path.rpartition("/")[2] for r in src.code_files(spark, str(tmp_path / "c")).select("path").collect()] == ["a.py"]
    n = spark.range(12).withColumn("label", F.lit("x"))
    src.write_graph(n, edges(spark, ("a", "b")), str(tmp_path / "g"))
    assert src.read_graph(spark, str(tmp_path / "g"))[0].count() == 12
    src.write_graph(n.limit(3), edges(spark, ("a", "b")), str(tmp_path / "g2"))
    assert src.read_graph(spark, str(tmp_path / "g2")) is None


def test_streams_match_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = sessions.events(spark, str(tmp_path / "in"), e.schema)
    sessions.run_available(sessions.pressure_phases(stream, 500.0), str(tmp_path / "p"), str(tmp_path / "pc"))
    totals = {r.user_id: r.t for r in e.groupBy("user_id").agg(F.sum("value").alias("t")).collect()}
    reached = {r.session for r in spark.read.parquet(str(tmp_path / "p")).filter("phase = 'critical'").collect()}
    assert reached == {u for u, t in totals.items() if t / 500.0 >= 0.95}
    q = sessions.session_counters(sessions.events(spark, str(tmp_path / "in"), e.schema)).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.event_type): r.n for r in spark.sql("SELECT user_id, event_type, sum(n) AS n FROM counted GROUP BY 1, 2").collect()}
    assert got == {(r.user_id, r.event_type): r["count"] for r in e.groupBy("user_id", "event_type").count().collect()}
    once = sessions.without_repeats(sessions.events(spark, str(tmp_path / "in"), e.schema), ["user_id"], within="400 days")
    sessions.run_available(once, str(tmp_path / "o"), str(tmp_path / "oc"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == len(totals)


def test_pressure(spark):
    t = spark.createDataFrame([(1, 1, 1, 60), (2, 1, 2, 15), (3, 1, 3, 25)], "id long, session_id long, ts long, tokens int")
    assert [r.phase for r in telemetry.pressure(t, 100).orderBy("id").collect()] == ["normal", "warn", "critical"]


def test_pressure_at_a_bound_does_not_depend_on_rounding(spark):
    t = spark.range(1, 21).selectExpr("id", "1L AS session_id", "id AS ts", "0.35D AS tokens")  # 7, which doubles miss when added one by one
    assert [r.id for r in telemetry.pressure(t, 10).filter("phase = 'warn'").collect()] == [20]


def test_pressure_of_turns_without_time_and_sums_just_below_a_bound(spark, tmp_path):
    import duckdb
    from mnemosaic.plans import catalogue

    con = duckdb.connect()
    rows = "(1, NULL, 1, 900.0), (2, TIMESTAMP '2024-01-01', 1, 2000.0), (3, TIMESTAMP '2024-01-02', 1, NULL), (4, TIMESTAMP '2024-01-01', 2, 2099.9999998), (5, TIMESTAMP '2024-01-02', 2, 0.0000002), (6, NULL, NULL, 2600.0), (7, NULL, NULL, 300.0)"
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, 'view' AS event_type, value::DOUBLE AS value, '{{}}' AS props FROM (VALUES {rows}) t(event_id, ts, user_id, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(catalogue.SQL["pressure_phases"]).fetchall())
    assert {i: phase for i, phase, _ in want} == {1: "critical", 2: "normal", 3: "normal", 4: "normal", 5: "warn", 6: "aggressive", 7: "critical"}
    assert sorted((r.id, r.phase, r.first) for r in catalogue.QUERIES["pressure_phases"](spark, str(tmp_path)).collect()) == want


def test_depth_of_a_tree_of_many_nodes(spark, tmp_path):
    import duckdb
    from mnemosaic.plans import catalogue

    ids = sorted({int(str(i)[:n]) for i in (7, 61, 1234, 98765, 123456, 7654321) for n in range(1, len(str(i)) + 1)} | {0})
    docs = spark.createDataFrame([(i, "x", "en", "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.SQL["fractal_stats"]).fetchone()
    assert tuple(catalogue.QUERIES["fractal_stats"](spark, str(tmp_path)).first()) == want


def test_attribution_takes_the_latest_before(spark):
    d = lambda h: dt.datetime(2024, 1, 1, h)
    log = spark.createDataFrame([(1, d(1), [5]), (2, d(2), [5]), (3, d(9), [5])], "id long, ts timestamp, ids array<long>")
    fb = spark.createDataFrame([(5, d(3))], "node_id long, at timestamp")
    assert telemetry.attribution(log, fb).first().log_id == 2


def test_consolidation(spark):
    t = table(spark, node(1, content="We decided to use spark here today.\nsecond", importance=0.4), node(2, content="run pytest on src/a.py", importance=0.8, created_ms=DAY), node(3))
    members = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d")], "id long, cluster string")
    got = consolidate.compress_clusters(members, t).collect()
    assert len(got) == 1 and got[0].level == 1 and got[0].importance == pytest.approx(0.72) and got[0].content.split("\n")[0] == "- run pytest on src/a.py"
    s = {r.id: r for r in consolidate.structured_summary(t, "id", "content").collect()}
    assert s[1].decisions and s[2].files == ["run pytest on src/a.py"] and s[2].tools and not s[3].decisions
    assert [(str(r.day), r.labels) for r in consolidate.by_day(t).orderBy("day").collect()] == [("1970-01-01", "n3, n1"), ("1970-01-02", "n2")]
    code = spark.createDataFrame([("a.py", "import os\nimport os\nx = 1\ndef f(y):\n    return y")], "path string, text string")
    assert consolidate.skeleton(code, "path", "text").first().skeleton == "import os\ndef f(y)"


def test_reports(spark):
    hist = spark.createDataFrame([(i, True) for i in range(30)], "ts long, success boolean")
    assert reports.inject_size(hist, 10).first().size == 7 and reports.inject_size(hist.limit(0), 10).first().size == 10
    msgs = spark.createDataFrame([(1, [("text", "abcd"), ("text", "abcde"), ("tool", None)])], "id long, parts array<struct<kind: string, text: string>>")
    assert {(r.kind, r.chars, r.tokens) for r in reports.message_sizes(msgs).collect()} == {("text", 9, 3), ("tool", None, None)}
    snap = table(spark, node(1, label="middle-term:s1", content='{"sessionId": "s9"}'), node(2, label="middle-term:s2", content="not json"))
    assert {r.id: r.session_id for r in reports.snapshots(snap).collect()} == {1: "s9", 2: "s2"}


def test_stateful_streams_match_batches(spark, tmp_path):
    from mnemosaic.streaming import state

    i = F.col("id")
    rows = spark.range(400).select("id", (i % 7).alias("session_id"), F.timestamp_seconds(1_700_000_000 + i * 10).alias("ts"), F.floor(i / 10).alias("turn"), F.lit("grep").alias("tool"), F.create_map(F.lit("q"), (i % 5).cast("string")).alias("args"), F.concat(F.lit("the output of call number "), i).alias("output"), F.concat(F.lit("p"), i % 3).alias("path"), F.floor(i / 50).cast("string").alias("content"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    back = spark.read.parquet(str(tmp_path / "in"))
    for name, make in (("calls", lambda r: state.repeated_calls(r, most=6)), ("reads", lambda r: state.unchanged_reads(r, most=4))):
        stream = spark.readStream.schema(back.schema).parquet(str(tmp_path / "in"))
        sessions.run_available(make(stream), str(tmp_path / name), str(tmp_path / (name + "c")))
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()), key=lambda r: r[1])
        assert got == sorted(map(tuple, make(back).collect()), key=lambda r: r[1]) and len(got) == 400 and 0 < sum(r[2] for r in got) < 400


def test_updates_can_clear_and_never_multiply(spark):
    t = table(spark, node(1, status="active"), node(2, status="active"))
    changes = spark.createDataFrame([(1, None, 0.9), (1, None, 0.8)], "id long, status string, importance double")
    got = {r.id: r for r in store.update(t, changes, 5, nulls=("status",)).collect()}
    assert len(got) == 2 and got[1].status is None and got[1].importance == 0.9 and got[2].status == "active"


def test_evaluation_sets_are_read(spark, tmp_path):
    import json

    one = {"sample_id": "s1", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "D1:2", "text": "yo"}], "session_1_date_time": "8 May, 2023"}, "qa": [{"question": "q", "answer": "a", "evidence": ["D1:1"], "category": 2}]}
    for name, whole in (("list", [one, {**one, "sample_id": "s2"}]), ("map", {"0": one, "1": {**one, "sample_id": "s2"}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole))
        turns, asked = src.conversations(spark, str(tmp_path / f"{name}.json"))
        assert {(r.sample, r.session, r.place, r.speaker, r.dia_id, r.text) for r in turns.collect()} == {(s, "session_1", k, p, f"D1:{k + 1}", t) for s in ("s1", "s2") for k, (p, t) in enumerate((("A", "hi"), ("B", "yo")))}
        assert {(r.sample, r.question, tuple(r.evidence), r.category) for r in asked.collect()} == {(s, "q", ("D1:1",), 2) for s in ("s1", "s2")}
    (tmp_path / "e.json").write_text(json.dumps([{"instance_id": "x", "tool_sequence": [{"name": "read", "target": "f"}]}, {"repo": "r"}]))
    rows = {r.instance_id: r for r in src.experiences(spark, str(tmp_path / "e.json")).collect()}
    assert rows["x"].tool_sequence[0].target == "f" and rows["x"].summary == "" and rows[""].touched_files == []
    (tmp_path / "l.json").write_text(json.dumps([{"related_instance_id": "a", "experience_instance_ids": ["x", "x", "y"]}]))
    assert src.experience_links(spark, str(tmp_path / "l.json")).count() == 2
