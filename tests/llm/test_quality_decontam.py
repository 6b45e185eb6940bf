import math
import random
import zlib

import numpy as np
from mnemosaic.llm import decontam, quality, queries
from mnemosaic.llm.common import table


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op9_quality(spark, big).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) / len(labels) >= 0.97


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, :3] = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y).score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_quality_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "fine text", 0.1), (2, "w " * 90000, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.scores(docs, model).collect()} == {0.5}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    odd = spark.createDataFrame([(None, 1, 0), (2, None, 0), (2, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scores(docs, quality.train(docs, odd)).count() == 4
    assert quality.scores(docs.limit(0), model).count() == 0


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (40, 12)), rng.integers(0, 4, (40, 30))
    assert decontam.align(a, b).tolist() == [brute_align(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_query_matches_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {r.doc_id: r for r in queries.op10_decontamination(spark, sf).collect()}
    assert got and all(r.contaminated and r.similarity >= decontam.SIMILARITY for r in got.values())
    words = [(i.item_id, decontam.words(i.text)) for i in items]
    for d in docs:
        own = decontam.words(d.text)
        if len(own) > 60 and d.doc_id not in got:
            continue  # the plain alignment of long clean texts takes minutes
        best = max(brute_align(w, own) / (2 * len(w)) for _, w in words) if own else 0
        assert (d.doc_id in got) == (best >= decontam.SIMILARITY)


def test_edited_copies_are_caught_and_others_left(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocab, k=30)) for _ in range(30)]
    docs, leaked = [], set()
    for d in range(120):
        body = rng.choices(vocab, k=200)
        if d % 3 == 0:
            w = items[d % 30].split()
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            del w[rng.randrange(len(w))]
            body[50:50] = w
            leaked.add(d)
        docs.append((d, " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, items[0], "x"), (0, docs[0][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, "a b"), (None, items[1])], "item_id long, text string")
    got = decontam.contamination(frame, bench).collect()
    assert len(got) == len(docs)
    assert {r.doc_id for r in got if r.contaminated} == leaked | {None}
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in docs if d is not None} - leaked
    assert not any(r.contaminated for r in decontam.contamination(frame, bench.limit(0)).collect())
    assert decontam.contamination(frame.limit(0), bench).count() == 0


def test_blocks_of_items_agree_with_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(0, 20, 2)], "item_id long, text string")
    one = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 3)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == one


def test_evenly_edited_copies_are_found_as_by_plain_alignment(spark):
    rng = random.Random(21)
    items = [[f"i{k}x{j}" for j in range(30)] for k in range(8)]
    common = [f"c{j}" for j in range(40)]

    def edited(words, every, how):
        out = []
        for j, w in enumerate(words):
            if j % every < every - 1:
                out.append(w)
            elif how != "cut":
                out += [rng.choice(common)] if how == "change" else [w, rng.choice(common)]
        return out

    docs = []
    for every in (2, 3, 4, 5, 6):
        for how in ("change", "insert", "cut"):
            k = len(docs) % len(items)
            docs.append((len(docs), " ".join(rng.choices(common, k=rng.randrange(90)) + edited(items[k], every, how) + rng.choices(common, k=50))))
    same = " ".join(edited(items[0], 5, "change"))
    docs += [(1000 + i, same) for i in range(200)]
    docs.append((2000, " ".join(rng.choices(common, k=9000) + edited(items[3], 5, "change") + rng.choices(common, k=9000))))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for some in (docs, docs[9:10], docs[-2:-1]):
        got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(some, "doc_id long, text string"), bench).collect()}
        for d, text in some:
            if 1000 < d < 2000:
                assert got[d].contaminated and got[d].item_id == 0
                continue
            own = decontam.words(text)
            near = [w for w in own if not w.startswith(b"c")]
            at = own.index(near[0])
            own = own[max(0, at - 100) : at + 200]
            best = max(brute_align([x.encode() for x in w], own) / 60 for w in items)
            assert got[d].contaminated == (best >= decontam.SIMILARITY), d
            assert got[d].similarity == (round(best, 6) if best >= decontam.SIMILARITY else 0)


def test_query_has_every_item_that_a_document_leaks(spark, tmp_path, monkeypatch):
    items = [" ".join(f"i{k}x{j}" for j in range(12)) for k in range(5)]
    docs = [(1, f"{items[0]} and {items[3]} z"), (2, "nothing here"), (3, " ".join(items)), (None, items[2])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(1, 0), (1, 3), (None, 2), *((3, k) for k in range(5))}
    for block in (decontam.BLOCK, 2):
        monkeypatch.setattr(decontam, "BLOCK", block)
        rows = queries.op10_decontamination(spark, str(tmp_path)).collect()
        assert len(rows) == len(want) and {(r.doc_id, r.item_id) for r in rows} == want
        assert all(r.contaminated and r.similarity == 1 for r in rows)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    """Rows that repeat an id, or have none, are judged each by itself, however the items are dealt into blocks."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(7)]
    near = " ".join(f"w2x{k}" if k != 5 else "odd" for k in range(12))
    docs = [(1, f"a b {items[0][1]} c"), (1, "clean words stand here alone"), (None, f"{items[3][1]}"), (None, "clean too"), (2, f"{near} then {items[4][1]}"), (3, None), (4, ""), (5, f"{items[5][1]} {items[6][1]}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for block, size in ((20_000, 32 << 20), (2, 32 << 20), (20_000, 100)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        one = sorted((tuple(r) for r in decontam.contamination(frame, bench).collect()), key=repr)
        all_ = sorted((tuple(r) for r in decontam.leaks(frame, bench).collect()), key=repr)
        kept = sorted((tuple(r) for r in decontam.drop_contaminated(frame, bench).collect()), key=repr)
        seen.append((one, all_, kept))
    assert seen[0] == seen[1] == seen[2]
    one, all_, kept = seen[0]
    assert [r[2] for r in one if r[0] == 1] in ([0, None], [None, 0]) and sorted(r[2] is None for r in one if r[0] is None) == [False, True]
    assert {(r[0], r[2]) for r in all_} == {(1, 0), (None, 3), (2, 2), (2, 4), (5, 5), (5, 6)} and len(kept) == 4


def test_leaks_match_brute_force_over_all_pairs(spark, sf):
    """Every document, long ones too, aligned whole with every item."""
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    held = decontam.Items(items)
    want = {}
    for d, text in docs.items():
        b = held.of(text)
        for i, a in zip(held.ids, held.tokens):
            score = int(decontam.align(a[None, :], np.where(b < 0, -3, b)[None, :])[0]) / (2 * len(a)) if len(b) else 0.0
            if score >= decontam.SIMILARITY:
                want[d, i] = round(score, 6)
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op10_decontamination(spark, sf).collect()}
    assert got == want and len(want) >= 3


def test_scores_match_a_plain_evaluation(spark, sf):
    """Every row of op9 against tables looked up one by one, and the tables against a plain boosting of the same rows."""
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = queries.op9_quality(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        x = quality.features(docs[r.doc_id])
        z = model.base + sum(float(t[sum(v >= e for e in edges)]) for v, edges, t in zip(x, model.edges, model.tables))
        z += sum(float(t[sum(x[a] >= e for e in model.coarse[a])][sum(x[b] >= e for e in model.coarse[b])]) for a, b, t in model.pairs)
        p = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(p - r.score) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_leaves_are_the_best_split():
    """A tree's cuts against trying every pair of cuts greedily."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 12
        g, h, c = rng.normal(size=n), rng.random(n) + 0.1, rng.integers(1, 30, n)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        cuts = [0, n]
        for _ in range(2):
            best = max(((value(a, k) + value(k, b) - value(a, b), -a, k) for a, b in zip(cuts, cuts[1:]) for k in range(a + 1, b) if c[a:k].sum() >= quality.LEAST_LEAF and c[k:b].sum() >= quality.LEAST_LEAF), default=None)
            if best is None or best[0] <= 1e-9:
                break
            cuts = sorted([*cuts, best[2]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(cuts, cuts[1:])])
        assert np.allclose(quality._leaves(g, h, c), want)
