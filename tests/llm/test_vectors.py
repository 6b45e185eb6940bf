import hashlib
import random

import duckdb
import numpy as np
from mnemosaic.llm import vectors
from mnemosaic.llm.common import Scratch, table

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part string"


def plain(rows, entries=256):
    """Every part against every entry, in Python's integers."""
    from math import floor, isfinite

    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [(i, [floor(1024 * x) for x in v], lab) for i, v, lab in kept if len(v) == size]
    cut = lambda v: [v[k * size // 4 : (k + 1) * size // 4] for k in range(4)]
    books = [[cut(v)[k] for _, v, _ in kept[:entries]] for k in range(4)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(book))
    for _ in range(4):
        for k, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[k], book)[1], []).append(cut(v)[k])
            for j, own in groups.items():
                book[j] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = [], {}
    for i, v, lab in kept:
        best = [near(p, b) for p, b in zip(cut(v), books)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(vectors.oracle())
    names = [d[0] for d in found.description]
    got = vectors.code_report(table(spark, sf, "embeddings"), Scratch(spark, "t"))
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())


def test_matches_plain_integers_with_nulls_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k, [float(np.float32(rng.choice([rng.uniform(-1, 1), 0.5, -0.25]))) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(400)]
    rows += [(401, None, 1), (402, [1.0] * 7 + [float("nan")], 1), (403, [float("inf")] + [0.0] * 7, None), (404, [None] + [0.0] * 7, 1), (405, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (7, rows[7][1], 2), (7, rows[7][1], 2), (None, [0.1] * 8, None), (406, [3e38] * 8, 1), (407, [], 1)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in vectors.code_report(frame, Scratch(spark, "t")).collect()), key=repr)
    assert got == plain([r for r in rows if r[0] != 406])


def test_few_rows_and_empty_tables(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25, -0.5, 1.0], 1, "", ""), (2, [0.5, 0.25, -0.5, 1.0], None, "", "")], SCHEMA)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in vectors.code_report(few, Scratch(spark, "t")).collect()) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    assert vectors.code_report(few.limit(0), Scratch(spark, "t")).count() == 0
    uneven = spark.createDataFrame([(1, [0.5, 0.25, -0.5], 1, "", "")], SCHEMA)
    assert vectors.code_report(uneven, Scratch(spark, "t")).count() == 0


def test_pruned_search_equals_a_full_one():
    rng = np.random.default_rng(2)
    for scale in (30, 1000, 1 << 26):
        entries = rng.integers(-scale, scale, (256, 16))
        entries[100] = entries[3]
        x = np.concatenate([rng.integers(-scale, scale, (700, 16)), entries[:50], np.zeros((2, 16), int)])
        index, error = vectors.Codebook(entries).nearest(x)
        full = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()


def test_decoded_vectors_have_the_error(spark, sf):
    frame = table(spark, sf, "embeddings")
    entries = vectors.train(frame)
    for r in vectors.decode(vectors.encode(frame, entries), entries).limit(20).collect():
        assert sum((a - int(b * 1024)) ** 2 for a, b in zip(vectors.scaled(np.array(r.embedding)).tolist(), r.approximate)) == r.error
