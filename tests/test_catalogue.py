"""Every registered query with SQL against DuckDB over the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest
from mnemosaic.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf, oracle, name):
    frame = catalogue.QUERIES[name](spark, sf)
    found = oracle.execute(catalogue.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect()), key=repr)
    assert got == want


def test_packing_matches_a_plain_walk(spark, sf):
    from mnemosaic.sources import nodes as src

    best = {}
    for r in src.nodes(src.table(spark, sf, "documents")).collect():
        best.setdefault(r.project, []).append((-r.importance, r.id, -(-len(r.content) // 4)))
    want = set()
    for project, rows in best.items():
        used, place, taken = 0, 0, []
        for _, i, cost in sorted(rows)[:100]:
            if used + cost <= 8000:
                used += cost
                taken.append((place, i))
                place += 1
        want |= {(project, k, i, used) for k, i in taken}
    rows = catalogue.QUERIES["budget_pack"](spark, sf).collect()
    assert {(r.project, r.place, r.id, r.used) for r in rows} == want and len(rows) == len(want)


def _vectors(spark, sf):
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    q = np.array(catalogue.QVEC) / np.linalg.norm(catalogue.QVEC)
    return rows, unit, {r.vec_id: float(unit[r.vec_id] @ q) for r in rows}


def test_selection_for_diversity_matches_a_plain_choice(spark, sf):
    rows, unit, score = _vectors(spark, sf)
    got = {(r.q, r.pick): r.id for r in catalogue.QUERIES["mmr_select"](spark, sf).collect()}
    for q in range(3):
        left, chosen = [r.vec_id for r in rows if r.label % 3 == q], []
        while len(chosen) < 10:
            best = max(left, key=lambda i: (round(score[i] - 0.3 * max([float(unit[i] @ unit[c]) for c in chosen if unit[i] @ unit[c] > 0], default=0.0), 12), -i))
            chosen.append(best)
            left.remove(best)
        assert [got[q, k + 1] for k in range(10)] == chosen


def test_selection_for_injection_matches_a_plain_choice(spark, sf):
    rows, unit, score = _vectors(spark, sf)
    got = {(r.q, r.pick): r.id for r in catalogue.QUERIES["mmr_injection"](spark, sf).collect()}

    def close(a, b):
        if a % 9 and b % 9:
            return float(unit[a] @ unit[b])
        x, y = ({f"w{i % 11}", f"w{i % 4}"} for i in (a, b))
        return len(x & y) / min(len(x), len(y))

    for q in range(3):
        left, chosen = sorted((r.vec_id for r in rows if r.label % 3 == q), key=lambda i: (-score[i], i)), []
        while len(chosen) < 10:
            gain = lambda i: 0.5 * score[i] - 0.5 * max([0.0, *(close(i, c) for c in chosen)]) - sum(0.1 * (i % 5 == c % 5) + 0.05 * (i % 6 == c % 6) for c in chosen)  # noqa: B023, E731
            best = left[0] if not chosen else max(left, key=lambda i: round(gain(i), 12))
            chosen.append(best)
            left.remove(best)
        assert [got[q, k + 1] for k in range(10)] == chosen


def test_leader_clusters_match_one_pass(spark, sf):
    rows, unit, _ = _vectors(spark, sf)
    want, size = {}, {}
    for label in {r.label for r in rows}:
        leaders = []
        for r in (r for r in rows if r.label == label):
            first = next((x for x in leaders if unit[r.vec_id] @ unit[x] >= 0.3), r.vec_id)
            leaders += [first] if first == r.vec_id else []
            want[label, r.vec_id] = first
            size[label, first] = size.get((label, first), 0) + 1
    got = {(r.label, r.id): r.leader for r in catalogue.QUERIES["leader_clusters"](spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if size[k[0], v] >= 2}


def test_repeated_calls_match_a_plain_walk(spark, sf):
    from collections import OrderedDict

    got = {r.id: (r.cached, r.output) for r in catalogue.QUERIES["repeated_calls"](spark, sf).collect()}
    held, want = {}, {}
    for e in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
        i, own = e.event_id, held.setdefault(e.user_id, OrderedDict())
        tool, key, out, turn = "edit" if i % 7 == 0 else "grep", None, f"the output of the call number {i}", i // 40
        key = (tool, i % 6)
        told = None
        if tool != "edit" and key in own:
            own.move_to_end(key)
            told = own[key][0] if turn - own[key][1] >= 2 else None
        want[i] = (told is not None, told or out)
        if told is None:
            own[key] = (out, turn)
            own.move_to_end(key)
            while len(own) > 4:
                own.popitem(last=False)
    assert got == want and 0 < sum(c for c, _ in want.values()) < len(want)


def test_summaries_match_a_plain_reading(spark, sf):
    import re

    from mnemosaic.operators import consolidate

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalogue.QUERIES["structured_summary"](spark, sf).collect():
        for name, pattern in consolidate.SECTIONS.items():
            lines = [re.sub(r"^[-*#\s]+", "", x).strip(" ")[:160] for x in text[r.id].split("\n") if re.search(pattern, x, re.A)]
            assert r[name] == list(dict.fromkeys(lines))[:5], (r.id, name)


def test_output_compression_saves_a_tenth_or_nothing(spark, sf):
    given = {("p", r.page_id): r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()} | {("d", r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["output_compression"](spark, sf).collect()
    whole = set(given.values())
    assert len(rows) == len(given) and len({r.strategy for r in rows}) >= 4
    for r in rows:
        assert (r.strategy == "none") == (r.output in whole and r.saved == 0) and (r.strategy == "none" or r.saved > 0.1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
