import hashlib
import zlib

from mnemosaic.llm import dedup, sharding
from mnemosaic.llm.common import Scratch

SCHEMA = "doc_id long, text string, best string"


def test_exact_groups_edges(spark):
    rows = [(5, "a b", "x"), (3, "ab", "x"), (4, "a  b", "x"), (8, None, "x"), (7, "\t", "x"), (9, "z" * 200000, "x"), (3, "ab", "x"), (None, "q", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = dedup.exact_groups(frame, Scratch(spark, "t")).collect()
    by = {(r.doc_id, r.group_size): r for r in got}
    assert len(got) == len(rows)
    assert by[3, 4].keep_id == 4 and by[5, 4].keep_id == 4 and by[8, 2].keep_id == 7
    assert by[5, 4].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert sum(r.kept for r in got) == 4
    kept = dedup.drop_exact_duplicates(frame, Scratch(spark, "t"))
    assert kept.columns == frame.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 7, 9]


def test_repeated_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "same", "x")] * 5 + [(2, "other", "x")], SCHEMA)
    assert sum(r.kept for r in dedup.exact_groups(frame, Scratch(spark, "t")).collect()) == 2
    assert sorted(r.doc_id for r in dedup.drop_exact_duplicates(frame, Scratch(spark, "t")).collect()) == [1, 2]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.exact_groups(empty, Scratch(spark, "t")).count() == 0
    assert dedup.drop_exact_duplicates(empty, Scratch(spark, "t")).count() == 0
    assert sharding.shuffled_shards(sharding.with_sizes(empty), Scratch(spark, "t")).count() == 0


def plain_order(rows, buckets, shards=8, seed=17):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, size, crc, bucket), in the order of their numbers: each bucket shuffled, then all laid end to end."""
    import numpy as np

    out, p = [], 0
    for b in range(buckets):
        own = sorted([r for r in rows if r[3] == b], key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1], r[4]))
        at = np.arange(len(own))
        np.random.Generator(np.random.PCG64([seed, b])).shuffle(at)
        for r, k in zip(own, at.tolist()):
            out.append((*r[:3], (p + k) % shards, (p + k) // shards))
        p += len(own)
    return out


def test_shards_are_even_gapless_and_match_plain_shuffling(spark, tmp_path):
    rows = [(i, "é" * (i % 7) if i % 5 else None, "x") for i in range(1001)] + [(4, "dup", "x")] * 300
    frame = sharding.with_sizes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    scratch = Scratch(spark, "t")
    shuffled = sharding.shuffled_shards(frame, scratch)
    one = [tuple(r) for r in shuffled.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(one) == sorted(tuple(r) for r in shuffled.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) and len(one) == len(rows)
    for s in range(8):
        slots = sorted(r[4] for r in one if r[3] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    numbered = spark.read.parquet(next(iter(scratch.live)))
    dealt = numbered.selectExpr("doc_id", "size", "text_crc32", f"CAST(pmod(xxhash64(17, coalesce(doc_id, -1), text_crc32, size, _nr), {sharding.LEAST}) AS INT)", "_nr").collect()
    assert sorted(plain_order([tuple(r) for r in dealt], sharding.LEAST)) == sorted(one)
    copies = [r[3] for r in dealt if r[0] == 4 and r[1] == 4]
    assert len(copies) == 300 and max(copies.count(b) for b in set(copies)) < 20  # repeated rows are spread over buckets
    text = dict((d, t) for d, t, _ in rows)
    assert all(size == len((text[d] or "").encode()) + 1 and crc == zlib.crc32((text[d] or "").encode()) for d, size, crc, _, _ in one if d != 4)
    ids = [r[0] for r in sorted(one, key=lambda r: (r[3], r[4]))]
    assert ids != sorted(ids)
    sharding.write_shards(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), Scratch(spark, "t"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and sorted((r.shard, r.slot) for r in back.collect()) == sorted((r[3], r[4]) for r in one)


def test_columns_of_any_name_stay(spark):
    frame = spark.createDataFrame([(1, "a", "p", "q", "r"), (1, "a", "s", "t", "u"), (None, None, "v", "w", "x")], "doc_id long, text string, _nr string, _bucket string, _POS string")
    got = sharding.shuffled_shards(sharding.with_sizes(frame), Scratch(spark, "t"))
    assert got.columns == [*frame.columns, "size", "text_crc32", "shard", "slot"]
    assert sorted((r["_nr"], r["_bucket"], r["_POS"]) for r in got.collect()) == [("p", "q", "r"), ("s", "t", "u"), ("v", "w", "x")]
    odd = spark.createDataFrame([(1, "ab", "p", "q", "r"), (2, "a b", "s", "t", "u"), (3, "z", "v", "w", "x")], "doc_id long, text string, _key string, _id string, _sha string")
    kept = dedup.drop_exact_duplicates(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns and sorted((r["_key"], r["_id"], r["_sha"]) for r in kept.collect()) == [("s", "t", "u"), ("v", "w", "x")]


def test_query_places_every_row(spark, sf):
    from mnemosaic.llm import queries

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(r["size"] == len(docs[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) for r in rows)
    places = sorted((r.slot, r.shard) for r in rows)
    assert places == [(p // 8, p % 8) for p in range(len(rows))]
