"""SimHash near-dedup through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each at most 23 bits wide, the length of the perfect
binary Golay code. Two 23-bit vectors at most two bits apart have a common neighbour within one bit
of either, so the codewords nearest to a vector and to its 23 one-bit neighbours (one or six distinct
ones) always meet. Of two fingerprints at most two bits apart, one segment is equal (pigeonhole) and
any other is at most two bits off: keys pair each segment, taken exactly, with the codeword indices
of the next one. Joined pairs are verified by counting differing bits.

Keys shared by more than CROWD fingerprints are not joined pairwise. Their fingerprints are keyed by
all vectors at most one bit away instead: fingerprints that share such a vector are at most two bits
apart, those at most two bits apart share one, and no vector has more than 65 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 64
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; zero for no words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return int.from_bytes(digest(b" ".join(parts), seed), "big")
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    total = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        some = b"".join([digest(line[a:b], seed) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)])])
        total += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder modulo the generator of every 23-bit unit vector, and the error of each syndrome."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        unit[i] = r
    error = np.zeros(1 << 11, np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return unit, error


_UNIT, _ERROR = _syndromes()


def nearest_indices(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices met by each 23-bit vector within one bit."""
    syndrome = np.zeros(len(vectors), np.int64)
    for i in range(23):
        syndrome ^= np.where(vectors >> i & 1, _UNIT[i], 0)
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    moved = np.concatenate(([0], _UNIT))
    near = (vectors[:, None] ^ flips) ^ _ERROR[syndrome[:, None] ^ moved]
    near = np.sort(near >> 11, axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(new)
    return row, near[row, col]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint (uint64): the exact segment with the indices of the next one."""
    parts = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        row, index = nearest_indices(parts[(k + 1) % 3])
        rows.append(row)
        keys.append(k << 40 | parts[k][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 4096):
                some = values[at : at + 4096]
                row, key = make(some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row].view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _one_bit(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flips = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    return np.repeat(np.arange(len(fps)), 65), (fps[:, None] ^ flips).ravel().view(np.int64)


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for distinct fingerprints: edges that connect all those at most two bits apart, none other."""
    keys = _keyed(fps, golay_keys)
    shared = scratch.keep(
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    )
    close = "bit_count(u ^ v) <= 2"
    two = shared.filter(f"n = 2 AND {close}").select("u", "v")
    some = scratch.keep(keys.join(shared.filter(f"n > 2 AND n <= {CROWD}").select("key"), "key"))
    pairs = (
        some.withColumnRenamed("fp", "u").join(some.withColumnRenamed("fp", "v"), "key").filter(f"u < v AND {close}").select("u", "v")
    )
    crowded = keys.join(shared.filter(f"n > {CROWD}").select("key"), "key", "left_semi").select("fp").distinct()
    star = (
        _keyed(crowded, _one_bit)
        .groupBy("key")
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all"))
        .filter("size(all) > 1")
        .select("u", F.explode("all").alias("v"))
        .filter("u <> v")
    )
    return two.union(pairs).union(star)


def simhash_components(docs: DataFrame, scratch: Scratch, words: int = 3) -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id.

    component_id is the smallest doc_id that is reached over links of two bits or fewer. Null and
    empty texts have fingerprint zero and link like any other; rows with a null doc_id get the
    component of their fingerprint and name none (null when no other row is reached). Repeated rows
    stay. Extra columns are not read. An empty table gives an empty one.
    """
    rows = scratch.keep(fingerprints(docs, words))
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(distinct, scratch), scratch).withColumnRenamed("node", "fp")
    linked = scratch.keep(linked)
    named = scratch.keep(linked.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id")))
    moved = scratch.keep(linked.join(named, "component").select("fp", "component_id"))
    found = scratch.keep(
        distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")
