"""Product codes of vectors, in integers: nearest entries are found by annular norm pruning.

|x - c| is at least the difference of the norms of x and c. So entries are kept in the order of their norms; a part of a vector
is first held against the few entries of nearest norm, the best of which bounds the norms that any nearer entry can have;
a binary search gives the interval of such entries, ends included, and only these are evaluated, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries of nearest norm that give the first bound, and parts of a vector that are evaluated together.
NEAREST, TOGETHER = 8, 512


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has no null, NaN or infinite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.filter(F.col(column).isNotNull() & F.forall(column, finite))


def first_entries(vectors: DataFrame, column: str = "embedding", n: int = ENTRIES) -> np.ndarray:
    """The scaled vectors of the n smallest vec_ids (equal ids by vector, null ids last) of those that matrix() takes: n rows, which reach the driver."""
    rows = usable(vectors, column)
    order = [F.col("vec_id").asc_nulls_last(), column]
    first = rows.orderBy(*order).select(F.size(column)).first()
    size = first[0] if first else 0
    inside = (F.size(column) == size) & F.forall(column, lambda x: F.abs(x.cast("double")) < limit(size) / SCALE)
    found = [r[0] for r in rows.filter(inside).orderBy(*order).select(column).limit(n).collect()]
    return scaled(np.array(found, np.float64).reshape(len(found), size))


def scaled(x: np.ndarray) -> np.ndarray:
    return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)


def limit(size: int) -> int:
    """Components from here on could give squared distances over the whole vector that don't fit a long."""
    return int((2**63 / max(size, 1)) ** 0.5 / 2)


def matrix(batch: pa.RecordBatch, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows of this length and within limit(), their scaled components)."""
    lists = batch.column(column)
    there = np.flatnonzero(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False)) == size)
    flat = lists.take(pa.array(there, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), size)
    fits = (np.abs(flat) < limit(size) / SCALE).all(axis=1)
    return there[fits], scaled(flat[fits])


class Codebook:
    """Entries of one part, in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        square = (entries.astype(object) ** 2).sum(axis=1) if entries.size else np.zeros(len(entries), object)
        norms = np.sqrt(square.astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of each row of x to the entries which[row] or, with one dimension, to all of these."""
        if which.ndim == 2:
            return ((x[:, None, :] - self.entries[which]) ** 2).sum(axis=2)
        c, top = self.entries[which], max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if 4 * x.shape[1] * top * top < 2**53:  # then floating point is exact, and fast
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, the lowest of equals; squared distance) for each row."""
        n = len(self.entries)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        by_norm = np.argsort(norms, kind="stable")
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), TOGETHER):
            own = by_norm[at : at + TOGETHER]
            part, length = x[own], norms[own]
            near = np.clip(np.searchsorted(self.norms, length)[:, None] + np.arange(-NEAREST // 2, NEAREST // 2), 0, n - 1)
            reach = np.sqrt(self.distances(part, self.order[near]).min(axis=1).astype(np.float64))
            slack = 1e-9 * (length + reach + 1)  # roots are rounded; a wider annulus loses nothing
            low = np.searchsorted(self.norms, length - reach - slack, "left")
            high = np.searchsorted(self.norms, length + reach + slack, "right")
            lowest, highest = int(low.min()), int(high.max())
            columns = np.argsort(self.order[lowest:highest], kind="stable")  # by index, so that the first of equals is the lowest
            d = self.distances(part, self.order[lowest:highest][columns])
            place = lowest + columns
            d[(place[None, :] < low[:, None]) | (place[None, :] >= high[:, None])] = np.iinfo(np.int64).max
            best = d.argmin(axis=1)
            index[own], error[own] = self.order[place[best]], d[np.arange(len(own)), best]
        return index, error


def codebooks(entries: np.ndarray, parts: int = PARTS) -> list[Codebook]:
    return [Codebook(p) for p in np.split(entries, parts, axis=1)]


def train(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The entries of each part after so many rounds over all usable vectors. Tasks hand on sums by entry; parts x entries rows reach the driver.

    The vectors' length is that of the smallest vec_id. Rows of another length, or with components whose squared distances don't fit a
    long, are not used; nor is any row if the length isn't a multiple of parts. Without usable rows there are no entries.
    """
    first = first_entries(vectors, column, entries)
    size = first.shape[1]
    if not len(first) or size % parts:
        return []
    now, width = np.split(first, parts, axis=1), size // parts
    slim = usable(vectors.select(column), column)
    for _ in range(rounds):
        books = [Codebook(x) for x in now]

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, len(first), width), np.int64), np.zeros((parts, len(first)), np.int64)
            for b in batches:
                for k, part in enumerate(np.split(matrix(b, column, size)[1], parts, axis=1)):
                    index, _ = books[k].nearest(part)
                    np.add.at(total[k], index, part)
                    count[k] += np.bincount(index, minlength=len(first))
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

        summed = slim.mapInArrow(sums, "part int, entry int, n bigint, s array<bigint>").groupBy("part", "entry")
        for r in summed.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s")).collect():
            now[r.part][r.entry] = np.array(r.s, np.int64) // r.n
    return now


def encode(vectors: DataFrame, entries: list[np.ndarray], column: str = "embedding") -> DataFrame:
    """The usable rows with code (two hex digits for each part) and error instead of columns so named. Other columns stay; repeated rows stay."""
    kept = usable(vectors.drop("code", "error"), column)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    size, books = sum(x.shape[1] for x in entries), [Codebook(x) for x in entries]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there, x = matrix(b, column, size)
            found = [book.nearest(part) for book, part in zip(books, np.split(x, len(books), axis=1))]
            text = [bytes(row).hex() for row in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
            own = b.take(pa.array(there, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(text, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=[*b.schema.names, "code", "error"])

    if not entries:
        return kept.limit(0).withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")})
    return kept.mapInArrow(codes, f"{fields}, code string, error bigint")


def decode(codes: DataFrame, entries: list[np.ndarray]) -> DataFrame:
    """The rows with the vector that each code stands for (approximate, array<double>) instead of a column so named; null codes give null."""
    kept = codes.drop("approximate")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [None if c is None else np.concatenate([e[i] for e, i in zip(entries, bytes.fromhex(c))]) / SCALE for c in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(read, pa.list_(pa.float64()))], names=[*b.schema.names, "approximate"])

    return kept.mapInArrow(vectors, f"{fields}, approximate array<double>")


def digest(entries: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for x in entries for v in x.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable row. Null labels count together; a sum beyond a long is null."""
    rows = vectors.select("vec_id", "embedding", "label")
    entries = train(rows)
    coded = scratch.keep(encode(rows, entries).select("vec_id", "label", "code", "error"))
    a, b = coded.alias("a"), coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).alias("b")
    return a.join(b, F.expr("a.label <=> b.label")).select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, rounds: int = ROUNDS, entries: int = ENTRIES) -> str:
    """The same by SQL: every part against every entry."""
    apart = "coalesce(list_sum([(p.v[i] - e.v[i]) * (p.v[i] - e.v[i]) for i in range(1, len(p.v) + 1)]), 0)"
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, k AS part, v[(k * len(v) // {parts} + 1):((k + 1) * len(v) // {parts})] AS v FROM kept, range({parts}) AS r(k)),
e0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.label) AS label, any_value(p.v) AS v, min({{'d': CAST({apart} AS BIGINT), 'entry': e.entry}}) AS best
  FROM p JOIN e{k} AS e ON p.part = e.part GROUP BY p.vec_id, p.part)""")
        if k < rounds:
            steps.append(f"""u{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, best.entry AS entry, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m
    FROM a{k}, range(1, 4097) AS r(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY ALL),
e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(u.v, e.v) AS v FROM e{k} AS e LEFT JOIN u{k} AS u ON e.part = u.part AND e.entry = u.entry)""")
    steps.append(f"""r AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(CAST(best.entry AS BIGINT))), 2, '0'), '' ORDER BY part) AS code,
         CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r GROUP BY label)
SELECT r.vec_id, code, error, label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM e{rounds}) AS codebooks_sha256
FROM r JOIN l ON r.label IS NOT DISTINCT FROM l.label""")
    return ",\n".join(steps)
