"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size against all documents, each block as one pass. The
score of an alignment (match 2, mismatch -1, gap -1) over twice the item's words is the similarity.
A score of t or more has at least t / 2 matches, so at most e = m - ceil(t / 2) of the item's m words
are without one, and it spans at most 3 m - t words of the document. An item's seeds are its s > e
rarest words, with repetitions; s - e of them must lie in such a span. Spans with so many are aligned:
no document at or over the threshold is missed, whatever the edits and however often it is copied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Items and bytes of items taken at once: the bounds of what a pass sends to the executors.
BLOCK, BLOCK_BYTES = 20_000, 32 << 20
LEAST_WORDS, SIMILARITY = 5, 0.5
#: Words of documents looked up at once, and cells of an alignment of many pairs: bounds of memory.
PIECE, CELLS = 4096, 1 << 20
_BREAKS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of characters other than ASCII blanks, marks and controls, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Items:
    """A block of test items: vocabulary, token arrays and postings of their seeds."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.vocab = _Vocabulary()
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        for item, text in items:
            found = words(text)
            if len(found) >= LEAST_WORDS:
                self.ids.append(item)
                self.tokens.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in found], np.int64))
        m = np.array([len(t) for t in self.tokens], np.int64)
        self.least = np.array([max(1, math.ceil(2 * n * similarity - 1e-9)) for n in m.tolist()], np.int64)
        self.missing = m - (self.least + 1) // 2
        self.seeds = self.missing + (m - self.missing + 3) // 4
        self.span = 3 * m - self.least
        self.words = np.concatenate([k * len(self.vocab) + np.unique(t) for k, t in enumerate(self.tokens)]) if self.tokens else np.zeros(0, np.int64)

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocab.__getitem__, found), np.int64, len(found))

    def choose_seeds(self, spread: np.ndarray) -> None:
        """spread: documents with each word of the vocabulary."""
        word, item = [], []
        for k, own in enumerate(self.tokens):
            rare = np.unique(own[np.argsort(spread[own], kind="stable")[: self.seeds[k]]])
            word.append(rare)
            item.append(np.full(len(rare), k))
        w, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, item))
        order = np.argsort(w, kind="stable")
        self.seed_item = i[order]
        self.first = np.searchsorted(w[order], np.arange(len(self.vocab) + 1))

    def windows(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, from, to): windows with enough seeds, which hold every alignment that reaches the threshold."""
        if not self.ids:
            return
        overlap = int(self.span.max())
        size = max(PIECE, 4 * overlap)
        some: list[tuple[int, int, np.ndarray]] = []
        n = 0
        for d, tokens in enumerate(docs):
            for at in range(0, max(1, len(tokens) - overlap), size - overlap):
                if n and n + len(tokens) - at > size:
                    yield from self._windows(some, docs)
                    some, n = [], 0
                some.append((d, at, tokens[at : at + size]))
                n += len(some[-1][2])
        yield from self._windows(some, docs)

    def bound(self, item: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each row of b no less than the score of its alignment with the item: every word that the item has counts as matched."""
        code = item[:, None] * len(self.vocab) + b
        has = self.words[np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)] == code
        total = np.cumsum(np.where(has & (b >= 0), 2, -1), axis=1)
        return (total - np.minimum(np.minimum.accumulate(total, axis=1), 0)).max(axis=1)

    def _windows(self, some: list[tuple[int, int, np.ndarray]], docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        tokens = np.concatenate([t for *_, t in some]) if some else np.zeros(0, np.int64)
        piece = np.repeat(np.arange(len(some)), [len(t) for *_, t in some])
        at = np.flatnonzero(tokens >= 0)
        first = self.first[tokens[at]]
        n = self.first[tokens[at] + 1] - first
        total = int(n.sum())
        if not total:
            return
        at = np.repeat(at, n)
        item = self.seed_item[np.arange(total) + np.repeat(first - np.cumsum(n) + n, n)]
        key = piece[at] * len(self.ids) + item
        order = np.argsort(key, kind="stable")
        key, at, item = key[order], at[order], item[order]
        last = np.arange(total) + (self.seeds - self.missing)[item] - 1
        near = np.minimum(last, total - 1)
        i = np.flatnonzero((last < total) & (key[near] == key) & (at[near] - at < self.span[item]))
        if not len(i):
            return
        key, item, to, from_ = key[i], item[i], at[i] + self.span[item[i]], at[near[i]] - self.span[item[i]] + 1
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (from_[1:] > to[:-1])])
        starts = np.cumsum([0, *(len(t) for *_, t in some)])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(i)]):
            p, k = int(key[a]) // len(self.ids), int(item[a])
            d, offset, _ = some[p]
            left, right, span = max(0, int(from_[a] - starts[p]) + offset), min(len(docs[d]), int(to[b - 1] - starts[p]) + offset), int(self.span[k])
            for x in range(left, max(left + 1, right - span), 2 * span):
                yield d, k, x, min(right, x + 3 * span)


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment of each row of a with the same row of b: match 2, mismatch -1, gap -1."""
    rows, width = b.shape
    ramp = np.arange(1, width + 1, dtype=np.int32)
    before = np.zeros((rows, width + 1), np.int32)
    best = np.zeros(rows, np.int32)
    for i in range(a.shape[1]):
        step = np.where(a[:, i : i + 1] == b, 2, -1).astype(np.int32)
        now = np.maximum(np.maximum(before[:, :-1] + step, before[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        before[:, 1:] = now
        best = np.maximum(best, now.max(axis=1))
    return best


def all_matches(items: Items, docs: list[np.ndarray]) -> list[dict[int, float]]:
    """For each document the items (places in the block) that reach the threshold, with their similarity."""
    todo = sorted(items.windows(docs), key=lambda t: (len(items.tokens[t[1]]), t[3] - t[2]))
    out: list[dict[int, float]] = [{} for _ in docs]
    at = 0
    while at < len(todo):
        n = 1
        while at + n < len(todo) and n < 256 and (n + 1) * len(items.tokens[todo[at + n][1]]) * 6 <= CELLS:
            n += 1
        some = todo[at : at + n]
        at += n
        b = np.full((n, max(to - from_ for *_, from_, to in some)), -3, np.int64)
        for r, (d, _, from_, to) in enumerate(some):
            b[r, : to - from_] = docs[d][from_:to]
        own = np.array([i for _, i, *_ in some])
        may = np.flatnonzero(items.bound(own, b) >= items.least[own])
        some, b = [some[r] for r in may.tolist()], b[may]
        a = np.full((len(some), max((len(items.tokens[i]) for _, i, *_ in some), default=0)), -2, np.int64)
        for r, (_, item, *_) in enumerate(some):
            a[r, : len(items.tokens[item])] = items.tokens[item]
        for (d, item, *_), score in zip(some, align(a, b).tolist()):
            if score >= items.least[item]:
                out[d][item] = max(out[d].get(item, 0.0), score / (2 * len(items.tokens[item])))
    return out


def best_matches(items: Items, docs: list[np.ndarray]) -> list[tuple[int | None, float]]:
    """For each document the item of highest similarity (smallest item id on ties), and that similarity; null and 0 if none reaches the threshold."""
    best = [max(((s, -items.ids[k]) for k, s in found.items()), default=None) for found in all_matches(items, docs)]
    return [(-x[1], x[0]) if x else (None, 0.0) for x in best]


def item_blocks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> Iterator[Items]:
    """Blocks of items with their seeds chosen over all documents."""
    spark = docs.sparkSession
    small_batches(docs)
    known = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = Items(sorted((r.item_id, r.text) for r in part.collect()), similarity)
        shared = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            n = np.zeros(len(items.vocab), np.int64)
            for b in batches:
                for t in b.column("text"):
                    found = np.unique(items.of(t.as_py()))
                    n[found[found >= 0]] += 1
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["key", "n"])

        spread = np.zeros(len(items.vocab), np.int64)
        counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        got = counted.toArrow()  # one row for each word of the block at most
        spread[got["key"].to_numpy()] = got["n"].to_numpy()
        items.choose_seeds(spread)
        yield items


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, contaminated, item_id, similarity.

    One row per row of docs. item_id is the most similar item that reaches the threshold, else null with similarity 0. Items with a
    null id or text or fewer than five words match nothing. Null and empty documents are clean.
    Repeated rows stay; other columns are not read; an empty table gives an empty one.
    """
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"))
    for items in item_blocks(docs, benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in slices(batches):
                own = best_matches(items, [items.of(t.as_py()) for t in b.column("text")])
                before = zip(b.column("item_id").to_pylist(), b.column("similarity").to_pylist())
                best = [max(x, y, key=lambda m: (m[1], -m[0] if m[0] is not None else 0)) for x, y in zip(before, own)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([i for i, _ in best], pa.int64()), pa.array([s for _, s in best], pa.float64())], ["doc_id", "text", "item_id", "similarity"])

        out = out.mapInArrow(run, "doc_id long, text string, item_id long, similarity double")  # each row keeps its own best from block to block
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.round("similarity", 6).alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, contaminated (true), item_id, similarity: a row for each item that a row of docs leaks. Clean documents have none.

    Nulls, empty texts and tables as in contamination(); rows that repeat an id, or have none, each have their own rows.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(docs, benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in slices(batches):
                found = all_matches(items, [items.of(t.as_py()) for t in b.column("text")])
                rows = [(d.as_py(), items.ids[k], s) for d, f in zip(b.column("doc_id"), found) for k, s in sorted(f.items())]
                d, i, s = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "similarity"])

        part = slim.mapInArrow(run, "doc_id long, item_id long, similarity double")
        out = part if out is None else out.union(part)
    return out.select("doc_id", F.lit(True).alias("contaminated"), "item_id", F.round("similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that no item matches, with all their columns. A pass per block of items.

    Rows with null or empty texts stay, as do repeated rows; extra columns of any name stay as they are.
    """
    out = docs
    for items in item_blocks(docs, benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in slices(batches):
                found = best_matches(items, [items.of(t.as_py()) for t in b.column("text")])
                yield b.filter(pa.array([s < similarity for _, s in found]))

        out = out.mapInArrow(run, docs.schema)
    return out
