"""Near-duplicates by the similarity of word shingles: Golay links first, then exact shingle prefixes.

Links of two bits, as simhash.py makes them with its Golay keys, are the first candidates: they join the closest
copies. Most pairs whose five-word shingles are 0.8 similar differ in about ten bits, though, so a second search
follows that misses no pair. A document's keys are the first of its shingles in one order for all documents, so
many that two sets that similar share one. The order is by frequency, from counts over all documents in a table of
fixed size, so that common lines come last and make few candidates. The exact similarity of the sets decides.

Groups of many alike documents are not paired off. In each star round a key's documents are held against the
smallest of them, each document against one such only, and what is similar becomes one component. Then only pairs
of different components remain. Keys of few documents are joined to themselves. Those of a crowd go in blocks, and
a block gives only the pairs that share enough keys to be that similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Marks, Scratch, fresh, slices, small_batches
from .components import connected_components
from .hashing import BASE, mixed, word_hashes
from .simhash import links

WORDS, SIMILARITY = 5, 0.8
#: Rows of the table of counts, and bits of the table of keys that more than one document has: bounds of what is broadcast.
BUCKETS, KEY_BITS = 1 << 18, 1 << 26
#: Star rounds, documents of a key from which it counts as a crowd, and documents in a block.
ROUNDS, CROWD, BLOCK = 2, 64, 512

def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; the whole sequence if it is shorter."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = (total + words[k : len(words) - n + 1 + k]) * np.uint64(BASE)
    return np.unique(mixed(total))


def _bits(found: np.ndarray) -> int:
    """SimHash of the distinct shingles, as a signed number."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        some = found[at : at + (1 << 15)].astype(">u8")
        set_ += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(found)).tobytes(), "big", signed=True)


def prefix_keys(found: np.ndarray, similarity: float, spread: np.ndarray) -> np.ndarray:
    """The first of the shingles, rarest first, so many that two sets that similar share one."""
    order = np.lexsort((found, spread[(found >> np.uint64(46)).astype(np.int64)]))
    return found[order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]]


class Numbered:
    """A number for each document: its doc_id, or one of its own where several texts share the id or it is null.

    Rows equal in doc_id and text are one document.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch):
        slim = self._slim(docs)
        shared = slim.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi OR id IS NULL").select(F.col("id").alias("_id"))
        shared = scratch.keep(shared)
        self.own = None
        if not shared.isEmpty():
            rows = scratch.keep(slim.join(shared, F.col("id").eqNullSafe(F.col("_id"))).select("id", "h").distinct())
            least = slim.agg(F.coalesce(F.min("id"), F.lit(0))).first()[0]
            self.own = scratch.keep(rows.select("id", "h", (F.lit(least - 1) - F.monotonically_increasing_id()).alias("node")))
            self.marks = Marks(self.own.select(F.coalesce("id", F.lit(0))), scratch)

    @staticmethod
    def _slim(docs: DataFrame) -> DataFrame:
        text = F.col("text").cast("string")
        return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))

    def of(self, docs: DataFrame, name: str) -> DataFrame:
        """docs with a column of that name for the number. Only rows whose doc_id may be shared are joined."""
        i = F.col("doc_id").cast("long")
        if self.own is None:
            return docs.withColumn(name, i)
        may, plain = self.marks.split(docs, F.coalesce(i, F.lit(0)))
        own = self.own.toDF("_own_id", "_own_h", "_own_node")
        h = F.xxhash64(F.coalesce(may["text"].cast("string"), F.lit("")))
        met = may.join(own, may["doc_id"].cast("long").eqNullSafe(own["_own_id"]) & (h == own["_own_h"]), "left")
        return plain.withColumn(name, i).union(met.select(*[may[c] for c in docs.columns], F.coalesce(own["_own_node"], may["doc_id"].cast("long")).alias(name)))

    def least(self, components: DataFrame) -> DataFrame:
        """(node, component) -> (node, id, keep, keep_id): the document that stays is that of the smallest doc_id, null first."""
        if self.own is None:
            return components.select("node", F.col("node").alias("id"), F.col("component").alias("keep"), F.col("component").alias("keep_id"))
        own = self.own.withColumnsRenamed({"node": "_n"})
        known = components.join(own, F.col("node") == F.col("_n"), "left").select("node", "component", F.when(F.col("_n").isNotNull(), F.col("id")).otherwise(F.col("node")).alias("id"), F.coalesce("h", F.lit(0)).alias("h"))
        first = known.groupBy("component").agg(F.min(F.struct("id", "h", "node")).alias("m"))
        return known.join(first, "component").select("node", "id", F.col("m.node").alias("keep"), F.col("m.id").alias("keep_id"))


def spread_of(slim: DataFrame) -> np.ndarray:
    """Documents by bucket of shingle hash, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for t in b.column("text"):
                np.add.at(n, (shingles(t.as_py()) >> np.uint64(46)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    got = slim.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _shared_bits(slim: DataFrame, similarity: float, spread) -> np.ndarray:
    """Bits of the keys that more than one document has, by remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t.as_py()) for t in b.column("text")]
            keys = [prefix_keys(s, similarity, spread.value) for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], ["key"])

    shared = slim.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    place = shared.select(F.pmod("key", F.lit(KEY_BITS)).cast("int").alias("p"))
    words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("b")).toArrow()
    out = np.zeros(KEY_BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def keyed_documents(slim: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, n, fp, keys): number of shingles, SimHash, and the prefix keys that another document may have, of each document that has such keys."""
    sc = slim.sparkSession.sparkContext
    spread = sc.broadcast(spread_of(slim))
    shared = sc.broadcast(_shared_bits(slim, similarity, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in slices(batches):
            rows = []
            for node, t in zip(b.column("node").to_pylist(), b.column("text")):
                s = shingles(t.as_py())
                if len(s):
                    keys = prefix_keys(s, similarity, spread.value)
                    place = keys & np.uint64(KEY_BITS - 1)
                    keys = keys[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                    if len(keys):
                        rows.append((node, len(s), _bits(s), keys.view(np.int64)))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["node", "n", "fp", "keys"])

    return slim.mapInArrow(run, "node long, n int, fp long, keys array<long>").dropDuplicates(["node"])


def _near(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _behind(n: str, similarity: float) -> Column:
    """Shingles behind the prefix: all that two documents can share besides prefix keys, by the one whose prefix ends first."""
    return F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1


def _enough(met: Column, similarity: float) -> Column:
    """Whether documents u and v of nu and nv shingles can be that similar with so many prefix keys in common."""
    return met + F.greatest(_behind("nu", similarity), _behind("nv", similarity)) >= F.lit(similarity / (1 + similarity)) * (F.col("nu") + F.col("nv")) - 1e-6


def _verified(pairs: DataFrame, known: DataFrame, slim: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs (u, v) whose shingle sets are that similar.

    Sizes and prefix keys rule out most others first. Then only the texts of the pairs left are read again; others are scanned alone.
    """
    u, v = (known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}")) for x in ("u", "v"))
    likely = pairs.join(u, "u").join(v, "v").filter(_near("nu", "nv", similarity)).filter(_enough(F.size(F.array_intersect("ku", "kv")), similarity))
    pairs = scratch.keep(likely.select("u", "v"))
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    marks = Marks(needed, scratch)
    may, _ = marks.split(slim, F.col("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))], ["node", "s"])

    sets = scratch.keep(may.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"]))
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    met = F.size(F.array_intersect("a", "b"))
    out = scratch.keep(both.filter(met >= F.lit(similarity) * (F.size("a") + F.size("b") - met) - 1e-9).select("u", "v"))
    scratch.drop(pairs, marks.words, sets)
    return out


def _golay_pairs(known: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of documents that stand for fingerprints two bits apart or fewer, and of each document with the one that stands for its own."""
    least = scratch.keep(known.groupBy("fp").agg(F.min("node").alias("node")))
    edges = scratch.keep(links(least, scratch))
    a, b = (least.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")) for x in ("u", "v"))
    apart = edges.join(a, "u").join(b, "v").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
    own = known.select("fp", F.col("node").alias("v")).join(least.select("fp", F.col("node").alias("u")), "fp").filter("u <> v").select("u", "v")
    return scratch.keep(apart.union(own).distinct())


def _crowd_pairs(crowds: DataFrame, similarity: float) -> DataFrame:
    """crowds(key, blocks, block, node, n, c, keys) -> (u, v) of different components that share enough keys to be that similar.

    A task has the documents of one key from one block or from two, so a key of any size is spread over tasks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = crowds.select("*", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "c", "keys")

    def run(table: pa.Table) -> pa.Table:
        block, nodes, c = (table[x].to_numpy() for x in ("block", "node", "c"))
        n = table["n"].to_numpy().astype(np.float64)
        lists = table["keys"].combine_chunks()
        keys, size = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        values, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        column = np.full(len(values), -1)
        column[often] = np.arange(len(often))
        row, col = np.repeat(np.arange(len(n)), size), column[place]
        met = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, len(often), 2048):
            has = np.zeros((len(n), 2048), np.float32)
            own = np.flatnonzero((col >= at) & (col < at + 2048))
            has[row[own], col[own] - at] = 1
            met += has @ has.T
        behind = np.ceil(similarity * n - 1e-9) - 1
        left = np.flatnonzero(block == table["i"][0].as_py()) if table["i"][0] != table["j"][0] else np.arange(len(n))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 256):
            r = left[at : at + 256]
            enough = met[r] + np.maximum(behind[r][:, None], behind) >= similarity / (1 + similarity) * (n[r][:, None] + n) - 1e-6
            alike = np.minimum(n[r][:, None], n) >= similarity * np.maximum(n[r][:, None], n) - 1e-9
            x, y = np.nonzero(enough & alike & (met[r] > 0) & (c[r][:, None] != c))
            us.append(nodes[r[x]])
            vs.append(nodes[y])
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
        return pa.table({"u": pairs[0], "v": pairs[1]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicate_components(slim: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """slim(node, text) -> (node, component) for documents that have a near-duplicate; the smallest node of all that are reached."""
    known = scratch.keep(keyed_documents(slim, similarity))  # without a shared prefix key a document is like no other
    tested = _golay_pairs(known.select("node", "fp"), scratch)
    found = _verified(tested, known, slim, similarity, scratch)
    scratch.drop_but(known, tested, found)

    def live(rows: DataFrame) -> DataFrame:
        """rows(node, n, keys or key) -> the documents of each key that documents of more than one component have."""
        component = scratch.keep(connected_components(found, scratch))
        key = F.explode("keys").alias("key") if "keys" in rows.columns else F.col("key")
        placed = scratch.keep(rows.join(component, "node", "left").select(key, "node", "n", F.coalesce("component", "node").alias("c")))
        split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("node", "n", "c")).alias("least"), F.count("*").alias("k")).filter("lo <> hi").select("key", "least", "k")
        return scratch.keep(placed.join(split, "key"))

    now = live(known.select("node", "n", "keys"))
    for _ in range(ROUNDS):
        scratch.drop_but(known, tested, found, now)
        star = now.select("key", F.col("node").alias("v"), "n", "c", "least.*").toDF("key", "v", "n", "c", "u", "nu", "cu").filter(F.col("c") != F.col("cu")).filter(_near("n", "nu", similarity))
        met = star.groupBy("u", "v").agg(F.count("*").alias("met")).join(tested, ["u", "v"], "left_anti")
        pairs = scratch.keep(met.groupBy("v").agg(F.max(F.struct("met", "u")).alias("best")).select("best.u", "v"))
        more = _verified(pairs, known, slim, similarity, scratch)
        found, tested = scratch.keep(found.union(more)), scratch.keep(tested.union(pairs))
        now = live(now.select("key", "node", "n"))
    scratch.drop_but(known, tested, found, now)
    few, crowd = now.filter(f"k <= {CROWD}"), now.filter(f"k > {CROWD}").select("key", "k", "node", "n", "c")
    many = crowd.groupBy("node").agg(F.count("*").alias("q"))  # keys that the count over few documents doesn't see
    few = scratch.keep(few.join(many, "node", "left").select("key", "node", "n", "c", F.coalesce("q", F.lit(0)).alias("q")))
    a, b = (few.select("key", F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("q").alias(f"q{x}")) for x in ("u", "v"))
    both = a.join(b, "key").filter("u < v AND cu <> cv").filter(_near("nu", "nv", similarity)).groupBy("u", "v", "nu", "nv", "qu", "qv").agg(F.count("*").alias("met"))
    enough = _enough(F.col("met") + F.least("qu", "qv"), similarity)
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    crowds = crowd.join(known.select("node", "keys"), "node").select("key", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "n", "c", "keys")
    rest = both.filter(enough).select("u", "v").union(_crowd_pairs(crowds, similarity)).distinct()
    pairs = scratch.keep(rest.join(tested, ["u", "v"], "left_anti"))
    found = scratch.keep(found.union(_verified(pairs, known, slim, similarity, scratch)))
    scratch.drop_but(found)
    return scratch.keep(connected_components(found, scratch))


def _grouped(docs: DataFrame, scratch: Scratch, similarity: float) -> tuple[Numbered, DataFrame]:
    held = Scratch(scratch.spark, "numbers")
    numbered = Numbered(docs, held)
    slim = numbered.of(small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")), "node").select("node", "text")
    found = near_duplicate_components(slim, scratch, similarity)
    out = scratch.keep(numbered.least(found))
    scratch.drop_but(out)
    return numbered, out


def near_duplicate_groups(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id): the smallest doc_id of its group (null first), for documents that have a near-duplicate.

    Rows equal in doc_id and text are one document; rows that share an id alone are not. Null and empty texts link to none.
    Other columns are not read. An empty table gives an empty one.
    """
    return _grouped(docs, scratch, similarity)[1].select(F.col("id").alias("doc_id"), F.col("keep_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near-duplicates of smaller doc_id, with all their columns.

    Rows equal in doc_id and text stay or go together. Null and empty texts stay. Extra columns of any name stay as they are.
    """
    numbered, found = _grouped(docs, scratch, similarity)
    gone = scratch.keep(found.filter("node <> keep").select("node"))
    marks = Marks(gone, scratch)
    scratch.drop(found)
    node = fresh(docs, "_node")
    may, clean = marks.split(numbered.of(docs, node), F.col(node))
    kept = may.join(gone.withColumnRenamed("node", node), node, "left_anti").select(*may.columns)
    return clean.union(kept).drop(node)
