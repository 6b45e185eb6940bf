"""Byte-level BPE encoding with a pair occurrence index, and decoding.

Each Arrow batch lays its new pre-tokens end to end as one array of symbols with links to the
neighbours. An index maps every adjacent pair that has a rank to all its positions. Active ranks are
taken in ascending order from a heap; a rank's positions are merged left to right, and the lists of
the pairs this makes are extended. A merge only makes pairs of higher rank, because its token has no
other source, so each rank is applied once. Known pre-tokens are kept per worker, in bounded number.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, pieces, small_batches, trim

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens that a worker remembers in each of two generations, and the longest it remembers.
REMEMBERED, LONGEST = 90_000, 48
#: Pre-tokens that are laid end to end under one index, and bytes of text that are split at once: bounds of memory.
INDEXED, PIECE = 8_000, 2 << 20
ENDOFTEXT = "<|endoftext|>"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered:
    """A bounded memory in two generations: what the last batches didn't use is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: set[str]) -> dict[str, bytes]:
        out = {w: self.young[w] for w in words & self.young.keys()}
        back = {w: self.old[w] for w in (words & self.old.keys()) - out.keys()}
        self.young.update(back)
        return out | back

    def keep(self, made: dict[str, bytes], fresh: list[str]) -> None:
        self.young.update((w, made[w]) for w in fresh if len(w) <= LONGEST)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class PairIndexBPE:
    """A vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, content: str, remembered: int = REMEMBERED):
        model = json.loads(content)
        vocab = model["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.symbol = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        made: set[int] = set(self.symbol.tolist())
        self.symbol[255] = -1
        self.rank_of: dict[int, int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[left + right]
            if new in made:
                raise ValueError(f"token {new} has two sources: ranks can't be applied in one ascending pass")
            made.add(new)
            self.rank_of[vocab[left] << 20 | vocab[right]] = rank
            self.by_rank.append((vocab[left], vocab[right], new))
        self.bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.known = _Remembered(remembered)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token as int32 bytes, by one index over all of them."""
        if not words:
            return []
        # a byte that UTF-8 never has ends each word: nothing merges across it
        raw = np.frombuffer(b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words]) + b"\xff", np.uint8)
        s = self.symbol[raw]
        size, rank_of, by_rank = len(s), self.rank_of, self.by_rank
        index: dict[int, list[int]] = {}
        keys = np.where((s[:-1] < 0) | (s[1:] < 0), -1, s[:-1] << 20 | s[1:])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        cuts = [0, *(np.flatnonzero(np.diff(ordered)) + 1).tolist(), len(order)]
        first, places_of = ordered[cuts[:-1]].tolist() if len(order) else [], order.tolist()
        for key, a, b in zip(first, cuts, cuts[1:]):
            if key in rank_of:
                index[rank_of[key]] = places_of[a:b]
        sym, after, before = s.tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
        heap = list(index)
        heapq.heapify(heap)
        push, pop, ranked = heapq.heappush, heapq.heappop, rank_of.get
        while heap:
            rank = pop(heap)
            left, right, new = by_rank[rank]
            places = index.pop(rank)
            places.sort()
            for p in places:
                if sym[p] != left:
                    continue
                q = after[p]
                if sym[q] != right:
                    continue
                sym[p] = new
                sym[q] = -2
                n = after[q]
                after[p] = n
                before[n] = p
                o = before[p]
                if o >= 0 and sym[o] >= 0 and (r := ranked(sym[o] << 20 | new)) is not None:
                    if r in index:
                        index[r].append(o)
                    else:
                        index[r] = [o]
                        push(heap, r)
                if sym[n] >= 0 and (r := ranked(new << 20 | sym[n])) is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        push(heap, r)
        done = np.array(sym, np.int32)
        kept = done >= 0
        ends = np.cumsum(kept)[np.flatnonzero(raw == 255)].tolist()
        flat, out, at = done[kept].tobytes(), [], 0
        for end in ends:
            out.append(flat[4 * at : 4 * end])
            at = end
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (int32)."""
        split = []
        for t in texts:
            parts = []
            at = 0
            for m in self.special.finditer(t) if self.special else ():
                parts.append(PRETOKEN.findall(t[at : m.start()]))
                parts.append(self.added[m.group()])
                at = m.end()
            parts.append(PRETOKEN.findall(t[at:]))
            split.append(parts)
        words = {w for parts in split for p in parts if not isinstance(p, int) for w in p}
        known = self.known.of(words)
        fresh = list(words - known.keys())
        for at in range(0, len(fresh), INDEXED):
            some = fresh[at : at + INDEXED]
            known.update(zip(some, self.merge_all(some)))
        self.known.keep(known, fresh)
        out = []
        for parts in split:
            ids = b"".join([np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in parts])
            out.append(np.frombuffer(ids, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[tuple[str, int], PairIndexBPE] = {}


def load(path: str, remembered: int = REMEMBERED) -> PairIndexBPE:
    """The vocabulary at a path, once per worker."""
    if (path, remembered) not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path, remembered] = PairIndexBPE(f.read(), remembered)
        trim()
    return _LOADED[path, remembered]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded string.

    Null texts count as empty (no ids, empty string). Texts of any length are encoded whole. The
    string <|endoftext|> in a text is the added token, as in the library. Rows are neither joined
    nor shuffled; repeated rows stay, other columns are not read. A worker remembers so many pre-tokens in each of two
    generations, about 200 bytes each; the result is the same for any number.
    """
    at = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(at, remembered)
        for batch in gathered(batches, PIECE):
            for b in pieces(batch, size=PIECE):
                ids = bpe.encode_batch([t or "" for t in b.column("text").to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                texts = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, texts], ["doc_id", "ids", "decoded"])

    slim = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode's columns."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
