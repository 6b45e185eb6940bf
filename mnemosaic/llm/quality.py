"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time with a small step, which adds up to one
lookup table per feature; then the pairs that explain most of what is left get tables of two
features in the same way. Scoring is the addition of table entries by bin.

Training reads at most SAMPLE labelled rows, those with the smallest hash of doc_id; that is the only
bounded input. Rows whose crc32(doc_id as text) mod 3 is 1 are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .hashing import word_hashes

SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, STEP, LEAST_LEAF = 120, 60, 0.1, 8
FEATURES = (
    "log_words", "word_length", "upper", "digit", "mark", "bang", "bar", "other_ascii", "non_ascii",
    "newline", "distinct_words", "repeat_next", "top_word", "repeat_lines", "line_words", "entropy",
)


def features(text: str | None) -> list[float]:
    """Numbers of the whole text alone; all zero for an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = word_hashes(raw)
    if not len(words):
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    times = np.unique(words, return_counts=True)[1]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda *codes: float(count[list(codes)].sum()) / size
    p = count[count > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        size / n,
        float(count[65:91].sum()) / size,
        float(count[48:58].sum()) / size,
        share(*b"#$%&*@^~"),
        share(*b"!?"),
        share(*b"|<>{}[]\\/=+_"),
        share(*b"\"'():;-"),
        float(count[128:].sum()) / size,
        share(10),
        len(times) / n ** 0.9,
        float((words[1:] == words[:-1]).sum()) / n,
        float(times.max()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(-(p * np.log2(p)).sum()),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class AdditiveModel:
    def __init__(self, prior: float):
        self.base = float(np.log(prior / (1 - prior)))
        self.edges = [np.zeros(0)] * len(FEATURES)
        self.tables = [np.zeros(1)] * len(FEATURES)
        self.coarse = [np.zeros(0)] * len(FEATURES)
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of few leaves over ordered bins: the value of each bin, from sums of gradients and curvature."""
    cuts = [0, len(g)]
    G, H, N = (np.concatenate(([0.0], np.cumsum(v))) for v in (g, h, n))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            c = np.arange(a + 1, b)
            c = c[(N[c] - N[a] >= LEAST_LEAF) & (N[b] - N[c] >= LEAST_LEAF)]
            if len(c):
                won = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (float(won[k]), int(c[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Deterministic. Without rows of both classes the score is the share of label 1 (0.5 without any)."""
    model = AdditiveModel(float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(k)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(bins[f], y - p, len(model.tables[f]))
            h = np.bincount(bins[f], p * (1 - p), len(model.tables[f]))
            step = STEP * _leaves(g, h, counts[f])
            model.tables[f] += step
            z += step[bins[f]]
    model.coarse = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    p = 1 / (1 + np.exp(-z))
    found = []
    for a in range(k):
        for b in range(a + 1, k):
            cell = coarse[a] * PAIR_BINS + coarse[b]
            g, h = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            found.append((float((g * g / (h + 1)).sum()), a, b, cell))
    found.sort(key=lambda t: (-t[0], t[1], t[2]))
    chosen = [(a, b, cell, np.zeros(PAIR_BINS**2)) for _, a, b, cell in found[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for _, _, cell, flat in chosen:
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            step = STEP * g / (h + 4.0)
            flat += step
            z += step[cell]
    model.pairs = [(a, b, flat.reshape(PAIR_BINS, PAIR_BINS)) for a, b, _, flat in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """docs(doc_id, text) and labels(doc_id, quality). At most sample labelled rows reach the driver, as features."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )
    # sample rows of two numbers at most: the bound of this broadcast
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(matrix(b.column("text")).tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy().astype(np.float64))


def scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score. Null and empty texts get the score of all-zero features; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(matrix(b.column("text"))))], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least so much, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(matrix(b.column("text"))) >= least))

    return small_batches(docs).mapInArrow(run, docs.schema)
