import random

import numpy as np
import xxhash
from mnemosaic.llm import simhash
from mnemosaic.llm.common import Scratch, table
from mnemosaic.llm.components import connected_components


def brute_fingerprint(text):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        parts = parts.replace(c, " ")
    parts = [x for x in parts.split(" ") if x]
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (id, fp). Smallest id reachable over links of two bits or fewer."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(pairs)}


def test_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs, Scratch(spark, "t")).collect()}
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert {d: f for d, (f, _) in got.items()} == dict(want)
    assert {d: c for d, (_, c) in got.items()} == brute_components(want)


def test_links_join_dense_and_sparse_fingerprints(spark):
    rng = random.Random(5)
    hub = rng.getrandbits(64)
    fps = {hub} | {hub ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(400)}
    chain = rng.getrandbits(64)
    for _ in range(40):  # a long path, two bits a step
        fps.add(chain)
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark, "t")
    got = {r.node: r.component for r in connected_components(simhash.links(frame, scratch), scratch).collect()}
    want = brute_components(list(zip(signed, fps)))
    assert {x: got.get(x, x) for x in signed} == want


def test_codeword_indices_meet_within_two_bits():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 23, 300)
    for flip in (0, 1 << 4, 1 << 22 | 1, 1 << 10 | 1 << 3):
        a, b = (set(zip(*(x.tolist() for x in simhash.nearest_indices(u)))) for u in (v, v ^ flip))
        assert {i for i, _ in a & b} == set(range(300))


def test_edges_of_input(spark):
    schema = "doc_id long, text string, fp string"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (9, "lone word", "x"), (None, "A b C d e", "x"), (11, "w " * 60000, "x")]
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, schema), Scratch(spark, "t")).collect())
    by = {d: (f, c) for d, f, c in got}
    assert len(got) == 8 and by[1] == by[2] == by[3] == (0, 1)
    assert by[7][1] == 7 and by[-1] == by[7]
    assert simhash.simhash_components(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
