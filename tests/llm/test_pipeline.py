import hashlib

import numpy as np
import pytest

import corpus_pipeline
from mnemosaic.llm import bpe, decontam, hashing, neardup, quality
from mnemosaic.llm.common import Scratch, table
from mnemosaic.sources.shared import application_dir, names


def brute_groups(texts):
    """Connected components of five-word shingle similarity of 0.8 or more, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in texts}
    ids = sorted(texts)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if label[a] != label[b] and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                    met = len(sets[a] & sets[b])
                    if met >= 0.8 * (len(sets[a]) + len(sets[b]) - met):
                        low, high = sorted((label[a], label[b]))
                        label = {d: low if x == high else x for d, x in label.items()}
                        changed = True
    return label


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_match_brute_force(spark, sf, block, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK", block)

    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect() if len(r.text) < 4000}
    vocab = [w for t in list(texts.values())[:50] for w in t.split()]
    for k, d in enumerate(sorted(texts)[:60]):
        w = texts[d].split()
        for _ in range(max(1, len(w) // 90)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[10_000 + k] = " ".join(w)
    hub = rng.choices(vocab, k=150)
    for k in range(90):  # a group of many alike documents
        w = list(hub)
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[20_000 + k] = " ".join(w)
    frame = spark.createDataFrame([*texts.items(), (None, "x"), (90_000, None), (90_001, "")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(frame, Scratch(spark, "t")).collect()}
    want = brute_groups(texts)
    assert all(want[d] == c for d, c in got.items())  # every link is exact; the search for candidates is not
    missed = {d for d in texts if want[d] != d} - {d for d in got if got[d] != d}
    assert not missed
    kept = neardup.keep_one_of_each_group(frame, Scratch(spark, "t"))
    assert kept.columns == frame.columns and kept.count() == frame.count() - sum(d != c for d, c in want.items())


def test_run_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    good = {r.doc_id: r.text for r in docs.collect() if model.score(np.array([quality.features(r.text)]))[0] >= 0.5}
    first = {}
    for d in sorted(good, key=lambda d: (-len(good[d]), d)):
        first.setdefault("".join(good[d].split()), d)
    exact = {d: good[d] for d in first.values()}
    label = brute_groups(exact)
    near = {d: t for d, t in exact.items() if label[d] == d}
    items = decontam.Items([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    bad = set()
    for d, t in near.items():  # the whole text aligned with every item
        own = items.of(t)
        if any(len(own) and decontam.align(a[None, :], np.where(own < 0, -3, own)[None, :])[0] >= decontam.SIMILARITY * 2 * len(a) for a in items.tokens):
            bad.add(d)
    assert bad
    want = {d: t for d, t in near.items() if d not in bad}
    root = application_dir(spark)
    tables = lambda: {(d, t) for d in names(spark, root) for t in names(spark, f"{root}/{d}")}
    seen = tables()
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == set(want)
    assert [d.split("-")[0] for d, _ in tables() - seen] == ["pipeline"]  # the last stage's input alone is left
    mine = bpe.load(bpe.default_vocabulary())
    for d, r in rows.items():
        ids = mine.encode_batch([want[d]])[0].tolist()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[d].encode()).hexdigest())


def test_stages_keep_columns_and_bear_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out


def test_appended_and_cut_copies_are_found(spark):
    import random

    rng = random.Random(12)
    texts, pairs = {}, []
    for k, (n, more) in enumerate([(300, 72), (300, 45), (100, 24), (800, 190), (40, 9), (60, 10)] * 12):
        body = [f"b{k}x{i}" for i in range(n)] if k % 3 else rng.choices([f"v{i}" for i in range(60)], k=n)
        end = [f"e{k}x{i}" for i in range(more)]
        texts[2 * k] = " ".join(body)
        texts[2 * k + 1] = " ".join(end + body if k % 2 else body + end)
        pairs.append((2 * k, 2 * k + 1))
    want = brute_groups(texts)
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(frame, Scratch(spark, "t")).collect()}
    assert sum(want[a] == want[b] for a, b in pairs) >= 60
    assert {d: got.get(d, d) for d in texts} == want
    # the same where most shingles are common
    line = " ".join(f"l{i}" for i in range(90))
    texts = {d: f"{line} {t}" for d, t in texts.items()}
    want = brute_groups(texts)
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(frame, Scratch(spark, "t")).collect()}
    assert {d: got.get(d, d) for d in texts} == want


def test_rows_that_share_an_id_alone_are_not_one_document(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, w, "a"), (2, w + " extra", "b"), (2, " ".join(f"z{i}" for i in range(30)), "c"), (None, w + " more", "d"), (None, None, "e"), (4, "", "f"), (4, "", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    kept = neardup.keep_one_of_each_group(frame, Scratch(spark, "t"))
    assert kept.columns == frame.columns
    assert sorted(r["_h"] for r in kept.collect()) == ["c", "d", "e", "f", "g"]


@pytest.mark.parametrize("kind", ["append", "drop", "edit"])
def test_pairs_of_barely_enough_similarity_are_all_found(spark, kind):
    """100 planted pairs of each kind at 0.80 to 0.85, against the exact similarity of each pair."""
    import random

    rng = random.Random(kind)
    texts, pairs, n = {}, [], 0
    while len(pairs) < 100:
        size = rng.randrange(30, 900)
        a = [f"t{n}x{rng.randrange(size if n % 2 else 60)}" for _ in range(size)]
        if kind == "append":
            b = a + [f"t{n}y{i}" for i in range(int(size * rng.uniform(0.15, 0.25)))]
        elif kind == "drop":
            at, cut = rng.randrange(size), int(size * rng.uniform(0.12, 0.2))
            b = a[:at] + a[at + cut :]
        else:
            b = list(a)
            for i in rng.sample(range(size), max(1, int(size * rng.uniform(0.018, 0.025)))):
                b[i] = f"t{n}z{i}"
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
        similarity = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        if 0.8 <= similarity <= 0.85:
            texts[2 * n], texts[2 * n + 1] = " ".join(a), " ".join(b)
            pairs.append((2 * n, 2 * n + 1))
        n += 1
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(frame, Scratch(spark, "t")).collect()}
    assert all(got.get(b) == a for a, b in pairs)


def test_long_and_odd_texts_hash_alike_whatever_the_pieces(monkeypatch):
    text = "  Ab\u00e9 c\t" + "x" * 300 + " d\n" * 50 + "\ud800 e" + " long" * 100
    raw = text.encode("utf-8", "surrogatepass")
    whole = hashing.word_hashes(raw)
    for piece in (1, 7, 64, 301):
        monkeypatch.setattr(hashing, "PIECE", piece)
        assert (hashing.word_hashes(raw) == whole).all()
    assert len(whole) == len(raw.split()) and len(set(whole.tolist())) == len(set(raw.split()))
