import hashlib
import random
import zlib

from mnemosaic.llm import conversations as cv
from mnemosaic.llm.common import Scratch, table

SCHEMA = "conv_id long, turn long, role string, text string, best string"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {"s": 1, "u": 2, "a": 3}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_edits(turns):
    """The least (cost, audit), row by row over all states; turns: (role, fault)."""

    def with_inserts(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                t = AFTER[NEXT[s]]
                best[t] = min(best.get(t, (1e9, "")), (c + 2, a + "I"))
        return best

    best = with_inserts({0: (0, "")})
    for role, fault in turns:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways.append((AFTER[NEXT[s]], c + 2 + more, "R"))
                if role[:1] == NEXT[s] or s == 0 and role[:1] == "s":
                    ways.append((AFTER[role[0]], c + more, "K"))
            for t, cost, e in ways:
                new[t] = min(new.get(t, (1e9, "")), (cost, a + e))
        best = with_inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def plain_report(rows):
    out, damaged = {}, plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, marked = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit = plain_edits([(r, f) for r, _, f in marked])
        state, left, done = 0, list(marked), []
        for e in audit:
            role, text = {"u": "user", "a": "assistant"}[NEXT[state]], ""
            if e != "I":
                kept, text, _ = left.pop(0)
                role = kept if e == "K" else role
            if e != "D":
                done.append(f"{role}:{text}")
                state = AFTER[role[0]]
        faults = [f for _, _, f in marked]
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def same(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = cv.damage_report(frame, Scratch(spark, "t")).collect()
    assert found[0].__fields__ == ["conv_id", "gaps", *cv.NAMES, "audit", "repaired_sha256"] if found else True
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found) and got == plain_report(rows)


def test_query_matches_a_plain_walk(spark, sf):
    same(spark, [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()])


def wild(rng, n):
    return [(rng.choice([None, 1, 2, 3, 4, 2**62]), rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "assistant", "tool", "ünder", "user2"]), rng.choice([None, "", " \t\n", "Yes.", "no", "A! ", "é?\n", "b . c", "x" * 3000])) for _ in range(n)]


def test_nulls_ties_repeats_and_odd_roles(spark):
    rng = random.Random(5)
    same(spark, wild(rng, 300))
    same(spark, [(7, None, "user", "Same."), (7, None, "user", "Same."), (None, None, None, None), (8, -(2**40), "user", "Hi."), (8, 2**40, "assistant", "Yes.")])


def test_segments_give_what_one_search_gives(spark, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT_BITS", 3)
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), t, rng.choice(["system", "user", "assistant", "user", "assistant", "x"]), rng.choice(["Yes.", "no", f"{t}.", f"{t}", ""])) for t in range(400)]
    same(spark, rows)


def test_search_is_the_least_of_all(spark):
    rng = random.Random(7)
    for _ in range(300):
        turns = [(rng.choice("suax"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(8))]
        codes = "".join(f"{'suax'.index(r) * 4 + ['', 'blank', 'duplicate', 'truncated'].index(f):x}" for r, f in turns)
        assert cv.search(codes) == plain_edits(turns)


def test_repaired_turns_read_as_the_digest_says(spark, sf):
    turns = cv.damaged(table(spark, sf, "conversations"))
    texts = {}
    for r in sorted(cv.repaired_turns(turns, Scratch(spark, "t")).collect(), key=lambda r: (r.conv_id, r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in cv.repaired(turns, Scratch(spark, "t")).collect():
        assert hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_and_wide_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.damage_report(empty, Scratch(spark, "t")).count() == 0
    assert cv.repaired_turns(cv.damaged(empty), Scratch(spark, "t")).count() == 0
    wide = spark.createDataFrame([(1, -(2**63), "user", "A."), (1, 2**63 - 1, "user", "B.")], "conv_id long, turn long, role string, text string")
    assert cv.gaps(wide, wide).first().gaps is None
