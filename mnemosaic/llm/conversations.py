"""Repair of conversation structure: the cheapest edits that make roles read system?, (user, assistant)+.

Rows get an order number in a range-partitioned sort, and a code of one hex digit: four times the class of the role's initial
plus the fault. A segment is the codes of up to SEGMENT rows of one conversation. A conversation in one segment is searched by
Dijkstra's method on the implicit lattice of (row, grammar state) with the key (cost, audit), which ends at the first accepting
end node taken from the heap. Of a longer one each segment is searched by itself, from each grammar state to each, so that one
conversation may hold any share of all rows; the best ways then follow segment by segment, and what their audits have in common
is put aside. Texts are never gathered: they are read in order, and edits are applied as they pass.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a conversation that are searched at once, as a power of two.
SEGMENT_BITS = 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Ends are 0 and 3.
ENDS = (0, 3)
#: The only state that a user or assistant turn leads to, and that a kept row of each initial (s, u, a, other) leads to.
NEXT = (2, 2, 3, 2)
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: Faults as coded; the first that holds counts.
BLANK, DUPLICATE, CUT = 1, 2, 3
LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of "conv_id:turn" modulo 20. Nulls but of the two keys become one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def ordered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows conv_id, turn, role, text, digest, last, at: at numbers all rows by conv_id, turn (nulls first), role and text."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    rows = turns.select("conv_id", "turn", told("role"), told("text")).withColumns({"digest": F.sha2("text", 256), "last": last})
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return scratch.keep(ranged.withColumn("at", F.monotonically_increasing_id()))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, at, code of ordered rows. Only role and text that occur again in a conversation are looked up."""
    again = rows.filter("last <> ''").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    a, b = rows.select("conv_id", "at", "role", "digest", "last").alias("a"), again.alias("b")
    seen = a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.role = b.role AND a.digest = b.digest"), "left")
    fault = F.when(F.col("last") == "", BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.expr("CASE substring(a.role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    return seen.select("a.conv_id", "at", F.lower(F.hex(initial * 4 + fault)).alias("code"))


def search(codes: str, start: int = 0, ways: bool = False):
    """The least (cost, audit) over the rows: to an accepting end, or with ways to each state that can be reached at the end."""
    heap, done, ends = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            if not ways and state in ENDS:
                return cost, audit
            ends[state] = cost, audit
        else:
            initial, fault = divmod(int(codes[i], 16), 4)
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                paid = cost + TRUNCATED * (fault == CUT)
                heappush(heap, (paid + REROLE, audit + "R", i + 1, NEXT[state]))
                if KEPT[state][initial] is not None:
                    heappush(heap, (paid + KEEP, audit + "K", i + 1, KEPT[state][initial]))
        heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
    return ends


def tally(codes: str, before: int | None = None) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of rows; before: the code of the row before them."""
    all_ = ([] if before is None else [before]) + [int(c, 16) for c in codes]
    faults = [c % 4 for c in all_[before is not None :]]
    illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(all_, all_[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
NAMES = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _arrow(columns: dict[str, list], conv: pa.DataType, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    kinds = {"conv_id": conv, **kinds}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def plans(codes: DataFrame) -> DataFrame:
    """conv_id, audit, cost and the counts of faults for each conversation of coded rows."""
    conv = dict(codes.dtypes)["conv_id"]
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    cut = codes.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(in_order.alias("codes"))  # so many rows at most
    counted = cut.withColumn("of", F.count("*").over(Window.partitionBy("conv_id")))
    out = f"conv_id {conv}, audit string, {COUNTS}, cost bigint"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["codes"].to_pylist()
            found = [search(x) for x in texts]
            counts = list(zip(*map(tally, texts))) or [[]] * 4
            yield _arrow({"conv_id": b["conv_id"].to_pylist(), "audit": [x[1] for x in found], **dict(zip(NAMES, counts)), "cost": [x[0] for x in found]}, b["conv_id"].type, {"audit": pa.string()})

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # sixteen ways of a segment are bounded, those of a batch might be long
                found = [search(b["codes"][k].as_py(), p, True) for p in range(4)]
                flat = [x.get(s, (None, None)) for x in found for s in range(4)]
                each = [b["conv_id"].slice(k, 1), b["segment"].slice(k, 1), b["codes"].slice(k, 1), pa.array([[x[0] for x in flat]], pa.list_(pa.int64())), pa.array([[x[1] for x in flat]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(each, names=["conv_id", "segment", "codes", "costs", "audits"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            cost, tail = min(tails[s] for s in ENDS if s in tails)
            return _arrow({"conv_id": [now], "audit": ["".join(common) + tail], **{n: [x] for n, x in zip(NAMES, counts)}, "cost": [cost]}, kind, {"audit": pa.string()})

        now = before = kind = None
        common: list[str] = []
        tails: dict[int, tuple[int, str]] = {}
        counts = [0] * 4
        for b in batches:
            kind = b["conv_id"].type
            for conv_id, codes, costs, audits in zip(*(b[c].to_pylist() for c in ("conv_id", "codes", "costs", "audits"))):
                if before is None or conv_id != now:
                    if before is not None:
                        yield row()
                    now, before, common, tails, counts = conv_id, None, [], {0: (0, "")}, [0] * 4
                ends: dict[int, tuple[int, str]] = {}
                for p, (cost, tail) in tails.items():
                    for s in range(4):
                        if (more := costs[4 * p + s]) is not None:
                            ends[s] = min(ends.get(s, (1 << 62, "")), (cost + more, tail + audits[4 * p + s]))
                shared = os.path.commonprefix([x[1] for x in ends.values()])
                common.append(shared)
                tails = {s: (cost, tail[len(shared) :]) for s, (cost, tail) in ends.items()}
                counts = [x + y for x, y in zip(counts, tally(codes, before))]
                before = int(codes[-1], 16)
        if before is not None:
            yield row()

    short = counted.filter("of = 1").select("conv_id", "codes").mapInArrow(whole, out)
    split = counted.filter("of > 1").repartition("conv_id", "segment").select("conv_id", "segment", "codes")
    parts = split.mapInArrow(ways, f"conv_id {conv}, segment bigint, codes string, costs array<bigint>, audits array<string>")
    return short.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(along, out))


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after a first row that has its plan."""
    known = plan.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", *NAMES)
    bare = rows.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("long").alias(n) for n in NAMES])
    return small_batches(known.unionByName(bare)).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("plan", plan row), then ("turn", conv_id, edit, role, text) for each row kept, changed or inserted."""
    plan, place, state = None, 0, 0

    def inserted():
        nonlocal place, state
        while plan and place < len(plan["audit"]) and plan["audit"][place] == "I":
            place, state = place + 1, NEXT[state]
            yield "turn", plan["conv_id"], "I", ("user", "assistant")[state - 2], ""

    for b in batches:
        for r in b.to_pylist():
            if r["at"] < 0:
                yield from inserted()
                plan, place, state = r, 0, 0
                yield "plan", r
                continue
            yield from inserted()
            edit, place = plan["audit"][place], place + 1
            if edit == "R":
                state = NEXT[state]
                yield "turn", r["conv_id"], edit, ("user", "assistant")[state - 2], r["text"]
            elif edit == "K":
                state = KEPT[state]["sua".index(r["role"][0])]
                yield "turn", r["conv_id"], edit, r["role"], r["text"]
    yield from inserted()


def repaired_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 0), edit (K kept, R role changed, I inserted), role and text of each conversation once repaired.

    turns: conv_id, turn, role, text. Null roles and texts are one space, so such a text is blank; null turns come first; equal turns
    go by role, then text; rows with a null conv_id are one conversation. Repeated rows are duplicates. A conversation whose
    rows all go has no row here. Other columns are left out.
    """
    rows = ordered(turns, scratch)
    conv = dict(rows.dtypes)["conv_id"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place, size, kind = 0, 0, None

        def typed():
            nonlocal kind
            for b in batches:
                kind = b["conv_id"].type
                yield b

        def batch():
            names = {"conv_id": kind, "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
            return _arrow(dict(zip(names, zip(*held))), kind, names)

        for what, *x in _edited(typed()):
            if what == "plan":
                place = 0
                continue
            held.append((x[0], place, *x[1:]))
            place, size = place + 1, size + len(x[3])
            if len(held) >= 1024 or size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return _stream(rows, plans(coded(rows))).mapInArrow(out, f"conv_id {conv}, place bigint, edit string, role string, text string")


def repaired(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, counts of faults, cost, audit and repaired_sha256 (of role:text, joined by newlines) of each conversation that has rows.

    Cases are those of repaired_turns(). The digest of one conversation is taken by one task, as SHA-256 goes from first byte to
    last; it holds a batch of texts at a time.
    """
    rows = ordered(turns, scratch)
    conv = dict(rows.dtypes)["conv_id"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        hashed = plan = kind = None
        first = True

        def typed():
            nonlocal kind
            for b in batches:
                kind = b["conv_id"].type
                yield b

        def batch():
            return _arrow({c: [x[c] for x in held] for c in ("conv_id", *NAMES, "audit", "repaired_sha256")}, kind, {"audit": pa.string(), "repaired_sha256": pa.string()})

        for what, *x in _edited(typed()):
            if what == "plan":
                if plan:
                    held.append(plan | {"repaired_sha256": hashed.hexdigest()})
                if len(held) >= 1024:
                    yield batch()
                    held = []
                plan, hashed, first = x[0], hashlib.sha256(), True
                continue
            hashed.update(f"{'' if first else chr(10)}{x[2]}:".encode())
            hashed.update(x[3].encode("utf-8", "surrogatepass"))
            first = False
        if plan:
            held.append(plan | {"repaired_sha256": hashed.hexdigest()})
        if held:
            yield batch()

    fields = ", ".join(f"{n} bigint" for n in NAMES)
    return _stream(rows, plans(coded(rows))).mapInArrow(out, f"conv_id {conv}, {fields}, audit string, repaired_sha256 string")


def gaps(original: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id of every original row, with the turns that its rows in turns leave out between first and last (0 without turns; null beyond a long)."""
    there = original.select("conv_id", F.lit(None).cast("long").alias("turn")).unionByName(turns.select("conv_id", F.col("turn").cast("long").alias("turn")))
    once = there.groupBy("conv_id", "turn").agg(F.lit(1).alias("_"))
    wide = "CAST(max(turn) AS DECIMAL(20)) - min(turn) + 1 - count(turn)"
    return once.groupBy("conv_id").agg(F.expr(f"CASE WHEN count(turn) = 0 THEN 0L ELSE try_cast({wide} AS BIGINT) END").alias("gaps"))


def damage_report(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation of the table: what damaged() did to it, and how it is repaired. An empty table gives no row."""
    turns = damaged(conversations)
    a, b = gaps(conversations, turns).alias("a"), repaired(turns, scratch).alias("b")
    both = a.join(b, F.expr("a.conv_id <=> b.conv_id"), "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    counts = [F.coalesce(f"b.{n}", F.lit(0)).cast("long").alias(n) for n in NAMES]
    return both.select("a.conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
