"""The kept code graph against full builds."""

import random

from mnemosaic.operators import codegraph
from mnemosaic.sources.shared import Scratch
from pyspark.sql import functions as F

FILES = "path string, content string"


def some_file(rng, k):
    body = "".join(f"{rng.choice(['', 'export '])}function f{i}(x) {{\n  return f{rng.randrange(4)}(x) + new T{rng.randrange(3)}();\n}}\nclass T{i} {{}}\n" for i in range(rng.randrange(1, 4)))
    return f'import {{ a }} from "./m{rng.randrange(8)}";\nconst q = require("../lib/m{rng.randrange(8)}.ts");\n' + body + "// " + "long " * 30


def test_any_sequence_of_changes_equals_a_full_build(spark):
    rng = random.Random(4)
    files = {f"src/m{k}.ts": some_file(rng, k) for k in range(6)}
    frame = lambda some: spark.createDataFrame(list(some.items()), FILES)
    kept = codegraph.CodeGraph(spark, f"{Scratch(spark, 'g').root}/x")
    assert kept.refresh(frame(files)) == 6 and kept.refresh(frame(files)) == 0
    for step in range(4):
        gone = rng.choice(sorted(files))
        del files[gone]
        changed = {p: some_file(rng, 0) for p in rng.sample(sorted(files), 2)} | {f"lib/m{step}.ts": some_file(rng, 1), "src/m7.ts": some_file(rng, 2), "short.ts": "tiny"}
        files |= changed
        if step % 2:
            kept.apply(frame(changed), spark.createDataFrame([(gone,)], "path string"))
        else:
            assert kept.refresh(frame(files)) == 4
        if step == 2:
            kept.compact()
        whole = codegraph.CodeGraph(spark, f"{Scratch(spark, 'g').root}/x")
        whole.refresh(frame(files))
        for view in ("nodes", "edges"):
            rows = [sorted(map(repr, getattr(g, view)().collect())) for g in (kept, whole)]
            assert rows[0] == rows[1] and rows[0]


def test_facts_of_several_languages(spark):
    rows = [
        ("a/b.py", "from ..x.y import z\nfrom . import w\nclass A:\n    pass\ndef f():\n    return A() if g() else f()\nasync def g(): pass"),
        ("m.go", "func (t *T) Run(x int) {\n  helper(x)\n}\nfunc helper(x int) {}\ntype T struct {}"),
        ("r.rs", "pub fn one() { two() }\nfn two() {}\nstruct S;"),
        ("J.java", "public final class J {\n  void m() { new J(); }\n}"),
        ("notes.txt", "def f(): pass"), ("e.py", None), ("none.py", ""), (None, "def f(): pass"),
    ]
    got = {}
    for r in codegraph.facts(spark.createDataFrame(rows, FILES)).collect():
        got.setdefault(r.path, set()).add((r.kind, r.name, r.line, r.inside, r.detail))
    assert got["a/b.py"] == {("def", "A", 3, None, "class"), ("def", "f", 5, None, "def"), ("def", "g", 7, None, "def"), ("call", "A", 6, "f", None), ("call", "g", 6, "f", None), ("type", "A", 6, "f", None), ("import", "..x.y", 1, None, "x/y"), ("import", ".", 2, None, "a")}
    assert ("call", "helper", 2, "Run", None) in got["m.go"] and ("def", "T", 5, None, "type") in got["m.go"]
    assert ("call", "two", 1, "one", None) in got["r.rs"] and ("def", "J", 1, None, "class") in got["J.java"]
    assert set(got) == {"a/b.py", "m.go", "r.rs", "J.java"}
