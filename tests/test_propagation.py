"""Label propagation: the number of tasks follows the edges, the labels don't follow the number of tasks."""

import random
from collections import Counter

from mnemosaic.operators import graph
from pyspark.sql import functions as F


def test_labels_are_the_same_over_any_number_of_tasks(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(40), 100 + rng.randrange(30)) for _ in range(120)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(3):
        seen = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(c, key=lambda x: (-c[x], x)) for n, c in seen.items()}
    size = Counter(label.values())
    want = {(n, c) for n, c in label.items() if size[c] >= 3}
    given = spark.createDataFrame(edges, "src long, dst long")
    for most in (1 << 20, 16):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        assert {(r.id, r.community) for r in graph.label_propagation(given, 3).collect()} == want
    dealt = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df: dealt.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df))
    graph.label_propagation(given, 1)
    assert sum("RepartitionByExpression [src" in p and ", 16" in p for p in dealt) == 2  # 240 edges both ways, 16 to a task
