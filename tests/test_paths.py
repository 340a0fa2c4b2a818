"""Learning paths against the list gone through turn after turn."""

import random

from pyspark.sql import functions as F

from spindrift.operators import graph as G


def plain_path(topics, needs, done):
    """topics: (place, node), in any order; a path of (node, turn)."""
    left, out, turn = sorted(topics), [], 0
    taken = set(done)
    moved = True
    while moved:
        moved, turn = False, turn + 1
        for t in left[:]:
            if needs.get(t[1], set()) <= taken:
                left.remove(t)
                out.append((t[1], turn))
                taken.add(t[1])
                moved = True
    return out


def test_paths_as_a_plain_loop(spark):
    draw = random.Random(2)
    edges, needs = set(), {}
    for n in range(120):
        for _ in range(draw.choice([0, 1, 2])):
            edges.add((n, draw.randint(0, 119)))
    for n, p in edges:
        needs.setdefault(n, set()).add(p)
    topics, done, wanted = [], [], {}
    for s in range(30):
        own = [(draw.randint(0, 40), n) for n in range(120) if draw.random() < 0.8]
        finished = {n for n in range(120) if draw.random() < draw.choice([0, 0.3, 0.9])}
        topics += [(s, n, place) for place, n in own]
        done += [(s, n) for n in finished]
        wanted[s] = plain_path(own, needs, finished)
    e = spark.createDataFrame(sorted(edges), "node long, prerequisite long").repartition(3)
    t = spark.createDataFrame(topics, "student int, node long, place int").repartition(3)
    d = spark.createDataFrame(done, "student int, node long")
    found = {}
    for r in G.learning_paths(t.unionByName(t.limit(5)), e, d).orderBy("student", "step").collect():
        found.setdefault(r["student"], []).append((r["node"], r["turn"]))
        assert r["step"] == len(found[r["student"]])
    assert found == {s: p for s, p in wanted.items() if p}
    assert max(turn for p in wanted.values() for _, turn in p) > 2 and sum(map(len, wanted.values())) < len(topics)


def test_cycles_and_empty_lists(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1), (5, 9)], "node long, prerequisite long")
    t = spark.createDataFrame([(0, n, 0) for n in range(6)], "student int, node long, place int")
    none = spark.createDataFrame([], "student int, node long")
    assert [r["node"] for r in G.learning_paths(t, e, none).collect()] == [0]
    assert G.learning_paths(t.filter(F.lit(False)), e, none).count() == 0
