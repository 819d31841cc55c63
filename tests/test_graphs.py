"""Ancestry and levels on chains, ladders, cycles and several projects at once."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import graphs


def tables(spark, edges, nodes=None):
    names = nodes or {(p, n) for p, a, b in edges for n in (a, b)}
    return (spark.createDataFrame(sorted(names), "project_id STRING, node_id STRING"),
            spark.createDataFrame(edges, "project_id STRING, src STRING, dst STRING"))


def brute(edges, sinks):
    up = {}
    for p, a, b in edges:
        up.setdefault((p, b), set()).add(a)
    out = set()
    for p, s in sinks:
        todo, seen = [s], {s}
        while todo:
            for a in up.get((p, todo.pop()), ()):
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        out |= {(p, s, a) for a in seen}
    return out


def answer(spark, edges, sinks):
    _, e = tables(spark, edges)
    got = graphs.upstream_of(spark.createDataFrame(sorted(sinks), "project_id STRING, node_id STRING"), e).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("kind", ["tree", "dag", "cycles"])
def test_upstream_equals_a_walk(spark, kind):
    rng = random.Random(kind)
    edges = set()
    for p in ("p", "q"):
        for n in range(1, 60):
            for _ in range(1 if kind == "tree" else rng.choice([0, 1, 1, 1, 2, 3])):
                src = rng.randrange(60 if kind == "cycles" else n)
                edges.add((p, f"n{src}", f"n{n}"))
    sinks = {(p, f"n{n}") for p in ("p", "q") for n in (0, 5, 30, 58, 59)} | {("q", "unknown"), ("none", "n1")}
    assert answer(spark, sorted(edges), sinks) == brute(edges, sinks)


def test_pure_cycles_and_loops(spark):
    edges = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "tail"), ("p", "me", "me"), ("p", "me", "x")]
    sinks = {("p", "tail"), ("p", "b"), ("p", "x"), ("p", "me")}
    assert answer(spark, edges, sinks) == brute(edges, sinks)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    edges = spark.range(1, n).select(F.lit("p").alias("project_id"), (F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    sinks = spark.createDataFrame([("p", n - 1), ("p", 10)], "project_id STRING, node_id BIGINT")
    written = []
    real = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: written.append(1) or real(df))
    got = graphs.upstream_of(sinks, edges).groupBy("sink").count().collect()
    assert {(r["sink"], r["count"]) for r in got} == {(n - 1, n), (10, 11)}
    assert len(written) < 30


def test_levels_of_a_long_chain_and_a_ladder(spark):
    n = 5000
    chain = [("p", str(k - 1), str(k)) for k in range(1, n)]
    ladder = [("q", f"{side}{k - 1}", f"{to}{k}") for k in range(1, 8) for side in "ab" for to in "ab"]
    nodes, edges = tables(spark, chain + ladder)
    got = {(r[0], r[1]): r[2] for r in graphs.topo_levels(nodes, edges).collect()}
    assert all(got["p", str(k)] == k for k in range(n)) and all(got["q", f"{s}{k}"] == k for s in "ab" for k in range(8))
