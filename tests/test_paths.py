"""Searches against restatements on random small graphs, and on hand-made ones."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from roadflow.operators import graph, paths, walk
from roadflow.plans.route import find_paths, present

SIX = [("1", "2", 7), ("1", "10", 3), ("10", "2", 1), ("2", "3", 2), ("3", "4", 2), ("10", "20", 9), ("20", "4", 1), ("2", "1", 7)]


def _frames(spark, edges, places=None):
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    nodes = spark.createDataFrame([(i, 144.9 + 0.001 * k, -37.8 + 0.002 * (k % 3)) if not places else (i, *places[i]) for k, i in enumerate(ids)], "id string, lon double, lat double")
    return nodes, spark.createDataFrame(edges, "src string, dst string, weight bigint")


def _best(edges, s):
    best, heap = {}, [(0, 0, (s,))]
    while heap:
        c, h, p = heapq.heappop(heap)
        if p[-1] in best:
            continue
        best[p[-1]] = (c, h, p)
        for a, b, w in edges:
            if a == p[-1] and b not in p:
                heapq.heappush(heap, (c + w, h + 1, (*p, b)))
    return best


def test_six_nodes(spark):
    nodes, edges = _frames(spark, SIX)
    bfs = paths.breadth_first(edges, "1").collect()
    assert {r["id"]: r["path"] for r in bfs}["4"] == ["1", "10", "20", "4"]
    one = paths.shortest(edges, "1", ["4"]).where("id = '4'").first()
    assert (one["cost"], one["path"]) == (8.0, ["1", "10", "2", "3", "4"])
    assert paths.shortest_to_any(edges, "1", ["4", "3"]).first()["id"] == "3"
    assert walk.depth_first(edges, "1", "4").first()["path"] == ["1", "10", "2", "3", "4"]
    assert [r["id"] for r in walk.depth_first_visits(edges, "1").orderBy("place").collect()] == ["1", "10", "2", "3", "4", "20"]


def test_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = sorted({(str(a), str(b)): rng.randint(1, 9) for a in range(8) for b in rng.sample(range(8), 3) if a != b}.items())
        edges = [(a, b, w) for (a, b), w in edges]
        nodes, frame = _frames(spark, edges)
        want = _best(edges, "0")
        got = {r["id"]: (r["cost"], r["hops"], tuple(r["path"])) for r in paths.shortest(frame, "0").collect()}
        assert got == {k: (float(c), h, p) for k, (c, h, p) in want.items()}
        every = {(r["src"], r["dst"]): r["cost"] for r in paths.all_pairs(nodes, frame).collect()}
        assert {k[1]: v for k, v in every.items() if k[0] == "0"} == {k: v[0] for k, v in got.items()}


def test_dispatcher(spark):
    nodes, edges = _frames(spark, SIX)
    for name in ("DFS", "DIJK", "AS", "GBFS", "ACO"):
        options = {"per_metre": 0.0} if name == "AS" else {}
        rows = find_paths(nodes, edges, "1", "4", name, **options).orderBy("rank").collect()
        assert rows[0]["path"][0] == "1" and rows[0]["path"][-1] == "4"
        if name in ("DIJK", "AS", "ACO"):
            assert rows[0]["cost"] == 8.0
    assert find_paths(nodes, edges, "1", "1", "BFS").first()["path"] == ["1"]
    assert not find_paths(nodes, edges, "4", "1", "DIJK").collect()
    assert "→" in present(find_paths(nodes, edges, "1", "4", "BFS"), nodes).first()["route"]
    assert present(find_paths(nodes, edges, "1", "4", "BFS"), nodes, seconds=False).first()["time"] is None
    with pytest.raises(ValueError):
        find_paths(nodes, edges, "1", "4", "NONE")


def test_costs_and_several_destinations(spark):
    """Every algorithm sums the column it is told to, and stops at the first or cheapest of its destinations."""
    nodes, edges = _frames(spark, SIX)
    seconds, price = edges.withColumn("seconds", F.col("weight") * 10.0), {(a, b): 10.0 * w for a, b, w in SIX}
    want = {"BFS": "1>10>20", "DFS": "1>10>2>3>4", "DIJK": "1>10>2>3>4", "AS": "1>10>2>3>4", "GBFS": "1>10>20", "KSP": "1>10>2>3>4"}
    for name, told in want.items():
        options = {"per_metre": 0.0} if name == "AS" else {}
        one = find_paths(nodes, seconds, "1", ["20", "4"], name, cost="seconds", **options).where("rank = 1").first()
        assert (one["path"], one["cost"]) == (told.split(">"), sum(price[e] for e in zip(told.split(">"), told.split(">")[1:])))
    one = find_paths(nodes, seconds, "1", "4", "BFS", cost="seconds").first()
    assert (">".join(one["path"]), one["cost"]) == ("1>10>20>4", 130.0)
    assert find_paths(nodes, edges, "1", ["4", "1"], "DIJK").first()["path"] == ["1"]


def test_dead_end_and_ants(spark):
    edges = [("1", "2", 1), ("1", "3", 1), ("3", "4", 1)]
    nodes, frame = _frames(spark, edges, {"1": (144.9, -37.8), "2": (144.95, -37.8), "3": (144.8, -37.8), "4": (145.0, -37.8)})
    assert walk.greedy(nodes, frame, "1", "4").first()["path"] == ["1", "3", "4"]
    once = [tuple(r) for r in walk.ant_colony(frame, "1", ["4"], ants=8).collect()]
    again = [tuple(r) for r in walk.ant_colony(frame.repartition(3), "1", ["4"], ants=8).collect()]
    assert once == again and once[0][1] == ["1", "3", "4"]


def test_components_and_repair(spark):
    edges = [("1", "2", 1), ("2", "1", 1), ("3", "4", 1), ("4", "3", 1)]
    nodes, frame = _frames(spark, edges, {"1": (144.90, -37.80), "2": (144.91, -37.80), "3": (144.95, -37.80), "4": (144.96, -37.80)})
    label = graph.components(nodes, frame)
    assert sorted((r["id"], r["component"]) for r in label.collect()) == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")]
    assert [(r["src"], r["dst"]) for r in graph.bridges_mst(nodes, label, 5000.0).collect()] == [("2", "3")]
    whole = graph.components(nodes, graph.connect(nodes, frame))
    assert whole.select("component").distinct().count() == 1
    near, arcs = graph.chunk(nodes, frame, "1", "2")
    assert sorted(r["id"] for r in near.collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        graph.chunk(nodes, frame, "1", "99")


def test_two_opt_against_whole_prices():
    """Reversals priced from running sums are those that whole paths are priced at, with unequal directions and missing edges."""
    def slow(path, cost):
        price = lambda p: (sum(e not in cost for e in zip(p, p[1:])), sum(cost.get(e, 0) for e in zip(p, p[1:])))
        while True:
            swaps = [[*path[:i], *path[i : j + 1][::-1], *path[j + 1 :]] for i in range(1, len(path) - 2) for j in range(i + 1, len(path) - 1)]
            better = next((p for p in swaps if price(p) < price(path)), None)
            if better is None:
                return path
            path = better

    rng = random.Random(2)
    for _ in range(60):
        names = [str(i) for i in range(rng.randint(2, 8))]
        cost = {(a, b): rng.randint(1, 30) for a in names for b in names if a != b and rng.random() < 0.8}
        assert walk.two_opt(list(names), cost) == slow(list(names), cost)
