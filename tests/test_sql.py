"""The table function against the search by rounds, and its bounds."""

from __future__ import annotations

import random

import pytest

from roadflow.operators import paths
from roadflow.plans import sql

FIELDS = "graph string, src string, dst string, weight double, origin string, target string"


def _trips(seed=5, graphs=6):
    rng, rows = random.Random(seed), []
    for g in range(graphs):
        for _ in range(25):
            a, b = rng.sample(range(9), 2)
            rows.append((f"g{g}", f"{g}.{a}", f"{g}.{b}", float(rng.randint(1, 5)), f"{g}.0", f"{g}.8"))
    return rows


def test_many_graphs_in_one_statement(spark):
    rows = _trips()
    sql.register(spark)
    spark.createDataFrame(rows, FIELDS).createOrReplaceTempView("trips")
    got = {r["graph"]: (r["path"], r["cost"]) for r in spark.sql("SELECT * FROM shortest_path(TABLE(trips) PARTITION BY graph)").collect()}
    edges = spark.createDataFrame([r[1:4] for r in rows], "src string, dst string, weight double")
    assert len(got) == 6
    for g in ("g0", "g3"):
        want = {r["id"]: (r["path"], r["cost"]) for r in paths.shortest(edges, f"{g[1:]}.0").collect()}
        assert got[g] == want.get(f"{g[1:]}.8", (None, None))


def test_large_components_are_searched_in_rounds(spark):
    """Trips by rounds, all components at once, are those of the table function."""
    from pyspark.sql import functions as F

    from roadflow.operators import graph

    edges = graph.symmetric(spark.createDataFrame([r[1:4] for r in _trips(9, 4)], "src string, dst string, weight double"))
    nodes = edges.select(F.col("src").alias("id")).distinct()
    labels = graph.components(nodes, edges)
    told = lambda small: sorted(map(tuple, sql.paths_of_components(labels, edges, small).collect()))
    whole = told(1000)
    assert len(whole) == 4 and all(r[3][-1] == r[2] for r in whole)
    assert told(0) == whole


def test_bounds(spark, monkeypatch):
    sql.register(spark)
    spark.createDataFrame([("a", "1", "2", 1.0, "1", "3"), ("b", "1", "2", 1.0, "1", "1"), ("c", None, None, None, "5", "5")], FIELDS).createOrReplaceTempView("trips")
    got = {r["graph"]: (r["path"], r["cost"]) for r in spark.sql("SELECT * FROM shortest_path(TABLE(trips) PARTITION BY graph)").collect()}
    assert got == {"a": (None, None), "b": (["1"], 0.0), "c": (["5"], 0.0)}
    spark.createDataFrame([("a", "1", "2", 1.0, "1", "3"), ("a", "1", "2", 1.0, "1", "2")], FIELDS).createOrReplaceTempView("trips")
    with pytest.raises(Exception, match="several trips"):
        spark.sql("SELECT * FROM shortest_path(TABLE(trips) PARTITION BY graph)").collect()
    one = sql.ShortestPath()
    monkeypatch.setattr(sql, "MOST_EDGES", 1)
    row = {"graph": "a", "src": "1", "dst": "2", "weight": 1.0, "origin": "1", "target": "2"}
    one.eval(row)
    with pytest.raises(ValueError, match="over 1 edges"):
        one.eval(row)


def test_trips_over_places_are_those_of_edges(spark):
    """By the table function or by rounds, over places with twins: costs and paths are those of the graph that is made."""
    from pyspark.sql import functions as F

    from roadflow.operators import graph

    rng = random.Random(11)
    rows = [(f"{c}{i}", 144.6 + c / 5 + rng.randrange(9) / 100, -37.8 + rng.randrange(9) / 100) for c in (1, 2) for i in range(60)]
    nodes = spark.createDataFrame([*rows, ("3", 145.4, -37.6), ("4", None, -37.8)], "id string, lon double, lat double").cache()
    edges = graph.radius_edges(nodes, 0.0201, "id").cache()
    labels = graph.radius_components(nodes, 0.0201)
    want = sorted(map(tuple, sql.paths_of_components(labels, edges, 1_000_000).collect()))
    assert len(want) >= 2 and labels.agg(F.count("id")).first()[0] == 122
    for small in (1_000_000, 0):
        assert sorted(map(tuple, sql.paths_of_places(nodes, 0.0201, small).collect())) == want
