"""Path search as frontier loops over DataFrames.

1. *Labels.*  A round joins the nodes that were improved last with the edges and keeps the best label of each node; it
stops when nothing improves, or nothing that improves can still beat the target.  Labels are numbers only (cost, hops), so a round
rewrites a short row for each node that was reached, whatever the length of its path.
2. *Paths.*  An edge is tight if it gives its end the label it has.  Paths follow tight edges: back from a target, step by
step, or from the origin to all nodes, level by level; each step writes the rows of one level.

Ties are total: breadth first by (hops, path), shortest paths by (cost, hops, path), paths compared as arrays of id texts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.geo import MEAN_EARTH_M, haversine
from roadflow.operators.ordering import number_rows
from roadflow.operators.spatial import dense_cells, near_places, places
from roadflow.scratch import Rounds
from roadflow.session import ship

LABEL = "id string, cost double, hops int"
PATH = "id string, cost double, hops int, path array<string>"


def _relax(edges: DataFrame | None, origin: str | DataFrame, rounds: Rounds, stop=None, cost: str = "weight", bound=None, by_hops: bool = False, onward=None) -> tuple[DataFrame | None, DataFrame]:
    """(arcs, best label (id, cost, hops) of each node reached).  By hops the cost is left out of a label (0).

    ``onward(frontier)`` gives the rows (dst, w, cost, hops) that a frontier's edges lead to, where these are not held as a table.

    ``stop(frontier, best)`` gives the frontier rows that go on, ``bound(reached, best)`` the reached ones.  Several origins, as
    a frame of ids, are searched at once; a node gets the label of the nearest.
    """
    spark, arcs = rounds.spark, None
    if onward is None:
        arcs = rounds.save(edges.select("src", "dst", F.col(cost).cast("double").alias("w")).where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
    first = spark.createDataFrame([(origin, 0.0, 0)], LABEL) if isinstance(origin, str) else origin.select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops")).distinct()
    best = rounds.save(first.withColumn("fresh", F.lit(True)))
    while True:
        frontier = best.where("fresh")
        if stop is not None:
            frontier = stop(frontier, best)
        reached = frontier.join(arcs, frontier["id"] == arcs["src"]) if onward is None else onward(frontier)
        price = F.lit(0.0) if by_hops else F.col("cost") + F.col("w")
        reached = reached.select(F.col("dst").alias("id"), price.alias("cost"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("fresh"))
        if bound is not None:
            reached = bound(reached, best)
        # an old row wins a tie with an equal new one, so it is not fresh again
        both = best.withColumn("fresh", F.lit(False)).unionByName(reached)
        new = both.groupBy("id").agg(F.min(F.struct("cost", "hops", "fresh")).alias("m")).select("id", "m.cost", "m.hops", "m.fresh")
        before = best
        best, fresh = rounds.save_counting(new, F.col("fresh"))
        rounds.drop(before)
        if not fresh:
            return arcs, best.drop("fresh")


def _tight(arcs: DataFrame, best: DataFrame, by_hops: bool) -> DataFrame:
    """(src, dst, w): the edges that give their ends the labels they have."""
    end = lambda c, name: best.select(F.col("id").alias(name), F.col("cost").alias(f"{c}_cost"), F.col("hops").alias(f"{c}_hops"))
    price = F.lit(True) if by_hops else F.col("a_cost") + F.col("w") == F.col("b_cost")
    both = arcs.join(end("a", "src"), "src").join(end("b", "dst"), "dst")
    return both.where(price & (F.col("a_hops") + 1 == F.col("b_hops"))).select("src", "dst", "w")


def _paths_to(arcs: DataFrame, best: DataFrame, origin: str, target: str, rounds: Rounds, by_hops: bool) -> DataFrame:
    """(id, cost, hops, path) of one target, or no row: of its tight paths the first one as an array of texts.

    Each step goes back by one hop; a node keeps the first of its ways on, which is the first of the whole path for it, too.
    """
    found = best.where(F.col("id") == target).first()  # one row
    spark = best.sparkSession
    if found is None:
        return spark.createDataFrame([], PATH)
    tight = rounds.save(_tight(arcs, best, by_hops))
    now = rounds.save(spark.createDataFrame([(target, [target], 0.0)], "id string, path array<string>, sum double"))
    for _ in range(found["hops"]):
        back = now.withColumnRenamed("id", "dst").join(tight, "dst").select(F.col("src").alias("id"), F.concat(F.array("src"), "path").alias("path"), (F.col("w") + F.col("sum")).alias("sum"))
        before, now = now, rounds.save(back.groupBy("id").agg(F.min(F.struct("path", "sum")).alias("m")).select("id", "m.path", "m.sum"))
        rounds.drop(before)
    rounds.drop(tight)
    price = F.col("sum") if by_hops else F.lit(found["cost"])
    return now.where(F.col("id") == origin).select(F.lit(target).alias("id"), price.alias("cost"), F.lit(found["hops"]).alias("hops"), "path")


def _paths_to_all(arcs: DataFrame, best: DataFrame, origin: str, rounds: Rounds, by_hops: bool) -> DataFrame:
    """(id, cost, hops, path) of every node that was reached; each level of hops is written once."""
    spark = best.sparkSession
    tight = rounds.save(_tight(arcs, best, by_hops))
    now = rounds.save(spark.createDataFrame([(origin, 0.0, 0, [origin])], PATH))
    levels = [now]
    while True:
        on = now.withColumnRenamed("id", "src").join(tight, "src").select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        now, n = rounds.save_counting(on.groupBy("id").agg(F.min(F.struct("path", "cost", "hops")).alias("m")).select("id", "m.cost", "m.hops", "m.path"), F.lit(True))
        if not n:
            rounds.drop(tight)
            return reduce(DataFrame.unionByName, levels)
        levels.append(now)


def _several(target: str | list[str] | None) -> list[str]:
    return [target] if isinstance(target, str) else list(target or ())


def _to(origin: str, targets: list[str], arcs: DataFrame, best: DataFrame, rounds: Rounds, by_hops: bool, with_paths: bool, first_only: bool) -> DataFrame:
    """Rows of the targets with their paths, or of all nodes without targets; with labels only, the rows of all nodes that have one.

    ``first_only``: of several targets those with the best label.
    """
    if not with_paths:
        return best
    if not targets:
        return _paths_to_all(arcs, best, origin, rounds, by_hops)
    if first_only and len(targets) > 1:
        labels = best.where(F.col("id").isin(*targets)).collect()  # one row for each target
        least = min(((r["cost"], r["hops"]) for r in labels), default=None)
        targets = [r["id"] for r in labels if (r["cost"], r["hops"]) == least] or targets[:1]
    return reduce(DataFrame.unionByName, [_paths_to(arcs, best, origin, t, rounds, by_hops) for t in dict.fromkeys(targets)])


def breadth_first(edges: DataFrame, origin: str, target: str | list[str] | None = None, cost: str = "weight", with_paths: bool = True, first_only: bool = False) -> DataFrame:
    """(id, cost, hops, path): fewest hops, ties by path; cost is the sum along the path.

    With targets the loop ends once one of them is reached, and rows are theirs; a row of another target is not its best path then, unless
    it was reached in the same round.  Without paths the rows are labels (id, hops) of all nodes that were reached.
    """
    targets, rounds = _several(target), Rounds(edges.sparkSession, "paths")
    stop = (lambda f, best: f.join(best.where(F.col("id").isin(*targets)).limit(1).select(F.lit(1).alias("_t")), F.lit(True), "left_anti")) if targets else None
    arcs, best = _relax(edges, origin, rounds, stop, cost, by_hops=True)
    found = _to(origin, targets, arcs, best, rounds, True, with_paths, first_only)
    return found if with_paths else found.select("id", "hops")


def visit_order(edges: DataFrame, origin: str) -> DataFrame:
    """(id, hops, path) of all reachable nodes; breadth-first order is by (hops, path)."""
    return breadth_first(edges, origin).select("id", "hops", "path")


def shortest(edges: DataFrame, origin: str, targets: list[str] | None = None, cost: str = "weight", with_paths: bool = True, first_only: bool = False) -> DataFrame:
    """(id, cost, hops, path): least costs from an origin to all nodes, or to the targets (frontier rows beyond the cheapest of them are dropped).

    Without paths the rows are labels (id, cost, hops); costs of nodes beyond the cheapest target are upper bounds then.
    """
    stop, rounds = None, Rounds(edges.sparkSession, "paths")
    if targets:
        def stop(frontier: DataFrame, best: DataFrame) -> DataFrame:
            limit = best.where(F.col("id").isin(*targets)).agg(F.coalesce(F.min("cost"), F.lit(float("inf"))).alias("_limit"))
            return frontier.crossJoin(F.broadcast(limit)).where("cost <= _limit").drop("_limit")  # one row

    arcs, best = _relax(edges, origin, rounds, stop, cost)
    return _to(origin, _several(targets), arcs, best, rounds, False, with_paths, first_only)


def labels_from(edges: DataFrame, origins: DataFrame, cost: str = "weight") -> DataFrame:
    """(id, cost, hops): least costs from the nearest of several origins (id)."""
    return _relax(edges, origins, Rounds(edges.sparkSession, "labels"), None, cost)[1]


def shortest_to_any(edges: DataFrame, origin: str, targets: list[str], cost: str = "weight") -> DataFrame:
    """One row: the cheapest of the targets, ties by their order."""
    place = F.coalesce(*[F.when(F.col("id") == t, F.lit(i)) for i, t in enumerate(targets)])
    first = shortest(edges, origin, targets, cost, with_paths=False).where(F.col("id").isin(*targets)).orderBy("cost", place).first()  # one row
    if first is None:
        return edges.sparkSession.createDataFrame([], PATH)
    return shortest(edges, origin, [first["id"]], cost)


def shortest_trips(edges: DataFrame, trips: DataFrame, cost: str = "weight") -> DataFrame:
    """(origin, target, path, cost): the cheapest path of every trip, all in the same rounds; no row where there is none.

    ``trips``: origin, target.  Trips must lie in components of their own, one for each, so their labels never meet.
    """
    rounds = Rounds(edges.sparkSession, "trips")
    held = rounds.save(trips.select("origin", "target").distinct())
    arcs, best = _relax(edges, held.select(F.col("origin").alias("id")), rounds, None, cost)
    return _trips_back(held, best, rounds.save(_tight(arcs, best, False)), rounds)


def shortest_trips_near(nodes: DataFrame, degrees: float, trips: DataFrame, radius: float = MEAN_EARTH_M) -> DataFrame:
    """As ``shortest_trips`` over the graph of ``graph.radius_edges``, which is not made: each round pairs the nodes that were improved last with those near them.

    ``nodes``: id, lon, lat and the ``target`` of their component's trip.  Pairs are neither shuffled nor written.  As in ``a_star``, nodes by which a path can't beat the
    best known cost are dropped: an edge of m metres costs at least w / (w + 1) of them, w being the least cost of all.
    """
    rounds = Rounds(nodes.sparkSession, "trips")
    held, every = rounds.save(trips.select("origin", "target").distinct()), rounds.save(nodes.select("id", "lon", "lat"))
    dense, metres = bool(dense_cells(every, every, degrees).limit(1).count()), F.floor(haversine("lat2", "lon2", "lat", "lon", radius)).cast("bigint")
    near = lambda one, two: near_places(one, two, degrees, metres, dense).where("id <> id2")
    least = near(every, every).agg(F.min("weight")).first()[0] or 0  # one number
    goals = nodes.join(held.select(F.col("target").alias("id")), "id").select(F.col("id").alias("target"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    straight = haversine("lat", "lon", "_lat", "_lon", radius) * (least / (least + 1) * (1 - 1e-9))
    left = rounds.save(nodes.select("id", "lon", "lat", "target").join(goals, "target").select("id", "target", straight.alias("_h")))

    def onward(frontier: DataFrame) -> DataFrame:
        return near(every, frontier.select("id", "cost", "hops").join(every, "id")).select(F.col("id").alias("dst"), F.col("weight").cast("double").alias("w"), F.col("cost2").alias("cost"), F.col("hops2").alias("hops"))

    def stop(frontier: DataFrame, best: DataFrame) -> DataFrame:
        limits = best.join(held.select(F.col("target").alias("id")), "id").select(F.col("id").alias("target"), F.col("cost").alias("_limit"))
        return frontier.join(left, "id").join(limits, "target", "left").where("_limit is null or cost + _h <= _limit").select(*best.columns)

    _, best = _relax(None, held.select(F.col("origin").alias("id")), rounds, stop, onward=onward)
    known = rounds.save(best.join(every, "id"))
    tight = near(known, known).where("cost2 + weight = cost and hops2 + 1 = hops").select(F.col("id2").alias("src"), F.col("id").alias("dst"), F.col("weight").cast("double").alias("w"))
    return _trips_back(held, best, rounds.save(tight), rounds)


def _trips_back(held: DataFrame, best: DataFrame, tight: DataFrame, rounds: Rounds) -> DataFrame:
    """The paths of trips from labels and tight edges, back from their targets."""
    ends = held.join(best.select(F.col("id").alias("target"), F.col("cost").alias("total")), "target")
    now = rounds.save(ends.select("origin", "target", "total", F.col("target").alias("id"), F.array("target").alias("path")))
    done = []
    while True:
        done.append(rounds.save(now.where("id = origin").select("origin", "target", "path", F.col("total").alias("cost"))))
        back = now.where("id <> origin").withColumnRenamed("id", "dst").join(tight, "dst").withColumn("path", F.concat(F.array("src"), "path"))
        before = now
        now, n = rounds.save_counting(back.groupBy("origin", "target", "total", F.col("src").alias("id")).agg(F.min("path").alias("path")), F.lit(True))
        rounds.drop(before)
        if not n:
            rounds.drop(tight)
            return reduce(DataFrame.unionByName, done)


def a_star(nodes: DataFrame, edges: DataFrame, origin: str, target: str | list[str], cost: str = "weight", per_metre: float = 0.99, with_paths: bool = True, first_only: bool = False) -> DataFrame:
    """The same paths as ``shortest``; rows whose cost plus a lower bound to the nearest target exceeds the best known cost are dropped.

    The bound is the great-circle distance times ``per_metre``, the least cost of a metre.
    """
    targets, rounds = _several(target), Rounds(edges.sparkSession, "paths")
    goals = nodes.where(F.col("id").isin(*targets)).select("lat", "lon").collect()  # one row for each target
    if not goals:
        raise ValueError(f"no node {target!r}")
    away = [haversine("lat", "lon", g["lat"], g["lon"]) * per_metre for g in goals]
    left = nodes.select("id", (F.least(*away) if len(away) > 1 else away[0]).alias("_h"))

    def bound(reached: DataFrame, best: DataFrame) -> DataFrame:
        limit = best.where(F.col("id").isin(*targets)).agg(F.coalesce(F.min("cost"), F.lit(float("inf"))).alias("_limit"))
        return reached.join(left, "id", "left").crossJoin(F.broadcast(limit)).where(F.col("cost") + F.greatest(F.coalesce("_h", F.lit(0.0)) - 1 - F.col("hops"), F.lit(0.0)) <= F.col("_limit")).drop("_h", "_limit")  # one row

    arcs, best = _relax(edges, origin, rounds, None, cost, bound)
    return _to(origin, targets, arcs, best, rounds, False, with_paths, first_only).where(F.col("id").isin(*targets))


def all_pairs(nodes: DataFrame, edges: DataFrame, cost: str = "weight") -> DataFrame:
    """(src, dst, cost, path): least costs between all pairs by repeated squaring of the min-plus matrix; for chunked graphs."""
    rounds = Rounds(nodes.sparkSession, "all-pairs")
    direct = edges.groupBy("src", "dst").agg(F.min(F.col(cost).cast("double")).alias("cost")).where("src <> dst").withColumn("path", F.array("src", "dst"))
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"), F.array("id").alias("path"))
    now = rounds.save(direct.unionByName(own))
    while True:
        second = now.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("cost").alias("c2"), F.col("path").alias("p2"))
        longer = now.join(second, "dst").select("src", F.col("end").alias("dst"), (F.col("cost") + F.col("c2")).alias("cost"), F.concat("path", F.slice("p2", F.lit(2), F.greatest(F.size("p2") - 1, F.lit(0)))).alias("path"))
        least = longer.groupBy("src", "dst").agg(F.min(F.struct("cost", F.size("path").alias("n"), "path")).alias("m")).select("src", "dst", "m.cost", "m.path")
        old = now.select("src", "dst", F.col("cost").alias("old"))
        new, changed = rounds.save_counting(least.join(old, ["src", "dst"], "left"), F.col("old").isNull() | (F.col("cost") < F.col("old")))
        rounds.drop(now)
        now = new.drop("old")
        now._round_path = new._round_path
        if not changed:
            return now


#: Places that one task of ``all_pairs_near`` starts from.
SOURCES = 128
FAR = "held array<string>, to array<struct<held: array<string>, same: boolean, cost: double>>"


def costs_from(near: list[np.ndarray], weights: list[np.ndarray], origins: np.ndarray) -> np.ndarray:
    """Least costs (node, origin) over a symmetric graph: sweeps to and fro over the nodes that have an improved neighbour, for all origins at once."""
    cost = np.full((len(near), len(origins)), np.inf)
    cost[origins, np.arange(len(origins))] = 0
    open_ones, order = np.zeros(len(near), bool), range(len(near))
    for x in origins:
        open_ones[near[x]] = True
    while open_ones.any():
        for x in order:
            if open_ones[x]:
                open_ones[x] = False
                best = (cost[near[x]] + weights[x][:, None]).min(0)
                if (best < cost[x]).any():
                    np.minimum(cost[x], best, out=cost[x])
                    open_ones[near[x]] = True
        order = order[::-1]
    return cost


def _numbered(nodes: DataFrame, degrees: float, where: Column, inside: Column, radius: float) -> tuple[DataFrame, DataFrame]:
    """The numbered places (no, held, near, w) of ``all_pairs_near``, and the same rows for each task (g), with the places that it starts from (mine)."""
    spark = nodes.sparkSession
    ship(spark)
    rounds, metres = Rounds(spark, "all-pairs"), F.floor(haversine("lat", "lon", "lat2", "lon2", radius)).cast("bigint")
    at = rounds.save(number_rows(places(nodes, ["id"]), ["lon", "lat", "block"], "no"))
    spots = at.select("lon", "lat", "no")
    arcs = near_places(spots, spots, degrees, metres).where(where).groupBy("no").agg(F.collect_list(F.struct("no2", "weight")).alias("arcs"))
    every = at.join(arcs, "no", "left").where(inside | F.col("arcs").isNotNull())
    known = rounds.save(every.select("no", F.col("held")["id"].alias("held"), F.coalesce(F.transform("arcs", lambda x: x["no2"].cast("int")), F.array().cast("array<int>")).alias("near"), F.coalesce(F.transform("arcs", lambda x: x["weight"].cast("double")), F.array().cast("array<double>")).alias("w")))
    groups = max(1, math.ceil(known.count() / SOURCES))
    return known, known.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("mine", F.pmod(F.col("no"), F.lit(groups)) == F.col("g"))


def _costs_of_mine(table: pa.Table) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(held, near, weights, mine, cost) of a task's rows, sorted by number: the least costs (place, mine), to a place itself those of the way back to it."""
    table = table.sort_by("no").combine_chunks()
    no, held = table["no"].to_numpy(), table["held"].combine_chunks()
    cut = lambda c: np.split(table[c].combine_chunks().flatten().to_numpy(), np.cumsum(np.diff(table[c].combine_chunks().offsets.to_numpy()))[:-1])
    near, weights = [np.searchsorted(no, x) for x in cut("near")], cut("w")
    mine = np.flatnonzero(table["mine"].to_numpy(zero_copy_only=False))
    cost = costs_from(near, weights, mine)
    for i, x in enumerate(mine):  # the way back to the place itself
        cost[x, i] = (cost[near[x], i] + weights[x]).min() if len(near[x]) else np.inf
    return held, near, weights, mine, cost


def all_pairs_near(nodes: DataFrame, degrees: float, where: Column, inside: Column, radius: float = MEAN_EARTH_M) -> DataFrame:
    """(src, dst, cost): as ``all_pairs`` over the chunk of a trip, without its edges and without paths.

    ``nodes``: id, lon, lat; ``where``: the condition on pairs of places, the same in both directions; ``inside``: places that count even if they have no edge.  Nodes of one place have the same
    costs, and among each other that of the cheapest way back to it.  Each task starts from some places and gets the numbers of the places next to
    each one: a chunk must be small enough for that.  Results are handed to the nodes without a shuffle.
    """
    _, sent = _numbered(nodes, degrees, where, inside, radius)

    def run(table: pa.Table) -> pa.Table:
        held, _, _, mine, cost = _costs_of_mine(table)
        reached = np.isfinite(cost)
        reached[mine, np.arange(len(mine))] = True
        which, ends = np.nonzero(reached.T)
        far, same = cost[ends, which], ends == mine[which]
        to = pa.StructArray.from_arrays([held.take(pa.array(ends)), pa.array(same), pa.array(far, mask=~np.isfinite(far))], ["held", "same", "cost"])
        return pa.table({"held": held.take(pa.array(mine)), "to": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(reached.sum(0))]), pa.int32()), to)})

    made = sent.groupBy("g").applyInArrow(run, FAR)
    each = made.select("held", F.explode("to").alias("t")).select(F.explode("held").alias("src"), "t").select("src", F.explode("t.held").alias("dst"), "t.same", "t.cost")
    itself = F.col("same") & (F.col("src") == F.col("dst"))
    return each.select("src", "dst", F.when(itself, 0.0).otherwise(F.col("cost")).alias("cost")).where("cost is not null")


def place_costs(nodes: DataFrame, degrees: float, where: Column, inside: Column, radius: float = MEAN_EARTH_M) -> DataFrame:
    """(no, held, near, w, far): the places of ``all_pairs_near``, their neighbours' numbers and metres, and the metres to every place in order of ``no`` (4 bytes each, little-endian; -1: none)."""
    _, sent = _numbered(nodes, degrees, where, inside, radius)

    def run(table: pa.Table) -> pa.Table:
        held, near, weights, mine, cost = _costs_of_mine(table)
        far = np.where(np.isfinite(cost), cost, -1).astype("<i4").T
        lists = lambda of, kind: pa.array([of[x] for x in mine], pa.list_(kind))
        return pa.table({"no": pa.array(mine, pa.int32()), "held": held.take(pa.array(mine)), "near": lists(near, pa.int32()), "w": lists([x.astype(np.int32) for x in weights], pa.int32()), "far": pa.array([x.tobytes() for x in far], pa.binary())})

    return sent.groupBy("g").applyInArrow(run, "no int, held array<string>, near array<int>, w array<int>, far binary")


def reverse_part(path: str, first: Column, last: Column) -> Column:
    """A path with its nodes from place ``first`` to ``last`` (from 1) in reverse order."""
    head, tail = F.slice(path, F.lit(1), first - 1), F.slice(path, last + 1, F.greatest(F.size(path) - last, F.lit(0)))
    return F.concat(head, F.reverse(F.slice(path, first, last - first + 1)), tail)


def closure(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges completed by all-pairs results: lowered where improved, virtual where there was none."""
    real = edges.select("src", "dst", F.col("weight").cast("double").alias("own"))
    return pairs.where("src <> dst").join(real, ["src", "dst"], "left").select("src", "dst", "cost", F.col("own").isNull().alias("is_virtual"), "path")


def top_paths(paths: DataFrame, k: int) -> DataFrame:
    """The k cheapest distinct paths, ranked by (cost, path)."""
    from pyspark.sql import Window as W

    best = paths.groupBy("path").agg(F.min("cost").alias("cost")).orderBy("cost", "path").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy("cost", "path"))).select("rank", "path", "cost")
