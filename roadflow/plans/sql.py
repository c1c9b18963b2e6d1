"""Path search in SQL: a table function over many small graphs in one statement.

    SELECT * FROM shortest_path(TABLE(trips) PARTITION BY graph)

``trips`` has one row for each edge: graph (any text), src, dst, weight, and the ends of the trip, origin and target, the same in all
rows of a graph.  Each graph is walked in the task that its rows are dealt to, so it must be small: one of more than ``MOST_EDGES`` edges
is refused, and belongs to ``route.find_paths``, which runs a single search over all tasks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.operators.graph import radius_components, radius_edges, radius_sums
from roadflow.operators.paths import shortest_trips, shortest_trips_near
from roadflow.scratch import Rounds

#: Edges of one graph, some 200 bytes each.
MOST_EDGES = 500_000
RETURNS = "graph string, origin string, target string, path array<string>, cost double"


class ShortestPath:
    """The cheapest path of each graph, ties by hops and path; null where the target can't be reached."""

    def __init__(self):
        self.arcs: dict[str, list[tuple[str, float]]] = {}
        self.n, self.trip = 0, None

    def eval(self, row) -> None:
        self.n += 1
        if self.n > MOST_EDGES:
            raise ValueError(f"graph {row['graph']!r} has over {MOST_EDGES} edges")
        trip = (row["graph"], row["origin"], row["target"])
        if self.trip not in (None, trip):
            raise ValueError(f"graph {row['graph']!r} has several trips")
        self.trip = trip
        if row["src"] is not None and row["dst"] is not None and row["weight"] is not None:
            self.arcs.setdefault(row["src"], []).append((row["dst"], float(row["weight"])))

    def terminate(self):
        if self.trip is None:
            return
        graph, origin, target = self.trip
        waiting, done = [(0.0, 0, [origin])], set()
        while waiting:
            cost, hops, path = heapq.heappop(waiting)
            if path[-1] == target:
                yield graph, origin, target, path, cost
                return
            if path[-1] in done:
                continue
            done.add(path[-1])
            for dst, w in self.arcs.get(path[-1], ()):
                if dst not in done:
                    heapq.heappush(waiting, (cost + w, hops + 1, [*path, dst]))
        yield graph, origin, target, None, None


def register(spark: SparkSession) -> None:
    """Make ``shortest_path`` known to a session's SQL."""
    from pyspark.sql.functions import udtf

    from roadflow.session import ship

    ship(spark)
    spark.udtf.register("shortest_path", udtf(ShortestPath, returnType=RETURNS))


def paths_of_components(labels: DataFrame, edges: DataFrame, small: int = 50_000) -> DataFrame:
    """(graph, origin, target, path, cost): the trip from the first to the last node (as texts) of each component.

    ``labels``: id, component.  Components of up to ``small`` edges go through the table function, in one statement; larger ones are searched over all
    tasks, in the same rounds for all of them.
    """
    spark = labels.sparkSession
    register(spark)
    rounds = Rounds(spark, "components-sql")
    arcs = rounds.save(edges.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("component").alias("graph"), "src", "dst", F.col("weight").cast("double").alias("weight")))
    ends = labels.groupBy(F.col("component").alias("graph")).agg(F.min("id").alias("origin"), F.max("id").alias("target"))
    sized = rounds.save(ends.join(arcs.groupBy("graph").agg(F.count(F.lit(1)).alias("n")), "graph"))
    trips = arcs.join(sized.where(F.col("n") <= small).drop("n"), "graph")
    found = spark.sql("SELECT * FROM shortest_path(TABLE(SELECT graph, src, dst, weight, origin, target FROM {trips}) PARTITION BY graph)", trips=trips)
    large = rounds.save(sized.where(F.col("n") > small).drop("n"))
    if not large.limit(1).count():
        return found
    rest = shortest_trips(arcs.join(large.select("graph"), "graph", "left_semi"), large).join(large.select("graph", "origin"), "origin")
    return found.unionByName(rest.select("graph", "origin", "target", "path", "cost"))


def paths_of_places(nodes: DataFrame, degrees: float, small: int = 50_000) -> DataFrame:
    """As ``paths_of_components`` of the graph of nodes at most ``degrees`` apart, of which only the edges of small components are made.

    Of nodes with equal coordinates the first takes part (and the last of a component): they have the same neighbours, and a path by the first one comes first.
    ``small`` counts edges between these.
    """
    spark = nodes.sparkSession
    register(spark)
    rounds = Rounds(spark, "places-sql")
    labels = radius_components(nodes, degrees).withColumnRenamed("component", "graph")
    ends = rounds.save(labels.groupBy("graph").agg(F.min("id").alias("origin"), F.max("id").alias("target")))
    known = nodes.where("lon is not null and lat is not null")
    heads = known.groupBy("lon", "lat").agg(F.min("id").alias("id")).select("id", "lon", "lat").unionByName(known.join(ends.select(F.col("target").alias("id")), "id").select("id", "lon", "lat")).distinct()
    heads = rounds.save(heads.join(labels, "id"))
    sums = radius_sums(heads, degrees, {"n": F.lit(1)}, "id")
    sized = rounds.save(ends.join(sums.join(heads, "id").groupBy("graph").agg(F.sum("n").alias("n")), "graph"))
    few = sized.where(F.col("n") <= small).drop("n")
    edges = radius_edges(heads.join(few, "graph", "left_semi"), degrees, "id", also=["graph"])
    trips = edges.select(F.col("src_graph").alias("graph"), "src", "dst", F.col("weight").cast("double").alias("weight")).join(few, "graph")
    found = spark.sql("SELECT * FROM shortest_path(TABLE(SELECT graph, src, dst, weight, origin, target FROM {trips}) PARTITION BY graph)", trips=trips)
    large = rounds.save(sized.where(F.col("n") > small).drop("n"))
    if not large.limit(1).count():
        return found
    rest = shortest_trips_near(heads.join(large.select("graph", "target"), "graph"), degrees, large).join(large.select("graph", "origin"), "origin")
    return found.unionByName(rest.select("graph", "origin", "target", "path", "cost"))
