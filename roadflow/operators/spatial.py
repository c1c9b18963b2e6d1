"""Range, nearest-neighbour and counting joins on coordinates.

A range join hashes both sides into grid cells as wide as the radius and joins cells with
equal keys, so no side is broadcast and no pair outside neighbouring cells is made.  Cells go round the globe;
their width in degrees comes from the highest latitude of the data.

A dense place doesn't make a large task: a cell whose pairs exceed ``MOST_PAIRS`` is dealt into blocks of both sides, and a
count takes groups of places that lie wholly within the distance by their numbers, so only groups at its edge are compared one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.functions.geo import EARTH_M, haversine
from roadflow.scratch import Rounds


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width))


def cell_widths(metres: float, top: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that no pair within a distance exceeds, up to a latitude ``top``; 360 where a pole is near."""
    reach = math.sin(min(metres / EARTH_M, math.pi) / 2)
    lat = math.degrees(metres / EARTH_M) * 1.000001
    share = reach / max(math.cos(math.radians(min(top, 90.0))), 1e-12)
    return (360.0 if share >= 1 else math.degrees(2 * math.asin(share)) * 1.000001), lat


def highest(nodes: DataFrame) -> float:
    """The largest latitude, without its sign."""
    return float(nodes.agg(F.max(F.abs("lat"))).first()[0] or 0.0)


#: Pairs of one cell that a task compares, and places of a group from which on groups are counted as a whole.
MOST_PAIRS = 100_000_000
GROUP = 8


def range_join(left: DataFrame, right: DataFrame, width_lon: float, width_lat: float, how: str = "inner") -> DataFrame:
    """Pairs from the same or neighbouring cells; all columns of both sides, which must not clash.

    ``left`` has lon and lat, ``right`` has lon2 and lat2.  Callers add the exact condition.  The last cell of longitude is
    the first one's neighbour; fewer than three cells are one.
    """
    a, b = celled(left, right, width_lon, width_lat)
    return a.join(b, ["cx", "cy"], how).drop("cx", "cy")


def celled(left: DataFrame, right: DataFrame, width_lon: float, width_lat: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with their cells (cx, cy); the right one in its own and all neighbouring ones."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = int(360 // width_lon)
    lon = lambda c, d: F.pmod(F.floor((F.col(c) + 180) / F.lit(360 / around)) + d, F.lit(around)) if around >= 3 else F.lit(0).cast("long")
    a = left.withColumn("cx", lon("lon", F.lit(0))).withColumn("cy", _cell("lat", width_lat))
    b = right.withColumn("dx", near if around >= 3 else F.lit(0)).withColumn("dy", near)
    return a, b.withColumn("cx", lon("lon2", F.col("dx"))).withColumn("cy", _cell("lat2", width_lat) + F.col("dy")).drop("dx", "dy")


def spread_cells(df: DataFrame) -> DataFrame:
    """Rows dealt by their cells to as many partitions as a shuffle has, however few bytes they have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy")


def split_range_join(left: DataFrame, right: DataFrame, width_lon: float, width_lat: float, keep: bool = False, spread: bool = False) -> DataFrame:
    """As ``range_join``, with cells of more than ``MOST_PAIRS`` pairs dealt into blocks; ``keep``: with the cells (cx, cy).

    ``spread``: cells go to all shuffle partitions, for rows that are few and make many pairs; by their bytes they would be put into a few tasks.

    Such a cell is cut into p parts of its left and p of its right rows; each row goes to the p blocks that it is part of, so a block
    has a p-th of either side.  One job counts the cells first; without a dense one the join is the plain one.
    """
    a, b = celled(left, right, width_lon, width_lat)
    cells = lambda df, n: df.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias(n))
    pairs = F.col("na").cast("double") * F.col("nb")
    dense = cells(a, "na").join(cells(b, "nb"), ["cx", "cy"]).where(pairs > MOST_PAIRS).select("cx", "cy", F.ceil(F.sqrt(pairs / MOST_PAIRS)).cast("int").alias("p"))
    gone = () if keep else ("cx", "cy")
    if not dense.limit(1).count():
        return (spread_cells(a) if spread else a).join(spread_cells(b) if spread else b, ["cx", "cy"]).drop(*gone)
    dense = Rounds(left.sparkSession, "dense").save(dense)

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        parts = F.coalesce("p", F.lit(1))
        known = df.join(dense, ["cx", "cy"], "left").withColumn(mine, F.pmod(F.xxhash64(*df.columns), parts).cast("int"))
        return known.withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1))).drop("p")

    return dealt(a, "_i", "_j").join(dealt(b, "_j", "_i"), ["cx", "cy", "_i", "_j"]).drop(*gone, "_i", "_j")


#: Sites that one row of a place holds, about.
MOST_HELD = 1_000


def places(sites: DataFrame, held: list[str], by: list[str] | None = None) -> DataFrame:
    """(lon, lat, by, block, m, held): sites of equal coordinates, and equal values of ``by``, as one row; sites without coordinates are left out.

    ``held`` is a sorted array of the named columns as structs, m its length.  A place of more than ``MOST_HELD`` sites is dealt into rows of about as
    many, numbered by ``block``.
    """
    keys, known = ["lon", "lat", *(by or [])], sites.where("lon is not null and lat is not null")
    full = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_HELD).select(*keys, F.ceil(F.col("_n") / MOST_HELD).cast("int").alias("_p"))
    dealt = known.join(full, keys, "left").withColumn("block", F.pmod(F.xxhash64(*held), F.coalesce("_p", F.lit(1))).cast("int"))
    return dealt.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_list(F.struct(*held))).alias("held"))


def dense_cells(one: DataFrame, two: DataFrame, degrees: float) -> DataFrame:
    """The cells of ``near_places`` that have more than ``MOST_PAIRS`` pairs."""
    a, b = celled(one.select("lon", "lat"), two.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), degrees, degrees)
    cells = lambda df, n: df.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias(n))
    return cells(a, "na").join(cells(b, "nb"), ["cx", "cy"]).where(F.col("na").cast("double") * F.col("nb") > MOST_PAIRS)


def near_places(one: DataFrame, two: DataFrame, degrees: float, metres: Column, split: bool = True) -> DataFrame:
    """Pairs of places at most ``degrees`` apart (inclusive), in both directions, with ``weight``; none of weight zero.

    ``split``: look for dense cells; a caller who knows that there are none (``dense_cells``) saves the job.

    All columns of both sides, those of ``two`` with a 2 at their end, and the cell (cx, cy) that a pair was joined in: all pairs of a left row
    are in one cell, so an aggregate by cell and left row needs no shuffle.
    """
    named = two.select(*[F.col(c).alias(f"{c}2") for c in two.columns])
    if split:
        both = split_range_join(one, named, degrees, degrees, keep=True, spread=True)
    else:
        a, b = celled(one, named, degrees, degrees)
        both = spread_cells(a).join(spread_cells(b), ["cx", "cy"])
    d2 = (F.col("lon") - F.col("lon2")) * (F.col("lon") - F.col("lon2")) + (F.col("lat") - F.col("lat2")) * (F.col("lat") - F.col("lat2"))
    return both.where(d2 <= F.lit(degrees) * F.lit(degrees)).withColumn("weight", metres).where("weight > 0")


def pairs_within_degrees(sites: DataFrame, radius: float, key: str = "site_no") -> DataFrame:
    """Unordered pairs (a, b, a's and b's coordinates) at most ``radius`` degrees apart (inclusive), a < b as text."""
    one = sites.select(F.col(key).alias("a"), "lon", "lat").where("lon is not null and lat is not null")
    two = sites.select(F.col(key).alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    both = split_range_join(one, two, radius, radius)
    d2 = (F.col("lon") - F.col("lon2")) * (F.col("lon") - F.col("lon2")) + (F.col("lat") - F.col("lat2")) * (F.col("lat") - F.col("lat2"))
    return both.where((F.col("a") < F.col("b")) & (d2 <= F.lit(radius) * F.lit(radius)))


def count_within_metres(sites: DataFrame, others: DataFrame, metres: float, key: str = "site_no") -> DataFrame:
    """(key, n): how many of ``others`` lie within a distance of each site (inclusive); sites without any count 0.

    Where ``others`` are dense, they are grouped first; see ``_count_by_groups``.
    """
    lon_width, lat_width = cell_widths(metres, highest(sites))
    there = others.where("lon is not null and lat is not null").groupBy(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).agg(F.count(F.lit(1)).alias("m"))
    # sites of one place have the same count
    keys = sites.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(key).alias("_place"))
    one = Rounds(sites.sparkSession, "places").save(keys)
    if _dense(there, lat_width / GROUP):
        found = _count_by_groups(one, there, metres, lon_width, lat_width, "_place")
    else:
        found = split_range_join(one, there, lon_width, lat_width, spread=True).where(haversine("lat", "lon", "lat2", "lon2") <= metres).select("_place", "m")
    n = one.join(found.groupBy("_place").agg(F.sum("m").alias("n")), "_place").select("lon", "lat", "n")
    return sites.select(key, "lon", "lat").join(n, ["lon", "lat"], "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _dense(places: DataFrame, width: float) -> bool:
    """Whether some group of places has more than ``GROUP`` squared of them."""
    groups = places.groupBy(_cell("lon2", width), _cell("lat2", width)).count()
    return bool(groups.where(F.col("count") > GROUP * GROUP).limit(1).count())


def _count_by_groups(sites: DataFrame, places: DataFrame, metres: float, lon_width: float, lat_width: float, key: str) -> DataFrame:
    """Rows (key, m) whose sums are the counts.

    Places are grouped into squares of an eighth of the distance; a group knows its middle, how many places it has, and how far from the
    middle its farthest one is.  By the triangle inequality a site either has a whole group within the distance, or none of it, or has to compare
    its places; these are the groups at the edge of the circle.
    """
    rounds, small = Rounds(places.sparkSession, "groups"), lat_width / GROUP
    held = rounds.save(places.withColumn("gx", _cell("lon2", small)).withColumn("gy", _cell("lat2", small)))
    middle = held.groupBy("gx", "gy").agg(((F.min("lon2") + F.max("lon2")) / 2).alias("glon"), ((F.min("lat2") + F.max("lat2")) / 2).alias("glat"), F.sum("m").alias("m"))
    reach = held.join(middle.drop("m"), ["gx", "gy"]).groupBy("gx", "gy").agg(F.max(haversine("lat2", "lon2", "glat", "glon")).alias("reach"))
    groups = rounds.save(middle.join(reach, ["gx", "gy"]).select("gx", "gy", F.col("glon").alias("lon2"), F.col("glat").alias("lat2"), "m", "reach"))
    # a middle may lie a group's width beyond the places that are in reach
    wide = 1 + 2 / GROUP
    near = split_range_join(sites, groups, min(lon_width * wide, 360.0), lat_width * wide, spread=True).withColumn("far", haversine("lat", "lon", "lat2", "lon2"))
    slack = 1e-6 * metres + 1e-3
    whole = F.col("far") + F.col("reach") + slack <= metres
    near = rounds.save(near.where(F.col("far") - F.col("reach") - slack <= metres).select(key, "lon", "lat", "gx", "gy", "m", whole.alias("whole")))
    edge = near.where("not whole").drop("m").join(held, ["gx", "gy"]).where(haversine("lat", "lon", "lat2", "lon2") <= metres)
    return near.where("whole").select(key, "m").unionByName(edge.select(key, "m"))


def cross_component_pairs(nodes: DataFrame, metres: float, radius: float = EARTH_M) -> DataFrame:
    """(a, b, component_a, component_b, dist) for nodes of different components within a distance; a < b as text.

    ``nodes``: id, lon, lat, component.
    """
    # a pair has at most one end in the largest component, so that one is on one side only
    largest = nodes.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(F.col("component").alias("_main"))
    tagged = nodes.join(F.broadcast(largest), nodes["component"] == F.col("_main"), "left")  # one row
    one = tagged.where("_main is null").select(F.col("id").alias("a"), "lon", "lat", F.col("component").alias("component_a"))
    held = tagged.select("id", "lon", "lat", "component", F.col("_main").isNotNull().alias("main"))
    lon_width, lat_width = cell_widths(metres * EARTH_M / radius, highest(nodes))
    two = held.select(F.col("id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("component").alias("component_b"), "main")
    both = split_range_join(one, two, lon_width, lat_width).where("component_a <> component_b and (main or a < b)")
    swap = F.col("a") > F.col("b")
    ends = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("a", "b"), ("component_b", "component_a"), ("component_a", "component_b"))]
    # the order of the ends is kept in the distance, too
    at = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    far = haversine(at("lat2", "lat"), at("lon2", "lon"), at("lat", "lat2"), at("lon", "lon2"), radius)
    return both.select(*ends, far.alias("dist")).where((F.col("dist") <= metres) & (F.col("a") < F.col("b")))


def _pairs_between(one: DataFrame, nodes: DataFrame, metres: float, top: float, radius: float = EARTH_M, join=range_join) -> DataFrame:
    lon_width, lat_width = cell_widths(metres * EARTH_M / radius, top)
    two = nodes.select(F.col("id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("component").alias("component_b"))
    both = join(one, two, lon_width, lat_width).where("component_a <> component_b")
    far = haversine("lat", "lon", "lat2", "lon2", radius)
    return both.select("a", "b", "component_a", "component_b", far.alias("dist")).where(F.col("dist") <= metres)


#: No two places are further apart.
HALF_ROUND_M = math.pi * EARTH_M * 1.01


def nearest_other(nodes: DataFrame, k: int, start_m: float = 2_000.0) -> DataFrame:
    """(a, b, dist, rank): the k nearest nodes of other components for each node, ties by id; all of them where there are fewer.

    A node that finds as many within the search radius is done; the others go on with a wider one.
    """
    rounds, top, total = Rounds(nodes.sparkSession, "nearest"), highest(nodes), nodes.count()
    sizes = nodes.groupBy("component").agg(F.least(F.lit(total) - F.count(F.lit(1)), F.lit(k)).alias("need"))
    todo = rounds.save(nodes.join(sizes, "component").where("need > 0").select(F.col("id").alias("a"), "lon", "lat", F.col("component").alias("component_a"), "need"))
    done, metres = None, start_m
    while done is None or todo.limit(1).count():
        pairs = _pairs_between(todo.drop("need"), nodes, metres, top).select("a", "b", "dist")
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("dist", "b"))).where(F.col("rank") <= k)
        whole = ranked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("a"))).join(todo.select("a", "need"), "a").where("n = need").select("a", "b", "dist", "rank")
        found = rounds.save(whole)
        done = found if done is None else done.unionByName(found)
        todo = rounds.save(todo.join(found.select("a").distinct(), "a", "left_anti"))
        if metres >= HALF_ROUND_M:
            break
        metres = min(metres * 4, HALF_ROUND_M)
    return done


def nearest_to_largest(nodes: DataFrame, start_m: float = 2_000.0) -> DataFrame:
    """(component, a, b, dist): for each component but the largest its nearest pair with the largest; ties by ids.

    A component that finds a pair within the search radius is done; the others go on with a wider one.
    """
    rounds, top = Rounds(nodes.sparkSession, "nearest"), highest(nodes)
    largest = nodes.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(F.col("component").alias("main"))
    tagged = nodes.join(F.broadcast(largest), nodes["component"] == F.col("main"), "left")  # one row
    todo = rounds.save(tagged.where("main is null").select(F.col("id").alias("a"), "lon", "lat", F.col("component").alias("component_a")))
    main = rounds.save(tagged.where("main is not null").select("id", "lon", "lat", "component"))
    done, metres = None, start_m
    while done is None or todo.limit(1).count():
        near = _pairs_between(todo, main, metres, top)
        best = near.groupBy(F.col("component_a").alias("component")).agg(F.min(F.struct("dist", "a", "b")).alias("m"))
        found = rounds.save(best.select("component", "m.a", "m.b", "m.dist"))
        done = found if done is None else done.unionByName(found)
        todo = rounds.save(todo.join(found.select(F.col("component").alias("component_a")), "component_a", "left_anti"))
        if metres >= HALF_ROUND_M:
            break
        metres = min(metres * 4, HALF_ROUND_M)
    return done
