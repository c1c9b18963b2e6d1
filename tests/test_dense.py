"""Range joins and counts where places are dense, against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from roadflow.operators import spatial


def _metres(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def _places(n, seed, lat=-37.8, lon=144.9, spread=0.004):
    rng = random.Random(seed)
    one = [(lon + rng.gauss(0, spread), lat + rng.gauss(0, spread)) for _ in range(n)]
    return [*one, *one[:20], *[(lon + 0.05 * i, lat) for i in range(-4, 5)]]


def _frame(spark, places, key="site_no"):
    return spark.createDataFrame([(str(i), *p) for i, p in enumerate(places)], f"{key} string, lon double, lat double")


@pytest.mark.parametrize(("lat", "lon", "group"), [(-37.8, 144.9, 8), (69.0, 179.999, 4)])
def test_counts_by_groups(spark, monkeypatch, lat, lon, group):
    wrap = lambda p: [((x + 180) % 360 - 180, y) for x, y in p]
    sites, others = wrap(_places(60, 1, lat, lon)), wrap(_places(900, 2, lat, lon))
    monkeypatch.setattr(spatial, "GROUP", group)
    a, b = _frame(spark, sites), _frame(spark, others, "id")
    for metres in (900.0, 6000.0):
        want = {str(i): sum(_metres(s, o) <= metres for o in others) for i, s in enumerate(sites)}
        assert {r["site_no"]: r["n"] for r in spatial.count_within_metres(a, b, metres).collect()} == want
    assert spatial._dense(b.selectExpr("lon as lon2", "lat as lat2"), spatial.cell_widths(6000.0, 70)[1] / group)


def test_dense_cells_are_dealt_into_blocks(spark, monkeypatch):
    places = _places(150, 3)
    sites = _frame(spark, places)
    pairs = lambda: sorted((r["a"], r["b"]) for r in spatial.pairs_within_degrees(sites, 0.006).collect())
    plain = pairs()
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.006**2
    assert plain == sorted((str(i), str(j)) for i, p in enumerate(places) for j, q in enumerate(places) if str(i) < str(j) and near(p, q))
    monkeypatch.setattr(spatial, "MOST_PAIRS", 50)
    assert pairs() == plain


def test_no_task_has_all_pairs_of_a_cell(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spatial, "MOST_PAIRS", 400)
    one = spark.range(200).select("id", F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"))
    two = spark.range(200).select(F.col("id").alias("id2"), F.lit(0.5).alias("lon2"), F.lit(0.5).alias("lat2"))
    both = spatial.split_range_join(one, two, 1.0, 1.0)
    assert both.count() == both.select("id", "id2").distinct().count() == 200 * 200
    plan = both._jdf.queryExecution().toString()
    assert "_i" in plan and "_j" in plan
