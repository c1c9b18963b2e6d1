"""Sources, cleaning, encoders and streaming on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from roadflow.functions import calendar, flow, geo
from roadflow.operators import clean, enrich, features
from roadflow.sources import files


def test_flow_curve(spark):
    rows = {r["f"]: r["v"] for r in spark.createDataFrame([(0.0,), (351.0,), (500.0,), (1000.0,), (1500.0,), (1501.0,), (-1.0,)], "f double").select("f", flow.speed(F.col("f")).alias("v")).collect()}
    assert rows == {0.0: 60.0, 351.0: 60.0, 500.0: 58.0, 1000.0: 50.0, 1500.0: 32.0, 1501.0: None, -1.0: None}
    t = spark.range(1).select(flow.edge_seconds(F.lit(1000.0), F.lit(9999.0)).alias("t"), flow.minutes_text(F.lit(125.7)).alias("m")).first()
    assert t["t"] == 150.0 and t["m"] == "2 min 5 sec"


def test_clean_and_reshape(spark):
    df = spark.createDataFrame([(1, "a", 5, 0), (1, "b", None, 2), (1, "c", -1023, 2), (1, "d", 1, 1)], "site int, det string, V00 int, V01 int")
    assert clean.flow_columns(df) == ["V00", "V01"]
    assert tuple(clean.drop_counters(df).first()) == (4, 1, 1, 2)
    assert tuple(clean.sum_detectors(clean.clean(df), ["site"]).first()) == (1, 6, 1)
    long = clean.unpivot_slots(df, ["site", "det"])
    assert long.count() == 8
    names = spark.createDataFrame([("V07_0.0",), ("V95",), ("x",)], "n string").select(calendar.slot_time(F.col("n"))).collect()
    assert [r[0] for r in names] == ["01:45", "23:45", None]


def test_enrich(spark, tmp_path):
    look = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "x", 3)], "site int, kind string, ord int")
    assert [tuple(r) for r in enrich.last_wins(look, "site", "kind", "ord").collect()] == [(1, "new")]
    (tmp_path / "h.csv").write_text("Date,Holiday Name,Jurisdiction\n20250127,Aus Day,VIC\n,blank,vic\nsoon,bad,vic\n20250128,other,nsw\n")
    named = enrich.holiday_lookup(files.read_csv(spark, str(tmp_path / "h.csv")))
    days = spark.createDataFrame([("2024-01-27",), ("2024-01-28",)], "d string").withColumn("d", F.to_date("d"))
    assert [r["day_type"] for r in enrich.day_type(days, "d", named).orderBy("d").collect()] == ["Aus Day", "normal"]


def test_encoders_and_splits(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, v double")
    fitted = features.fit_zscore(df, "v")
    back = features.unzscore(features.zscore(df, "v", fitted, "z"), "z", fitted, "b")
    assert all(abs(r["b"] - r["v"]) < 1e-9 for r in back.collect())
    low = features.fit_minmax(df, "v")
    assert features.unminmax(features.minmax(df, "v", low, "s"), "s", low, "b").where("abs(b - v) > 1e-9").count() == 0
    assert features.tail_split(df, ["k"], 3).where("is_test").agg(F.min("k")).first()[0] == 7
    assert features.hash_split(df, ["k"]).where("is_train").count() == 7
    w = features.windows(df.withColumn("s", F.lit(1)), "s", ["k"], ["v"], "v", 4, 1, 2).orderBy("start").collect()
    assert [r["start"] for r in w] == [0, 2, 4] and w[0]["y"] == [4.0]


def test_files(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"SITE_NO": "7", "SITE_NAME": "n", "SITE_TYPE": "t", "COMMENTS": None}, "geometry": {"type": "Point", "coordinates": [144.9, -37.8]}}
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    assert tuple(files.read_geojson(spark, str(tmp_path / "s.json")).first()) == ("7", "n", "t", None, 144.9, -37.8)
    (tmp_path / "l.csv").write_bytes("a\ncaf\xe9\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "l.csv")).first()["a"] == "café"
    for y, n in (("2014", 2), ("x", 1)):
        (tmp_path / "r" / y).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "r" / y / f"VSDATA_2014010{i + 1}.csv").write_text("NB_SCATS_SITE,V00\n1,2\n")
    assert files.years(spark, str(tmp_path / "r")) == ["2014"]
    assert files.read_year(spark, str(tmp_path / "r"), "2014", 1).count() == 1
    for name in ("featured_2013.csv", "featured_2014.csv", "featured_2025.csv", "featured.csv"):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_text("a,b\n1,2.5\n")
    got = files.read_years(spark, str(tmp_path / "f" / "featured*.csv"), schema="a int, b double")
    assert sorted(r["filename"] for r in got.collect()) == ["featured_2014.csv", "featured_2025.csv"]
    assert dict(files.read_csv(spark, str(tmp_path / "f" / "featured_2014.csv"), infer=True).dtypes) == {"a": "int", "b": "double"}
    folder = files.write_csv(got.drop("filename"), str(tmp_path / "out"), "featured", "2014")
    assert files.read_csv(spark, folder, "a int, b double").count() == 2
    with pytest.raises(FileNotFoundError):
        (tmp_path / "r" / "2015").mkdir()
        files.read_year(spark, str(tmp_path / "r"), "2015")


def test_geometry(spark):
    r = spark.range(1).select(geo.haversine(-37.8, 144.9, -37.8, 145.0).alias("m"), *[c.alias(n) for c, n in zip(geo.wkt_point(F.lit("POINT (144.5 -37.5)")), ("x", "y"))], geo.wkt_point(F.lit("none"))[0].alias("z")).first()
    assert abs(r["m"] - 8786) < 5 and (r["x"], r["y"], r["z"]) == (144.5, -37.5, None)
    assert geo.box_around(0, 0, 1, 0, 0.2) == {"lat": (-0.2, 1.2), "lon": (-0.01, 0.01)}


def test_attention():
    import numpy as np

    from roadflow.plans.forecast import attention

    x = np.random.default_rng(0).normal(size=(1, 4, 3))
    y = attention(x, x, x, causal=True)
    assert y.shape == (1, 4, 3) and np.allclose(y[0, 0], x[0, 0])


def _metres(a, b):
    import math

    p, q, x, y = map(math.radians, (a[1], b[1], a[0], b[0]))
    return 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2))


@pytest.mark.parametrize("lat", [0.0, 60.0, 75.0, -89.95])
def test_range_joins_at_any_latitude(spark, lat):
    import math
    import random

    from roadflow.operators import spatial

    rng = random.Random(int(lat))
    wide = 40 / max(0.5, 111 * math.cos(math.radians(lat)))
    place = lambda: ((rng.uniform(-wide, wide) + 180 + 180) % 360 - 180, min(90.0, max(-90.0, lat + rng.uniform(-0.2, 0.2))))  # noqa: E731  # on both sides of the date line
    points = [(str(i), *place(), str(i % 3)) for i in range(90)]
    nodes = spark.createDataFrame(points, "id string, lon double, lat double, component string")
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[3] != b[3] and _metres(a[1:3], b[1:3]) <= 5000}
    assert {(r["a"], r["b"]) for r in spatial.cross_component_pairs(nodes, 5000.0).collect()} == want
    counts = {r["id"]: r["n"] for r in spatial.count_within_metres(nodes, nodes.select("lon", "lat"), 5000.0, "id").collect()}
    assert counts == {a[0]: sum(_metres(a[1:3], b[1:3]) <= 5000 for b in points) for a in points}


def test_nearest_neighbours_at_any_distance(spark):
    from roadflow.operators import spatial

    points = [("a", 0.0, 0.0, "x"), ("b", 0.01, 0.0, "x"), ("c", 170.0, 60.0, "y"), ("d", -175.0, -40.0, "z")]
    nodes = spark.createDataFrame(points, "id string, lon double, lat double, component string")
    want = sorted((a[0], b[0]) for a in points for b in sorted((b for b in points if b[3] != a[3]), key=lambda b: (_metres(a[1:3], b[1:3]), b[0]))[:3])
    assert sorted((r["a"], r["b"]) for r in spatial.nearest_other(nodes, 3).collect()) == want
    found = {r["component"]: r["b"] for r in spatial.nearest_to_largest(nodes).collect()}
    assert found == {c: min("ab", key=lambda i: _metres(next(p[1:3] for p in points if p[0] == i), q)) for c, q in (("y", points[2][1:3]), ("z", points[3][1:3]))}


def test_lags_across_blocks(spark):
    from roadflow.operators import features

    rows = [(i, (i * 7919) % 1000) for i in range(2500)]
    got = {r["t"]: (r["lag_2"], r["lag_1"]) for r in features.lag_windows(spark.createDataFrame(rows, "t long, v long"), ["t"], "v", 2).collect()}
    assert got == {i: (rows[i - 2][1], rows[i - 1][1]) for i in range(2, 2500)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from roadflow.scratch import shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    on = lambda master, **conf: SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_dir(on(master))
        assert shared_dir(on(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_dir(on("local[4]"))


def test_forecast_steps(spark, tmp_path):
    import datetime
    import math

    import numpy as np

    from roadflow.plans import forecast

    def clock(t):
        values = ((t.weekday(), 7), (t.month - 1, 12), (t.hour, 23), (t.minute, 59))
        return [f(2 * math.pi * v / p) for v, p in values for f in (math.sin, math.cos)]

    times = [datetime.datetime(2024, 3, 31, h, m) for h in (0, 9, 22) for m in (0, 15, 45)] + [datetime.datetime(2024, 1, 7, 22, 50)]
    later = np.array([clock(t + datetime.timedelta(minutes=15)) for t in times])
    later[:, 2:4] = [clock(t)[2:4] for t in times]
    assert np.allclose(forecast.advance_clock(np.array([clock(t) for t in times])), later)

    rng = np.random.default_rng(1)
    d = 8
    square = ("wq", "wk", "wv", "wo", "cq", "ck", "cv", "co", "w1", "w2")
    layer = {k: rng.normal(0, 0.2, (d, d)) for k in square} | {k: np.ones(d) for k in ("g1", "g2", "g3")} | {k: np.zeros(d) for k in ("s1", "s2", "s3", "b1", "b2")}
    weights = {"categories": [(1, rng.normal(size=(3, 4)))], "embed": rng.normal(0, 0.3, (9 + 4, d)), "layers": [layer], "decoder": [layer], "head": rng.normal(size=d), "flow": 0, "clock": 2}
    x = np.array([[k, k % 4, *clock(times[k % 3])] for k in range(5)])
    rows = [("a", 0, x.tolist()), ("b", 3, x[::-1].tolist())]
    got = {r["site"]: r["forecast"] for r in forecast.forecast_windows(spark.createDataFrame(rows, "site string, start long, x array<array<double>>"), weights, 2, 3).collect()}
    now = x[None]
    for step in range(3):
        y = forecast.forward(now, weights, 2)
        assert np.isclose(got["a"][step], y[0])
        after = now[:, -1:].copy()
        after[:, 0, 0], after[:, 0, 2:10] = y, forecast.advance_clock(after[:, 0, 2:10])
        now = np.concatenate([now[:, 1:], after], axis=1)
    changed = x.copy()
    changed[-1, 0] += 5
    first = [forecast.encoder_layer(forecast.embedded(v[None], weights), layer, 2)[0, :-1] for v in (x, changed)]
    assert np.allclose(*first)  # no step sees a later one
    forecast.save_weights(spark, str(tmp_path / "w"), **layer)
    assert all(np.array_equal(v, layer[k]) for k, v in forecast.load_weights(spark, str(tmp_path / "w")).items())
