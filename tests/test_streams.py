"""Streams from files against the batch operators: late rows, rows out of order, and restarts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from roadflow.operators.features import last_before
from roadflow.streaming.files import file_stream, result, run_available
from roadflow.streaming.flows import last_values, slot_counts

FIELDS = "site long, t timestamp, o long, v double"


def _rows(n=400):
    """Rows of five sites in an order that is a little disturbed, with equal times among them."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        minute = max(0, i * 2 - rng.randint(0, 20))
        rows.append((rng.randint(1, 5), f"2024-01-01 {minute // 60 % 24:02d}:{minute % 60:02d}:00", i, float(rng.randint(0, 99))))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "site long, t string, o long, v double").withColumn("t", F.to_timestamp("t"))


def _feed(spark, rows, folder, parts, first=0):
    size = -(-len(rows) // parts)
    for i in range(parts):
        _frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(f"{folder}/{first + i}")


def _stream(spark, folder):
    return file_stream(spark, f"{folder}/*", spark.createDataFrame([], FIELDS), per_trigger=1)


def _latest(spark, rows, n):
    df = _frame(spark, rows)
    counts = df.groupBy("site").count().collect()
    out = []
    for r in counts:  # last_before leaves out sites with fewer rows
        few = min(n, r["count"])
        out += last_before(df.where(F.col("site") == r["site"]), "site", "t", F.lit("2030-01-01").cast("timestamp"), ["o"], few).select("site", "age", "o", "v").collect()
    return sorted(map(tuple, out))


def test_latest_rows_over_a_restart(spark, tmp_path):
    rows, folder = _rows(), str(tmp_path / "in")
    changes = lambda: last_values(_stream(spark, folder), "t", "site", "v", "o", 24, late="1 hour")
    _feed(spark, rows[:250], folder, 3)
    run_available(changes(), str(tmp_path / "out"), str(tmp_path / "state"))
    told = lambda: sorted(map(tuple, result(spark, str(tmp_path / "out"), ["site"]).select("site", "age", "o", "v").collect()))
    assert told() == _latest(spark, rows[:250], 24)
    _feed(spark, rows[250:], folder, 2, first=3)
    run_available(changes(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert told() == _latest(spark, rows, 24)
    # a row beyond the watermark changes nothing, one within it does
    _feed(spark, [(1, "2024-01-01 00:00:00", 9000, 1.0), (2, "2024-01-01 13:10:00", 9001, 2.0)], folder, 1, first=5)
    run_available(changes(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert told() == _latest(spark, [*rows, (2, "2024-01-01 13:10:00", 9001, 2.0)], 24)


def test_silent_sites_are_forgotten(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts = [[(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:00:00", 2, 2.0)], [(2, "2024-01-02 00:00:00", 3, 3.0)], [(2, "2024-01-02 01:00:00", 4, 4.0)], [(1, "2024-01-02 02:00:00", 5, 5.0)]]
    for i, rows in enumerate(parts):
        _feed(spark, rows, folder, 1, first=i)
        run_available(last_values(_stream(spark, folder), "t", "site", "v", "o", 24, late="1 minute", idle="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["site"], r["age"]): r["v"] for r in result(spark, str(tmp_path / "out"), ["site"]).collect()}
    # site 1 was forgotten during its day of silence; site 2 was, too, when its timer was due before its second row came
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): 5.0}
    assert got[2, 1] == 4.0


def test_slots(spark, tmp_path):
    rows, folder = _rows(), str(tmp_path / "in")
    _feed(spark, rows, folder, 4)
    run_available(slot_counts(_stream(spark, folder), "t", "site", "v", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    want = slot_counts(_frame(spark, rows), "t", "site", "v")
    got = result(spark, str(tmp_path / "out"), ["site", "slot_start"]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
