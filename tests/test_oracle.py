"""A sample of the registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["f1_bbox_sites", "a1_detector_sum", "a2_pivot_slots", "j3_site_type_fallback", "j6_schools_within_500m", "w1_windows_24_1_4", "n7_flow_to_speed", "g20_degree", "g2_components", "e2_regression_metrics", "pipeline_long_series", "r3_one_hot", "w5_row_slice", "w2_lag_across_sites", "o1_in_order", "n4_degree_distances", "n28_desirability", "j12_knn_3", "j13_nearest_pair"]


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, want.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
