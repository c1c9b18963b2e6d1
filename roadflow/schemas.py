"""Schemas of the logical tables."""

from __future__ import annotations

SITES = "site_no string, site_name string, site_type string, lon double, lat double"
NODES = "id string, lon double, lat double"
EDGES = "src string, dst string, weight bigint"
PATHS = "rank int, path array<string>, cost double"
SERIES = "date date, time string, NB_SCATS_SITE bigint, scat_type string, day_type string, school_count bigint, Flow double"
HOLIDAYS = "`Date` string, `Holiday Name` string, `Information` string, `More Information` string, `Jurisdiction` string"
SLOTS = 96
