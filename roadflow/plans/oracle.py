"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from roadflow.functions import flow
from roadflow.operators.enrich import HOLIDAYS
from roadflow.plans.queries import ANY, BEFORE, ORIGIN, RADIUS, SLOTS, TARGET, TYPES as EVENT_TYPES


def _place(k: str, a: int, b: int, c: int, d: int) -> str:
    return f"144.45::DOUBLE + (({k} * {a} + {k} * {k} * {b}) % 1103) / 1000.0::DOUBLE AS lon, -38.05::DOUBLE + (({k} * {c} + {k} * {k} * {d}) % 601) / 1000.0::DOUBLE AS lat"


def _hav(lat1: str, lon1: str, lat2: str, lon2: str, r: float = 6371000.0) -> str:
    return f"({2 * r}::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


SLOT = "(hour(ts) * 4 + minute(ts) // 15)"


def _edges(name: str, r: float) -> str:
    metres = f"CAST(floor({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371008.8)}) AS BIGINT)"
    near = f"(a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {r}::DOUBLE * {r}::DOUBLE"
    return f"{name}_half AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, {metres} AS weight FROM nodes a JOIN nodes b ON a.id < b.id AND {near} WHERE {metres} > 0), {name} AS MATERIALIZED (SELECT * FROM {name}_half UNION ALL SELECT dst, src, weight FROM {name}_half)"


def _chunk(edges: str, origin: str, target: str, margin: float) -> str:
    """nodes of a trip (kept) and its edges (arcs)."""
    return f"""ends AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM nodes WHERE id IN ('{origin}', '{target}')),
box AS (SELECT la - greatest((lb - la) * {margin}::DOUBLE, 0.01::DOUBLE) AS la, lb + greatest((lb - la) * {margin}::DOUBLE, 0.01::DOUBLE) AS lb, oa - greatest((ob - oa) * {margin}::DOUBLE, 0.01::DOUBLE) AS oa, ob + greatest((ob - oa) * {margin}::DOUBLE, 0.01::DOUBLE) AS ob FROM ends),
inside AS MATERIALIZED (SELECT id FROM nodes, box WHERE (lat BETWEEN la AND lb AND lon BETWEEN oa AND ob) OR id IN ('{origin}', '{target}')),
arcs AS MATERIALIZED (SELECT * FROM {edges} WHERE src IN (SELECT id FROM inside) OR dst IN (SELECT id FROM inside)),
kept AS MATERIALIZED (SELECT id FROM inside UNION SELECT src FROM arcs UNION SELECT dst FROM arcs)"""


def _labels(edges: str) -> str:
    return f"""label(id, component) AS (SELECT id, min(component) FROM (
  WITH RECURSIVE reach(id, component) USING KEY (id) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT e.dst, min(r.component) FROM reach r JOIN {edges} e ON e.src = r.id JOIN recurring.reach old ON old.id = e.dst WHERE r.component < old.component GROUP BY e.dst
  ) SELECT * FROM reach) GROUP BY id)"""


SITES = f"sites AS (SELECT CAST(c_custkey AS VARCHAR) AS site_no, c_name AS site_name, c_mktsegment AS site_type, {_place('c_custkey', 7919, 31, 104729, 17)} FROM customer)"
SCHOOLS = f"schools AS (SELECT s_suppkey AS school_id, {_place('s_suppkey', 6007, 13, 5003, 29)} FROM supplier)"
NODES = SITES + ", nodes AS MATERIALIZED (SELECT site_no AS id, lon, lat FROM sites WHERE lat BETWEEN -38.0 AND -37.5 AND lon BETWEEN 144.5 AND 145.5)"
DET = "det AS (SELECT event_id, user_id AS NB_SCATS_SITE, event_type AS NB_DETECTOR, ts, CAST(ts AS DATE) AS date, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -1023.0 ELSE value END AS value FROM events)"
WIDE = DET + ", wide AS (SELECT NB_SCATS_SITE, date, NB_DETECTOR, " + ", ".join(f"CAST(sum(CASE WHEN {SLOT} % 4 = {k} THEN floor(value) END) AS BIGINT) AS V{32 + k}" for k in range(4)) + " FROM det GROUP BY ALL)"
VS = [f"V{32 + k}" for k in range(4)]
FULL = " AND ".join(f"{v} IS NOT NULL" for v in VS)
NONNEG = " AND ".join(f"{v} >= 0" for v in VS)
CLEAN = WIDE + f", clean AS (SELECT * FROM wide WHERE {FULL} AND {NONNEG})"
DAILY = DET + ", daily AS (SELECT NB_SCATS_SITE, date, count(*) AS n FROM det GROUP BY ALL)"
TYPES = "types AS (SELECT c_custkey AS site, CASE WHEN s_suppkey IS NULL THEN c_mktsegment ELSE 'NEW_' || c_mktsegment END AS scat_type FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)"
PAIRS = "pairs AS (SELECT user_id AS site, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS predicted FROM events)"
SERIES = "series AS (SELECT user_id AS site, ts, event_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
E2, E3 = _edges("edges", 0.02), _edges("edges", RADIUS)
TRIP = f"{NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.2)}"


def _flows(k: int) -> str:
    return f"flows AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(count(*) * {k} AS DOUBLE) AS flow FROM events GROUP BY ALL)"


def _speed(f: str) -> str:
    return f"round_even(greatest(0.0, least(60.0, (-{flow.B} - sqrt({flow.B * flow.B}::DOUBLE + {4 * flow.A}::DOUBLE * {f})) / {2 * flow.A}::DOUBLE)), 0)"


def _seconds(f: str, w: str = "weight") -> str:
    v = f"(CASE WHEN {f} BETWEEN 0 AND 1500 AND {_speed(f'least({f}, 1500)')} > 0 THEN {_speed(f'least({f}, 1500)')} ELSE 30.0 END)"
    return f"(round_even({w} / ({v} * 1000 / 3600), 2) + 30)"


def _timed(k: int, edges: str = "edges") -> str:
    return _flows(k) + f", flowed AS (SELECT e.src, e.dst, e.weight, coalesce(t.flow, o.flow, 500.0) AS flow FROM {edges} e LEFT JOIN flows t ON t.id = e.dst LEFT JOIN flows o ON o.id = e.src), timed AS MATERIALIZED (SELECT src, dst, weight, flow, {_seconds('flow')} AS cost FROM flowed)"


def _dijkstra(arcs: str = "arcs", cost: str = "weight") -> str:
    return f"""best(id, cost) AS (SELECT id, cost FROM (WITH RECURSIVE d(id, cost) USING KEY (id) AS (
    SELECT '{ORIGIN}', CAST(0 AS DOUBLE)
    UNION
    SELECT e.dst, min(d.cost + e.{cost}) FROM d JOIN {arcs} e ON e.src = d.id LEFT JOIN recurring.d old ON old.id = e.dst GROUP BY e.dst, old.cost HAVING old.cost IS NULL OR min(d.cost + e.{cost}) < old.cost
  ) SELECT * FROM d))"""


def _bfs(arcs: str = "arcs", cost: str = "weight") -> str:
    return f"""bfs(id, hops, path, cost) AS (SELECT * FROM (WITH RECURSIVE b(id, hops, path, cost) USING KEY (id) AS (
    SELECT '{ORIGIN}', CAST(0 AS BIGINT), ['{ORIGIN}'], CAST(0 AS DOUBLE)
    UNION
    SELECT x.id, x.hops, x.path, x.cost FROM (
      SELECT e.dst AS id, min(b.hops) + 1 AS hops, arg_min(list_append(b.path, e.dst), b.path) AS path, arg_min(b.cost + e.{cost}, b.path) AS cost
      FROM b JOIN {arcs} e ON e.src = b.id LEFT JOIN recurring.b old ON old.id = e.dst WHERE old.id IS NULL GROUP BY e.dst) x
  ) SELECT * FROM b))"""


BFS = _bfs()
TOLD_BFS = f"SELECT array_to_string(path, '>') AS path, CAST(floor(cost) AS BIGINT) AS cost FROM bfs WHERE id = '{TARGET}'"
FAR = f"goal AS (SELECT lon AS glon, lat AS glat FROM nodes WHERE id = '{TARGET}'), far AS (SELECT id, sqrt((lon - glon) ** 2 + (lat - glat) ** 2) AS far FROM nodes, goal)"


def _steps(following: str, arcs: str = "arcs", summed: str = "arcs", cost: str = "weight") -> str:
    """A search that goes on to the first neighbour not seen yet, in a given order, and back from dead ends: one row for each step."""
    return f"""adj AS MATERIALIZED (SELECT src, list(dst ORDER BY {following}) AS d FROM {arcs} GROUP BY src),
steps(n, trail, seen) AS (SELECT * FROM (WITH RECURSIVE w(n, trail, seen) AS (
    SELECT 0, ['{ORIGIN}'], ['{ORIGIN}']
    UNION ALL
    SELECT n + 1, CASE WHEN nxt IS NULL THEN trail[1:len(trail) - 1] ELSE list_append(trail, nxt) END, CASE WHEN nxt IS NULL THEN seen ELSE list_append(seen, nxt) END
    FROM (SELECT w.*, list_filter(a.d, lambda x: NOT list_contains(w.seen, x))[1] AS nxt FROM w LEFT JOIN adj a ON a.src = w.trail[-1] WHERE len(w.trail) > 0 AND w.trail[-1] <> '{TARGET}')
  ) SELECT * FROM w)),
found AS (SELECT trail FROM steps WHERE trail[-1] = '{TARGET}'),
legs AS (SELECT trail, trail[i] AS a, trail[i + 1] AS b FROM found, range(1, len(trail)) r(i))
SELECT array_to_string(any_value(l.trail), '>') AS path, CAST(floor(sum(e.{cost})) AS BIGINT) AS cost FROM legs l JOIN {summed} e ON e.src = l.a AND e.dst = l.b HAVING count(*) > 0"""


def _cheapest(arcs: str, cost: str) -> str:
    """path and cost of the cheapest path, the first of equal ones as a text."""
    return f"""WITH {_dijkstra(arcs, cost)}, paths(path) AS (SELECT path FROM (WITH RECURSIVE p(id, path) AS (
    SELECT '{TARGET}', '{TARGET}'
    UNION ALL
    SELECT e.src, e.src || '>' || p.path FROM p JOIN best now ON now.id = p.id JOIN {arcs} e ON e.dst = p.id JOIN best b ON b.id = e.src WHERE p.id <> '{ORIGIN}' AND abs(b.cost + e.{cost} - now.cost) < 1e-6
  ) SELECT * FROM p) WHERE id = '{ORIGIN}')
SELECT (SELECT min(path) FROM paths) AS path, CAST(floor(cost) AS BIGINT) AS cost FROM best WHERE id = '{TARGET}'"""


def _routes(arcs: str, cost: str) -> str:
    """A row for each algorithm of the dispatcher."""
    return f"""SELECT 'BFS' AS algorithm, * FROM (WITH {_bfs(arcs, cost)} {TOLD_BFS})
UNION ALL SELECT 'DFS', * FROM (WITH {_steps('dst', arcs, arcs, cost)})
UNION ALL SELECT 'GBFS', * FROM (WITH {FAR}, {_steps('far, dst', f'{arcs} a JOIN far ON far.id = a.dst', arcs, cost)})
UNION ALL SELECT a.algorithm, c.path, c.cost FROM (VALUES ('DIJK'), ('AS')) a(algorithm), ({_cheapest(arcs, cost)}) c"""


#: By how much the cheapest paths that are enumerated may be longer than the shortest: room for well over ten of them.
ROOM = 1.02


def _simple_paths(arcs: str, cost: str, targets: tuple[str, ...] = (TARGET,)) -> str:
    """All simple paths (path, cost) up to ``ROOM`` times the cheapest, by enumeration from the origin within the exact rest."""
    ends = ", ".join(f"'{t}'" for t in targets)
    return f"""rest(id, rest) AS MATERIALIZED (SELECT id, rest FROM (WITH RECURSIVE d(id, rest) USING KEY (id) AS (
    SELECT unnest([{ends}]), CAST(0 AS DOUBLE)
    UNION
    SELECT e.src, min(d.rest + e.{cost}) FROM d JOIN {arcs} e ON e.dst = d.id LEFT JOIN recurring.d old ON old.id = e.src GROUP BY e.src, old.rest HAVING old.rest IS NULL OR min(d.rest + e.{cost}) < old.rest
  ) SELECT * FROM d)),
simple AS (SELECT path, cost FROM (WITH RECURSIVE p(id, cost, path) AS (
    SELECT '{ORIGIN}', CAST(0 AS DOUBLE), ['{ORIGIN}']
    UNION ALL
    SELECT e.dst, p.cost + e.{cost}, list_append(p.path, e.dst) FROM p JOIN {arcs} e ON e.src = p.id JOIN rest r ON r.id = e.dst
    WHERE p.id NOT IN ({ends}) AND NOT list_contains(p.path, e.dst) AND p.cost + e.{cost} + r.rest <= {ROOM} * (SELECT rest FROM rest WHERE id = '{ORIGIN}')
  ) SELECT * FROM p) WHERE id IN ({ends}))"""


def _first_paths(arcs: str, cost: str) -> str:
    return f"{_simple_paths(arcs, cost)} SELECT row_number() OVER (ORDER BY cost, len(path), path)::BIGINT AS rank, array_to_string(path, '>') AS path, CAST(floor(cost) AS BIGINT) AS cost FROM simple QUALIFY rank <= 5"


def _zero(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 1 ELSE 0 END"


def _windows(length: int, step: int) -> str:
    return f"win AS (SELECT site, rn, n, v, sum(v) OVER w AS x_sum, lead(v, {length}) OVER (PARTITION BY site ORDER BY ts, event_id) AS y FROM series WINDOW w AS (PARTITION BY site ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)), kept AS (SELECT * FROM win WHERE rn % {step} = 0 AND rn + {length + 1} <= n)"


def _cycle(v: str, p: int, name: str) -> str:
    return f"round(sin(2 * pi() * ({v}) / {p}.0), 6) + 0.0 AS {name}_sin, round(cos(2 * pi() * ({v}) / {p}.0), 6) + 0.0 AS {name}_cos"


def oracle_sql() -> dict[str, str]:
    hod = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in HOLIDAYS)
    comp = f"WITH {NODES}, {E2}, {_labels('edges')}"
    comp3 = f"WITH {NODES}, {E3}, {_labels('edges')}, placed AS MATERIALIZED (SELECT n.id, n.lon, n.lat, l.component FROM nodes n JOIN label l USING (id))"
    dist = _hav("a.lat", "a.lon", "b.lat", "b.lon")
    return {
        "s10_column_pruning": "SELECT event_id, user_id FROM events",
        "s13_site_ids": f"WITH {NODES} SELECT id FROM nodes",
        "s14_sheet_unpivot": f"WITH {DET}, d AS (SELECT DISTINCT NB_SCATS_SITE AS site, date FROM det), k AS (SELECT unnest({SLOTS}) AS k) SELECT d.site, CAST(d.date AS VARCHAR) AS date, 'one_' || k AS time, CASE WHEN EXISTS (SELECT 1 FROM det WHERE det.NB_SCATS_SITE = d.site AND det.date = d.date AND {SLOT} = k) THEN 1.0::DOUBLE END AS flow FROM d, k",
        "s15_tail_split": "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 1000 AS is_test FROM events) SELECT is_test, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM r GROUP BY ALL",
        "p2_wkt_extract": f"WITH {SITES} SELECT site_no, CASE WHEN CAST(site_no AS INT) % 7 <> 0 THEN round(lon, 3) END AS lon, CASE WHEN CAST(site_no AS INT) % 7 <> 0 THEN round(lat, 3) END AS lat FROM sites",
        "f1_bbox_sites": f"WITH {NODES} SELECT s.site_no, s.site_type, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat FROM sites s JOIN nodes n ON n.id = s.site_no",
        "f3f4_clean_counts": f"WITH {CLEAN} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM clean",
        "f5_date_range": f"WITH {DET} SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM det WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY ALL",
        "f7_digit_dates": "SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events WHERE event_id % 5 <> 0",
        "f8_known_sites": f"WITH {NODES} SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE CAST(user_id AS VARCHAR) IN (SELECT id FROM nodes)",
        "f11_last_24_before": f"WITH r AS (SELECT user_id AS site, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE ts < TIMESTAMP '{BEFORE}') SELECT site, event_id, CAST(age AS INT) AS age FROM r WHERE age <= 24 AND n >= 24",
        "f12_unknown_category": "WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY')) SELECT c.c_custkey, c.c_mktsegment, coalesce(k.code, 0) AS code FROM customer c LEFT JOIN k USING (c_mktsegment)",
        "n10_slot_index": f"SELECT CAST({SLOT} AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY ALL",
        "n11_slot_label": f"SELECT printf('%02d:%02d', CAST({SLOT} // 4 AS INT), CAST({SLOT} % 4 * 15 AS INT)) AS time, count(*) AS n FROM events GROUP BY ALL",
        "n12_date_formats": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
        "n13_date_time": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS t FROM events",
        "n13_fallback_columns": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%d 00:15:00') END AS t FROM events",
        "n18_next_step": f"WITH e AS (SELECT event_id, ts, minute(ts) % 59 + 15 AS m, hour(ts) % 23 + (minute(ts) % 59 + 15) // 60 AS h FROM events) SELECT event_id, {_cycle('(isodow(ts) - 1 + h // 24) % 7', 7, 'dow')}, {_cycle('month(ts) - 1', 12, 'month')}, {_cycle('h % 24', 23, 'hour')}, {_cycle('m % 60', 59, 'minute')} FROM e".replace(", 6)", ", 5)"),
        "e5_sampled_metrics": f"WITH {PAIRS}, p AS (SELECT value AS y, value - predicted AS e FROM pairs WHERE predicted IS NOT NULL ORDER BY md5('42|' || event_id), event_id LIMIT 1000) SELECT count(*) AS n, round(1 - var_pop(e) / var_pop(y), 4) AS explained_variance, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(y), 4) AS r2 FROM p",
        "n14_date_in_name": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY ALL",
        "n15_cyclical_features": f"SELECT event_id, {_cycle('isodow(ts) - 1', 7, 'dow')}, {_cycle('month(ts) - 1', 12, 'month')}, {_cycle('hour(ts)', 23, 'hour')}, {_cycle('minute(ts)', 59, 'minute')} FROM events",
        "n18_inverse_cycle": "SELECT event_id, CAST(hour(ts) % 23 AS BIGINT) AS hour FROM events",
        "n31_positional_encoding": f"""WITH l AS (SELECT user_id AS site, event_id, floor(value) AS v, 24 - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE ts < TIMESTAMP '{BEFORE}')
SELECT site, event_id, CAST(i AS BIGINT) AS i, round(v + CASE WHEN i % 2 = 0 THEN sin(p * exp((i - i % 2) * -ln(10000.0) / 8)) ELSE cos(p * exp((i - i % 2) * -ln(10000.0) / 8)) END, 6) AS value FROM l, range(8) b(i) WHERE p >= 0 AND n >= 24""",
        "w6_future_slots": "WITH m AS (SELECT user_id AS site, max(ts) AS ts FROM events GROUP BY ALL) SELECT site, strftime(ts + INTERVAL (15 * k) MINUTE, '%Y-%m-%d %H:%M:%S') AS t FROM m, range(1, 5) r(k)",
        "a1_detector_sum": f"WITH {CLEAN} SELECT NB_SCATS_SITE, CAST(date AS VARCHAR) AS date, {', '.join(f'CAST(sum({v}) AS BIGINT) AS {v}' for v in VS)} FROM clean GROUP BY ALL",
        "a2_pivot_slots": f"WITH {DET}, s AS (SELECT NB_SCATS_SITE, date, {SLOT} AS slot, count(*) AS n FROM det GROUP BY ALL) SELECT NB_SCATS_SITE, CAST(date AS VARCHAR) AS date, {', '.join(f'avg(CASE WHEN slot = {k} THEN n END) AS V00_{k}' for k in SLOTS)} FROM s GROUP BY ALL",
        "a3_flow_extents": f"WITH {CLEAN} SELECT min(least({', '.join(VS)})) AS min_flow, max(greatest({', '.join(VS)})) AS max_flow, CAST(sum({' + '.join(map(_zero, VS))}) AS BIGINT) AS zeros FROM clean",
        "a4_drop_counters": f"WITH {WIDE} SELECT count(*) AS rows_before, count(*) FILTER (NOT ({FULL})) AS dropped_null, count(*) FILTER (({FULL}) AND NOT ({NONNEG})) AS dropped_negative, count(*) FILTER (({FULL}) AND ({NONNEG})) AS rows_after FROM wide",
        "a5_series_profile": f"WITH {DET} SELECT round(min(value), 6) AS min_flow, round(max(value), 6) AS max_flow, round(avg(value), 4) AS mean_flow, round(stddev_pop(value), 4) AS std_flow, count(DISTINCT NB_SCATS_SITE) AS sites, count(DISTINCT date) AS dates, count(*) FILTER (value IS NULL) AS null_flows, count(*) FILTER (value < 0) AS negative_flows FROM det",
        "r2_unpivot_slots": f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT NB_SCATS_SITE, CAST(date AS VARCHAR) AS date, NB_DETECTOR, '{v}' AS time_idx, CAST({v} AS DOUBLE) AS Flow FROM wide" for v in VS),
        "r3_one_hot": "SELECT event_id, " + ", ".join(f"CAST(event_type = '{c}' AS INT) AS is_{c}" for c in EVENT_TYPES) + " FROM events",
        "a14_class_counts": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
        "w5_row_slice": "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 24 OFFSET 300",
        "w2_lag_across_sites": "SELECT * FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT), 12) OVER w AS lag_12, lag(CAST(floor(value) AS BIGINT)) OVER w AS lag_1 FROM events WINDOW w AS (ORDER BY ts, event_id) QUALIFY row_number() OVER w > 12)",
        "o1_in_order": "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS place FROM events",
        "l3_random_sample": "SELECT event_id, user_id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 50",
        "g20_edge_data": f"WITH {NODES}, {E3} SELECT src, dst, weight FROM edges WHERE src = '{ORIGIN}' AND dst = (SELECT min(dst) FROM edges WHERE src = '{ORIGIN}')",
        "n4_degree_distances": f"WITH {NODES}, {E2} SELECT e.src, e.dst, round(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2), 2) AS apart, round(sqrt(CAST((trunc(a.lat) - trunc(b.lat)) ** 2 + (trunc(a.lon) - trunc(b.lon)) ** 2 AS DOUBLE)), 6) AS whole FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.src < e.dst",
        "n28_desirability": f"WITH {NODES}, {E2} SELECT src, dst, round(0.5::DOUBLE * pow(1 / CAST(weight AS DOUBLE), 2) * 1e6::DOUBLE, 6) AS pull FROM edges",
        "l1_sample": f"WITH {DAILY} SELECT NB_SCATS_SITE, CAST(date AS VARCHAR) AS date, n FROM daily ORDER BY 1, daily.date LIMIT 100",
        "x1_union_years": f"WITH {DET} SELECT NB_SCATS_SITE, CAST(count(*) AS DOUBLE) AS first_half, CAST(NULL AS DOUBLE) AS second_half FROM det WHERE date < DATE '2024-01-15' GROUP BY 1 UNION ALL SELECT NB_SCATS_SITE, NULL, CAST(count(*) AS DOUBLE) FROM det WHERE date >= DATE '2024-01-15' GROUP BY 1",
        "x3_distinct_types": "SELECT DISTINCT event_type FROM events",
        "x4_missing_nodes": f"WITH {NODES} SELECT id FROM nodes EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events",
        "x6_full_coverage": "SELECT user_id, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS all_types FROM events GROUP BY ALL",
        "j2_site_type_last_wins": f"WITH {TYPES} SELECT * FROM types",
        "j3_site_type_fallback": f"WITH {DAILY}, {TYPES} SELECT d.NB_SCATS_SITE AS site, CAST(d.date AS VARCHAR) AS date, coalesce(t.scat_type, 'NATION_' || s.s_nationkey, 'Unknown') AS scat_type FROM daily d LEFT JOIN types t ON t.site = d.NB_SCATS_SITE LEFT JOIN supplier s ON s.s_suppkey = d.NB_SCATS_SITE",
        "j4_school_default": f"WITH {SITES}, {SCHOOLS}, c AS (SELECT CAST(a.site_no AS BIGINT) AS site, count(*) AS n FROM sites a JOIN schools b ON {dist} <= 5000 GROUP BY ALL HAVING count(*) > 2) SELECT e.site, coalesce(c.n, 0) AS school_count FROM (SELECT DISTINCT user_id AS site FROM events) e LEFT JOIN c USING (site)",
        "j5_holiday_day_type": f"WITH {DAILY} SELECT CASE strftime(date, '%m-%d') {hod} ELSE 'normal' END AS day_type, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY ALL",
        "j6_schools_within_500m": f"WITH {SITES}, {SCHOOLS} SELECT a.site_no, count(b.school_id) AS n FROM sites a LEFT JOIN schools b ON {dist} <= 500 GROUP BY ALL",
        "a11_zscore": "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS z FROM events",
        "a12_minmax_train_fit": "WITH f AS (SELECT min(value) AS low, max(value) - min(value) AS span FROM events WHERE event_id % 10 < 7) SELECT event_id, round((value - low) / span, 6) AS scaled FROM events, f",
        "n19_inverse_zscore": "SELECT event_id, round(value, 4) AS back FROM events",
        "a13_label_encode": "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)",
        "w1_windows_24_1_4": f"WITH {SERIES}, {_windows(24, 4)} SELECT site, rn AS start, CAST(x_sum AS BIGINT) AS x_sum, y FROM kept",
        "w2_lag_12": "WITH s AS (SELECT user_id AS site, event_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT), 12) OVER w AS lag_12, lag(CAST(floor(value) AS BIGINT), 1) OVER w AS lag_1, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT site, event_id, v, lag_12, lag_1 FROM s WHERE rn > 12",
        "w3_sequences_10": f"WITH {SERIES}, {_windows(10, 1)} SELECT site, count(*) AS windows, CAST(sum(y) AS BIGINT) AS y_sum FROM kept GROUP BY ALL",
        "w9_hash_split": "SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) <= floor(0.7 * count(*) OVER ()) AS is_train FROM events",
        "w10_validation_split": "WITH t AS (SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY md5('42|' || event_id), event_id) <= floor(0.7 * count(*) OVER ())) SELECT event_id, row_number() OVER (ORDER BY md5('7|' || event_id), event_id) <= floor(0.9 * count(*) OVER ()) AS is_train FROM t",
        "e1_mape": f"WITH {PAIRS} SELECT round(avg(CASE WHEN value > 0 THEN abs(value - predicted) / value END) * 100, 3) AS mape FROM pairs WHERE predicted IS NOT NULL",
        "e2_regression_metrics": f"WITH {PAIRS}, p AS (SELECT value AS y, value - predicted AS e FROM pairs WHERE predicted IS NOT NULL AND value IS NOT NULL) SELECT count(*) AS n, round(1 - var_pop(e) / var_pop(y), 4) AS explained_variance, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(y), 4) AS r2 FROM p",
        "e3_batch_metrics": f"WITH {PAIRS}, p AS (SELECT event_id % 16 AS b, value - predicted AS e FROM pairs WHERE predicted IS NOT NULL), g AS (SELECT b, avg(e * e) AS mse, avg(abs(e)) AS mae FROM p GROUP BY b) SELECT round((SELECT avg(mse) FROM g), 4) AS batch_mse, round((SELECT avg(mae) FROM g), 4) AS batch_mae, round(avg(e * e), 4) AS mse, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM p",
        "j1_radius_edges": f"WITH {NODES}, {E3} SELECT * FROM edges_half",
        "x7_symmetric_edges": f"WITH {NODES}, {E3} SELECT src, count(*) AS n FROM edges GROUP BY ALL",
        "g1_site_graph": f"WITH {NODES}, {E2} SELECT * FROM edges",
        "g6_adjacency": f"WITH {NODES}, {E2} SELECT src AS id, string_agg(dst || ':' || weight, ',' ORDER BY dst, weight) AS neighbours FROM edges GROUP BY ALL",
        "g20_degree": f"WITH {NODES}, {E3} SELECT src AS id, count(*) AS out_degree, CAST(sum(weight) AS BIGINT) AS total_weight FROM edges GROUP BY ALL",
        "g2_components": f"{comp} SELECT * FROM label",
        "a16_component_sizes": f"{comp} SELECT component, count(*) AS size FROM label GROUP BY ALL",
        "j11_bridge_candidates": f"{comp}, placed AS MATERIALIZED (SELECT n.id, n.lon, n.lat, l.component FROM nodes n JOIN label l USING (id)) SELECT a.id AS a, b.id AS b, a.component AS component_a, b.component AS component_b, CAST(floor({dist}) AS BIGINT) AS metres FROM placed a JOIN placed b ON a.id < b.id AND a.component <> b.component AND {dist} <= 3000",
        "j12_knn_3": f"{comp3}, p AS (SELECT a.id AS a, b.id AS b, {dist} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank FROM placed a JOIN placed b ON a.component <> b.component) SELECT a, b, CAST(floor(d) AS BIGINT) AS metres, rank FROM p WHERE rank <= 3",
        "j13_nearest_pair": f"{comp3}, main AS (SELECT component FROM label GROUP BY ALL ORDER BY count(*) DESC, component LIMIT 1), p AS (SELECT a.component, a.id AS a, b.id AS b, {dist} AS d, row_number() OVER (PARTITION BY a.component ORDER BY {dist}, a.id, b.id) AS k FROM placed a JOIN placed b ON a.component <> b.component WHERE b.component = (SELECT component FROM main)) SELECT component, a, b, CAST(floor(d) AS BIGINT) AS metres FROM p WHERE k = 1",
        "g4_connected": f"WITH {NODES} SELECT min(id) AS component, count(*) AS size FROM nodes",
        "g5_chunk_nodes": f"WITH {TRIP} SELECT id FROM kept",
        "g5_chunk_edges": f"WITH {TRIP} SELECT * FROM arcs",
        "a10_chunk_stats": f"WITH {TRIP}, o AS (SELECT * FROM nodes WHERE id = '{ORIGIN}'), t AS (SELECT * FROM nodes WHERE id = '{TARGET}') SELECT (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM arcs) AS edges, (SELECT count(*) FROM nodes) AS all_nodes, (SELECT count(*) FROM edges) AS all_edges, CAST(floor({_hav('o.lat', 'o.lon', 't.lat', 't.lon')}) AS BIGINT) AS direct_m, round(box.lb - box.la, 6) AS box_height, round(box.ob - box.oa, 6) AS box_width, round((1 - (SELECT count(*) FROM kept) / (SELECT count(*) FROM nodes)) * 100, 6) AS reduction_pct FROM o, t, box",
        "j10_edge_flow": f"WITH {NODES}, {E2}, {_timed(15)} SELECT src, dst, CAST(flow AS BIGINT) AS flow FROM timed",
        "n7_flow_to_speed": "WITH e AS (SELECT user_id AS site, CAST(count(*) * 15 AS DOUBLE) AS flow, floor(sum(value)) AS total FROM events GROUP BY 1) SELECT site, " + ", ".join(f"CASE WHEN {c} BETWEEN 0 AND 1500 THEN CAST(round_even(greatest(0.0, least(60.0, (-{flow.B} {sign} sqrt({flow.B * flow.B}::DOUBLE + {4 * flow.A}::DOUBLE * least({c}, 1500))) / {2 * flow.A}::DOUBLE)), 0) AS DOUBLE) END AS {name}_{c}" for c in ("flow", "total") for name, sign in (("under", "-"), ("over", "+"))) + " FROM e",
        "n9_edge_time_floor": f"WITH {NODES}, {E2}, {_timed(20)} SELECT src, dst, CAST(floor(cost) AS BIGINT) AS seconds FROM timed",
        "s12_edge_costs_rewritten": f"WITH {NODES}, {E2}, {_timed(15)} SELECT src, dst, CAST(floor(CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN cost ELSE weight END) AS BIGINT) AS cost FROM timed",
        "j9_cost_override": f"WITH {NODES}, {E2} SELECT src, CAST(sum(CASE WHEN weight < 1000 THEN weight * 2 ELSE weight END) AS BIGINT) AS cost FROM edges GROUP BY ALL",
        "g7_bfs_levels": f"WITH {TRIP}, {BFS} SELECT id, hops FROM bfs",
        "g10_bfs_path": f"WITH {TRIP}, {BFS} {TOLD_BFS}",
        "g17_routes_by_metres": f"WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)} {_routes('arcs', 'weight')}",
        "g17_routes_by_seconds": f"WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)}, {_timed(15, 'arcs')} {_routes('timed', 'cost')}",
        "k2_top_k_paths": f"WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)}, {_first_paths('arcs', 'weight')}",
        "k2_paths_by_seconds": f"WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)}, {_timed(15, 'arcs')}, {_first_paths('timed', 'cost')}",
        "g17_routes_to_any": f"""WITH {TRIP}, {_simple_paths('arcs', 'weight', ANY)}, r AS (SELECT row_number() OVER (ORDER BY cost, len(path), path)::BIGINT AS rank, path[-1] AS reached, CAST(floor(cost) AS BIGINT) AS cost FROM simple)
SELECT algorithm, rank, reached, cost FROM r, (VALUES ('DIJK', 1), ('AS', 1), ('KSP', 5)) a(algorithm, n) WHERE rank <= n""",
        "g12_shortest_cost": f"WITH {TRIP}, {_dijkstra()} SELECT id, CAST(cost AS BIGINT) AS cost FROM best",
        "g13_multi_target": f"WITH {TRIP}, {_dijkstra()} SELECT id, CAST(cost AS BIGINT) AS cost FROM best WHERE id IN ('{TARGET}', '30', '1028') ORDER BY cost LIMIT 1",
        "g14_a_star": f"WITH {TRIP}, {_dijkstra()} SELECT id, CAST(cost AS BIGINT) AS cost FROM best WHERE id = '{TARGET}'",
        "g9_all_pairs": f"""WITH {TRIP}, every(src, dst, cost) AS (SELECT * FROM (WITH RECURSIVE d(s, id, cost) USING KEY (s, id) AS (
    SELECT id, id, CAST(0 AS DOUBLE) FROM kept
    UNION
    SELECT d.s, e.dst, min(d.cost + e.weight) FROM d JOIN arcs e ON e.src = d.id LEFT JOIN recurring.d old ON old.s = d.s AND old.id = e.dst GROUP BY d.s, e.dst, old.cost HAVING old.cost IS NULL OR min(d.cost + e.weight) < old.cost
  ) SELECT * FROM d)) SELECT src, dst, CAST(cost AS BIGINT) AS cost FROM every""",
        "g8_dfs_order": f"""WITH {TRIP}, adj AS MATERIALIZED (SELECT src, list(dst ORDER BY dst DESC) AS d FROM arcs GROUP BY src), walked AS (SELECT arg_max(seen, n) AS seen FROM (WITH RECURSIVE w(n, stack, seen) AS (
    SELECT 0, ['{ORIGIN}'], CAST([] AS VARCHAR[])
    UNION ALL
    SELECT n + 1, CASE WHEN old THEN stack[1:len(stack) - 1] ELSE list_concat(stack[1:len(stack) - 1], coalesce(d, CAST([] AS VARCHAR[]))) END, CASE WHEN old THEN seen ELSE list_append(seen, stack[-1]) END
    FROM (SELECT w.*, list_contains(w.seen, w.stack[-1]) AS old, a.d FROM w LEFT JOIN adj a ON a.src = w.stack[-1] WHERE len(w.stack) > 0)
  ) SELECT * FROM w)) SELECT CAST(i AS INT) AS place, seen[i] AS id FROM walked, range(1, len(seen) + 1) r(i)""",
        "g11_dfs_path": f"WITH {TRIP}, {_steps('dst')}",
        "g15_greedy_path": f"WITH {TRIP}, goal AS (SELECT lon AS glon, lat AS glat FROM nodes WHERE id = '{TARGET}'), far AS (SELECT id, sqrt((lon - glon) ** 2 + (lat - glat) ** 2) AS far FROM nodes, goal), {_steps('far, dst', 'arcs JOIN far ON far.id = dst')}",
        "g3_spanning_bridges": f"""{comp3}, near AS (SELECT a.id AS a, b.id AS b, least(a.component, b.component) AS ca, greatest(a.component, b.component) AS cb, {dist} AS d FROM placed a JOIN placed b ON a.id < b.id AND a.component <> b.component AND {dist} <= 10000),
best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d, a, b) AS k FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY ca, cb ORDER BY d, a, b) = 1)),
tied(k, c) AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE r(k, c) AS (
    SELECT k, ca FROM best
    UNION
    SELECT r.k, CASE WHEN b.ca = r.c THEN b.cb ELSE b.ca END FROM r JOIN best b ON b.k < r.k AND (b.ca = r.c OR b.cb = r.c)
  ) SELECT * FROM r))
SELECT a AS src, b AS dst, CAST(floor(d) AS BIGINT) AS weight FROM best WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.k = best.k AND t.c = best.cb)""",
        "route_by_traffic": f"""WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)}, {_timed(15, 'arcs')}, {_dijkstra('timed', 'cost')},
paths(path) AS (SELECT path FROM (WITH RECURSIVE p(id, path) AS (
    SELECT '{TARGET}', '{TARGET}'
    UNION ALL
    SELECT e.src, e.src || '>' || p.path FROM p JOIN best now ON now.id = p.id JOIN timed e ON e.dst = p.id JOIN best b ON b.id = e.src WHERE p.id <> '{ORIGIN}' AND abs(b.cost + e.cost - now.cost) < 1e-6
  ) SELECT * FROM p) WHERE id = '{ORIGIN}')
SELECT (SELECT min(path) FROM paths) AS path, CAST(floor(cost) AS BIGINT) AS cost FROM best WHERE id = '{TARGET}'""",
        "j14_path_length": f"WITH {TRIP}, {BFS}, leg AS (SELECT path[i] AS a, path[i + 1] AS b FROM bfs, range(1, len(path)) r(i) WHERE id = '{TARGET}') SELECT CAST(1 AS BIGINT) AS rank, CAST(floor(sum({dist})) AS BIGINT) AS metres FROM leg JOIN nodes a ON a.id = leg.a JOIN nodes b ON b.id = leg.b",
        "j15_path_cost": f"WITH {NODES}, {E2} SELECT src || '>' || dst AS k, weight * 2 AS cost FROM edges",
        "n22_route_text": f"WITH {NODES}, {E2}, {_timed(15)} SELECT src, dst, CAST(floor(cost) AS BIGINT) // 60 || ' min ' || CAST(floor(cost) AS BIGINT) % 60 || ' sec' AS text FROM timed",
        "pipeline_long_series": f"WITH {CLEAN}, {TYPES}, {SITES}, {SCHOOLS}, c AS (SELECT CAST(a.site_no AS BIGINT) AS site, count(*) AS n FROM sites a JOIN schools b ON {dist} <= 5000 GROUP BY ALL), s AS (" + " UNION ALL ".join(f"SELECT NB_SCATS_SITE, date, '{8 + k // 4:02d}:{k % 4 * 15:02d}' AS time, CAST(sum({v}) AS BIGINT) AS Flow FROM clean GROUP BY 1, 2" for k, v in enumerate(VS)) + f") SELECT CAST(s.date AS VARCHAR) AS date, s.time, s.NB_SCATS_SITE, coalesce(t.scat_type, 'Unknown') AS scat_type, CASE strftime(s.date, '%m-%d') {hod} ELSE 'normal' END AS day_type, coalesce(c.n, 0) AS school_count, s.Flow FROM s LEFT JOIN types t ON t.site = s.NB_SCATS_SITE LEFT JOIN c ON c.site = s.NB_SCATS_SITE",
        "u1_paths_of_components": f"""WITH {NODES}, {E3}, {_labels('edges')}, ends AS (SELECT component, min(id) AS origin, max(id) AS target FROM label GROUP BY 1 HAVING count(*) > 1),
far(origin, id, cost) AS (SELECT * FROM (WITH RECURSIVE d(origin, id, cost) USING KEY (origin, id) AS (
    SELECT origin, origin, CAST(0 AS DOUBLE) FROM ends
    UNION
    SELECT d.origin, e.dst, min(d.cost + e.weight) FROM d JOIN edges e ON e.src = d.id LEFT JOIN recurring.d old ON old.origin = d.origin AND old.id = e.dst GROUP BY d.origin, e.dst, old.cost HAVING old.cost IS NULL OR min(d.cost + e.weight) < old.cost
  ) SELECT * FROM d))
SELECT e.component AS graph, e.origin, e.target, CAST(f.cost AS BIGINT) AS cost, true AS arrives FROM ends e JOIN far f ON f.origin = e.origin AND f.id = e.target""",
        "s1_geojson_sites": f"WITH {SITES} SELECT site_no, site_name, site_type, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sites",
        "s2_graph_text": f"WITH {NODES}, {E2} SELECT src, dst, weight, round(lon, 6) AS lon, round(lat, 6) AS lat, '{ORIGIN}' AS origin, '{TARGET}' AS destinations FROM edges JOIN nodes ON id = src",
        "s5_scan_by_encoding": "SELECT event_id, event_type || 'é' AS kind FROM events",
        "s12_costs_in_place": f"WITH {NODES}, {E2}, {_timed(15)} SELECT src, dst, CAST(floor(CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN cost ELSE weight END) AS BIGINT) AS cost FROM timed",
        "n23_route_table": f"""WITH {NODES}, {E3}, {_chunk('edges', ORIGIN, TARGET, 0.1)}, {_timed(15, 'arcs')}, {_simple_paths('timed', 'cost')},
f AS (SELECT row_number() OVER (ORDER BY cost, len(path), path)::BIGINT AS rank, path, cost FROM simple QUALIFY rank <= 5), leg AS (SELECT rank, path[i] AS a, path[i + 1] AS b FROM f, range(1, len(path)) r(i)),
m AS (SELECT rank, sum({dist}) AS metres FROM leg JOIN nodes a ON a.id = leg.a JOIN nodes b ON b.id = leg.b GROUP BY rank)
SELECT rank, array_to_string(path, ' → ') AS route, CAST(floor(cost) AS BIGINT) // 60 || ' min ' || CAST(floor(cost) AS BIGINT) % 60 || ' sec' AS time, round(metres / 1000, 2) AS km FROM f JOIN m USING (rank)""",
        "k3_top_paths": f"WITH {NODES}, {E3}, t AS (SELECT a.src || '>' || b.dst AS path, min(a.weight + b.weight) AS cost FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = '{ORIGIN}' AND b.dst <> '{ORIGIN}' GROUP BY 1) SELECT row_number() OVER (ORDER BY cost, path) AS rank, path, CAST(cost AS BIGINT) AS cost FROM t QUALIFY rank <= 10",
        "o3_components_by_size": f"WITH {NODES}, {E2}, {_labels('edges')}, c AS (SELECT component, count(*) AS size FROM label GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, component) AS place, component, size FROM c",
        "o4_bridges_by_distance": f"WITH {NODES}, {E2}, {_labels('edges')}, p AS (SELECT a.id AS a, b.id AS b, CAST(floor({dist}) AS BIGINT) AS metres FROM (SELECT * FROM nodes JOIN label USING (id)) a JOIN (SELECT * FROM nodes JOIN label USING (id)) b ON a.id < b.id AND a.component <> b.component WHERE {dist} <= 3000) SELECT row_number() OVER (ORDER BY metres, a, b) AS place, a, b, metres FROM p",
        "o5_neighbours_in_text_order": f"WITH {NODES}, {E3} SELECT src AS id, string_agg(dst, '>' ORDER BY dst) AS neighbours FROM edges GROUP BY src",
        "g4c_star": f"WITH {NODES}, {E2}, {_labels('edges')}, h AS (SELECT DISTINCT component AS id FROM label), f AS (SELECT min(id) AS id FROM h) SELECT a.id AS src, b.id AS dst, CAST(floor({dist}) AS BIGINT) AS weight FROM h JOIN nodes a USING (id), f JOIN nodes b ON b.id = f.id WHERE a.id <> b.id",
        "g4d_fixed_pairs": f"WITH {NODES}, w AS (SELECT CAST(s_suppkey AS VARCHAR) AS src, CAST(s_suppkey + 1 AS VARCHAR) AS dst FROM supplier), m AS (SELECT src, dst, CAST(floor({dist}) AS BIGINT) AS weight FROM w JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst) SELECT * FROM m UNION SELECT dst, src, weight FROM m",
        "f6_region_holidays": "SELECT DISTINCT strftime(ts, '%m-%d') AS md, 'day ' || dayofyear(ts) AS day_type FROM events WHERE event_id % 11 <> 0 AND dayofyear(ts) % 3 IN (0, 1)",
        "x2_union_of_chunks": f"WITH {WIDE} SELECT NB_SCATS_SITE, count(*) * 4 AS n, CAST(sum(coalesce(V32, 0) + coalesce(V33, 0) + coalesce(V34, 0) + coalesce(V35, 0)) AS BIGINT) AS flow FROM wide GROUP BY 1",
        "s4_typed_csv": "SELECT event_id, event_type, value, 'event_id int, event_type string, value double' AS kinds FROM events",
        "s7_year_folders": "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
        "n24_stage_names": "SELECT 'featured_' || strftime(ts, '%Y%m%d') || '.csv' AS name, count(*) AS n FROM events GROUP BY 1",
        "n25_site_texts": "SELECT CAST(c_custkey AS VARCHAR) AS site_no, 'Site No: ' || c_custkey || '<br>Name: ' || c_name || '<br>Type: ' || c_mktsegment || CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN '' ELSE '<br>Comments: ' || CAST(floor(c_acctbal) AS BIGINT) END AS text FROM customer",
        "n29_reversed_parts": f"WITH {NODES}, {E3}, a AS (SELECT src AS id, list(dst ORDER BY dst) AS p FROM edges GROUP BY src HAVING count(*) >= 4) SELECT id, array_to_string([p[1]] || list_reverse(p[2:len(p) - 1]) || [p[-1]], '>') AS path FROM a",
        "w7_weighted_draws": """WITH w AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS weight FROM customer WHERE floor(c_acctbal) > 0), s AS (SELECT c_custkey, weight, CAST(sum(weight) OVER (ORDER BY c_custkey) AS BIGINT) AS upto FROM w),
e AS (SELECT event_id, CAST((SELECT sum(weight) FROM w) AS HUGEINT) * ((event_id * 7919 + 104729) % 1000003) // 1000003 AS point FROM events)
SELECT event_id, c_custkey FROM e JOIN s ON point < upto AND point >= upto - weight""",
        "m7_four_steps": f"""WITH b AS (SELECT user_id AS site, ts, event_id, value FROM events WHERE ts < TIMESTAMP '{BEFORE}'), u AS (SELECT hour(ts) AS h, avg(value) AS m FROM b GROUP BY 1),
r AS (SELECT site, ts, event_id, value - m AS r FROM b JOIN u ON h = hour(ts)),
l AS (SELECT r, lag(r, 1) OVER w AS a, lag(r, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY site ORDER BY ts, event_id)),
q AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(r * a) AS ra, sum(r * b) AS rb FROM l WHERE b IS NOT NULL),
f AS (SELECT (ra * bb - rb * ab) / (aa * bb - ab * ab) AS wa, (rb * aa - ra * ab) / (aa * bb - ab * ab) AS wb FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS age FROM r),
t AS (SELECT site, max(CASE WHEN age = 1 THEN r END) AS r1, max(CASE WHEN age = 2 THEN r END) AS r2, max(ts) AS ts FROM n WHERE age <= 2 GROUP BY site HAVING count(*) = 2),
y1 AS (SELECT site, ts, wa, wb, r1, wa * r1 + wb * r2 AS p1 FROM t, f), y2 AS (SELECT *, wa * p1 + wb * r1 AS p2 FROM y1), y3 AS (SELECT *, wa * p2 + wb * p1 AS p3 FROM y2), y4 AS (SELECT *, wa * p3 + wb * p2 AS p4 FROM y3),
k AS (SELECT c_custkey AS site, step, y4.ts + step * INTERVAL 15 MINUTE AS due, [p1, p2, p3, p4][step] AS p FROM customer CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS step) LEFT JOIN y4 ON y4.site = c_custkey)
SELECT site, CAST(step AS BIGINT) AS step, strftime(due, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(p + coalesce(m, (SELECT avg(value) FROM b)), 500.0), 4) AS flow FROM k LEFT JOIN u ON u.h = hour(k.due)""",
        "t1_stream_slot_counts": "SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot_start, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY ALL",
        "t2_stream_last_values": "SELECT user_id AS site, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, event_id, value FROM events QUALIFY age <= 24",
        "t1_slot_counts": "SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot_start, count(*) AS n FROM events GROUP BY ALL",
    }
