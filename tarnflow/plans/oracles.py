"""SQL for the registered queries, on the same tables."""

from __future__ import annotations

from ..sources.derived import SQL

_PREMERGE = "premerge AS (SELECT terminal, unit, area, up_area FROM basin JOIN units ON unit = id)"
_SIDES = """sides AS (SELECT {key}, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM {cells} UNION ALL SELECT {key}, x + 1, y, x + 1, y + 1 FROM {cells}
  UNION ALL SELECT {key}, x + 1, y + 1, x, y + 1 FROM {cells} UNION ALL SELECT {key}, x, y + 1, x, y FROM {cells}),
outline AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides r WHERE r.{key} = s.{key} AND r.x1 = s.x2 AND r.y1 = s.y2 AND r.x2 = s.x1 AND r.y2 = s.y1))"""
_BASIN_CELLS = "bcells AS (SELECT terminal, x, y FROM basin JOIN units ON unit = id)," + _SIDES.format(key="terminal", cells="bcells")
_TOTALS = "totals AS (SELECT terminal, count(*) AS units, CAST(sum(area) AS BIGINT) AS area, CAST(max(depth) AS BIGINT) AS depth FROM basin JOIN units ON unit = id GROUP BY terminal)"
_AREAS = _TOTALS + ", areas AS (SELECT outlet_id, unit_id, reason, units, area, depth FROM resolved JOIN totals ON unit_id = terminal)"
_TRI = """tri AS (SELECT s_suppkey AS polygon, unnest([{'a': s % 7, 'b': s % 5, 'c': s % 7 + 8 + s % 3, 'd': s % 5 + 1}, {'a': s % 7 + 8 + s % 3, 'b': s % 5 + 1, 'c': s % 7 + 2, 'd': s % 5 + 9 + s % 4},
  {'a': s % 7 + 2, 'b': s % 5 + 9 + s % 4, 'c': s % 7, 'd': s % 5}]) AS e FROM (SELECT s_suppkey, s_suppkey AS s FROM supplier)),
te AS (SELECT polygon, CAST(e.a AS DOUBLE) AS x1, CAST(e.b AS DOUBLE) AS y1, CAST(e.c AS DOUBLE) AS x2, CAST(e.d AS DOUBLE) AS y2 FROM tri),
scan AS (SELECT polygon, r AS "row", x1 + (r + 0.5::DOUBLE - y1) / (y2 - y1) * (x2 - x1) AS x FROM te, (SELECT unnest(range(0, 40)) AS r) WHERE least(y1, y2) < r + 0.5::DOUBLE AND r + 0.5::DOUBLE <= greatest(y1, y2)),
pairs AS (SELECT polygon, "row", list(x ORDER BY x) AS xs FROM scan GROUP BY ALL),
inside AS (SELECT polygon, "row", unnest(range(CAST(ceil(xs[1] - 0.5) AS BIGINT), CAST(ceil(xs[2] - 0.5) AS BIGINT))) AS col FROM pairs)"""

_REFINED = _TRI + """, mcells AS (SELECT polygon, i.row, i.col, code, acc FROM inside i JOIN cells c ON i.row = c.row AND i.col = c.col),
o AS (SELECT s_suppkey AS polygon, s_suppkey % 5 + 3.25::DOUBLE AS pr, s_suppkey % 7 + 3.5::DOUBLE AS pc FROM supplier),
pours AS (SELECT polygon, "row", col FROM (SELECT m.*, row_number() OVER (PARTITION BY polygon ORDER BY (m.row + 0.5::DOUBLE - pr) * (m.row + 0.5::DOUBLE - pr) + (m.col + 0.5::DOUBLE - pc) * (m.col + 0.5::DOUBLE - pc), acc DESC, m.row, m.col) AS p
  FROM mcells m JOIN o USING (polygon) WHERE acc >= 100000) WHERE p = 1),
fl AS (SELECT polygon, "row", col, "row" + CASE code WHEN 1 THEN 0 ELSE 1 END AS nr, col + CASE code WHEN 4 THEN 0 ELSE 1 END AS nc FROM mcells WHERE code IS NOT NULL),
rf AS (SELECT polygon, "row", col FROM pours UNION SELECT rf.polygon, fl.row, fl.col FROM rf JOIN fl ON fl.polygon = rf.polygon AND fl.nr = rf.row AND fl.nc = rf.col)"""


def _with(extra: str, select: str) -> str:
    return SQL + ("," + extra if extra else "") + select


ORACLES = {
    "select_level": _with("", "SELECT max(level) AS level FROM leveled"),
    "levels": _with("", "SELECT level, count(*) AS units FROM leveled GROUP BY level"),
    "edge_list": _with("", "SELECT id, pos, up FROM dag_edges"),
    "bbox_scan": _with("", "SELECT id, area FROM units, grid WHERE minx <= w // 2 * 100 AND maxx >= w // 4 * 100 AND miny <= w // 2 * 100 AND maxy >= w // 4 * 100"),
    "id_lookup": _with("", "SELECT id, level, area, up_area FROM units WHERE id IN (SELECT unit_id FROM resolved)"),
    "search_bbox": _with("b AS (SELECT outlet_id, gx / 1000.0::DOUBLE AS lon, gy / 1000.0::DOUBLE AS lat FROM outlets), c AS (SELECT *, 1000.0::DOUBLE / 110540 AS u, 1000.0::DOUBLE / (111320 * greatest(abs(cos(radians(lat))), 1e-10)) AS a FROM b)",
        "SELECT outlet_id, round(CAST(CAST(greatest(lon - a, -180) AS FLOAT) AS DOUBLE), 4) AS minx, round(CAST(CAST(greatest(lat - u, -90) AS FLOAT) AS DOUBLE), 4) AS miny, round(CAST(CAST(least(lon + a, 180) AS FLOAT) AS DOUBLE), 4) AS maxx, round(CAST(CAST(least(lat + u, 90) AS FLOAT) AS DOUBLE), 4) AS maxy FROM c"),
    "snap_candidates": _with("", "SELECT outlet_id, count(*) AS candidates, min(d2) AS nearest_d2 FROM hits GROUP BY outlet_id"),
    "snap_weight_first": _with("", "SELECT outlet_id, snap_id, unit_id, d2, candidates FROM (SELECT *, count(*) OVER (PARTITION BY outlet_id) AS candidates, row_number() OVER (PARTITION BY outlet_id ORDER BY weight DESC, mainstem DESC, d2, snap_id) AS p FROM hits) WHERE p = 1"),
    "snap_distance_first": _with("", "SELECT outlet_id, snap_id, unit_id, d2, band FROM (SELECT *, count(*) OVER (PARTITION BY outlet_id) AS band, row_number() OVER (PARTITION BY outlet_id ORDER BY weight DESC, mainstem DESC, snap_id) AS p FROM (SELECT *, min(d2) OVER (PARTITION BY outlet_id) AS least FROM hits) WHERE sqrt(d2) <= sqrt(least) + 1) WHERE p = 1"),
    "pip_strict": _with("", "SELECT outlet_id, id AS unit_id FROM pip WHERE inside"),
    "pip_boundary_tiebreak": _with("", "SELECT outlet_id, unit_id, candidates, strict, reason FROM resolved"),
    "resolve_status": _with("", "SELECT o.outlet_id, unit_id, CASE WHEN unit_id IS NULL THEN 'OutsideAllCatchments' ELSE 'Resolved' END AS status FROM outlets o LEFT JOIN resolved r ON o.outlet_id = r.outlet_id"),
    "upstream_tree": _with("", "SELECT terminal, unit, depth FROM basin"),
    "upstream_dag": _with("", "SELECT terminal, unit FROM basin_dag"),
    "bfs_rank": _with("", "SELECT terminal, unit, depth, row_number() OVER (PARTITION BY terminal ORDER BY depth, unit) - 1 AS rank FROM basin"),
    "same_level_violation": _with("e AS (SELECT id, up FROM tree_edges UNION ALL SELECT parent_id, id FROM leveled WHERE level = 1 AND parent_id % 11 = 0)", "SELECT e.id, up, a.level, b.level AS up_level FROM e JOIN leveled a ON e.id = a.id JOIN leveled b ON up = b.id WHERE a.level <> b.level"),
    "pre_merge": _with(_PREMERGE, "SELECT * FROM premerge"),
    "terminal_override": _with(_PREMERGE, "SELECT terminal, CAST(sum(CASE WHEN unit = terminal AND terminal % 3 = 0 THEN area // 2 ELSE area END) AS BIGINT) AS area FROM premerge GROUP BY terminal"),
    "dissolve_boundary": _with(_BASIN_CELLS, "SELECT terminal, count(*) AS edges FROM outline GROUP BY terminal"),
    "dissolve_planar_area": _with(_BASIN_CELLS, "SELECT terminal, CAST(sum(x1 * y2 - x2 * y1) // 2 AS BIGINT) AS planar_area FROM outline GROUP BY terminal"),
    "delineate_area": _with(_AREAS, "SELECT * FROM areas"),
    "morton": _with("q AS (SELECT id, CAST(floor((minx / 1000.0::DOUBLE + 180) / 360 * 65535 + 0.5) AS BIGINT) AS x, CAST(floor((miny / 1000.0::DOUBLE + 180) / 360 * 65535 + 0.5) AS BIGINT) AS y FROM units)",
        "SELECT id, CAST(list_sum(list_transform(range(0, 16), lambda i: (((x >> CAST(i AS INTEGER)) & 1) << CAST(2 * i AS INTEGER)) + (((y >> CAST(i AS INTEGER)) & 1) << CAST(2 * i + 1 AS INTEGER)))) AS BIGINT) AS morton FROM q"),
    "hilbert": _with("""q AS (SELECT id, CAST(floor((minx / 1000.0::DOUBLE + 180) / 360 * 65535 + 0.5) AS BIGINT) AS x, CAST(floor((miny / 1000.0::DOUBLE + 90) / 180 * 65535 + 0.5) AS BIGINT) AS y FROM units),
hc AS (SELECT id, 32768 AS h, x, y, CAST(0 AS BIGINT) AS d FROM q UNION ALL SELECT id, h // 2, CASE WHEN x < h AND y < h THEN y WHEN x < h THEN x WHEN y >= h THEN x - h ELSE h - 1 - y END,
  CASE WHEN x < h AND y < h THEN x WHEN x < h OR y >= h THEN y - h ELSE h - 1 - (x - h) END, d + CAST(h AS BIGINT) * h * CASE WHEN x < h AND y < h THEN 0 WHEN x < h THEN 1 WHEN y >= h THEN 2 ELSE 3 END FROM hc WHERE h > 0)""", "SELECT id, d AS hilbert FROM hc WHERE h = 0"),
    "d8_decode": "SELECT o_orderkey AS cell, [0, 1, 1, 1, 0, -1, -1, -1, NULL][1 + k] AS esri_row, [1, 1, 0, -1, -1, -1, 0, 1, NULL][1 + k] AS esri_col, [NULL, 0, -1, -1, -1, 0, 1, 1, 1][1 + k] AS taudem_row, [NULL, 1, 1, 0, -1, -1, -1, 0, 1][1 + k] AS taudem_col FROM (SELECT o_orderkey, CAST(o_custkey % 9 AS INTEGER) AS k FROM orders)",
    "pixel_coord": _with("", "SELECT outlet_id, greatest(CAST(floor(gx / 25) AS BIGINT), 0) AS col, greatest(CAST(floor((5000 - gy) / 25) AS BIGINT), 0) AS \"row\" FROM outlets"),
    "rasterize": "WITH " + _TRI + "SELECT polygon, \"row\", col FROM inside",
    "mask": _with(_TRI, "SELECT c.row, c.col, CASE WHEN i.col IS NOT NULL THEN code END AS code, CASE WHEN i.col IS NOT NULL THEN acc END AS acc FROM cells c LEFT JOIN (SELECT DISTINCT \"row\", col FROM inside) i ON c.row = i.row AND c.col = i.col"),
    "snap_pour_point": _with("o AS (SELECT outlet_id, gy % 200 / 10.0::DOUBLE AS pr, gx % 900 / 10.0::DOUBLE AS pc FROM outlets), m AS (SELECT outlet_id, c.row, c.col, acc, (c.row + 0.5::DOUBLE - pr) * (c.row + 0.5::DOUBLE - pr) + (c.col + 0.5::DOUBLE - pc) * (c.col + 0.5::DOUBLE - pc) AS d2 FROM o JOIN cells c ON abs(c.row - CAST(floor(pr) AS BIGINT)) <= 3 AND abs(c.col - CAST(floor(pc) AS BIGINT)) <= 3 WHERE acc >= 300000)",
        "SELECT outlet_id, \"row\", col, acc, d2 FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY d2, acc DESC, \"row\", col) AS p FROM m) WHERE p = 1"),
    "trace_upstream": _with("""f AS (SELECT "row", col, "row" + CASE code WHEN 1 THEN 0 ELSE 1 END AS nr, col + CASE code WHEN 4 THEN 0 ELSE 1 END AS nc FROM cells WHERE code IS NOT NULL),
tr AS (SELECT "row" AS pour_row, col AS pour_col, "row", col FROM cells WHERE "row" % 5 = 4 AND col % 25 = 20 UNION SELECT pour_row, pour_col, f.row, f.col FROM tr JOIN f ON f.nr = tr.row AND f.nc = tr.col)""", "SELECT * FROM tr"),
    "polygonize_edges": "WITH " + _TRI + ", pc AS (SELECT polygon, col AS x, \"row\" AS y FROM inside)," + _SIDES.format(key="polygon", cells="pc") + "SELECT polygon, count(*) AS boundary_edges, CAST(sum(x1 * y2 - x2 * y1) // 2 AS BIGINT) AS cells FROM outline GROUP BY polygon",
    "d8_select": _with("""tiles AS (SELECT n_nationkey AS tile_id, n_nationkey % 5 * 500 AS tx, n_nationkey // 5 * 500 AS ty, n_nationkey % 5 * 500 + 500 + CASE WHEN n_nationkey % 4 = 0 THEN 100 ELSE 0 END AS ux, n_nationkey // 5 * 500 + 500 AS uy FROM nation),
bx AS (SELECT id, minx, miny, maxx + CASE WHEN id % 6 = 0 THEN 100 ELSE 0 END AS maxx, maxy FROM units),
ct AS (SELECT id, count(*) FILTER (tx <= minx AND maxx <= ux AND ty <= miny AND maxy <= uy) AS n, count(tile_id) AS meeting, min(tile_id) FILTER (tx <= minx AND maxx <= ux AND ty <= miny AND maxy <= uy) AS tile_id FROM bx LEFT JOIN tiles ON tx <= maxx AND minx <= ux AND ty <= maxy AND miny <= uy GROUP BY id)""",
        "SELECT id, CASE WHEN n = 1 THEN 'Selected' WHEN n > 1 THEN 'Ambiguous' WHEN meeting > 1 THEN 'Spans' ELSE 'NoCovering' END AS status, CASE WHEN n = 1 THEN tile_id END AS tile_id FROM ct"),
    "validate_counts": "SELECT count(*) AS units, count(*) AS graph_rows FROM part",
    "validate_membership": "SELECT p_partkey + 1 AS id, CASE WHEN (p_partkey + 1) % 17 <> 3 THEN 'NoUnit' ELSE 'NoGraphRow' END AS problem FROM part WHERE ((p_partkey + 1) % 17 <> 3) <> ((p_partkey + 1) % 13 <> 5)",
    "validate_levels": "SELECT p_partkey + 1 AS id, 0 AS graph_level, 1 AS unit_level FROM part WHERE (p_partkey + 1) % 19 = 0",
    "validate_dangling": _with("", "SELECT id, up FROM dag_edges WHERE up % 23 = 7"),
    "validate_snaps": _with("", "SELECT snap_id, unit_id, CASE WHEN unit_id % 29 = 1 THEN 'MissingUnit' ELSE 'WrongLevel' END AS problem FROM snaps WHERE unit_id % 29 = 1 OR unit_id % 31 = 2"),
    "basin_id_check": r"SELECT id, basin_id, length(basin_id) BETWEEN 1 AND 128 AND regexp_full_match(basin_id, '[A-Za-z0-9._-]+') AND NOT ends_with(basin_id, '.') AND NOT regexp_full_match(upper(basin_id), 'CON|PRN|AUX|NUL|(COM|LPT)[1-9]') AS valid FROM (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN 'com' || c_custkey % 12 WHEN 2 THEN c_custkey || '.' WHEN 3 THEN 'basin ' || c_custkey WHEN 4 THEN 'a_b-' || c_custkey WHEN 5 THEN repeat('x', c_custkey % 200) ELSE '..' END AS basin_id FROM customer)",
    "default_label": "SELECT s_suppkey AS id, s_name || '/v' || s_nationkey || '/' || ['d8-best-effort', 'd8-required', 'no-refine'][1 + CAST(s_suppkey % 3 AS INTEGER)] AS label FROM supplier",
    "row_group_plan": "SELECT c_mktsegment, row_group, n // g + CASE WHEN row_group < n % g THEN 1 ELSE 0 END AS rows FROM (SELECT c_mktsegment, n, g, unnest(range(0, g)) AS row_group FROM (SELECT c_mktsegment, count(*) * 37 AS n, CASE WHEN count(*) * 37 < 4096 THEN 1 ELSE CAST(ceil(count(*) * 37 / 8192) AS BIGINT) END AS g FROM customer GROUP BY 1))",
    "duplicate_rows": "SELECT l_orderkey AS basin_id, l_linenumber AS delineation, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "dataset_bbox": _with("", "SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM units"),
    "envelope": _with("", "SELECT count(*) AS total, count(unit_id) AS succeeded, count(*) - count(unit_id) AS failed FROM outlets o LEFT JOIN resolved r ON o.outlet_id = r.outlet_id"),
    "basin_sizes_by_arrival": _with(_AREAS, "SELECT date_trunc('hour', ts) AS hour, count(*) AS arrivals, CAST(sum(area) AS BIGINT) AS area FROM events JOIN areas ON user_id = outlet_id GROUP BY 1"),
    "largest_basins": _with(_AREAS, "SELECT nation, outlet_id, units, area FROM (SELECT c_nationkey AS nation, outlet_id, units, area, row_number() OVER (PARTITION BY c_nationkey ORDER BY area DESC, outlet_id) AS p FROM areas JOIN customer ON outlet_id = c_custkey) WHERE p = 1"),
    "d8_encode": "SELECT o_orderkey AS cell, CASE WHEN abs(r) <= 1 AND abs(c) <= 1 THEN [32, 64, 128, 16, NULL, 1, 8, 4, 2][CAST(3 * r + c + 5 AS INTEGER)] END AS esri, CASE WHEN abs(r) <= 1 AND abs(c) <= 1 THEN [4, 3, 2, 5, NULL, 1, 6, 7, 8][CAST(3 * r + c + 5 AS INTEGER)] END AS taudem, [16, 32, 64, 128, 1, 2, 4, 8, NULL][CAST(o_custkey % 9 + 1 AS INTEGER)] AS back FROM (SELECT *, o_orderkey % 5 - 2 AS r, o_orderkey // 5 % 5 - 2 AS c FROM orders)",
    "pixel_area": "SELECT s_suppkey AS id, (s_suppkey % 9 + 1) * (s_suppkey % 5 + 1) / 32.0::DOUBLE AS area FROM supplier",
    "cell_lookup": _with("", "SELECT outlet_id, gy % 40 AS \"row\", gx % 120 AS col, code, acc, CASE WHEN c.row IS NULL THEN 'OutOfBounds' WHEN code IS NULL THEN 'NoData' ELSE 'Data' END AS state FROM outlets LEFT JOIN cells c ON c.row = gy % 40 AND c.col = gx % 120"),
    "refine_terminals": _with(_REFINED, "SELECT o.polygon, CASE WHEN e.polygon IS NULL THEN 'EmptyMask' WHEN p.polygon IS NULL THEN 'NoStreamCell' ELSE 'Refined' END AS status, p.row AS pour_row, p.col AS pour_col, coalesce(n, 0) AS cells FROM o LEFT JOIN (SELECT DISTINCT polygon FROM mcells) e USING (polygon) LEFT JOIN pours p ON p.polygon = o.polygon LEFT JOIN (SELECT polygon, count(*) AS n FROM rf GROUP BY 1) k ON k.polygon = o.polygon"),
    "refined_outline": _with(_REFINED + ", pc AS (SELECT polygon, col AS x, \"row\" AS y FROM rf)," + _SIDES.format(key="polygon", cells="pc"), "SELECT polygon, count(*) AS boundary_edges, CAST(sum(x1 * y2 - x2 * y1) // 2 AS BIGINT) AS cells FROM outline GROUP BY polygon"),
    "refinement_gate": _with("", "SELECT id, CASE WHEN id % 3 = 2 THEN 'Disabled' WHEN id % 4 <> 0 AND id % 5 <> 0 THEN 'Refine' WHEN id % 3 = 1 THEN 'Error' WHEN id % 4 = 0 THEN 'NoD8AuxDeclared' ELSE 'NoRasterSource' END AS gate FROM units"),
    "self_intersections": """WITH k AS (SELECT o_orderkey AS ring, o_orderkey % 7 AS a, o_orderkey % 5 AS b, o_orderkey % 3 AS c, o_orderkey % 4 AS d, o_orderkey % 2 AS e FROM orders),
pt AS (SELECT ring, a AS ax, b AS ay, a + 6 AS bx, b + 1 + c AS by_, a + d * 2 AS cx, b + 5 AS cy, a + 5 - c * 3 AS dx, b + 6 + e AS dy FROM k),
sd AS (SELECT ring, 0 AS seq, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM pt UNION ALL SELECT ring, 1, bx, by_, cx, cy FROM pt UNION ALL SELECT ring, 2, cx, cy, dx, dy FROM pt UNION ALL SELECT ring, 3, dx, dy, ax, ay FROM pt)
SELECT s.ring, s.seq, t.seq AS other FROM sd s JOIN sd t ON s.ring = t.ring AND s.seq < t.seq
WHERE sign((s.x2 - s.x1) * (t.y1 - s.y1) - (s.y2 - s.y1) * (t.x1 - s.x1)) * sign((s.x2 - s.x1) * (t.y2 - s.y1) - (s.y2 - s.y1) * (t.x2 - s.x1)) < 0
  AND sign((t.x2 - t.x1) * (s.y1 - t.y1) - (t.y2 - t.y1) * (s.x1 - t.x1)) * sign((t.x2 - t.x1) * (s.y2 - t.y1) - (t.y2 - t.y1) * (s.x2 - t.x1)) < 0""",
    "first_origins": "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS first_origin, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "largest_part": "WITH " + _TRI + ", ar AS (SELECT polygon, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM te GROUP BY 1) SELECT nation, polygon, area FROM (SELECT s_nationkey AS nation, polygon, area, row_number() OVER (PARTITION BY s_nationkey ORDER BY area DESC, polygon DESC) AS p FROM ar JOIN supplier ON s_suppkey = polygon) WHERE p = 1",
    "same_units": _with("", "SELECT terminal, bool_and(a.unit IS NOT NULL AND b.unit IS NOT NULL) AS same FROM (SELECT DISTINCT terminal, unit FROM basin) a FULL JOIN (SELECT DISTINCT terminal, unit FROM basin_dag) b USING (terminal, unit) GROUP BY terminal"),
    "tree_totals": _with("every AS (SELECT id AS terminal, id AS unit, 0 AS depth FROM units UNION ALL SELECT terminal, up, depth + 1 FROM every JOIN tree_edges ON unit = id)", "SELECT terminal AS id, count(*) AS units, CAST(sum(area) AS BIGINT) AS total, CAST(max(depth) AS BIGINT) AS depth FROM every JOIN units ON unit = units.id GROUP BY terminal"),
    "river_totals": _with("", "SELECT id, count(*) OVER w AS units, CAST(sum(area) OVER w AS BIGINT) AS total, n - id AS depth FROM units, grid WINDOW w AS (ORDER BY id DESC)"),
}
