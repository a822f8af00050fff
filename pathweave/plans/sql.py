"""DuckDB SQL for the registered queries, from shared pieces."""

from __future__ import annotations

R = "6371008.8"


def hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (lon a, lat b) and (lon c, lat d)."""
    return f"(2 * {R} * asin(least(1.0, sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - ({a})) / 2), 2)))))"


def lon(i: str) -> str:
    return f"(-111.95 + ({i}) % 40 * 0.00012::double)"


def lat(i: str) -> str:
    return f"(33.40 + ({i}) // 40 * 0.00012::double)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({c} - ({a}))) * cos(radians({d}))"
    x = f"(cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c} - ({a}))))"
    deg = f"(degrees(atan2({y}, {x})) + 360)"
    return f"({deg} - 360 * floor({deg} / 360))"


NODE = f"n AS (SELECT c_custkey AS id, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat, c_custkey % 17 = 3 AS crossing FROM customer)"
EDGE = f"""
e0 AS (SELECT c_custkey AS u, c_custkey + 1 AS v, 0 AS k, * FROM customer WHERE c_custkey % 40 < 39 UNION ALL SELECT c_custkey, c_custkey + 40, 1, * FROM customer),
e1 AS (SELECT *, u * 2 + k AS id, {hav(lon('u'), lat('u'), lon('v'), lat('v'))} AS m0 FROM e0 WHERE v IN (SELECT c_custkey FROM customer)),
e AS (SELECT id, u, v, floor(m0 * 100) / 100 AS m, m0, c_mktsegment AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'paved' WHEN 'BUILDING' THEN 'concrete' WHEN 'FURNITURE' THEN 'gravel' WHEN 'HOUSEHOLD' THEN 'grass' ELSE 'unknown' END AS surface,
  c_acctbal < 0 AS stairs, CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accessible, (u * 7) % 100 / 100.0::double AS shade,
  CASE WHEN c_acctbal < 0 THEN 'steps' WHEN u % 17 = 3 AND k = 0 THEN 'crossing' ELSE 'path' END AS type FROM e1)
"""
COUNTS = "cnt AS (SELECT count(*) AS n FROM customer), scnt AS (SELECT count(*) AS ns FROM supplier)"
BUILDING = f"""
{COUNTS},
b AS (SELECT s_suppkey AS id, s_suppkey % 29 <> 0 AS in_area, floor(s_acctbal)::bigint AS gsf,
  CASE WHEN s_suppkey % 23 = 0 THEN []::bigint[] WHEN s_suppkey % 31 = 0 THEN [n + s_suppkey] ELSE [(s_suppkey * 15) % n, (s_suppkey * 15 + 7) % n] END AS doors FROM supplier, cnt)
"""
REQUEST = """
rq0 AS (SELECT f.s_suppkey AS from_id, t.s_suppkey AS to_id FROM supplier f, supplier t, scnt WHERE (f.s_suppkey * 101 + t.s_suppkey) % greatest(1, ns // 100) = 0
  UNION ALL SELECT 1, ns + 1 FROM scnt),
rq AS (SELECT from_id * (ns + 2) + to_id AS request, from_id, to_id FROM rq0, scnt)
"""
FOOTPRINT = f"""
fp0 AS (SELECT p_partkey AS footprint_id, p_type, p_size, {lon('(p_partkey * 7) % n')} + 0.00003 AS x, {lat('(p_partkey * 7) % n')} + 0.00004 AS y, 0.00002 + p_size * 0.000002 AS h FROM part, cnt),
fp AS (SELECT *, 'S' || (footprint_id % 50) AS code, x - h AS x0, x + h AS x1, y - h AS y0, y + h AS y1 FROM fp0)
"""


def factor(s: str) -> str:
    return f"CASE {s} WHEN 'paved' THEN 1.0 WHEN 'concrete' THEN 1.0 WHEN 'asphalt' THEN 1.0 WHEN 'gravel' THEN 0.9 WHEN 'grass' THEN 0.85 WHEN 'sand' THEN 0.7 ELSE 0.95 END"


def arcs(accessible: bool = False, shade_weight: float = 0.0, heat: float = 0.0, avoid: bool = False) -> str:
    price = f"((m / (1.35 * {factor('surface')}) + CASE WHEN stairs THEN 12.0 ELSE 0.0 END + CASE WHEN to_ % 17 = 3 THEN 20.0 ELSE 0.0 END) * (1 + {shade_weight} * (1 - shade) * {heat}) * CASE WHEN {str(avoid).lower()} AND stairs THEN 4.0 ELSE 1.0 END)::double"
    where = "WHERE NOT stairs AND coalesce(accessible, true)" if accessible else ""
    return f"arcs AS MATERIALIZED (SELECT from_ AS u, to_ AS v, {price} AS m FROM (SELECT u AS from_, v AS to_, * FROM e UNION ALL SELECT v, u, * FROM e) {where})"


def searches(name: str = "t", arcs_name: str = "arcs") -> str:
    """Cost from every building's doors to every node, by (building, node)."""
    return f"""{name}(b, k, d) USING KEY (b, k) AS (
  SELECT id, unnest(doors), 0.0::double FROM b
  UNION ALL
  SELECT {name}.b, a.v, min({name}.d + a.m) FROM {name} JOIN {arcs_name} a ON a.u = {name}.k
  LEFT JOIN recurring.{name} p ON p.b = {name}.b AND p.k = a.v
  WHERE p.k IS NULL OR {name}.d + a.m < p.d - 1e-9 GROUP BY {name}.b, a.v)"""


def od(pieces: str, column: str = "cost") -> str:
    return f"""
WITH RECURSIVE {EDGE}, {BUILDING}, {REQUEST}, {pieces}, {searches()},
ends AS (SELECT id, unnest(doors) AS k FROM b),
c AS (SELECT rq.request, min(t.d) AS d FROM rq JOIN b f ON f.id = rq.from_id JOIN ends x ON x.id = rq.to_id JOIN b g ON g.id = rq.to_id JOIN t ON t.b = rq.from_id AND t.k = x.k
  WHERE rq.from_id <> rq.to_id AND f.in_area AND g.in_area GROUP BY 1)
SELECT rq.request, round(c.d, 3) AS {column} FROM rq LEFT JOIN c USING (request)"""


STATUS = f"""
WITH RECURSIVE {EDGE}, {BUILDING}, {REQUEST}, {arcs()}, {arcs(True, avoid=True).replace('arcs AS', 'arcs2 AS')}, {searches()}, {searches('t2', 'arcs2')},
ends AS (SELECT id, unnest(doors) AS k FROM b),
c AS (SELECT rq.request, count(t.k) AS any_way, count(t2.k) AS good_way FROM rq JOIN ends x ON x.id = rq.to_id LEFT JOIN t ON t.b = rq.from_id AND t.k = x.k LEFT JOIN t2 ON t2.b = rq.from_id AND t2.k = x.k GROUP BY 1)
SELECT rq.request, CASE WHEN f.id IS NULL OR g.id IS NULL THEN 'unknown_building' WHEN f.id = g.id THEN 'same_building' WHEN NOT f.in_area OR NOT g.in_area THEN 'out_of_service_area'
  WHEN len(f.doors) = 0 OR len(g.doors) = 0 THEN 'no_entrance' WHEN coalesce(good_way, 0) > 0 THEN 'ok' WHEN coalesce(any_way, 0) > 0 THEN 'no_accessible_route' ELSE 'disconnected' END AS status
FROM rq LEFT JOIN b f ON f.id = rq.from_id LEFT JOIN b g ON g.id = rq.to_id LEFT JOIN c USING (request)"""


def components(edge_sql: str, node_sql: str, final: str) -> str:
    return f"""
WITH RECURSIVE {EDGE}, {NODE}, ce AS ({edge_sql}), cn AS ({node_sql}),
ca AS MATERIALIZED (SELECT u, v FROM ce UNION ALL SELECT v, u FROM ce),
t(k, c) USING KEY (k) AS (SELECT id, id FROM cn UNION ALL
  SELECT a.v, min(t.c) FROM t JOIN ca a ON a.u = t.k JOIN recurring.t p ON p.k = a.v WHERE t.c < p.c GROUP BY a.v)
{final}"""


CUT = "SELECT u, v, m FROM e WHERE NOT (u // 40 = 10 AND v // 40 = 11)"
SAMPLES = f"""
WITH RECURSIVE {EDGE}, {BUILDING}, {REQUEST}, arcs AS MATERIALIZED (SELECT u, v, m FROM e UNION ALL SELECT v, u, m FROM e), {searches()},
ends AS (SELECT id, unnest(doors) AS k FROM b),
s AS (SELECT rq.request, {hav(lon('(rq.from_id * 15) % n'), lat('(rq.from_id * 15) % n'), lon('(rq.to_id * 15) % n'), lat('(rq.to_id * 15) % n'))} AS straight, min(t.d) AS graph
  FROM rq JOIN b f ON f.id = rq.from_id JOIN b g ON g.id = rq.to_id CROSS JOIN cnt LEFT JOIN ends x ON x.id = rq.to_id LEFT JOIN t ON t.b = rq.from_id AND t.k = x.k
  WHERE f.in_area AND g.in_area AND len(f.doors) > 0 AND len(g.doors) > 0 AND f.id <> g.id GROUP BY ALL),
q AS (SELECT request, round(straight, 2) AS straight_m, round(graph, 2) AS graph_m, CASE WHEN graph IS NULL THEN 'disconnected' END AS failure FROM s WHERE straight >= 50),
r AS (SELECT *, graph_m / straight_m AS ratio FROM q)
"""
_x0, _y0, _x1, _y1 = lon("u"), lat("u"), lon("v"), lat("v")
_jit = "CASE WHEN j = 1 THEN 0.000003 ELSE 0 END"

ORACLES: dict[str, str] = {
    "edge_length_haversine": f"WITH {EDGE} SELECT id, u, v, round(m0, 6) AS length_m FROM e",
    "polyline_length_gate_g4": f"""
WITH l AS (SELECT c_custkey AS id, {hav(lon('c_custkey'), lat('c_custkey'), lon('c_custkey + 1'), lat('c_custkey + 1'))} + {hav(lon('c_custkey + 1'), lat('c_custkey + 1'), lon('c_custkey + 2'), lat('c_custkey + 2'))} AS m
  FROM customer)
SELECT id, round(abs((round(m, 2) + CASE WHEN id % 7 = 0 THEN 0.8 ELSE 0 END) - m), 2) AS delta_m FROM l WHERE abs((round(m, 2) + CASE WHEN id % 7 = 0 THEN 0.8 ELSE 0 END) - m) > 0.5""",
    "bearing_compass": f"""
WITH p AS (SELECT c_custkey AS id, {bearing(lon('c_custkey'), lat('c_custkey'), lon('(c_custkey * 13 + 41) % n'), lat('(c_custkey * 13 + 41) % n'))} AS b, (c_custkey * 13 + 41) % n <> c_custkey AS ok FROM customer, (SELECT count(*) AS n FROM customer))
SELECT id, round(b, 3) AS bearing, ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][(floor(b / 45 + 0.5) % 8 + 1)::int] AS compass FROM p WHERE ok""",
    "project_on_segment": f"""
WITH s AS (SELECT p_partkey AS id, c_custkey, {lon('c_custkey')} AS ax, {lat('c_custkey')} AS ay, {lon('(c_custkey * 13 + 41) % n')} AS bx, {lat('(c_custkey * 13 + 41) % n')} AS ey,
    {lon('c_custkey')} + 0.00005 AS px, {lat('c_custkey')} + p_size * 0.00001 AS py FROM part JOIN (SELECT count(*) AS n FROM customer) ON true JOIN customer ON c_custkey = (p_partkey * 7) % n),
k AS (SELECT *, cos(radians((ay + ey) / 2)) AS c FROM s), d AS (SELECT *, (bx - ax) * c AS dx, ey - ay AS dy FROM k),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((px - ax) * c * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM d)
SELECT id, round(t, 6) AS t, round({hav('px', 'py', '(ax + t * (bx - ax))', '(ay + t * (ey - ay))')}, 3) AS dist_m FROM t""",
    "point_in_footprint": f"WITH {NODE}, {COUNTS}, {FOOTPRINT} SELECT footprint_id, count(*)::bigint AS nodes FROM fp JOIN n ON n.lon >= x0 AND n.lon < x1 AND n.lat >= y0 AND n.lat < y1 GROUP BY 1",
    "segment_crossings": f"""
WITH {COUNTS}, s AS (SELECT s_suppkey AS id, {lon('(s_suppkey * 15) % n')} + 0.00001 AS ax, {lat('(s_suppkey * 15) % n')} AS ay, {lon('(s_suppkey * 37 + 11) % n')} AS bx, {lat('(s_suppkey * 37 + 11) % n')} + 0.00002 AS ey FROM supplier, cnt),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.*, (l.bx - l.ax) AS rx, (l.ey - l.ay) AS ry, (r.bx - r.ax) AS sx, (r.ey - r.ay) AS sy, r.ax - l.ax AS qx, r.ay - l.ay AS qy FROM s l JOIN s r ON l.id < r.id),
c AS (SELECT *, rx * sy - ry * sx AS den FROM p), t AS (SELECT left_id, right_id, (qx * sy - qy * sx) / den AS t, (qx * ry - qy * rx) / den AS u FROM c WHERE den <> 0)
SELECT left_id, right_id, round(t, 4) AS t, round(u, 4) AS u FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
    "classify_reject_reason": """
SELECT reason, count(*)::bigint AS rows FROM (SELECT CASE WHEN s_suppkey % 19 = 0 THEN 'null-island coordinates (0, 0)' WHEN s_suppkey % 17 = 0 THEN 'missing point geometry' ELSE 'kept' END AS reason FROM supplier) GROUP BY 1""",
    "reconcile_s7": """
SELECT source, total, kept, rejected, total = kept + rejected AS ok FROM (SELECT l_returnflag AS source, count(*)::bigint AS total, count(*) FILTER (l_linestatus = 'O')::bigint AS kept, count(*) FILTER (l_linestatus <> 'O')::bigint AS rejected FROM lineitem GROUP BY 1)""",
    "dedup_code_records": f"""
WITH RECURSIVE p AS (SELECT c_custkey AS id, 'C' || (c_custkey % 97) AS code, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END AS gsf FROM customer),
ca AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.code = b.code AND a.id <> b.id AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 150),
t(k, c) USING KEY (k) AS (SELECT id, id FROM p UNION ALL SELECT a.v, min(t.c) FROM t JOIN ca a ON a.u = t.k JOIN recurring.t q ON q.k = a.v WHERE t.c < q.c GROUP BY a.v),
g AS (SELECT code, c AS cluster, count(*)::bigint AS member_count, sum(gsf)::double AS summed_gsf, max(gsf)::double AS primary_gsf FROM t JOIN p ON p.id = t.k GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY summed_gsf DESC, cluster) - 1 AS ord, count(*) OVER (PARTITION BY code) AS nc, sum(member_count) OVER (PARTITION BY code) AS nm FROM g),
far AS (SELECT s.c AS cluster, round(max({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}), 1) AS max_span_m FROM t s JOIN t z ON s.c = z.c JOIN p a ON a.id = s.k JOIN p b ON b.id = z.k GROUP BY 1)
SELECT 'bldg:' || code || CASE WHEN ord > 0 THEN '#' || (ord + 1) ELSE '' END AS record_id, cluster, member_count, summed_gsf, primary_gsf, CASE WHEN nm = 1 THEN 'single' WHEN nc > 1 THEN 'separate' ELSE 'wings' END AS resolution, max_span_m FROM o JOIN far USING (cluster)""",
    "metric_changes": """
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS build_hash, o_orderpriority AS metric, count(*)::double AS value FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY build_hash) AS before FROM s)
SELECT metric, build_hash, value, before, value - before AS change, coalesce(before >= 2 AND value < 2, false) AS lost FROM l""",
    "footprint_coverage": f"""
WITH {COUNTS}, {FOOTPRINT}, b AS (SELECT 'S' || (s_suppkey % 70) AS code, greatest(0, floor(s_acctbal) * 12)::bigint AS gsf FROM supplier), c AS (SELECT DISTINCT code FROM fp),
d AS (SELECT b.*, c.code IS NOT NULL AS has FROM b LEFT JOIN c USING (code))
SELECT count(*)::bigint AS records, count(*) FILTER (has)::bigint AS with_footprint, count(*) FILTER (NOT has)::bigint AS without_footprint, round(100 * count(*) FILTER (has) / count(*), 1) AS coverage_pct,
  count(DISTINCT code)::bigint AS distinct_codes, count(DISTINCT code) FILTER (has)::bigint AS distinct_covered, count(*) FILTER (NOT has AND gsf = 0)::bigint AS without_zero_gsf, count(*) FILTER (NOT has AND gsf >= 50000)::bigint AS without_over_50k FROM d""",
    "merge_priority_sources": f"""
WITH {COUNTS}, {FOOTPRINT}, s AS (SELECT footprint_id, code, 0 AS priority FROM fp WHERE p_size > 49 UNION ALL SELECT footprint_id, code, 1 FROM fp WHERE p_size <= 49)
SELECT code, priority, count(*)::bigint AS rows FROM (SELECT *, min(priority) OVER (PARTITION BY code) AS best FROM s) WHERE priority = best GROUP BY 1, 2""",
    "freshness_stats": """
WITH l AS (SELECT 'EditDate' AS field, epoch_us(ts) // 1000 AS v FROM events UNION ALL SELECT 'ExtractDateTime', CASE WHEN event_id % 3 <> 0 THEN event_id * 1000 END FROM events),
k AS (SELECT field, list_sort(list(v)) AS vs FROM l WHERE v IS NOT NULL GROUP BY 1)
SELECT field, vs[1] AS min_ms, vs[-1] AS max_ms, vs[len(vs) // 2 + 1] AS p50_ms, len(vs)::bigint AS n FROM k""",
    "percentile_gates": """
WITH s AS (SELECT 1 + value / 100 AS r, event_id % 1000 = 7 AS bad FROM events),
o AS (SELECT quantile_cont(r, 0.5) FILTER (NOT bad) AS r1, quantile_cont(r, 0.9) FILTER (NOT bad) AS r2, max(r) FILTER (NOT bad) AS r3, count(*) FILTER (bad)::double AS r4 FROM s)
SELECT gate, round(v, 3) AS value, most::double AS most, round(v, 3) <= most AS ok FROM (SELECT unnest(['R1', 'R2', 'R3', 'R4']) AS gate, unnest([r1, r2, r3, r4]) AS v, unnest([1.30, 1.45, 3.00, 0.0]) AS most FROM o)""",
    "dangling_s2": "SELECT o_orderkey AS edge_id, o_custkey + o_orderkey % 7 * 300 AS node_id FROM orders WHERE o_custkey + o_orderkey % 7 * 300 NOT IN (SELECT c_custkey FROM customer)",
    "entrance_refs_s3": f"""
WITH {BUILDING}, r AS (SELECT id, unnest(doors) AS node FROM b) SELECT r.id, r.node, CASE WHEN c.c_custkey IS NULL THEN 'missing' ELSE 'walkway' END AS is_ FROM r LEFT JOIN customer c ON c.c_custkey = r.node WHERE c.c_custkey IS NULL OR c.c_custkey % 3 <> 0""",
    "unique_ids_s4": """
WITH i AS (SELECT 'building' AS kind, 'x:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'node', 'x:' || (c_custkey % 1400) FROM customer)
SELECT id, count(*)::bigint AS n, count(DISTINCT kind)::bigint AS kinds FROM i GROUP BY 1 HAVING count(*) > 1""",
    "bounds_g2": f"""
WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 211 = 0 THEN 0.0 ELSE {lon('c_custkey')} END AS lon, CASE WHEN c_custkey % 211 = 0 THEN 0.0 WHEN c_custkey % 97 = 0 THEN 34.0 ELSE {lat('c_custkey')} END AS lat FROM customer)
SELECT id::varchar AS entity, CASE WHEN lon = 0 AND lat = 0 THEN '(0, 0)' ELSE 'out of bounds' END AS measurement FROM p WHERE (lon = 0 AND lat = 0) OR NOT (lon BETWEEN -112.2 AND -111.7 AND lat BETWEEN 33.3 AND 33.5)""",
    "endpoint_s5": f"""
WITH {EDGE}, p AS (SELECT id, u, CASE WHEN id % 13 = 0 THEN 0.000005 ELSE 0 END AS off FROM e)
SELECT id, round({hav(lon('u') + ' + off', lat('u'), lon('u'), lat('u'))}, 2) AS off_m FROM p WHERE {hav(lon('u') + ' + off', lat('u'), lon('u'), lat('u'))} > 0.1""",
    "near_duplicates_g7": f"""
WITH p AS (SELECT c_custkey * 2 + j AS id, {lon('c_custkey')} + {_jit} AS lon, {lat('c_custkey')} + {_jit} AS lat FROM customer, (SELECT unnest([0, 1]) AS j) WHERE j = 0 OR c_custkey % 31 = 0)
SELECT a.id AS a, b.id AS b, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS dist_m FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) < 0.00001 AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 0.5""",
    "edge_in_footprint_g3": f"""
WITH {EDGE}, {COUNTS}, {FOOTPRINT}, l AS (SELECT id, {_x0} AS ax, {_y0} AS ay, {_x1} AS bx, {_y1} AS ey FROM e WHERE id % 11 <> 0 AND id % 89 <> 5 AND id % 97 <> 1),
c AS (SELECT id, footprint_id, greatest(least(ax, bx), x0) AS cx0, least(greatest(ax, bx), x1) AS cx1, greatest(least(ay, ey), y0) AS cy0, least(greatest(ay, ey), y1) AS cy1 FROM l JOIN fp ON p_size <= 45 AND p_size % 5 <> 0 AND ax <= x1 AND bx >= x0 AND ay <= y1 AND ey >= y0)
SELECT id AS edge_id, footprint_id, round({hav('cx0', 'cy0', 'cx1', 'cy1')}, 2) AS inside_m FROM c WHERE {hav('cx0', 'cy0', 'cx1', 'cy1')} > 2""",
    "entrance_far_g8": "SELECT s_suppkey::varchar AS entity, CASE WHEN snap > 40 THEN 'FAIL' ELSE 'WARN' END AS level, snap AS snap_m FROM (SELECT s_suppkey, (s_suppkey * 37 % 60)::double AS snap FROM supplier) WHERE snap > 25",
    "nearest_edge": f"""
WITH {EDGE}, {COUNTS}, p AS (SELECT p_partkey AS id, {lon('(p_partkey * 7) % n')} + p_size * 0.0000031 - 0.0001 AS px, {lat('(p_partkey * 7) % n')} - p_size * 0.00002 AS py FROM part, cnt),
d AS (SELECT p.id, e.id AS edge_id, px, py, {_x0} AS ax, {_y0} AS ay, {_x1} AS bx, {_y1} AS ey FROM p JOIN e ON {_y0} BETWEEN py - 0.0013 AND py + 0.0013 AND {_x0} BETWEEN px - 0.0016 AND px + 0.0016),
k AS (SELECT *, cos(radians((ay + ey) / 2)) AS c FROM d), q AS (SELECT *, (bx - ax) * c AS dx, ey - ay AS dy FROM k),
t AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * c * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM q),
m AS (SELECT id, min({hav('px', 'py', '(ax + t * (bx - ax))', '(ay + t * (ey - ay))')}) AS m FROM t GROUP BY 1)
SELECT id, round(m, 3) AS dist_m FROM m WHERE m <= 125""",
    "components_s8": components(CUT, "SELECT id FROM n", "SELECT c AS component, count(*)::bigint AS nodes FROM t GROUP BY 1"),
    "largest_component": components(
        CUT, "SELECT DISTINCT u AS id FROM ce UNION SELECT v FROM ce",
        """, s AS (SELECT c, count(*) AS nodes FROM t GROUP BY 1), top AS (SELECT c FROM s ORDER BY nodes DESC, c LIMIT 1), g AS (SELECT t.c, count(*) AS edges, sum(m) AS metres FROM ce JOIN t ON t.k = ce.u GROUP BY 1)
SELECT (SELECT edges::bigint FROM g JOIN top USING (c)) AS edges, (SELECT round(metres, 2) FROM g JOIN top USING (c)) AS metres,
  (SELECT count(*)::bigint FROM s WHERE c NOT IN (SELECT c FROM top)) AS others, (SELECT coalesce(sum(nodes), 0)::bigint FROM s WHERE c NOT IN (SELECT c FROM top)) AS other_nodes,
  (SELECT count(*)::bigint FROM g WHERE c NOT IN (SELECT c FROM top) AND metres > 100) AS warned""",
    ),
    "trade_components": """
WITH RECURSIVE ce AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS u, (l_partkey % 40 + l_suppkey // 10 * 40) * 2 + 1 AS v FROM lineitem),
ca AS MATERIALIZED (SELECT u, v FROM ce UNION ALL SELECT v, u FROM ce),
t(k, c) USING KEY (k) AS (SELECT DISTINCT u, u FROM ca UNION ALL SELECT a.v, min(t.c) FROM t JOIN ca a ON a.u = t.k JOIN recurring.t p ON p.k = a.v WHERE t.c < p.c GROUP BY a.v)
SELECT c AS component, count(*)::bigint AS nodes FROM t GROUP BY 1""",
    "coverage_c1_c5": f"""
WITH {EDGE}, {BUILDING} SELECT 'C1' AS metric, round(avg((len(doors) > 0)::int), 6) AS value, avg((len(doors) > 0)::int) >= 0.95 AS ok FROM b WHERE in_area
UNION ALL SELECT 'C5', round(sum(m), 2), sum(m) >= 25000 FROM e WHERE type <> 'link'""",
    "work_queue_c6": f"WITH {BUILDING} SELECT id, gsf, row_number() OVER (ORDER BY gsf DESC, id) AS place FROM b WHERE id % 4 <> 1",
    "sssp_length": f"""
WITH RECURSIVE {EDGE}, arcs AS MATERIALIZED (SELECT u, v, m FROM e UNION ALL SELECT v, u, m FROM e),
t(k, d) USING KEY (k) AS (SELECT 0::bigint, 0.0::double UNION ALL SELECT a.v, min(t.d + a.m) FROM t JOIN arcs a ON a.u = t.k LEFT JOIN recurring.t p ON p.k = a.v WHERE p.k IS NULL OR t.d + a.m < p.d - 1e-9 GROUP BY a.v)
SELECT k AS id, round(d, 2) AS length_m FROM t""",
    "isochrone_300m": f"""
WITH RECURSIVE {EDGE}, {BUILDING}, arcs AS MATERIALIZED (SELECT u, v, m FROM e UNION ALL SELECT v, u, m FROM e), {searches()}
SELECT b AS id, count(*)::bigint AS nodes, round(max(d), 2) AS farthest_m FROM t WHERE d <= 300 GROUP BY 1""",
    "od_route_cost_default": od(arcs()),
    "od_route_by_cells": od(arcs()),
    "isochrone_hulls": f"""
WITH RECURSIVE {EDGE}, {BUILDING}, arcs AS MATERIALIZED (SELECT u, v, m FROM e UNION ALL SELECT v, u, m FROM e), {searches()},
h AS (SELECT 60.0 / ({R} * pi() / 180) AS high), c AS (SELECT DISTINCT b, floor({lon('k')} / (high / cos(radians(33.5))))::bigint AS x, floor({lat('k')} / high)::bigint AS y FROM t, h WHERE d <= 150)
SELECT b AS id, round(count(*) * 3600.0, 1)::double AS area_m2, sum(4 - (SELECT count(*) FROM c o WHERE o.b = c.b AND abs(o.x - c.x) + abs(o.y - c.y) = 1))::bigint AS sides FROM c GROUP BY 1""",
    "kept_routes": f"SELECT request, cost, request % 2 = 0 AS kept FROM ({od(arcs())})",
    "schema_faults_s1": """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS file, c_acctbal::decimal(12,2) AS b, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer),
f AS (SELECT file, pos, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'is missing' END, CASE WHEN k % 17 <> 0 AND k % 13 = 0 THEN 'doesn''t match' END,
  CASE WHEN seg NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'isn''t one of' END, CASE WHEN k % 3 = 0 AND b < 0 THEN 'is less than' END, CASE WHEN k % 3 = 0 AND b <= 0 THEN 'is not more than' END,
  CASE WHEN k % 19 = 0 THEN 'is more than' END, CASE WHEN seg = 'HOUSEHOLD' AND k % 5 <> 0 THEN 'is missing' END], lambda x: x IS NOT NULL)) AS fault FROM c
  UNION ALL SELECT DISTINCT file, 0, 'is missing' FROM c UNION ALL SELECT DISTINCT file, 0, 'unexpected' FROM c WHERE file % 4 = 0)
SELECT file, fault, count(*)::bigint AS rows, sum(pos)::bigint AS places FROM f GROUP BY 1, 2""",
    "hilbert_order": f"""
WITH {NODE}, c AS (SELECT id, floor((lon + 180.0) / 360.0 * 16777216)::bigint AS x, floor((lat + 90.0) / 180.0 * 16777216)::bigint AS y FROM n),
h AS (SELECT id, list_reduce(list_transform(range(0, 24), lambda k: {{'x': (1 << (23 - k))::bigint, 'y': 0::bigint, 'd': 0::bigint}}), lambda a, s: {{
    'x': CASE WHEN (a.y & s.x) <> 0 THEN a.x WHEN (a.x & s.x) <> 0 THEN 16777215 - a.y ELSE a.y END,
    'y': CASE WHEN (a.y & s.x) <> 0 THEN a.y WHEN (a.x & s.x) <> 0 THEN 16777215 - a.x ELSE a.x END,
    'd': a.d + s.x * s.x * CASE WHEN (a.x & s.x) <> 0 THEN CASE WHEN (a.y & s.x) <> 0 THEN 2 ELSE 3 END WHEN (a.y & s.x) <> 0 THEN 1 ELSE 0 END}}, {{'x': x, 'y': y, 'd': 0::bigint}}).d AS h FROM c)
SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS idx FROM h""",
    "od_route_cost_accessible": od(arcs(True, avoid=True)),
    "od_route_shade": od(arcs(False, 0.8, 1.0, True)),
    "route_status": STATUS,
    "detour_ratio": SAMPLES + "SELECT request, straight_m, graph_m, round(ratio, 6) AS detour_ratio, failure FROM r",
    "detour_percentiles": SAMPLES + "SELECT round(quantile_cont(ratio, 0.5), 3) AS r1, round(quantile_cont(ratio, 0.9), 3) AS r2, round(max(ratio), 3) AS r3, count(failure)::bigint AS r4 FROM r",
    "leg_islands": f"""
WITH {EDGE}, s AS (SELECT CASE WHEN id % 2 = 0 THEN u // 40 ELSE -1 - u % 40 END AS route, CASE WHEN id % 2 = 0 THEN u % 40 ELSE u // 40 END AS pos, * FROM e),
f AS (SELECT *, CASE WHEN pos = 0 OR type IN ('crossing', 'steps') OR lag(type) OVER w IN ('crossing', 'steps') OR name <> lag(name) OVER w THEN 1 ELSE 0 END AS starts FROM s WINDOW w AS (PARTITION BY route ORDER BY pos)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY route ORDER BY pos) - 1 AS leg FROM f)
SELECT route, leg::int AS leg, count(*)::bigint AS edges, floor(sum(m) * 100 + 0.5) / 100 AS distance_m,
  CASE WHEN arg_min(type, pos) = 'crossing' THEN 'Cross the street' WHEN arg_min(type, pos) = 'steps' THEN 'Take the stairs' ELSE CASE WHEN leg = 0 THEN 'Walk' ELSE 'Continue' END || ' along ' || arg_min(name, pos) END AS instruction FROM g GROUP BY route, leg""",
    "closures_active": """
WITH c AS (SELECT event_id, event_type, ts AS from_, CASE WHEN event_id % 5 <> 0 THEN ts + to_hours((event_id % 48)::int) END AS to_ FROM events)
SELECT event_type, count(*)::bigint AS closures, sum(event_id)::bigint AS ids FROM c WHERE from_ <= TIMESTAMP '2024-01-15 12:00:00' AND (to_ IS NULL OR to_ > TIMESTAMP '2024-01-15 12:00:00') GROUP BY 1""",
    "heat_factor": """
WITH l AS (SELECT event_id, ts + to_days((event_id % 365)::int) - INTERVAL 7 HOUR AS t FROM events), h AS (SELECT event_id, month(t) AS mo, hour(t) + minute(t) / 60.0::double AS h FROM l)
SELECT event_id, round(CASE WHEN mo BETWEEN 5 AND 9 THEN 1 WHEN mo IN (4, 10) THEN 0.5 WHEN mo IN (3, 11) THEN 0.2 ELSE 0 END::double * CASE WHEN h < 8 OR h >= 20 THEN 0 WHEN h < 13 THEN (h - 8) / 5 WHEN h <= 17 THEN 1 ELSE (20 - h) / 3 END, 4) AS heat FROM h""",
    "parallel_edge_ord": """
WITH l AS (SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, l_quantity::bigint AS q FROM lineitem)
SELECT a, b, q, row_number() OVER (PARTITION BY a, b ORDER BY q) - 1 AS ord FROM l WHERE a <> b""",
    "degree_histogram": f"WITH {EDGE} SELECT degree, count(*)::bigint AS nodes FROM (SELECT k, count(*)::bigint AS degree FROM (SELECT u AS k FROM e UNION ALL SELECT v FROM e) GROUP BY 1) GROUP BY 1",
    "json_reference_walk": """
SELECT 'node:' || k AS id, count(*)::bigint AS events FROM (SELECT json_extract_string(props, '$.k')::bigint AS k FROM events) WHERE k % 10 <> 0 GROUP BY 1""",
    "manifest_counts": f"""
WITH {EDGE}, {NODE}, {BUILDING} SELECT (SELECT count(*) FROM b)::bigint AS buildings, (SELECT count(*) FROM b WHERE in_area AND len(doors) > 0)::bigint AS routable_buildings, (SELECT count(*) FROM n)::bigint AS nodes,
  (SELECT count(*) FROM n WHERE crossing)::bigint AS crossings, (SELECT count(*) FROM e)::bigint AS edges, (SELECT round(sum(m), 2) FROM e) AS total_length_m""",
    "alias_search": """
WITH a AS (SELECT s_suppkey AS id, trim(regexp_replace(regexp_replace(lower(s_name), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS alias FROM supplier) SELECT id, alias FROM a WHERE starts_with(alias, 'supplier0000000')""",
    "category_assignment": """
SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN lower(p_type) WHEN p_brand <> 'Brand#2' THEN lower(p_brand) ELSE 'unknown' END AS category, count(*)::bigint AS rows FROM part GROUP BY 1""",
    "overlay_resolution": f"""
WITH {NODE}, {COUNTS}, r AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey * 15) % n END AS exact_node, {lon('(s_suppkey * 15) % n')} + 0.00001 * (s_suppkey % 7) AS x, {lat('(s_suppkey * 15) % n')} AS y, CASE s_suppkey % 4 WHEN 1 THEN 4.0 WHEN 2 THEN 14.0 ELSE 0.1 END AS r FROM supplier, cnt),
h AS (SELECT r.id, exact_node, count(n.id) AS hits, min(n.id) AS hit FROM r LEFT JOIN n ON exact_node IS NULL AND abs(n.lat - y) < 0.0002 AND abs(n.lon - x) < 0.0002 AND {hav('n.lon', 'n.lat', 'x', 'y')} <= r GROUP BY ALL)
SELECT id, CASE WHEN exact_node IS NOT NULL THEN 'exact' WHEN hits = 1 THEN 'spatial' WHEN hits > 1 THEN 'ambiguous' ELSE 'failed' END AS resolution, coalesce(exact_node, CASE WHEN hits = 1 THEN hit END) AS resolved_to FROM h""",
    "overlay_files": """
WITH s AS (SELECT s_suppkey AS k, 'f' || s_nationkey AS file, s_suppkey % 5 AS m, 'geo:1.5,2.5,r=' || s_suppkey % 9 AS g FROM supplier),
w AS (SELECT file, k, 's' || k AS id, k % 7 <> 0 AND m IN (0, 1, 2) AS good FROM s WHERE k % 3 <> 2
  UNION ALL SELECT CASE WHEN k % 2 = 0 THEN file ELSE 'gone' END, k, 'x' || k, false FROM s WHERE k % 11 = 0),
f AS (SELECT file, bool_or(good) AS changed, count(*) FILTER (good)::int AS repinned, count(*) FILTER (NOT good)::int AS skipped FROM w GROUP BY 1),
e AS (SELECT s.file, 's' || s.k AS overlay_id, CASE WHEN w.good THEN 'node:' || s.k WHEN m = 0 THEN g WHEN m = 1 THEN 'osm:way/9' WHEN m = 2 THEN 'node:old' END AS ref,
  CASE WHEN m IN (2, 3) THEN g END AS fallback FROM s LEFT JOIN w ON w.id = 's' || s.k)
SELECT file, changed, repinned, skipped, overlay_id, ref, fallback FROM f LEFT JOIN e USING (file)""",
    "around_blocks": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 0 END::bigint AS pierced, p_partkey % 7 <> 0 AS led, CASE WHEN p_partkey % 7 = 0 THEN 'runs into the footprint' END AS reason FROM part""",
    "check_constraints": """
SELECT c_custkey::varchar AS entity, m AS measurement FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal <= 0 OR c_acctbal >= 2000 THEN 'length' END, CASE WHEN c_custkey % 90 = 4 THEN 'order' END], lambda x: x IS NOT NULL)) AS m FROM customer)""",
    "reference_integrity": f"""
WITH {COUNTS}, k AS (SELECT o_custkey % 1700 AS k FROM orders), r AS (
  SELECT 'n' || k AS value, 'edge.from_node_id' AS reference FROM k WHERE k NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'n' || (k + 40), 'edge.to_node_id' FROM k WHERE k + 40 NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'b' || (c_custkey % 130), 'node.building_id' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 130 NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT (s_suppkey * 30)::varchar, 'building.footprint_id' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey * 30 NOT IN (SELECT p_partkey FROM part))
SELECT value, reference, count(*)::bigint AS rows FROM r GROUP BY 1, 2""",
    "build_hash": f"""
WITH {EDGE}, {NODE}, l AS (SELECT 0 AS part, id::varchar AS k, id::varchar AS line FROM n UNION ALL SELECT 1, id::varchar, id || '|' || u || '|' || v || '|' || printf('%.3f', m) FROM e),
g AS (SELECT part, substr(sha256(k), 1, 2) AS pre, sha256(string_agg(line, chr(10) ORDER BY k, line)) AS h FROM l GROUP BY 1, 2)
SELECT sha256(string_agg(part || ':' || pre || ':' || h, '' ORDER BY part, pre)) AS graph_hash FROM g""",
    "route_results": f"""
WITH RECURSIVE {EDGE}, {BUILDING}, {REQUEST}, {arcs()}, {searches()}, ends AS (SELECT id, unnest(doors) AS k FROM b),
c AS (SELECT rq.request, min(t.d) AS d FROM rq JOIN ends x ON x.id = rq.to_id JOIN t ON t.b = rq.from_id AND t.k = x.k GROUP BY 1),
r AS (SELECT rq.*, c.d, CASE WHEN f.id IS NULL OR g.id IS NULL THEN 'unknown_building' WHEN f.id = g.id THEN 'same_building' WHEN NOT f.in_area OR NOT g.in_area THEN 'out_of_service_area'
    WHEN len(f.doors) = 0 OR len(g.doors) = 0 THEN 'no_entrance' WHEN c.d IS NULL THEN 'disconnected' END AS reason,
    CASE WHEN f.id IS NULL OR (g.id IS NOT NULL AND NOT f.in_area) OR (g.id IS NOT NULL AND g.in_area AND len(f.doors) = 0) THEN rq.from_id ELSE rq.to_id END AS blamed
  FROM rq LEFT JOIN b f ON f.id = rq.from_id LEFT JOIN b g ON g.id = rq.to_id LEFT JOIN c USING (request))
SELECT request, reason IS NULL AS ok, reason, CASE WHEN reason = 'disconnected' THEN from_id || ' -> ' || to_id WHEN reason IN ('unknown_building', 'out_of_service_area', 'no_entrance') THEN blamed::varchar END AS detail,
  CASE WHEN reason IS NULL THEN floor(d + 0.5)::bigint END AS seconds, CASE WHEN reason IS NULL THEN true END AS named FROM r""",
    "drop_stubs": f"""
WITH {EDGE}, s AS (SELECT c_custkey + 10000000 AS id, c_custkey AS u, c_custkey + 10000000 AS v, 1 + c_custkey % 13 AS m, c_custkey % 3 = 0 AS held FROM customer WHERE c_custkey % 5 = 0),
x AS (SELECT id, u, v, m, false AS held FROM e UNION ALL SELECT * FROM s), g AS (SELECT k, count(*) AS n FROM (SELECT u AS k FROM x UNION ALL SELECT v FROM x) GROUP BY 1)
SELECT id FROM x JOIN g a ON a.k = u JOIN g b ON b.k = v WHERE NOT (m < 8 AND (a.n = 1 OR (b.n = 1 AND NOT held)))""",
    "collapse_chains": f"""
WITH {EDGE}, s AS (SELECT id, u, v, name, CASE WHEN v = u + 1 THEN 0 ELSE 10000000 END AS up, CASE WHEN v = u + 1 THEN u // 40 ELSE -1 - u % 40 END AS street FROM e),
f AS (SELECT *, CASE WHEN lag(name) OVER w IS NULL OR lag(name) OVER w <> name OR u % 16 = 7 THEN 1 ELSE 0 END AS starts FROM s WINDOW w AS (PARTITION BY street ORDER BY u)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY street ORDER BY u) AS chain FROM f)
SELECT min(id) AS id, name, min(u + up) AS a, max(v + up) AS b, count(*)::bigint AS edges FROM g GROUP BY street, chain, name""",
    "dedupe_edges": f"WITH {EDGE} SELECT id FROM e WHERE id % 3 <> 2 UNION ALL SELECT id + 10000000 FROM e WHERE id % 3 = 0 UNION ALL SELECT id + 10000000 FROM e WHERE id % 3 = 2",
    "split_lines": """
WITH g AS (SELECT c_custkey // 40 AS way, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT -1 - c_custkey % 40, count(*) FROM customer GROUP BY 1)
SELECT way, (n - 1)::bigint AS parts, 2::bigint AS points FROM g WHERE n > 1""",
    "door_ordinals": """
WITH d AS (SELECT s_suppkey AS k, i, (s_suppkey + i) % 2 = 0 AS provisional, (s_suppkey * i) % 3 = 1 AS weak, CASE WHEN (s_suppkey + 2 * i) % 4 = 0 THEN 0 ELSE 1 END AS side, (s_suppkey * 4 + i) AS spot FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE (s_suppkey + i) % 7 <> 0)
SELECT k AS building_id, i::bigint AS i, row_number() OVER (PARTITION BY k ORDER BY provisional, weak, side, spot % 40, spot // 40) - 1 AS ordinal FROM d""",
    "content_id_counts": f"""
WITH {EDGE} SELECT (2 * count(*))::bigint AS rows, count(*)::bigint AS edges, 0::bigint AS ords, (2 * count(*))::bigint AS good, (SELECT count(DISTINCT k) FROM (SELECT u AS k FROM e UNION ALL SELECT v FROM e))::bigint AS nodes FROM e""",
    "one_component_s8": components(
        CUT + " AND NOT (u % 40 IN (11, 12) AND v % 40 IN (11, 12) AND v = u + 1) AND NOT (u // 40 IN (9, 10) AND v = u + 40)", "SELECT id FROM n",
        """, s AS (SELECT c, count(*) AS nodes, bool_and(k // 40 = 10 AND k % 60 <> 0) AS held FROM t GROUP BY 1)
SELECT c AS component, nodes::bigint AS nodes FROM s WHERE NOT held AND c <> (SELECT arg_max(c, nodes * 1000000000 + c) FROM s)""",
    ),
    "service_area_g1": f"""
WITH {NODE} SELECT id FROM n WHERE NOT (lon >= -111.95005 AND lon < -111.94765 AND lat >= 33.39995 AND lat < 33.4011) AND NOT (lon >= -111.94705 AND lon < -111.94 AND lat >= 33.40055 AND lat < 33.5)""",
    "long_straight_g5": f"""
WITH k AS (SELECT c_custkey AS k, c_custkey + 1 + (c_custkey % 50) * 40 AS j FROM customer),
m AS (SELECT k, greatest({hav(lon('k'), lat('k'), lon('j'), lat('j'))}, {hav(lon('j'), lat('j'), lon('(j + 1)'), lat('(j + 1)'))}) AS m FROM k)
SELECT k AS id, round(m, 1) AS m FROM m WHERE m > 400""",
    "far_buildings_c2": f"""
WITH {EDGE}, {COUNTS}, b AS (SELECT s_suppkey AS id, -111.95 - (s_suppkey % 9) * 0.0001 AS x, 33.40 + ((s_suppkey * 15 % n) // 40) * 0.00012::double AS y FROM supplier, cnt)
SELECT id FROM b WHERE {hav('x', 'y', '-111.95', 'y')} > 50""",
    "without_entrance_c3": f"WITH {BUILDING} SELECT id FROM b WHERE in_area AND len(doors) = 0 AND id % 46 <> 0",
    "unreachable_c4": f"""
WITH {BUILDING}, r AS (SELECT id, unnest(doors) AS k FROM b), h AS (SELECT DISTINCT k // 200 AS strip FROM r WHERE id = 1),
ok AS (SELECT DISTINCT id FROM r JOIN customer ON c_custkey = k WHERE k // 200 IN (SELECT strip FROM h))
SELECT id FROM b WHERE len(doors) > 0 AND id NOT IN (SELECT id FROM ok)""",
    "key_violations": """
WITH t AS (SELECT o_orderkey % 9973 AS edge_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS idx, o_custkey % 50 AS f, o_orderkey % 400 AS ord FROM orders),
v AS (SELECT 'repeats in (edge_id)' AS key FROM t GROUP BY edge_id HAVING count(*) > 1 UNION ALL SELECT 'repeats in (idx)' FROM t WHERE idx IS NOT NULL GROUP BY idx HAVING count(*) > 1
  UNION ALL SELECT 'repeats in (from_node_id, to_node_id, ord)' FROM t GROUP BY f, ord HAVING count(*) > 1)
SELECT key, count(*)::bigint AS values FROM v GROUP BY 1""",
    "reconciliation_gate_s7": """
WITH g AS (SELECT l_returnflag AS source, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS kept FROM lineitem GROUP BY 1),
c AS (SELECT source, n + CASE WHEN source = 'R' THEN 1 ELSE 0 END AS fetched, kept, CASE WHEN source <> 'A' THEN n - kept END AS rejected FROM g)
SELECT source, fetched || ' <> ' || kept || ' + ' || coalesce(rejected::varchar, 'null') AS measurement FROM c WHERE rejected IS NULL OR fetched <> kept + rejected""",
    "shape_reject_reason": f"""
WITH {COUNTS}, {FOOTPRINT}, c AS (SELECT DISTINCT 'S' || (s_suppkey % 40) AS code FROM supplier WHERE s_suppkey % 3 <> 0),
r AS (SELECT footprint_id, CASE WHEN c.code IS NULL THEN 'code not in the building set' WHEN footprint_id % 7 = 0 OR regexp_matches(p_type, '(?i)\\b(SOLAR|CANOPY|INFRASTRUCTURE)\\b') THEN 'open-air canopy or infrastructure' ELSE 'kept' END AS reason FROM fp LEFT JOIN c USING (code))
SELECT reason, count(*)::bigint AS rows, sum(footprint_id)::bigint AS ids FROM r GROUP BY 1""",
    "shape_faults": """
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN 'Point' WHEN p_partkey % 29 <> 0 THEN 'Polygon' END AS t, p_partkey % 13 = 0 AS short, p_partkey % 13 <> 0 AND p_partkey % 17 = 0 AS open_, p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 = 0 AS far FROM part),
f AS (SELECT k, unnest(list_filter([CASE WHEN t IS NULL THEN 'geometry is missing' WHEN t <> 'Polygon' THEN 'geometry is Point' END, CASE WHEN k % 31 = 0 THEN 'code is not a building code' END, CASE WHEN short THEN 'ring has fewer than 4 positions' END,
  CASE WHEN short OR open_ THEN 'ring is not closed' END, CASE WHEN far THEN 'vertex out of bounds' END], lambda x: x IS NOT NULL)) AS fault FROM p)
SELECT fault, count(*)::bigint AS rows, sum(k)::bigint AS ordinals FROM f GROUP BY 1""",
    "gained_codes": """
WITH b AS (SELECT DISTINCT 'C' || (c_custkey % 211) AS code FROM customer), x AS (SELECT DISTINCT 'C' || (s_suppkey % 61) AS code FROM supplier), y AS (SELECT DISTINCT 'C' || (p_partkey % 173) AS code FROM part)
SELECT 'gained' AS kind, code FROM b WHERE code IN (FROM y) AND code NOT IN (FROM x) UNION ALL SELECT 'lost', code FROM x WHERE code NOT IN (FROM y) UNION ALL SELECT 'uncovered', code FROM b WHERE code NOT IN (FROM x) AND code NOT IN (FROM y)""",
    "overrides": f"""
WITH {EDGE} SELECT CASE WHEN id % 14 = 0 THEN 'sand' ELSE surface END AS surface, count(*)::bigint AS rows, round(sum(CASE WHEN id % 21 = 0 THEN 0.9 ELSE shade END), 6) AS shade FROM e WHERE id % 41 <> 0 GROUP BY 1""",
    "entrance_actions": f"""
SELECT s_suppkey AS id, s_suppkey % 50 AS buildingId, s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 1 AS provisional, round({lat('(s_suppkey + CASE WHEN s_suppkey % 5 = 0 THEN 40 ELSE 0 END)')}, 6) AS lat FROM supplier WHERE s_suppkey % 9 <> 0
UNION ALL SELECT s_suppkey + 1000000, s_suppkey % 50, false, round({lat('s_suppkey')}, 6) FROM supplier WHERE s_suppkey % 8 = 3""",
    "way_filter": """
WITH t AS (SELECT p_partkey AS k, ['footway', 'service', 'residential', 'motorway', 'pedestrian', 'tertiary'][(p_partkey % 6 + 1)::int] AS h, CASE p_partkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS foot, p_partkey % 7 = 0 AS sidewalk, p_partkey % 4 = 0 AS area, p_partkey % 11 = 0 AS af FROM part),
p AS (SELECT *, af OR (h = 'pedestrian' AND area) AS plaza FROM t),
r AS (SELECT k, plaza, CASE WHEN h IN ('footway', 'pedestrian') THEN true WHEN h = 'service' AND coalesce(foot, '') <> 'no' THEN true WHEN h IN ('residential', 'tertiary') THEN NOT sidewalk AND coalesce(foot, '') = 'yes' ELSE plaza END AS kept FROM p)
SELECT kept, plaza, count(*)::bigint AS rows, sum(k)::bigint AS ids FROM r GROUP BY 1, 2""",
    "same_grade": """
SELECT p_partkey % 3 = (CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 4 - 1 ELSE 0 END) AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS meets, count(*)::bigint AS rows, sum(p_partkey)::bigint AS ids FROM part GROUP BY 1""",
    "manifest_upsert": """
WITH s AS (SELECT 'f' || (s_suppkey * 20) AS file, -1::bigint AS bytes FROM supplier)
SELECT 'f' || c_custkey AS file, c_custkey AS bytes FROM customer WHERE 'f' || c_custkey NOT IN (SELECT file FROM s) UNION ALL SELECT file, bytes FROM s""",
    "field_status": """
WITH b AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'todo' ELSE 'done' END AS status FROM supplier)
SELECT status, CASE status WHEN 'todo' THEN 'to visit' WHEN 'none' THEN 'not queued' ELSE status END AS label, sum(id)::bigint AS ids, count(*)::bigint AS count FROM b GROUP BY 1""",
    "latest_changes": "SELECT event_id % 997 AS k, max(event_id) AS at FROM events GROUP BY 1 HAVING max(event_id) % 5 <> 0",
    "point_along_line": f"""
WITH k AS (SELECT c_custkey AS k, (c_custkey % 30)::double AS goal, {hav(lon('c_custkey'), lat('c_custkey'), lon('c_custkey + 1'), lat('c_custkey + 1'))} AS m1, {hav(lon('c_custkey + 1'), lat('c_custkey + 1'), lon('c_custkey + 41'), lat('c_custkey + 41'))} AS m2 FROM customer),
t AS (SELECT k, least(1.0, goal / m1) AS f1, greatest(0.0, least(1.0, (goal - m1) / m2)) AS f2 FROM k)
SELECT k AS id, round({lon('k')} + f1 * ({lon('k + 1')} - {lon('k')}) + f2 * ({lon('k + 41')} - {lon('k + 1')}), 8) AS lon, round({lat('k')} + f1 * ({lat('k + 1')} - {lat('k')}) + f2 * ({lat('k + 41')} - {lat('k + 1')}), 8) AS lat FROM t""",
    "turn_angle": """
WITH a AS (SELECT c_custkey AS id, (c_custkey * 37 % 360) AS a, (c_custkey * 101 % 720 - 360) AS b FROM customer), d AS (SELECT id, ((a - b) % 360 + 360) % 360 AS d FROM a)
SELECT id, round(least(d, 360 - d)::double, 6) AS angle FROM d""",
    "ring_area_and_mean": f"""
WITH {COUNTS}, {FOOTPRINT} SELECT footprint_id, round(4 * h * h * cos(radians(y)) * pow({R} * pi() / 180, 2), 2) AS area_m2, round((5 * x - h) / 5, 7) AS lon, round((5 * y - h) / 5, 7) AS lat FROM fp""",
    "wkt_points": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey % 180 + 0.25::double END AS lon, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN -(p_partkey % 90)::double END AS lat FROM part""",
}
