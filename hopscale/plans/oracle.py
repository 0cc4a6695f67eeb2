"""DuckDB SQL for the queries: the whole construction in plain relational terms, independent of the engine.

Shortest paths are a keyed recursion, representatives a recursion over the zones in order. Chains of
layers are written out for up to LAYERS layers; absent ones are empty.
"""

from __future__ import annotations

LAYERS = 7

NET = """
p AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS w FROM supplier),
s AS (SELECT s_suppkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS b FROM supplier),
e AS (
  SELECT u.k AS src, v.k AS dst, CAST(1000 + abs(u.b - v.b) % 1000 AS DOUBLE) AS cost
  FROM s AS u CROSS JOIN p JOIN s AS v ON (v.k = u.k + 1 AND (u.k + 1) % p.w <> 0) OR v.k = u.k + p.w
),
a AS (SELECT src, dst, cost FROM e UNION ALL SELECT dst, src, cost FROM e)"""

PATHS = """
sp(src, dst, cost) USING KEY (src, dst) AS (
  SELECT k, k, CAST(0 AS DOUBLE) FROM s
  UNION
  SELECT sp.src, a.dst, min(sp.cost + a.cost) FROM sp JOIN a ON a.src = sp.dst
  LEFT JOIN recurring.sp AS r ON r.src = sp.src AND r.dst = a.dst
  WHERE r.cost IS NULL OR sp.cost + a.cost < r.cost GROUP BY ALL
)"""


def _hierarchy(zones: str = "SELECT k AS zone FROM s") -> str:
    out = [
        f"z AS ({zones})",
        "zi AS (SELECT zone, row_number() OVER (ORDER BY zone) - 1 AS i, count(*) OVER () AS n FROM z)",
        "ext AS (SELECT max(cost) AS extent FROM sp JOIN zi ON zi.zone = sp.src WHERE i % greatest(1, n // least(10, n)) = 0)",
        f"rad AS (SELECT CAST(k AS INTEGER) AS layer, 3000.0 * 2 ** k AS radius FROM range({LAYERS + 1}) AS t(k), ext WHERE 3000.0 * 2 ** k < 1.5 * extent OR k < 2)",
        "nl AS (SELECT count(*) AS n FROM rad)",
        "r0 AS (SELECT zone FROM z)",
    ]
    for k in range(LAYERS):
        # stored costs before any pruning; none if the layer does not exist
        out.append(f"c{k} AS (SELECT sp.src, sp.dst, sp.cost FROM sp JOIN r{k} AS x ON x.zone = sp.src JOIN r{k} AS y ON y.zone = sp.dst, rad, nl WHERE layer = {k} AND (layer = nl.n - 1 OR cost <= 1.5 * radius))")
        j = k + 1
        if j == LAYERS:
            break
        out.append(f"n{j} AS (SELECT src, dst, cost FROM c{k}, rad WHERE layer = {j} AND src <> dst AND cost < radius / 2)")
        out.append(f"o{j} AS (SELECT r{k}.zone, row_number() OVER (ORDER BY r{k}.zone) AS i, coalesce(any_value(l.lst), []) AS lst FROM r{k} LEFT JOIN (SELECT src, list(dst) AS lst FROM n{j} GROUP BY src) AS l ON l.src = r{k}.zone WHERE EXISTS (FROM rad WHERE layer = {j}) GROUP BY r{k}.zone)")
        out.append(f"m{j}(i, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o{j}.i, CASE WHEN list_has_any(lst, chosen) THEN chosen ELSE list_append(chosen, zone) END FROM m{j} JOIN o{j} ON o{j}.i = m{j}.i + 1)")
        out.append(f"r{j} AS (SELECT unnest(arg_max(chosen, i)) AS zone FROM m{j})")
        out.append(f"g{j} AS (SELECT zone, zone AS rep FROM r{j} UNION ALL SELECT src, arg_min(dst, (cost, dst)) FROM n{j} JOIN r{j} ON r{j}.zone = n{j}.dst WHERE src NOT IN (SELECT zone FROM r{j}) GROUP BY src)")
    sizes = " UNION ALL ".join(f"SELECT {k} AS layer, count(*) AS n FROM r{k}" for k in range(LAYERS))
    out += [
        f"sizes AS ({sizes})",
        "final AS (SELECT least((SELECT n FROM nl), coalesce((SELECT min(layer) FROM sizes WHERE layer > 1 AND n < 3), 99)) AS k)",
        "layers AS (SELECT layer, radius, CASE WHEN layer < k - 1 THEN 1.5 * radius END AS cutoff FROM rad, final WHERE layer < k)",
        "q0 AS (SELECT zone, zone AS rep FROM z)",
        *[f"q{k} AS (SELECT q{k - 1}.zone, g{k}.rep FROM q{k - 1} JOIN g{k} ON g{k}.zone = q{k - 1}.rep, final WHERE {k} < final.k)" for k in range(1, LAYERS)],
        "groups AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS layer, zone, rep FROM q{k}" for k in range(LAYERS)) + ")",
        "reps AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS layer, zone, CAST(row_number() OVER (ORDER BY zone) - 1 AS INTEGER) AS rep_idx FROM r{k}, final WHERE {k} < final.k" for k in range(LAYERS)) + ")",
        "stored AS (SELECT x.layer, sp.src, sp.dst, sp.cost FROM sp JOIN reps AS x ON x.zone = sp.src JOIN reps AS y ON y.zone = sp.dst AND y.layer = x.layer JOIN layers ON layers.layer = x.layer WHERE cutoff IS NULL OR sp.cost <= cutoff)",
        "gaps AS (SELECT x.layer, x.zone AS src, y.zone AS dst, sp.cost FROM reps AS x JOIN reps AS y ON x.layer = y.layer AND x.zone <> y.zone JOIN groups AS gx ON gx.layer = x.layer + 1 AND gx.zone = x.zone JOIN groups AS gy ON gy.layer = x.layer + 1 AND gy.zone = y.zone AND gy.rep = gx.rep JOIN sp ON sp.src = x.zone AND sp.dst = y.zone JOIN layers ON layers.layer = x.layer + 1 WHERE sp.cost <= radius AND NOT EXISTS (FROM stored WHERE stored.layer = x.layer AND stored.src = x.zone AND stored.dst = y.zone))",
        "costs AS (FROM stored UNION ALL FROM gaps)",
    ]
    return ",\n".join(out)


def _sql(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(x.strip() for x in (NET, *parts))}\n{select}"


ALL = (PATHS, _hierarchy())
FOUND = "found AS (SELECT x.zone AS src, y.zone AS dst, min_by(c.cost, c.layer) AS cost, min(c.layer) AS layer FROM groups AS x JOIN groups AS y ON x.layer = y.layer JOIN costs AS c ON c.layer = x.layer AND c.src = x.rep AND c.dst = y.rep GROUP BY ALL)"
VALUES = "vals AS (SELECT layer, src, dst, 1 / (cost + 2000) AS value FROM costs), corr AS (SELECT d.layer, d.src, d.dst, min_by(c.value, c.layer) AS correction FROM vals AS d JOIN groups AS gs ON gs.zone = d.src AND gs.layer > d.layer JOIN groups AS gd ON gd.zone = d.dst AND gd.layer = gs.layer JOIN vals AS c ON c.layer = gs.layer AND c.src = gs.rep AND c.dst = gd.rep AND c.value > 0 GROUP BY ALL)"
ACT = "act AS (SELECT l_suppkey AS zone, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS value FROM lineitem GROUP BY 1)"
# f(get_cost) is the whole operator
ACC = "acc AS (SELECT z.zone, round(coalesce(sum(act.value / (cost + 2000)), 0), 6) AS value FROM z LEFT JOIN found ON found.src = z.zone LEFT JOIN act ON act.zone = found.dst GROUP BY z.zone)"
DENSE = "dens AS (SELECT sp.src AS zone, round(sum(coalesce(act.value, 0) / (cost + 2000)), 6) AS value FROM sp LEFT JOIN act ON act.zone = sp.dst GROUP BY 1)"
EVERY = "every AS (SELECT x.k AS src, y.k AS dst FROM s AS x, s AS y)"

ORACLES = {
    "net_edges": _sql("SELECT src, dst, cost FROM e"),
    "net_adjacency": _sql("SELECT src, dst, cost FROM a"),
    "net_degree": _sql("SELECT k AS node_id, count(a.dst) AS degree FROM s LEFT JOIN a ON a.src = s.k GROUP BY k"),
    "grid_network": "WITH g AS (SELECT i, j, i * 9 + j AS id FROM range(12) AS a(i), range(9) AS b(j)) SELECT id AS src, id + 9 AS dst, CAST(500 AS DOUBLE) AS cost FROM g WHERE i < 11 UNION ALL SELECT id, id + 1, 500 FROM g WHERE j < 8",
    "range_join_edges": "WITH t AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey * 7 % 10007 AS DOUBLE) AS y FROM customer) SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS cost FROM t AS a JOIN t AS b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 22500",
    "sssp_single": _sql("SELECT src, dst, cost FROM sp WHERE src = 0", PATHS),
    "sssp_cutoff": _sql("SELECT src, dst, cost FROM sp WHERE cost <= 4500", PATHS),
    "edge_problems": _sql(
        "SELECT CAST(count(*) AS BIGINT) + (SELECT count(*) FROM e WHERE src % 5 = 0) AS edges, (SELECT count(*) FROM e WHERE src % 5 = 0) AS twice, count(*) FILTER (src % 7 = 0) AS none, count(*) FILTER (src % 7 IN (1, 2, 3)) AS bad, CAST(0 AS BIGINT) AS open FROM e"
    ),
    "components_cut": _sql(
        "SELECT n AS node, min(m) AS root FROM lab GROUP BY n",
        "cheap AS (SELECT src, dst FROM a WHERE cost < 1300)",
        "lab(n, m) AS (SELECT src, src FROM cheap UNION SELECT lab.n, cheap.dst FROM lab JOIN cheap ON cheap.src = lab.m)",
    ),
    "sssp_rounds": _sql("SELECT src, dst, cost FROM sp WHERE cost <= 6000", PATHS),
    "dense_cost": _sql("SELECT every.src, every.dst, coalesce(cost, CAST('inf' AS DOUBLE)) AS cost FROM every LEFT JOIN sp ON sp.src = every.src AND sp.dst = every.dst AND cost <= 9000", PATHS, EVERY),
    "network_extent": _sql("SELECT extent FROM ext", *ALL),
    "layer_radii": _sql("SELECT layer, CAST(radius AS DOUBLE) AS radius, CAST(cutoff AS DOUBLE) AS cutoff FROM layers", *ALL),
    "layer_costs": _sql("SELECT layer, src, dst, cost FROM costs", *ALL),
    "layer_reps": _sql("SELECT layer, zone, rep_idx FROM reps", *ALL),
    "layer_groups": _sql("SELECT layer, zone, rep FROM groups", *ALL),
    "layer_info": _sql("SELECT layer, CAST(radius AS DOUBLE) AS radius, (SELECT count(*) FROM reps WHERE reps.layer = layers.layer) AS n_representatives, CAST(cutoff AS DOUBLE) AS cutoff, (SELECT count(*) FROM costs WHERE costs.layer = layers.layer) AS n_costs FROM layers", *ALL),
    "densities": _sql("SELECT (SELECT count(*) FROM costs) / n ** 2 AS density, (SELECT count(*) FROM costs WHERE layer = 0) / n ** 2 AS finest, (SELECT count(*) FROM costs) / n ** 2 AS interaction FROM p", *ALL),
    "nesting_check": _sql("SELECT f.layer, f.rep, c.layer AS coarse_layer, count(DISTINCT c.rep) AS n FROM groups AS f JOIN groups AS c ON c.zone = f.zone AND c.layer > f.layer GROUP BY ALL HAVING n > 1", *ALL),
    "nesting_broken": _sql(
        "SELECT f.layer, f.rep, c.layer AS coarse_layer, count(DISTINCT c.rep) AS n FROM wrong AS f JOIN wrong AS c ON c.zone = f.zone AND c.layer > f.layer GROUP BY ALL HAVING n > 1",
        *ALL,
        "wrong AS (SELECT layer, zone, CASE WHEN layer = final.k - 1 AND zone % 3 = 0 THEN zone ELSE rep END AS rep FROM groups, final)",
    ),
    "nodes_explored": _sql(
        "SELECT CAST((SELECT count(*) FROM tried JOIN reps0 AS x ON x.layer = tried.layer JOIN sp ON sp.src = x.zone WHERE cutoff IS NULL OR sp.cost <= cutoff) + (SELECT count(*) FROM filled JOIN sp ON sp.src = filled.src WHERE sp.cost <= reach) AS BIGINT) AS explored",
        *ALL,
        "reps0 AS (" + " UNION ALL ".join(f"SELECT {k} AS layer, zone FROM r{k}" for k in range(LAYERS)) + ")",
        # every layer that was kept with the cutoff it was built with, and the coarsest once more if a smaller one was dropped
        "tried AS (SELECT layer, CASE WHEN layer = nl.n - 1 THEN NULL ELSE 1.5 * radius END AS cutoff FROM rad, nl, final WHERE layer < final.k UNION ALL SELECT final.k - 1, NULL FROM final, nl WHERE final.k < nl.n)",
        # searches for gaps start at every representative that lacks a pair, also one out of reach
        "lacking AS (SELECT DISTINCT x.layer, x.zone AS src, layers.radius AS reach FROM reps AS x JOIN reps AS y ON x.layer = y.layer AND x.zone <> y.zone JOIN groups AS gx ON gx.layer = x.layer + 1 AND gx.zone = x.zone JOIN groups AS gy ON gy.layer = x.layer + 1 AND gy.zone = y.zone AND gy.rep = gx.rep JOIN layers ON layers.layer = x.layer + 1 WHERE NOT EXISTS (FROM stored WHERE stored.layer = x.layer AND stored.src = x.zone AND stored.dst = y.zone))",
        "filled AS (SELECT src, reach FROM lacking)",
    ),
    "gap_fill_pairs": _sql("SELECT layer, src, dst, cost FROM gaps", *ALL),
    "get_cost_pairs": _sql("SELECT x.zone AS src, y.zone AS dst, coalesce(cost, CAST('inf' AS DOUBLE)) AS cost, layer FROM z AS x CROSS JOIN z AS y LEFT JOIN found ON found.src = x.zone AND found.dst = y.zone ", *ALL, FOUND),
    "zone_subset_costs": _sql("SELECT layer, src, dst, cost FROM costs", PATHS, _hierarchy("SELECT k AS zone FROM s WHERE k % 2 = 0")),
    "decay_power": _sql("SELECT layer, src, dst, round(2.0 * pow(1000 + cost, -1.5), 12) AS value FROM costs", *ALL),
    "decay_exponential": _sql("SELECT layer, src, dst, round(exp(-0.0005 * cost), 12) AS value FROM costs", *ALL),
    "net_operator": _sql("SELECT layer, src, dst, round(value, 12) AS value, round(correction, 12) AS correction, round(value - coalesce(correction, 0), 12) AS net FROM vals LEFT JOIN corr USING (layer, src, dst)", *ALL, VALUES),
    "without_self": _sql(
        "SELECT layer, src, dst, round(value, 12) AS value, round(correction, 12) AS correction, round(value - coalesce(correction, 0), 12) AS net FROM vals LEFT JOIN corr USING (layer, src, dst) WHERE NOT (layer = 0 AND src = dst)",
        *ALL,
        VALUES,
    ),
    "interaction_info": _sql("SELECT layer, CAST(radius AS DOUBLE) AS radius, (SELECT count(*) FROM reps WHERE reps.layer = layers.layer) AS n_representatives, (SELECT count(*) FROM vals WHERE vals.layer = layers.layer) AS n_interactions, (SELECT count(*) FROM corr WHERE corr.layer = layers.layer) AS n_corrections FROM layers", *ALL, VALUES),
    "accessibility": _sql("SELECT zone, value FROM acc", *ALL, FOUND, ACT, ACC),
    "accessibility_multi": _sql(
        "SELECT z.zone, r.rhs, round(coalesce(sum(m.value / (cost + 2000)), 0), 6) AS value FROM z CROSS JOIN (SELECT DISTINCT rhs FROM m) AS r LEFT JOIN found ON found.src = z.zone LEFT JOIN m ON m.zone = found.dst AND m.rhs = r.rhs GROUP BY ALL",
        *ALL,
        FOUND,
        "m AS (SELECT l_suppkey AS zone, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS rhs, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)",
    ),
    "interaction_row": _sql("SELECT z.zone, round(coalesce(1 / (cost + 2000), 0), 10) AS value FROM z LEFT JOIN found ON found.dst = z.zone AND found.src = 3", *ALL, FOUND),
    "top_zones": _sql("SELECT zone, value FROM acc ORDER BY value DESC, zone LIMIT 5", *ALL, FOUND, ACT, ACC),
    "accessibility_stats": _sql("SELECT round(max(value), 4) AS high, round(min(value), 4) AS low, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS spread, arg_max(zone, (value, -zone)) AS best FROM acc", *ALL, FOUND, ACT, ACC),
    "dense_accessibility": _sql("SELECT zone, value FROM dens", PATHS, ACT, DENSE),
    "approx_error": _sql("SELECT round(avg(abs(acc.value - dens.value) / dens.value), 6) AS mean_relative_error FROM acc JOIN dens USING (zone)", *ALL, FOUND, ACT, ACC, DENSE),
    "accessibility_transposed": _sql("SELECT zone, value FROM acc", *ALL, FOUND, ACT, ACC),
    "stored_hierarchy": _sql("SELECT layer, src, dst, cost FROM costs", *ALL),
    "stored_network": _sql("SELECT k AS node_id, count(a.dst) AS degree FROM s LEFT JOIN a ON a.src = s.k GROUP BY k"),
    "stored_coordinates": "SELECT s_suppkey AS zone, CAST(s_suppkey * 10 AS DOUBLE) AS x, CAST(s_suppkey + 0.5 AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 2 = 0",
    "stored_single_file": _sql("SELECT zone, value FROM acc", *ALL, FOUND, ACT, ACC),
    "generated_facts": "SELECT * FROM (VALUES ('random', CAST(150 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), true), ('large', 500, 1, 0, true), ('transport', 300, 1, 0, true)) AS t(name, n_nodes, n_components, n_wrong, complete)",
    "parquet_roundtrip": _sql("SELECT zone, value FROM acc", *ALL, FOUND, ACT, ACC),
}
