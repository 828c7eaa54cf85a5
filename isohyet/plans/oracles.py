"""The registered queries in plain SQL, written independently of the Spark plans."""

from __future__ import annotations

from isohyet.schemas import (
    HORIZONS, LAG_HOURS, LAG_MEASURES, MEASURES, RAIN_CLASSES, RAIN_LEVELS, STATIC, STATION_METADATA, TERRAIN,
    UPSTREAM_LAG_HOURS, UPSTREAM_MEASURES,
)

SPREAD = [c for c in MEASURES if c != "rain"]
PI2 = "2 * 3.141592653589793e0"


def hav(lat1, lon1, lat2, lon2):
    hl, ho = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    a = f"({hl} * {hl} + cos(radians({lat1})) * cos(radians({lat2})) * {ho} * {ho})"
    return f"(6371e0 * 2 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0e0))))"


def num(expr, name=None):
    """A double for output: six decimals, no negative zero."""
    r = f"(round_even(CAST({expr} AS DOUBLE) * 1e6, 0) / 1e6)"
    return f"CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END AS {name or expr}"


def nums(names):
    return ", ".join(num(n) for n in names)


def place(key, first, second):
    return (f"32 + ({key} * {key} * {first} + {key} * 31) % 10007 / 10007e0",
            f"35 + ({key} * {second} + 5) % 10009 / 10009e0")


def statics(k, lon):
    return (f"(({k} * 37) % 100) * 1e1 - 5e1 AS elevation, (({k} * 13) % 64) / 4e0 - 8e0 AS tpi_local, "
            f"(({k} * 29) % 128) / 4e0 - 16e0 AS tpi_regional, (({k} * 7) % 32) / 2e0 + 1e0 AS roughness_local, "
            f"(({k} * 11) % 64) / 2e0 + 2e0 AS roughness_regional, ({lon} - 34.95e0) * 93 AS dist_to_coast")


V: dict[str, str] = {}  # views by name; each may use the ones before it

V["readings"] = """
SELECT event_id, user_id // 5 + 1 AS station_id, ts,
  CASE WHEN event_type = 'purchase' THEN floor(value) / 4e0
       WHEN event_type = 'error' AND k < 20 THEN -59994e0 ELSE 0e0 END AS rain,
  CASE WHEN event_type = 'signup' AND k < 10 THEN -1e0 ELSE floor(value) / 2e0 END AS ws,
  k * 3.6e0 AS wd, k % 20 + 10 AS td, k * 1.25e0 - 3 AS rh,
  k % 20 + 10 + event_id % 3 - 0.5e0 AS tdmax, k % 20 + 10 - event_id % 4 + 0.5e0 AS tdmin
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k FROM events)"""
_lat, _lon = place("station_id", 7919, 4639)
V["stations"] = f"""
SELECT *, {statics('station_id', 'longitude')}
FROM (SELECT station_id, {_lat} AS latitude, {_lon} AS longitude
      FROM (SELECT DISTINCT user_id // 5 + 1 AS station_id FROM events))"""
_lat, _lon = place("cell_id", 6101, 3571)
V["cells"] = f"""
SELECT *, {statics('cell_id', 'lon')}
FROM (SELECT cell_id, {_lat} AS lat, {_lon} AS lon FROM (SELECT s_suppkey + 1 AS cell_id FROM supplier))"""
_lat, _lon = place("cell_id", 3889, 7253)
V["points"] = f"SELECT cell_id, {_lat} AS lat, {_lon} AS lon FROM (SELECT c_custkey + 1 AS cell_id FROM customer)"
V["ranged"] = """
SELECT *, -ws * sin(radians(wd)) AS u_vec, -ws * cos(radians(wd)) AS v_vec FROM (
  SELECT event_id, station_id, ts, CASE WHEN rain >= 0 THEN rain END AS rain, CASE WHEN ws >= 0 THEN ws END AS ws, wd,
         td, CASE WHEN rh >= 0 AND rh <= 100 THEN rh END AS rh, tdmax, tdmin FROM readings)"""
_AGG = """coalesce(sum(rain), 0) AS rain, avg(ws) AS ws, avg(td) AS td, avg(rh) AS rh, max(tdmax) AS tdmax,
  min(tdmin) AS tdmin, avg(u_vec) AS u_vec, avg(v_vec) AS v_vec"""
V["rollup"] = f"SELECT station_id, date_trunc('hour', ts) AS hour, {_AGG} FROM ranged GROUP BY ALL"


def cleaned(source, step, unit, limit=2):
    """Spine, gap fill and repair over a roll-up (station_id, hour, measures)."""
    back = "OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    look = ", ".join(
        f"last_value({c} IGNORE NULLS) {back} AS pv_{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) {back} AS pi_{c}, "
        f"first_value({c} IGNORE NULLS) {ahead} AS nv_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) {ahead} AS ni_{c}" for c in SPREAD)
    fill = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pi_{c} IS NULL OR i - pi_{c} > {limit} THEN NULL "
        f"WHEN ni_{c} IS NULL THEN pv_{c} "
        f"ELSE pv_{c} + (nv_{c} - pv_{c}) * (i - pi_{c}) / (ni_{c} - pi_{c}) END AS {c}" for c in SPREAD)
    return f"""
SELECT station_id, hour, h, rain, ws, td, rh, CASE WHEN td > tdmax THEN td ELSE tdmax END AS tdmax,
       CASE WHEN td < tdmin THEN td ELSE tdmin END AS tdmin, u_vec, v_vec
FROM (SELECT station_id, hour, CAST(epoch(hour) / 3600 AS BIGINT) AS h, rain, {fill}
  FROM (SELECT *, {look}
    FROM (SELECT s.station_id, s.hour, CAST(epoch(s.hour) / {step} AS BIGINT) AS i, coalesce(r.rain, 0) AS rain,
                 {', '.join('r.' + c for c in SPREAD)}
      FROM (SELECT station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 {unit})) AS hour
            FROM {source} GROUP BY station_id) s
      LEFT JOIN {source} r ON r.station_id = s.station_id AND r.hour = s.hour)))"""


V["clean"] = cleaned("rollup", 3600, "HOUR")


def candidates(targets, key, lat, lon, k, exclude_self=False, where="TRUE"):
    me = f"AND t.{key} <> s.station_id" if exclude_self else ""
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance_km, station_id) AS rank FROM (
    SELECT t.{key} AS target, t.{lat} AS lat, t.{lon} AS lon, s.station_id, s.latitude, s.longitude,
           {hav(f't.{lat}', f't.{lon}', 's.latitude', 's.longitude')} AS distance_km
    FROM {targets} t, stations s WHERE {where} {me})) WHERE rank <= {k}"""


def triangles(cand, group="target"):
    """Best enclosing trio, or the three nearest, from (target, rank, ...) candidate rows."""
    def side(a, b):
        return (f"((a.lat - {b}.latitude) * ({a}.longitude - {b}.longitude) "
                f"- ({a}.latitude - {b}.latitude) * (a.lon - {b}.longitude))")
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    neg, pos = " OR ".join(f"{x} < 0" for x in s), " OR ".join(f"{x} > 0" for x in s)
    on = " AND ".join(f"a.{g.strip()} = {{0}}.{g.strip()}" for g in group.split(","))
    cols = ", ".join(f"a.{g.strip()} AS {g.strip()}" for g in group.split(","))
    pick = ", ".join(f"{x}.station_id AS n{i}, {x}.distance_km AS d{i}" for i, x in enumerate("abc", 1))
    return f"""
SELECT {group}, lat, lon, boundary AS is_boundary, n1 AS neighbor_1_id, n2 AS neighbor_2_id, n3 AS neighbor_3_id,
       d1 AS neighbor_1_distance, d2 AS neighbor_2_distance, d3 AS neighbor_3_distance
FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY boundary, d1 + d2 + d3, r1, r2, r3) AS pick
  FROM (
    SELECT {cols}, a.lat AS lat, a.lon AS lon, {pick}, a.rank AS r1, b.rank AS r2, c.rank AS r3,
           (({neg}) AND ({pos})) AS boundary
    FROM {cand} a JOIN {cand} b ON {on.format('b')} AND a.rank < b.rank
    JOIN {cand} c ON {on.format('c')} AND b.rank < c.rank)
  WHERE NOT boundary OR (r1 = 1 AND r2 = 2 AND r3 = 3)) WHERE pick = 1"""


V["cell_cand"] = candidates("cells", "cell_id", "lat", "lon", 10)
V["cell_tri"] = triangles("cell_cand")
V["neighbors"] = "SELECT c.*, t.* EXCLUDE (target, lat, lon) FROM cells c JOIN cell_tri t ON t.target = c.cell_id"
V["near"] = " UNION ALL ".join(
    f"SELECT cell_id, {i} AS rank, neighbor_{i}_id AS station_id, neighbor_{i}_distance AS d FROM neighbors"
    for i in (1, 2, 3))


def side_by_side(near):
    return ("SELECT n.cell_id, c.hour, c.h, " + ", ".join(
        f"max(CASE WHEN rank = {i} THEN c.{m} END) AS {m}_n{i}" for i in (1, 2, 3) for m in MEASURES
    ) + ", " + ", ".join(f"max(CASE WHEN rank = {i} THEN d END) AS d{i}" for i in (1, 2, 3))
        + f" FROM {near} n JOIN clean c ON c.station_id = n.station_id GROUP BY ALL")


# a neighbour may be silent in an hour: its distance comes from the neighbour table
V["series"] = "SELECT s.* EXCLUDE (d1, d2, d3), neighbor_1_distance AS d1, neighbor_2_distance AS d2, " \
    "neighbor_3_distance AS d3 FROM (" + side_by_side("near") + ") s JOIN neighbors USING (cell_id)"


def idw_sql(m):
    num_, den = "0e0", "0e0"
    for i in (1, 2, 3):
        num_ += f" + coalesce({m}_n{i} / nullif(d{i}, 0), 0e0)"
        den += f" + CASE WHEN {m}_n{i} IS NOT NULL THEN coalesce(1 / nullif(d{i}, 0), 0e0) ELSE 0e0 END"
    exact = ", ".join(f"CASE WHEN d{i} = 0 THEN {m}_n{i} END" for i in (1, 2, 3))
    return f"coalesce({exact}, ({num_}) / nullif({den}, 0))"


V["idw_raw"] = f"SELECT cell_id, hour, h, {', '.join(f'{idw_sql(m)} AS {m}' for m in MEASURES)} FROM series"
V["grid"] = """
SELECT cell_id, hour, h, CASE WHEN rain < 0.01e0 THEN 0e0 ELSE rain END AS rain, CASE WHEN ws < 0 THEN 0e0 ELSE ws END AS ws, td,
       CASE WHEN rh > 100 THEN 100e0 WHEN rh < 0 THEN 0e0 ELSE rh END AS rh, tdmax, tdmin, u_vec, v_vec FROM idw_raw"""
_LAGGED = [f"{c}_t-{n}h" for c in LAG_MEASURES for n in LAG_HOURS]
V["lagged"] = "SELECT g.*, " + ", ".join(
    f'l{n}.{c} AS "{c}_t-{n}h"' for c in LAG_MEASURES for n in LAG_HOURS
) + " FROM grid g " + " ".join(f"LEFT JOIN grid l{n} ON l{n}.cell_id = g.cell_id AND l{n}.h = g.h - {n}" for n in LAG_HOURS)
_UP = {"west": 1, "north": 3}


def upstream(base):
    """Upstream columns beside a base with cell_id, h, u_vec, v_vec."""
    cols, joins = [], []
    for name, sid in _UP.items():
        for n in [0, *UPSTREAM_LAG_HOURS]:
            lag, a, b = ("" if n == 0 else f"_t-{n}h"), f"{name}{n}", f"own{n}"
            joins.append(f"LEFT JOIN clean {a} ON {a}.station_id = {sid} AND {a}.h = g.h - {n}")
            cols += [f'{a}.{c} AS "{c}_{name}{lag}"' for c in UPSTREAM_MEASURES]
            cols.append(f'{a}.u_vec * {a}.rh AS "moisture_flux_{name}{lag}"')
            cols += [f'{a}.{x}_vec - {b}.{x}_vec AS "{x}_convergence_{name}{lag}"' for x in "uv"]
    joins += [f"LEFT JOIN grid own{n} ON own{n}.cell_id = g.cell_id AND own{n}.h = g.h - {n}" for n in [0, *UPSTREAM_LAG_HOURS]]
    return f"SELECT g.*, {', '.join(cols)} FROM {base} g {' '.join(joins)}"


_UPCOLS = [f"{c}_{name}{'' if n == 0 else f'_t-{n}h'}" for name in _UP for n in [0, *UPSTREAM_LAG_HOURS]
           for c in [*UPSTREAM_MEASURES, "moisture_flux", "u_convergence", "v_convergence"]]
V["upstreamed"] = upstream("lagged")


def calendar(ts):
    local = f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem')"
    month = f"({PI2} * month({local}) / 12)"
    day = f"({PI2} * dayofyear({local}) / dayofyear(make_date(year({local}), 12, 31)))"
    return ", ".join(num(e, n) for e, n in (
        (f"sin{month}", "month_sin"), (f"cos{month}", "month_cos"), (f"sin{day}", "day_sin"), (f"cos{day}", "day_cos")))


V["pixels"] = """
SELECT p_partkey // 50 // 40 AS tile, (p_partkey // 50) % 40 AS "row", p_partkey % 50 AS col,
       CASE WHEN p_size <> 13 THEN p_size * 10 END AS elev FROM part"""


def box(r, name):
    return f"""
SELECT p.tile, p."row", p.col, any_value(p.elev) AS elev, avg(q.elev) AS mean_{name}, stddev_pop(q.elev) AS std_{name}
FROM pixels p JOIN pixels q ON q.tile = p.tile AND q."row" BETWEEN p."row" - {r} AND p."row" + {r}
 AND q.col BETWEEN p.col - {r} AND p.col + {r} WHERE p.elev IS NOT NULL GROUP BY ALL"""


V["box3"] = box(3, "local")
V["box7"] = box(7, "regional")
V["terrain"] = """
SELECT tile, "row", col, CAST(a.elev AS DOUBLE) AS elevation, a.elev - mean_local AS tpi_local, std_local AS roughness_local,
       a.elev - mean_regional AS tpi_regional, std_regional AS roughness_regional
FROM box3 a JOIN box7 b USING (tile, "row", col)"""
V["lattice"] = """
SELECT p_partkey // 50 AS lat_idx, p_partkey % 50 AS lon_idx, round(32.2e0 + (p_partkey // 50) / 100e0, 6) AS lat,
       round(35.1e0 + (p_partkey % 50) / 100e0, 6) AS lon, floor(p_retailprice) AS dist FROM part"""
V["forecasts"] = """
SELECT cell_id, CASE WHEN cell_id % 13 = 0 THEN hour - INTERVAL 1 HOUR ELSE hour END AS hour, rain * 0.875e0 AS precipitation_t1,
       rain * 0.75e0 AS precipitation_t3, rain * 0.5e0 AS precipitation_t6, rain * 0.25e0 AS precipitation_t12
FROM (SELECT cell_id, hour, rain, row_number() OVER (PARTITION BY cell_id ORDER BY hour DESC) AS rn FROM grid) WHERE rn = 1"""
V["stored"] = """
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1"""
V["closest"] = "SELECT target AS station_id, station_id AS cell_id, distance_km FROM (" + (
    "SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance_km, station_id) AS rank FROM ("
    "SELECT s.station_id AS target, c.cell_id AS station_id, "
    + hav("s.latitude", "s.longitude", "c.lat", "c.lon") + " AS distance_km FROM stations s, cells c)) WHERE rank = 1")
V["pairs"] = """
SELECT a.station_id, g.cell_id, o.hour, o.h, z.horizon, g.rain AS forecast, o.rain AS observed
FROM grid g CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS horizon) z JOIN closest a ON a.cell_id = g.cell_id
JOIN clean o ON o.station_id = a.station_id AND o.h = g.h + z.horizon"""


def persist(m):
    return f"""
SELECT o.station_id, o.hour, o.h, z.horizon, p.{m} AS forecast, o.{m} AS observed
FROM clean o CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS horizon) z
LEFT JOIN clean p ON p.station_id = o.station_id AND p.h = o.h - z.horizon"""


V["persisted"] = persist("rain")


def views_for(body: str) -> list[str]:
    """Names of the views that a query needs, in order."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in V:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(V[name])
    return [n for n in V if n in need]


def query(body: str, **extra: str) -> str:
    names = views_for(body + " ".join(extra.values()))
    parts = [f"{n} AS MATERIALIZED ({V[n]})" for n in names] + [f"{n} AS MATERIALIZED ({t})" for n, t in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _error_cols(prefix, where):
    e = "(forecast - observed)"
    f = f"FILTER (WHERE {where} AND {e} IS NOT NULL)"
    rmse = f"sqrt(avg({e} * {e}) {f})"
    return ", ".join([
        f"count(*) {f} AS {prefix}n", num(f"avg(abs({e})) {f}", f"{prefix}mae"), num(rmse, f"{prefix}rmse"),
        num(f"avg({e}) {f}", f"{prefix}bias"), num(f"{rmse} / nullif(avg(observed) {f}, 0)", f"{prefix}scatter")])


def _scores(source, by):
    return f"SELECT {by}, {_error_cols('', 'TRUE')}, {_error_cols('event_', 'observed >= 0.1e0')} FROM {source} GROUP BY {by}"


def _band(x):
    cases = " ".join(f"WHEN {x} < {u!r}e0 THEN {i}" for i, u in enumerate(RAIN_LEVELS, -1))
    return f"CASE {cases} WHEN {x} >= {RAIN_LEVELS[-1]!r}e0 THEN {len(RAIN_LEVELS) - 1} END"


def _class(x):
    cases = " ".join(f"WHEN {x} < {hi!r}e0 THEN '{n}'" for (n, _), (_, hi) in zip(RAIN_CLASSES, RAIN_CLASSES[1:]))
    return f"CASE {cases} WHEN {x} IS NOT NULL THEN '{RAIN_CLASSES[-1][0]}' END"


def _skill(prefix, where):
    f = f"FILTER (WHERE {where} AND forecast IS NOT NULL AND persistence IS NOT NULL)"
    a = f"sqrt(avg((forecast - observed) * (forecast - observed)) {f})"
    b = f"sqrt(avg((persistence - observed) * (persistence - observed)) {f})"
    return (f"count(*) {f} AS {prefix}n, {num(a, prefix + 'rmse')}, {num(b, prefix + 'baseline_rmse')}, "
            f"{num(f'1 - {a} / nullif({b}, 0)', prefix + 'skill')}")


_OBS = """
SELECT station_id, event_id % 7 <> 0 AS ok, event_id % 11 = 0 AS twice, date_trunc('second', ts) AS ts, rain, ws, wd, td, rh, tdmax, tdmin
FROM readings"""
_FLAT = """CASE WHEN twice THEN rain + 1 WHEN ok THEN rain END"""
_TRI = ["neighbor_1_distance", "neighbor_2_distance", "neighbor_3_distance"]
_IDS = "neighbor_1_id, neighbor_2_id, neighbor_3_id"


def _statics_sql(terrain, more=""):
    names = [*STATIC, *(TERRAIN if terrain else [])]
    cols = ", ".join([f"c.{n} AS {n}_target" for n in names] + [f"s{i}.{n} AS {n}_n{i}" for i in (1, 2, 3) for n in names])
    joins = " ".join(f"JOIN stations s{i} ON s{i}.station_id = c.neighbor_{i}_id" for i in (1, 2, 3))
    return cols, joins


def _static_names(terrain=True):
    return [f"{n}_{t}" for t in ("target", "n1", "n2", "n3") for n in [*STATIC, *(TERRAIN if terrain else [])]]


def _bearing(a, b, c, d):
    dl = f"radians({d} - {b})"
    e = f"sin({dl}) * cos(radians({c}))"
    n = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})"
    t = f"degrees(atan2({e}, {n}))"
    return f"CASE WHEN {t} < 0 THEN {t} + 360 ELSE {t} END"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["flatten_observations"] = query(f"""
SELECT station_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00' AS "timestamp", {num(_FLAT, 'rain')},
  {num('ws')}, {num('CASE WHEN ok THEN wd END', 'wd')}, {num('td')}, {num('CASE WHEN ok THEN rh END', 'rh')}, {num('tdmax')},
  {num('tdmin')}, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in ('wsmax', 'wdmax', 'stdwd', 'ws1mm', 'ws10mm'))}
FROM ({_OBS})""")
    q["normalize_time"] = query(f"""
SELECT station_id, ts, {num(_FLAT, 'rain')}, {num('ws')}, {num('CASE WHEN ok THEN wd END', 'wd')}, {num('td')},
  {num('CASE WHEN ok THEN rh END', 'rh')}, {num('tdmax')}, {num('tdmin')} FROM ({_OBS})""")
    q["station_catalog"] = f"""
SELECT id AS station_id, n AS name, replace(n, ' ', '_') AS file_name, {num('id / 4e0', 'latitude')}, {num('id / 8e0', 'longitude')}
FROM (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS n FROM region UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name FROM nation
      UNION ALL SELECT c_custkey + 1000, c_mktsegment || ' post' FROM customer) WHERE NOT regexp_matches(n, '[0-9]')"""
    q["range_rules"] = query(f"SELECT event_id, station_id, ts, {nums(['rain', 'ws', 'wd', 'td', 'rh', 'tdmax', 'tdmin'])} FROM ranged")
    q["wind_components"] = query(f"SELECT event_id, {nums(['u_vec', 'v_vec'])} FROM ranged")
    q["hourly_rollup"] = query(f"SELECT station_id, hour, {nums(MEASURES)} FROM rollup")
    q["hourly_spine"] = query(f"SELECT station_id, hour, {num('rain')}, {num('td')} FROM nofill", nofill=cleaned("rollup", 3600, "HOUR", 0))
    body = V["clean"]
    unrepaired = body.replace("CASE WHEN td > tdmax THEN td ELSE tdmax END AS tdmax", "tdmax").replace(
        "CASE WHEN td < tdmin THEN td ELSE tdmin END AS tdmin", "tdmin")
    q["gap_fill"] = query(f"SELECT station_id, hour, {nums(MEASURES)} FROM filled", filled=unrepaired)
    q["hourly_clean"] = query(f"SELECT station_id, hour, {nums(MEASURES)} FROM clean")
    daily = f"""
SELECT station_id, hour, {_AGG} FROM (
  SELECT *, -ws * sin(radians(wd)) AS u_vec, -ws * cos(radians(wd)) AS v_vec FROM (
    SELECT l_suppkey + 1 AS station_id, date_trunc('day', l_shipdate) AS hour, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END AS rain,
      l_quantity / 2 AS ws, l_linenumber * 45e0 AS wd, l_quantity AS td, CASE WHEN l_quantity * 2.5e0 <= 100 THEN l_quantity * 2.5e0 END AS rh,
      l_quantity + l_linenumber - 2 AS tdmax, l_quantity - l_linenumber + 2 AS tdmin FROM lineitem)) GROUP BY ALL"""
    q["daily_clean"] = query(f"SELECT station_id, CAST(hour AS TIMESTAMP) AS hour, {nums(MEASURES)} FROM d",
                             daily=daily, d=cleaned("daily", 86400, "DAY"))
    q["insert_ignore"] = query(f"""
SELECT o_custkey, o_orderdate, o_orderkey, {num('o_totalprice')} FROM stored UNION ALL
SELECT o_custkey, o_orderdate, o_orderkey, {num('o_totalprice')} FROM
 (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-12-25' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1) b
WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.o_custkey = b.o_custkey AND t.o_orderdate = b.o_orderdate)""")
    q["upsert_latest"] = f"""
SELECT o_custkey, o_orderdate, o_orderkey, {num('o_totalprice')} FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate >= TIMESTAMP '2000-01-01' DESC, o_orderkey DESC) = 1"""
    q["snapshot_upsert"] = q["upsert_latest"]
    q["retention_trim"] = query(f"SELECT station_id, hour, {nums(MEASURES)} FROM clean WHERE hour >= TIMESTAMP '2024-01-31 00:20:00' - INTERVAL 27 HOUR")
    q["backfill_manifest"] = """
SELECT s_name AS station_name, s_suppkey AS station_id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS total_rows
FROM supplier WHERE NOT s_acctbal < 2000"""
    cols = "event_id, station_id, ts, " + nums(["rain", "ws", "wd", "td", "rh", "tdmax", "tdmin"])
    q["incremental_filter"] = query(f"""
SELECT {cols} FROM readings r LEFT JOIN (
  SELECT station_id AS sid, max(date_trunc('hour', ts)) AS mark FROM readings
  WHERE ts < TIMESTAMP '2024-01-01' + (station_id % 20 + 4) * INTERVAL 1 DAY GROUP BY ALL) m ON m.sid = r.station_id
WHERE mark IS NULL OR date_trunc('hour', ts) > mark""")
    q["incremental_filter_global"] = query(f"""
SELECT {cols} FROM readings WHERE ts > (SELECT max(date_trunc('hour', ts)) FROM readings WHERE ts < TIMESTAMP '2024-01-20')""")
    q["closed_hours"] = query(f"SELECT station_id, hour, {nums(MEASURES)} FROM rollup WHERE hour < TIMESTAMP '2024-01-30 22:00:00'")
    q["required_stations"] = query("SELECT station_id FROM near UNION SELECT 1 UNION SELECT 3")
    st = nums(["latitude", "longitude", "elevation", *TERRAIN, "dist_to_coast"])
    q["active_stations"] = query(f"SELECT station_id, {st} FROM stations WHERE station_id <> 2 AND station_id IN (SELECT station_id FROM clean WHERE rain > 20)")
    q["grid_cells"] = query(f"""
SELECT CAST(i * 101 + j + 1 AS BIGINT) AS cell_id, {num('32e0 + i * 0.01e0', 'lat')}, {num('35e0 + j * 0.01e0', 'lon')}, count(*) AS points
FROM (SELECT floor((lat - 32e0) / 0.01e0 + 0.5e0) AS i, floor((lon - 35e0) / 0.01e0 + 0.5e0) AS j FROM points) GROUP BY i, j""")
    q["haversine_pairs"] = query(f"""
SELECT l_orderkey, l_linenumber, c.cell_id AS to_id, {num(hav('p.lat', 'p.lon', 'c.lat', 'c.lon'), 'distance_km')}
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN points p ON p.cell_id = o_custkey + 1 JOIN cells c ON c.cell_id = l_suppkey + 1""")
    q["knn_join"] = query(f"SELECT target AS cell_id, CAST(rank AS INTEGER) AS rank, station_id, {num('distance_km')} FROM pc",
                          pc=candidates("points", "cell_id", "lat", "lon", 10))
    q["triangle_neighbors"] = query(f"SELECT target AS cell_id, {nums(['lat', 'lon'])}, is_boundary, {_IDS}, {nums(_TRI)} FROM t",
                                    pc=candidates("points", "cell_id", "lat", "lon", 10), t=triangles("pc"))
    q["station_neighbors"] = query(f"SELECT target AS station_id, {nums(['lat', 'lon'])}, is_boundary, {_IDS}, {nums(_TRI)} FROM t",
                                   pc=candidates("stations", "station_id", "latitude", "longitude", 10, True, "s.station_id <> 2"), t=triangles("pc"))
    fold = """SELECT f.station_id AS fold, a.target, a.lat, a.lon, a.station_id, a.latitude, a.longitude, a.distance_km,
  row_number() OVER (PARTITION BY f.station_id, a.target ORDER BY a.rank) AS rank
FROM pc f JOIN pc a ON a.target = f.target AND a.station_id <> f.station_id WHERE f.rank <= 10"""
    q["leave_location_out"] = query(f"SELECT fold, target AS station_id, {nums(['lat', 'lon'])}, is_boundary, {_IDS}, {nums(_TRI)} FROM t",
                                    pc=candidates("stations", "station_id", "latitude", "longitude", 11, True), folds=fold,
                                    t=triangles("folds", "fold, target"))
    q["available_cells"] = query(f"""
SELECT cell_id, {_IDS} FROM neighbors WHERE cell_id NOT IN (
  SELECT cell_id FROM near WHERE station_id NOT IN (SELECT station_id FROM clean WHERE rain > 30))""")
    q["neighbor_features"] = query(f"SELECT cell_id, {_IDS}, hour, {nums([f'{m}_n{i}' for i in (1, 2, 3) for m in MEASURES])} FROM series JOIN neighbors USING (cell_id)")
    cols, joins = _statics_sql(True)
    q["static_features"] = query(f"""
SELECT cell_id, {nums(['lat', 'lon'])}, is_boundary, {_IDS}, {nums(_static_names())}, {', '.join(num(f'neighbor_{i}_distance', f'dist_n{i}') for i in (1, 2, 3))}
FROM (SELECT c.cell_id, c.lat, c.lon, c.is_boundary, {_IDS}, {', '.join(_TRI)}, {cols} FROM neighbors c {joins})""")
    q["bearing_elevation"] = query(f"""
SELECT c.cell_id, {', '.join(num(f's{i}.elevation - c.elevation', f'elevation_diff_n{i}') for i in (1, 2, 3))},
  {', '.join(num(_bearing(f's{i}.latitude', f's{i}.longitude', 'c.lat', 'c.lon'), f'bearing_n{i}') for i in (1, 2, 3))} FROM neighbors c {joins}""")
    q["interpolation_features"] = query(f"""
SELECT cell_id, {_IDS}, hour, {nums([f'{m}_n{i}' for i in (1, 2, 3) for m in MEASURES])}, {nums(_static_names())},
  {', '.join(num(f'd{i}', f'dist_n{i}') for i in (1, 2, 3))}, {calendar('hour')}
FROM series JOIN (SELECT c.cell_id, {_IDS}, {cols} FROM neighbors c {joins}) USING (cell_id)""")
    q["idw_grid"] = query(f"SELECT cell_id, hour, {nums(MEASURES)} FROM grid")
    q["cyclic_time"] = f"SELECT o_orderkey, o_orderdate AS hour, {calendar('o_orderdate')} FROM orders"
    lagcols = ", ".join(num(f'"{c}"') for c in _LAGGED)
    upcols = ", ".join(num(f'"{c}"') for c in _UPCOLS)
    q["local_lags"] = query(f"SELECT cell_id, hour, {nums(LAG_MEASURES)}, {lagcols} FROM lagged")
    q["upstream_features"] = query(f"SELECT cell_id, hour, {nums(['u_vec', 'v_vec'])}, {upcols} FROM u", u=upstream("grid"))
    q["forecast_features"] = query(f"""
SELECT cell_id, hour, {nums(MEASURES)}, {lagcols}, {upcols}, {calendar('hour')}
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY h) AS rn FROM upstreamed) WHERE rn > 24""")
    q["neighbor_lags"] = query("SELECT c.station_id, c.hour, " + ", ".join(num(f"c.{m}", m) for m in ("rain", "td")) + ", " + ", ".join(
        num(f"l{n}.{m}", f'"{m}_t-{n}h"') for m in ("rain", "td") for n in (1, 2, 3)) + " FROM clean c " + " ".join(
        f"LEFT JOIN clean l{n} ON l{n}.station_id = c.station_id AND l{n}.h = c.h - {n}" for n in (1, 2, 3)))
    q["latest_per_cell"] = query(f"SELECT cell_id, hour, {nums(MEASURES)} FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY hour DESC) AS rn FROM grid) WHERE rn = 1")
    rect = f"{num('lat')}, {num('lon')}, {num('lat - 0.005e0', 'south')}, {num('lon - 0.005e0', 'west')}, {num('lat + 0.005e0', 'north')}, {num('lon + 0.005e0', 'east')}"
    q["now_layer"] = query(f"""
SELECT cell_id, hour, {num('rain')}, {rect}, CAST({_band('rain')} AS INTEGER) AS band
FROM grid JOIN (SELECT cell_id, lat, lon FROM cells) USING (cell_id) WHERE hour = (SELECT max(hour) FROM grid)""")
    q["forecast_layer"] = query(f"""
SELECT cell_id, hour, CAST(date_diff('hour', hour, (SELECT max(hour) FROM forecasts)) AS INTEGER) AS hours_behind, horizon, {num('rain')}, {rect},
  CAST({_band('rain')} AS INTEGER) AS band
FROM ({' UNION ALL '.join(f'SELECT cell_id, hour, {n} AS horizon, precipitation_t{n} AS rain FROM forecasts' for n in HORIZONS)})
JOIN (SELECT cell_id, lat, lon FROM cells) USING (cell_id)""")
    q["time_index"] = query("SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS idx FROM (SELECT DISTINCT hour FROM grid)")
    page = "SELECT hour, cell_id, " + num("rain") + ", idx FROM grid JOIN (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS idx FROM (SELECT DISTINCT hour FROM grid)) USING (hour) WHERE idx = "
    q["demo_page"] = query(page + "101")
    q["demo_page_end"] = query(page + "(SELECT count(DISTINCT hour) - 1 FROM grid)")
    q["horizon_times"] = """
SELECT o_orderkey, o_orderdate AS hour, horizon, CASE WHEN horizon = 0 THEN 'Now' ELSE 't+' || horizon || 'h' END AS label,
  strftime(t, '%Y-%m-%d %H:%M') AS local_time, strftime(t, '%H:%M') AS clock, strftime(t, '%a') AS day
FROM (SELECT o_orderkey, o_orderdate, horizon, ((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem') + horizon * INTERVAL 1 HOUR AS t
      FROM orders CROSS JOIN (SELECT unnest([0, 1, 3, 6, 12]) AS horizon))"""
    q["text_times"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stored,
  strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem', '%Y-%m-%d %H:%M') AS local FROM events"""
    q["rain_bands"] = query(f"SELECT event_id, CAST({_band('rain')} AS INTEGER) AS band, {_class('rain')} AS rain_class FROM readings")
    miss = ["rain", "ws", "td", "rh"]
    q["missingness_report"] = query(f"""
SELECT station_id, n, {nums([m + '_missing' for m in miss])}, greatest({', '.join(m + '_missing' for m in miss)}) <= 0.4e0 AS kept
FROM (SELECT station_id, count(*) AS n, {', '.join(f'avg(CASE WHEN {m} IS NULL THEN 1e0 ELSE 0e0 END) AS {m}_missing' for m in miss)}
      FROM (SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN td END AS td) FROM ranged) GROUP BY station_id)""")
    rules = {"negative_rain": "rain < 0", "rh_out_of_range": "rh < 0 OR rh > 100", "negative_ws": "ws < 0",
             "too_hot": "td > 25 OR tdmax > 25 OR tdmin > 25", "td_above_tdmax": "td > tdmax", "td_below_tdmin": "td < tdmin",
             **{f"{m}_null": f"{m} IS NULL" for m in ("rain", "ws", "wd", "td", "rh", "tdmax", "tdmin")}}
    q["quality_report"] = query(" UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {c}) AS n_bad, count(*) AS n FROM readings" for r, c in rules.items()))
    q["longest_segment"] = query("""
SELECT station_id, hours, start_hour, end_hour, end_hour = (SELECT max(hour) FROM clean) AS ends_at_end FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY hours DESC, end_hour DESC) AS rn FROM (
    SELECT station_id, count(*) AS hours, min(hour) AS start_hour, max(hour) AS end_hour
    FROM (SELECT station_id, hour, h - row_number() OVER (PARTITION BY station_id ORDER BY hour) AS island FROM clean
          WHERE td IS NOT NULL AND ws IS NOT NULL) GROUP BY station_id, island)) WHERE rn = 1""")
    ahead = {n: f"max(rain) OVER (PARTITION BY cell_id ORDER BY h RANGE BETWEEN {n} FOLLOWING AND {n} FOLLOWING)" for n in HORIZONS}
    q["targets_by_horizon"] = query(f"SELECT cell_id, hour, {num('rain')}, " + ", ".join(
        num(ahead[n], f"target_t{n}") for n in HORIZONS) + " FROM grid")
    q["nearest_cell"] = query(f"""
SELECT station_id, cell_id, {num('d', 'distance_km')} FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, cell_id) AS rn FROM (
    SELECT s.station_id, p.cell_id, {hav('s.latitude', 's.longitude', 'p.lat', 'p.lon')} AS d FROM stations s, points p)) WHERE rn = 1""")
    q["verification_pairs"] = query(f"SELECT station_id, cell_id, hour, horizon, {nums(['forecast', 'observed'])} FROM pairs")
    q["forecast_errors"] = query(_scores("pairs", "horizon"))
    q["persistence_forecast"] = query(f"SELECT station_id, hour, horizon, {nums(['forecast', 'observed'])} FROM persisted")
    q["persistence_skill"] = query(f"""
SELECT horizon, {_skill('', 'observed IS NOT NULL')}, {_skill('event_', 'observed >= 0.1e0')}
FROM (SELECT p.*, b.forecast AS persistence FROM pairs p JOIN persisted b USING (station_id, h, horizon)) GROUP BY horizon""")
    q["event_scores"] = query(f"""
SELECT horizon, hits, misses, false_alarms, {num('missed_mm')}, {num('hits / nullif(hits + misses, 0)', 'recall')},
  {num('hits / nullif(hits + false_alarms, 0)', '"precision"')}, {num('2 * hits / nullif(2 * hits + misses + false_alarms, 0)', 'f1')}
FROM (SELECT horizon, count(*) FILTER (WHERE forecast >= 0.1e0 AND observed >= 0.1e0) AS hits,
        count(*) FILTER (WHERE forecast < 0.1e0 AND observed >= 0.1e0) AS misses,
        count(*) FILTER (WHERE forecast >= 0.1e0 AND observed < 0.1e0) AS false_alarms,
        avg(observed) FILTER (WHERE forecast < 0.1e0 AND observed >= 0.1e0) AS missed_mm
      FROM persisted GROUP BY horizon)""")
    q["rain_class_weights"] = query(f"""
SELECT rain_class, n, {num('n / total', 'share')}, {num('total / (6 * n)', 'weight')}
FROM (SELECT *, sum(n) OVER () AS total FROM (SELECT {_class('rain')} AS rain_class, count(*) AS n FROM clean GROUP BY ALL))""")
    feats = [f"{c}_t-{n}h" for c in ("rain", "td", "rh") for n in (1, 6, 24)]
    q["lag_correlation"] = query(" UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {n} AS horizon, count("{f}") FILTER (WHERE target_t{n} IS NOT NULL) AS n, {num(f'corr("{f}", target_t{n})', 'corr')} FROM lt"""
        for f in feats for n in HORIZONS), lt="SELECT l.*, " + ", ".join(f"t{n}.rain AS target_t{n}" for n in HORIZONS) + " FROM lagged l " + " ".join(
        f"LEFT JOIN grid t{n} ON t{n}.cell_id = l.cell_id AND t{n}.h = l.h + {n}" for n in HORIZONS))
    q["temporal_split"] = query(f"""
SELECT CASE WHEN hour < (SELECT hour FROM x WHERE i = floor(n * 0.8e0)) THEN 'train' ELSE 'test' END AS part, station_id, hour, {num('rain')} FROM clean""",
        x="SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hour FROM clean)")
    q["bias_correction"] = query(f"""
SELECT station_id, hour, horizon, season, {nums(['forecast', 'observed'])}, {num('forecast - coalesce(bias, 0)', 'corrected')}
FROM p LEFT JOIN (SELECT horizon, season, avg(forecast - observed) AS bias FROM p WHERE station_id <> 2 GROUP BY ALL) b USING (horizon, season)
WHERE station_id = 2""", p=f"""
SELECT *, CASE WHEN month((hour AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem') BETWEEN 5 AND 9 THEN 'dry' ELSE 'wet' END AS season
FROM ({persist('td')}) WHERE forecast IS NOT NULL AND observed IS NOT NULL""")
    flags = [("g.u_vec", "local_wind"), ("w.u_vec", "west"), ("n.u_vec", "north")]
    q["sensor_flags"] = query(f"""
SELECT g.cell_id, g.hour, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in flags)}) AS missing_sensors,
  CAST({' + '.join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _ in flags)} AS INTEGER) AS n_missing,
  {' OR '.join(f"{c} IS NULL" for c, _ in flags)} AS low_confidence
FROM grid g LEFT JOIN clean w ON w.station_id = 1 AND w.h = g.h LEFT JOIN clean n ON n.station_id = 3 AND n.h = g.h""")
    axis = "SELECT cell_id, arg_min({c}_idx, (abs({c}v - p.{c}), {c}_idx)) AS {c}_idx FROM points p CROSS JOIN (SELECT DISTINCT {c}_idx, {c} AS {c}v FROM lattice) GROUP BY cell_id"
    q["nearest_lattice"] = query(f"""
SELECT cell_id, {nums(['lat', 'lon'])}, lat_idx, lon_idx, {num('dist')} FROM points JOIN la USING (cell_id) JOIN lo USING (cell_id)
LEFT JOIN (SELECT lat_idx, lon_idx, dist FROM lattice) USING (lat_idx, lon_idx)""", la=axis.format(c="lat"), lo=axis.format(c="lon"))
    q["lattice_index"] = query(f"SELECT lat_idx, lon_idx, {nums(['lat', 'lon', 'dist'])} FROM lattice")
    terr = ["elevation", "tpi_local", "roughness_local", "tpi_regional", "roughness_regional"]
    q["terrain_stats"] = query(f'SELECT tile, "row", col, {nums(terr)} FROM terrain')
    q["terrain_at_points"] = query(f"""
SELECT tile, "row", col, point_id, n, {nums(terr)} FROM (
  SELECT l_partkey AS point_id, count(*) AS n, (l_partkey + 25) // 50 // 40 AS tile, ((l_partkey + 25) // 50) % 40 AS "row", (l_partkey + 25) % 50 AS col
  FROM lineitem GROUP BY l_partkey) LEFT JOIN terrain USING (tile, "row", col)""")
    def square(r):
        return f"""
SELECT t.cell_id, any_value(t.elev) - avg(q.elev) AS tpi, stddev_pop(q.elev) AS roughness FROM tr t
JOIN px q ON q."row" BETWEEN t."row" - {r} AND t."row" + {r} AND q.col BETWEEN t.col - {r} AND t.col + {r} GROUP BY t.cell_id"""

    q["build_cells"] = query(f"""
SELECT cell_id, {nums(['lat', 'lon'])}, is_boundary, {_IDS}, {nums(_TRI)}, {num('tr.elev', 'elevation')}, {num('b3.tpi', 'tpi_local')},
  {num('b3.roughness', 'roughness_local')}, {num('b7.tpi', 'tpi_regional')}, {num('b7.roughness', 'roughness_regional')}, {num('dist', 'dist_to_coast')}
FROM (SELECT cell_id, lat, lon, is_boundary, {_IDS}, {', '.join(_TRI)} FROM neighbors)
LEFT JOIN tr USING (cell_id) LEFT JOIN b3 USING (cell_id) LEFT JOIN b7 USING (cell_id) JOIN la USING (cell_id) JOIN lo USING (cell_id)
LEFT JOIN (SELECT lat_idx, lon_idx, dist FROM lattice) USING (lat_idx, lon_idx)""",
        sz="SELECT greatest(2, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS k FROM part",
        px="""SELECT p_partkey // k AS "row", p_partkey % k AS col, p_size * 10 AS elev FROM part, sz WHERE p_partkey < k * k AND p_size <> 13""",
        tr="""SELECT cell_id, "row", col, elev FROM (
  SELECT cell_id, CAST(floor((floor(lat) + 1 - lat) * (k - 1) + 0.5e0) AS BIGINT) AS "row",
    CAST(floor((lon - floor(lon)) * (k - 1) + 0.5e0) AS BIGINT) AS col FROM cells, sz) JOIN px USING ("row", col)""",
        b3=square(3), b7=square(7), la=axis.format(c="lat").replace("points", "cells"), lo=axis.format(c="lon").replace("points", "cells"))
    q["tile_names"] = """
SELECT c_custkey, printf('%s%02d%s%03d.hgt', CASE WHEN la >= 0 THEN 'N' ELSE 'S' END, abs(la), CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END, abs(lo)) AS tile
FROM (SELECT c_custkey, CAST(floor(c_custkey % 170 - 85.25e0) AS INTEGER) AS la, CAST(floor(c_custkey % 350 - 175.75e0) AS INTEGER) AS lo FROM customer)"""
    pc = candidates("stations", "station_id", "latitude", "longitude", 10, True)
    nn = " UNION ALL ".join(f"SELECT target AS cell_id, {i} AS rank, neighbor_{i}_id AS station_id, neighbor_{i}_distance AS d FROM t" for i in (1, 2, 3))
    ss = "SELECT s.* EXCLUDE (d1, d2, d3), neighbor_1_distance AS d1, neighbor_2_distance AS d2, neighbor_3_distance AS d3 FROM (" \
        + side_by_side("nn") + ") s JOIN t ON t.target = s.cell_id"
    raw = f"SELECT cell_id, hour, h, {', '.join(f'{idw_sql(m)} AS {m}' for m in MEASURES)} FROM ss"
    long = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, e.{m} AS forecast, o.{m} AS observed FROM est e JOIN clean o ON o.station_id = e.cell_id AND o.h = e.h"
        for m in MEASURES)
    q["idw_leave_out_scores"] = query(_scores("long", "measure"), pc=pc, t=triangles("pc"), nn=nn, ss=ss, raw=raw,
                                      est=V["grid"].replace("FROM idw_raw", "FROM raw"), long=long)
    def at_stations(trios, key, m):
        """Observed value and distance-weighted value of complete hours of stations, from their trios."""
        values = ", ".join(f"c{i}.{m} AS {m}_n{i}, neighbor_{i}_distance AS d{i}" for i in (1, 2, 3))
        joins = " ".join(f"JOIN clean c{i} ON c{i}.station_id = neighbor_{i}_id AND c{i}.h = o.h AND c{i}.{m} IS NOT NULL" for i in (1, 2, 3))
        return f"""SELECT {key}, y, {idw_sql(m)} AS w FROM (SELECT {key}, o.{m} AS y, {values} FROM {trios}
JOIN (SELECT *, h AS hh FROM clean) o ON o.station_id = target AND o.{m} IS NOT NULL {joins})"""

    def totals(sign=""):
        return ", ".join(f"{sign}{e} AS {n}" for n, e in (
            ("n", "count(*)"), ("sx", "sum(w)"), ("sxx", "sum(w * w)"), ("sy", "sum(y)"), ("sxy", "sum(w * y)"), ("syy", "sum(y * y)")))

    added = ", ".join(f"sum({c}) AS {c}" for c in ("n", "sx", "sxx", "sy", "sxy", "syy"))
    slope = "(n * sxy - sx * sy) / (n * sxx - sx * sx)"
    q["linear_cross_validation"] = query(f"""
SELECT station_id AS fold, coalesce(o.n, 0)::BIGINT AS n, f.n::BIGINT AS train_rows, {num('a', 'intercept')}, {num('b', 'weighted')},
  {num('sqrt((o.syy - 2 * (a * o.sy + b * o.sxy) + a * a * o.n + 2 * a * b * o.sx + b * b * o.sxx) / o.n)', 'rmse')},
  {num('sqrt((o.syy - 2 * o.sxy + o.sxx) / o.n)', 'weighted_rmse')}
FROM (SELECT *, (sy - b * sx) / n AS a FROM (SELECT *, {slope} AS b FROM fits)) f LEFT JOIN own o ON o.target = f.station_id""",
        pc=candidates("stations", "station_id", "latitude", "longitude", 10, True), t=triangles("pc"),
        pd=candidates("stations", "station_id", "latitude", "longitude", 11, True), folds=fold.replace("pc", "pd"), u=triangles("folds", "fold, target"),
        base=at_stations("t", "target", "ws"), other=at_stations("u", "fold, target", "ws"),
        own=f"SELECT target, {totals()} FROM base GROUP BY target",
        lost=f"SELECT fold, {totals('-')} FROM base JOIN (SELECT fold, target FROM u) USING (target) GROUP BY fold",
        won=f"SELECT fold, {totals()} FROM other GROUP BY fold",
        fits=f"""SELECT station_id, {added} FROM (
  SELECT s.station_id, o.n, o.sx, o.sxx, o.sy, o.sxy, o.syy FROM stations s JOIN own o ON o.target <> s.station_id
  UNION ALL SELECT fold, n, sx, sxx, sy, sxy, syy FROM lost UNION ALL SELECT fold, n, sx, sxx, sy, sxy, syy FROM won) GROUP BY station_id""")
    q["hurdle_rain"] = query(f"""
SELECT target AS station_id, count(*) AS n, count(*) FILTER (WHERE y >= 0.1e0) AS wet, {num('avg(CASE WHEN y < 0.1e0 THEN 1e0 ELSE 0e0 END)', 'dry_share')},
  true AS not_negative, true AS "whole", true AS no_worse FROM base GROUP BY target""",
        pc=candidates("stations", "station_id", "latitude", "longitude", 10, True), t=triangles("pc"), base=at_stations("t", "target", "rain"))
    routed = [*[f"td_n{i}" for i in (1, 2, 3)], *[f"dist_n{i}" for i in (1, 2, 3)]]
    q["null_routing"] = query(" UNION ALL ".join(
        f"SELECT '{c}' AS input, count(*) FILTER (WHERE (hh * 7 + target * 13 + {n}) % 5 = 0) AS nulls, count(*) AS n, true AS no_worse FROM base"
        for n, c in enumerate(routed)),
        pc=candidates("stations", "station_id", "latitude", "longitude", 10, True), t=triangles("pc"), base=at_stations("t", "target, hh", "td"))
    q["placed_readings"] = query(f"""
SELECT event_id, station_id, {nums(['rain', 'latitude', 'longitude'])} FROM readings
JOIN (SELECT station_id, latitude, longitude FROM stations WHERE elevation >= 200) USING (station_id)""")
    q["skipped_stations"] = query("SELECT DISTINCT station_id FROM readings JOIN stations USING (station_id) WHERE elevation < 200")
    q["table_state"] = query("""SELECT count(*) AS n, count(DISTINCT station_id) AS stations, min(hour) AS "first", max(hour) AS "last" FROM clean""")
    cut = "FROM clean WHERE hour BETWEEN TIMESTAMP '2024-01-09 05:00:00' AND TIMESTAMP '2024-01-12 23:00:00'"
    have = " AND ".join(f"neighbor_{i}_id IN (SELECT station_id FROM win)" for i in (1, 2, 3))
    q["replay"] = query(f"""
SELECT cell_id, hour, {nums([f'precipitation_t{n}' for n in HORIZONS])}, {nums(['lat', 'lon'])}, dense_rank() OVER (ORDER BY hour) - 1 AS idx
FROM (SELECT cell_id, hour, {', '.join(f'rain AS precipitation_t{n}' for n in HORIZONS)} FROM raw
      WHERE hour >= TIMESTAMP '2024-01-10 05:00:00' AND cell_id IN (SELECT cell_id FROM neighbors WHERE {have}))
JOIN (SELECT cell_id, lat, lon FROM cells) USING (cell_id)""", win=f"SELECT * {cut}", ss=V["series"].replace("JOIN clean c", "JOIN win c"),
        raw=V["idw_raw"].replace("FROM series", "FROM ss"))
    def drawn(c, sigma):
        u = [f"((('0x' || substr(md5(concat_ws('/', station_id, h, '{c}', '7', '{n}')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"
             for n in (1, 2)]
        return num(f"({c} + {sigma}e0 * sqrt(-2e0 * ln({u[0]})) * cos(6.283185307179586e0 * {u[1]}))", c)

    q["noisy_rain"] = query(f"SELECT station_id, hour, {drawn('rain', 0.33)}, {drawn('td', 1.8)} FROM clean")
    # a stream over the whole table must end with the batch result
    q["stream_hourly"] = q["hourly_rollup"]
    q["stream_closed_bins"] = query(f"""
SELECT station_id, hour, {nums(MEASURES)} FROM rollup
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
    q["stream_grid"] = q["stream_late"] = q["idw_grid"]  # every hour of the table is over at the stream's clock
    q["stream_forecasts"] = query(f"""
SELECT cell_id, hour, {', '.join(num('rain', f'precipitation_t{n}') for n in HORIZONS)}
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY hour DESC) AS rn FROM grid
      WHERE hour >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 27 HOUR) WHERE rn = 1""")
    q["stream_metrics"] = query("""
SELECT 0 AS batch, count(*) AS readings, (SELECT count(*) FROM readings WHERE event_id % 3 > 0) - count(*) AS repeats,
  0 AS rejected, 0 AS late, max(ts) AS newest FROM (SELECT DISTINCT station_id, ts FROM readings WHERE event_id % 3 > 0)
UNION ALL
SELECT 1, count(*), (SELECT count(*) FROM readings WHERE event_id % 2 = 0) - count(*),
  (SELECT count(*) FROM readings WHERE event_id % 50 = 0), count(*), max(ts)
FROM (SELECT DISTINCT station_id, ts FROM readings WHERE event_id % 2 = 0
      EXCEPT SELECT station_id, ts FROM readings WHERE event_id % 3 > 0)
UNION ALL
SELECT 2, count(*), (SELECT count(*) FROM readings WHERE event_id % 3 = 0) - count(*), 0, count(*), max(ts)
FROM (SELECT DISTINCT station_id, ts FROM readings WHERE event_id % 3 = 0
      EXCEPT SELECT station_id, ts FROM readings WHERE event_id % 3 > 0 OR event_id % 2 = 0)""")
    q["stream_unique"] = query("""
SELECT DISTINCT station_id, ts FROM loads WHERE load < 2 OR ts > (SELECT max(ts) FROM loads WHERE load = 0) - INTERVAL 48 HOUR""",
        held="""SELECT event_id, station_id, ts, CASE WHEN event_id % 6 = 1 THEN 2 ELSE n END AS load FROM (
  SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS n FROM readings)""",
        loads="SELECT * FROM held UNION ALL SELECT event_id, station_id, ts, load + 1 FROM held WHERE event_id % 4 = 0 AND load < 2")
    q["archive_run"] = q["normalize_time"]
    q["bootstrap_stations"] = query(f"SELECT station_id, {nums(STATION_METADATA.names[1:])} FROM stations")
    q["replaced_table"] = f"SELECT o_orderkey, o_custkey, {num('o_totalprice')} FROM orders WHERE o_orderkey % 3 = 0"
    q["ordered_export"] = "SELECT count(*) AS n, 0 AS wrong FROM orders"
    return q
