"""Nearest stations and enclosing triangles."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.geo import haversine, lattice_shape, side_sql, unit_vector
from isohyet.schemas import GRID_BOX, GRID_STEP, NEIGHBOR_CANDIDATES
from isohyet.session import cut_lineage, spread

# Cubes around the unit sphere halve in side per level; the deepest is under a metre.
DEEPEST = 24
CUBE = ["cx", "cy", "cz"]
POINT = ["px", "py", "pz"]
# A cube with more than so many times the wanted stations is looked into.
CROWD = 16


def grid_cells(spark, lat_min=GRID_BOX["lat_min"], lat_max=GRID_BOX["lat_max"], lon_min=GRID_BOX["lon_min"],
               lon_max=GRID_BOX["lon_max"], step=GRID_STEP) -> DataFrame:
    """Regular lattice of cell centres, row-major ids from 1."""
    rows, cols = lattice_shape(lat_min, lat_max, lon_min, lon_max, step)
    i, j = F.floor(F.col("id") / cols), F.col("id") % cols
    return spark.range(rows * cols).select(
        (F.col("id") + 1).alias("cell_id"),
        F.round(F.lit(lat_min) + i * F.lit(step), 6).alias("lat"),
        F.round(F.lit(lon_min) + j * F.lit(step), 6).alias("lon"),
    )


def active_stations(stations: DataFrame, hourly: DataFrame, left_out=()) -> DataFrame:
    """Stations that have clean data, without the ones left out."""
    kept = stations.filter(~F.col("station_id").isin(list(left_out))) if left_out else stations
    return kept.join(hourly.select("station_id").distinct(), "station_id", "left_semi")


def _cubes(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add the point on the unit sphere (px py pz) and its deepest cube (cx cy cz)."""
    df = df.selectExpr("*", *[f"{v} AS {p}" for v, p in zip(unit_vector(lat, lon), POINT)])
    edge = 2**DEEPEST - 1
    return df.selectExpr("*", *[f"least(floor(({p} + 1) * {2.0 ** (DEEPEST - 1)}D), {edge}L) AS {c}" for c, p in zip(CUBE, POINT)])


def _at_level(level: str) -> list[str]:
    """SQL of the cube columns at a coarser level."""
    return [f"shiftright({c}, {DEEPEST} - {level}) AS {c}" for c in CUBE]


def nearest_stations(targets: DataFrame, stations: DataFrame, k: int = NEIGHBOR_CANDIDATES,
                     target_id: str = "cell_id", exclude_self: bool = False) -> DataFrame:
    """The k nearest stations of each target, exactly, without pairing all with all.

    Rows: target_id, lat, lon, rank (from 1), neighbor_id, distance_km and the
    neighbour's latitude and longitude, ordered by distance, then neighbor_id.
    ``targets`` has target_id, lat, lon; with ``exclude_self`` target_id is a
    station_id that never picks itself.

    Space is cut into nested cubes.  A target's home is the smallest cube
    around it that holds k stations.  The farthest corner of that cube is then
    no nearer than the k-th station, so every station that can matter lies in a
    ball around the target that the home and its neighbours one level up cover.
    ``closest_cubes`` narrows these down; stations join by cube at the end, and only
    the k best rows per target leave a task (window group limit).
    """
    want = k + 1 if exclude_self else k
    pyramid = _pyramid(stations, want)
    stored = closest_cubes(targets, pyramid, want, target_id)
    chord2 = " + ".join(f"({p} - {s}) * ({p} - {s})" for p, s in zip(POINT, ("sx", "sy", "sz")))
    near = f"{chord2} <= reach2" + (" AND _t <> neighbor_id" if exclude_self else "")
    return (
        stored.join(pyramid, ["level", *CUBE]).filter(near)
        .select(F.col("_t").alias(target_id), "lat", "lon", "neighbor_id",
                haversine("lat", "lon", "latitude", "longitude").alias("distance_km"), "latitude", "longitude")
        .withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {target_id} ORDER BY distance_km, neighbor_id)"))
        .filter(f"rank <= {k}")
        .select(target_id, "lat", "lon", "rank", "neighbor_id", "distance_km", "latitude", "longitude")
    )


def _pyramid(stations: DataFrame, want: int) -> DataFrame:
    """Every station in its cube of every level."""
    # of a pile of stations on one spot only the lowest ids can be chosen
    spots = (
        stations.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
        .selectExpr("station_id AS neighbor_id", "latitude", "longitude",
                    "row_number() OVER (PARTITION BY latitude, longitude ORDER BY station_id) AS _n")
        .filter(f"_n <= {want}").drop("_n")
    )
    return _cubes(spots, "latitude", "longitude").selectExpr(
        "*", f"explode(sequence(0, {DEEPEST})) AS level"
    ).selectExpr("neighbor_id", "latitude", "longitude", "px AS sx", "py AS sy", "pz AS sz", "level", *_at_level("level"))


def _gap2(level: str, far: bool) -> str:
    """SQL of the squared distance from a target to the nearest or farthest point of a cube."""
    side = f"pow(2D, 1 - {level})"
    parts = []
    for p, c in zip(POINT, CUBE):
        low = f"({c} * {side} - 1)"
        parts.append(f"greatest({p} - {low}, {low} + {side} - {p})" if far else f"greatest({low} - {p}, {p} - {low} - {side}, 0D)")
    return " + ".join(f"pow({x}, 2)" for x in parts)


def _tightened(rows: DataFrame, want: int) -> DataFrame:
    """One row a target: its cubes, without those beyond the bound ``reach2``, and whether one is still ``crowded``.

    The bound is the farthest corner up to which the nearest cubes hold ``want`` stations for certain.
    """
    cube = f"struct({_gap2('level', True)} AS far2, {_gap2('level', False)} AS near2, n, level, {', '.join(CUBE)})"
    found = rows.groupBy("_t", "lat", "lon", *POINT).agg(F.min("reach2").alias("reach2"), F.expr(f"sort_array(collect_list({cube})) AS cubes"))
    sure = ("aggregate(cubes, struct(0L AS seen, CAST('Infinity' AS DOUBLE) AS bound), (a, c) -> CASE WHEN a.seen >= "
            f"{want} THEN a ELSE struct(a.seen + c.n AS seen, CASE WHEN a.seen + c.n >= {want} THEN c.far2 ELSE a.bound END AS bound) END).bound")
    found = found.withColumn("reach2", F.expr(f"least(reach2, {sure} * (1 + 1e-9D) + 1e-15D)"))
    found = found.withColumn("cubes", F.expr("filter(cubes, c -> c.near2 <= reach2)"))
    return found.withColumn("crowded", F.expr(f"exists(cubes, c -> c.n > {CROWD * want} AND c.level < {DEEPEST})"))


def closest_cubes(targets: DataFrame, pyramid: DataFrame, want: int, target_id: str = "cell_id") -> DataFrame:
    """Cubes that can hold one of a target's ``want`` nearest stations: _t, lat, lon, the point, reach2, level, cube, n.

    Branch and bound: cubes beyond the bound on the k-th distance are dropped; crowded ones are replaced by their parts
    two levels down, which tighten the bound, until none is crowded.  Only targets beside a crowd take part in that, and
    none meets more stations than a few cubes of ``CROWD`` times ``want``, however many the crowd has.
    """
    # cubes with k stations or more; the root counts whatever it holds
    crowded = pyramid.groupBy("level", *CUBE).agg(F.expr("count(1) AS _n")).filter(f"_n >= {want} OR level = 0").drop("_n")
    deepest = F.coalesce(crowded.agg(F.max("level")).scalar(), F.lit(0))

    points = targets.selectExpr(f"{target_id} AS _t", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL")
    home = (
        _cubes(points, "lat", "lon").withColumn("level", F.explode(F.sequence(F.lit(0), deepest)))
        .selectExpr("_t", "lat", "lon", "level", *_at_level("level"))
        .join(crowded, ["level", *CUBE], "left_semi")
        .groupBy("_t", "lat", "lon").agg(F.expr("max(level) AS home"))
    )
    home_far = _gap2("home", True).replace("cx", "_cx").replace("cy", "_cy").replace("cz", "_cz")
    steps = "explode(sequence(-1L, 1L))"
    around = (
        _cubes(spread(home, "_t"), "lat", "lon").selectExpr("_t", "lat", "lon", "home", *POINT, *CUBE)
        .selectExpr("_t", "lat", "lon", "home", *POINT, *CUBE, *[f"shiftright({c}, {DEEPEST} - home) AS _{c}" for c in CUBE])
        .selectExpr("_t", "lat", "lon", *POINT, f"({home_far}) * (1 + 1e-9D) + 1e-15D AS reach2",
                    "greatest(home - 1, 0) AS level", *_at_level("greatest(home - 1, 0)"))
        .selectExpr("*", f"{steps} AS dx").selectExpr("*", f"{steps} AS dy").selectExpr("*", f"{steps} AS dz")
        .selectExpr("_t", "lat", "lon", *POINT, "reach2", "level", "cx + dx AS cx", "cy + dy AS cy", "cz + dz AS cz")
        .filter(f"{_gap2('level', False)} <= reach2")  # only cubes that the ball touches
    )
    counts = pyramid.groupBy("level", *CUBE).agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(_tightened(around.join(counts, ["level", *CUBE]), want))
    parts, open_ = [found.filter("NOT crowded")], found.filter("crowded")
    children = None
    while not open_.isEmpty():
        if children is None:  # cubes by the cube one or two levels up
            up = [f"shiftright({c}, up) AS _{c}" for c in CUBE]
            children = cut_lineage(cut_lineage(counts).selectExpr("*", "explode(array(1, 2)) AS up").filter("level >= up").selectExpr(
                "level AS part", "level - up AS level", *[f"{c} AS part_{c}" for c in CUBE], *up, "n AS part_n", "up"))
            children = children.selectExpr("part", "level", "up", *[f"_{c} AS {c}" for c in CUBE], *[f"part_{c}" for c in CUBE], "part_n")
        cubes = _each_cube(open_).withColumn("up", F.expr(f"CASE WHEN n > {CROWD * want} AND level < {DEEPEST} THEN least(2, {DEEPEST} - level) ELSE 0 END"))
        own = ["_t", "lat", "lon", *POINT, "reach2"]
        split = cubes.filter("up > 0").join(children, ["level", "up", *CUBE]).selectExpr(
            *own, "part AS level", *[f"part_{c} AS {c}" for c in CUBE], "part_n AS n")
        found = cut_lineage(_tightened(cubes.filter("up = 0").select(*own, "level", *CUBE, "n").unionByName(split), want))
        parts.append(found.filter("NOT crowded"))
        open_ = found.filter("crowded")
    return _each_cube(reduce(DataFrame.unionByName, parts))


def _each_cube(found: DataFrame) -> DataFrame:
    return found.select("_t", "lat", "lon", *POINT, "reach2", F.explode("cubes").alias("c")).selectExpr(
        "_t", "lat", "lon", *POINT, "reach2", "c.level", *[f"c.{c}" for c in CUBE], "c.n")


def candidate_lists(nearest: DataFrame, target_id: str = "cell_id") -> DataFrame:
    """One row per target with its (at most k) candidates as an array in rank order, dealt over all cores: choosing among them is the dear step."""
    one = "struct(rank, neighbor_id, distance_km, latitude, longitude)"
    dealt = spread(nearest, target_id, "lat")  # by other keys than the ranking, or the planner leaves it out; below the lists, which no filter passes
    return dealt.groupBy(target_id, "lat", "lon").agg(F.expr(f"sort_array(collect_list({one})) AS candidates"))


def choose_triangle(lists: DataFrame, k: int = NEIGHBOR_CANDIDATES) -> DataFrame:
    """Pick three neighbours from each target's candidate array, row by row.

    Of all trios whose triangle holds the target the one with the least sum of
    distances wins (then the first in candidate order); without one the three
    nearest are taken and is_boundary is true.  Targets with fewer than three
    candidates keep those; the others are null, and ``available_cells`` leaves them out.
    """
    pairs = list(combinations(range(k), 2))
    at = {p: n for n, p in enumerate(pairs)}
    pair_list = ", ".join(f"struct({a} AS a, {b} AS b)" for a, b in pairs)
    trio_list = ", ".join(
        f"struct({i} AS i, {j} AS j, {m} AS m, {at[i, j]} AS ij, {at[j, m]} AS jm, {at[i, m]} AS im)"
        for i, j, m in combinations(range(k), 3))
    # which side of each line between two candidates the target is on: once per pair, not per trio
    corner = {x: (f"get(lats, p.{x})", f"get(lons, p.{x})") for x in "ab"}
    there, back = (side_sql(("lat", "lon"), corner[x], corner[y]) for x, y in ("ab", "ba"))
    rest = [x for x in lists.columns if x != "candidates"]
    sides = lists.selectExpr(
        *rest, "candidates", "candidates.latitude AS lats", "candidates.longitude AS lons", "candidates.distance_km AS d"
    ).selectExpr(
        *rest, "candidates", "d", f"transform(array({pair_list}), p -> {there}) AS there",
        f"transform(array({pair_list}), p -> {back}) AS back",
    )
    around = "get(there, t.ij), get(there, t.jm), get(back, t.im)"
    best = (f"array_min(transform(filter(array({trio_list}), t -> t.m < size(d) AND NOT (least({around}) < 0 AND "
            f"greatest({around}) > 0)), t -> struct(get(d, t.i) + get(d, t.j) + get(d, t.m) AS total, t.i, t.j, t.m)))")
    picks = sides.selectExpr(*rest, "candidates", f"{best} AS best").selectExpr(
        *rest, "best IS NULL AS is_boundary",
        *[f"get(candidates, coalesce(best.{x}, {n})) AS n{n + 1}" for n, x in enumerate("ijm")],
    )
    return picks.selectExpr(*rest, "is_boundary", *[
        x for n in (1, 2, 3)
        for x in (f"n{n}.neighbor_id AS neighbor_{n}_id", f"n{n}.distance_km AS neighbor_{n}_distance")
    ])


def triangle_neighbors(targets: DataFrame, stations: DataFrame, k: int = NEIGHBOR_CANDIDATES,
                       target_id: str = "cell_id", exclude=(), exclude_self: bool = False) -> DataFrame:
    """Three neighbours per target, from the k nearest stations that are not excluded."""
    usable = stations.filter(~F.col("station_id").isin(list(exclude))) if exclude else stations
    near = nearest_stations(targets, usable, k, target_id, exclude_self)
    return choose_triangle(candidate_lists(near, target_id), k)


def station_neighbors(stations: DataFrame, holdout: int | None = None, k: int = NEIGHBOR_CANDIDATES) -> DataFrame:
    """Neighbours of every station among the others; the held-out one is never a neighbour."""
    targets = stations.select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    exclude = () if holdout is None else (holdout,)
    return triangle_neighbors(targets, stations, k, "station_id", exclude, exclude_self=True)


def leave_location_out(stations: DataFrame, k: int = NEIGHBOR_CANDIDATES) -> DataFrame:
    """Neighbour choices that change when one location is held out: fold, station_id, neighbours.

    A fold differs from ``station_neighbors`` only where the held-out station
    was among a target's k candidates, so only those (at most k per target)
    are computed; one search for k + 1 candidates serves all folds.
    """
    targets = stations.select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    lists = candidate_lists(nearest_stations(targets, stations, k + 1, "station_id", True), "station_id")
    folds = lists.withColumn("fold", F.explode(F.slice(F.col("candidates")["neighbor_id"], 1, k)))
    rest = F.filter("candidates", lambda s: s["neighbor_id"] != F.col("fold"))
    return choose_triangle(folds.withColumn("candidates", F.slice(rest, 1, k)), k)


def long_neighbors(wide: DataFrame, target_id: str = "cell_id") -> DataFrame:
    """(target, rank, station_id, distance_km) from the wide form."""
    each = ", ".join(f"{i}, neighbor_{i}_id, neighbor_{i}_distance" for i in (1, 2, 3))
    return wide.selectExpr(target_id, f"stack(3, {each}) AS (rank, station_id, distance_km)")


def required_stations(neighbors: DataFrame, upstream) -> DataFrame:
    """Every station that the grid needs: neighbours of any rank and the upstream ones."""
    ids = neighbors.selectExpr("explode(array(neighbor_1_id, neighbor_2_id, neighbor_3_id)) AS station_id")
    more = neighbors.sparkSession.createDataFrame([(int(s),) for s in upstream], "station_id long")
    return ids.union(more).distinct()


def available_cells(neighbors: DataFrame, hourly: DataFrame) -> DataFrame:
    """Cells whose three neighbours all have a series (ids only are compared)."""
    have = hourly.select(F.col("station_id")).distinct()
    out = neighbors
    for i in (1, 2, 3):
        out = out.join(have.select(F.col("station_id").alias(f"neighbor_{i}_id")), f"neighbor_{i}_id", "left_semi")
    return out.select(*neighbors.columns)


def nearest_target(targets: DataFrame, stations: DataFrame, target_id: str = "cell_id") -> DataFrame:
    """The closest target (cell) of every station: the search with the sides swapped."""
    as_sites = targets.select(F.col(target_id).alias("station_id"), F.col("lat").alias("latitude"),
                              F.col("lon").alias("longitude"))
    as_points = stations.select(F.col("station_id").alias("_station"), F.col("latitude").alias("lat"),
                                F.col("longitude").alias("lon"))
    near = nearest_stations(as_points, as_sites, 1, "_station")
    return near.select(F.col("_station").alias("station_id"), F.col("neighbor_id").alias(target_id), "distance_km")
