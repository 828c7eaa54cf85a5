import math
import random
from itertools import combinations

import pytest

from isohyet.functions.geo import lattice_shape
from isohyet.operators import neighbors as nb


def dist(a, b):
    hl, ho = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    x = hl * hl + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * ho * ho
    return 6371.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(max(1 - x, 0)))


def holds(p, a, b, c):
    def side(q, r):
        return (p[0] - r[0]) * (q[1] - r[1]) - (q[0] - r[0]) * (p[1] - r[1])
    s = [side(a, b), side(b, c), side(c, a)]
    return not (min(s) < 0 < max(s))


def scatter(kind, n, seed):
    rng = random.Random(seed)
    if kind == "even":
        return [(rng.uniform(30, 34), rng.uniform(34, 37)) for _ in range(n)]
    if kind == "crowded":  # two thirds in a spot of some hundred metres, some on one point
        spot = [(32.0 + rng.uniform(0, 0.002), 35.0 + rng.uniform(0, 0.002)) for _ in range(n // 3)]
        return spot + [(32.001, 35.001)] * (n // 3) + scatter("even", n - 2 * (n // 3), seed + 1)
    if kind == "world":
        return [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    return [(89.9 - rng.random(), rng.uniform(-180, 180)) for _ in range(n // 2)] + [  # pole and date line
        (rng.uniform(-1, 1), rng.choice([179.9, -179.9]) + rng.uniform(-0.05, 0.05)) for _ in range(n - n // 2)]


def frames(spark, targets, stations):
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(targets, 1)], "cell_id long, lat double, lon double")
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(stations, 1)], "station_id long, latitude double, longitude double")
    return t, s


@pytest.mark.parametrize("kind", ["even", "crowded", "world", "edge"])
def test_nearest_equals_brute_force(spark, kind):
    targets, stations = scatter(kind, 80, 5), scatter(kind, 150, 9)
    t, s = frames(spark, targets, stations)
    got = {}
    for r in nb.nearest_stations(t, s, 7).collect():
        got.setdefault(r.cell_id, []).append((r["rank"], r.neighbor_id, r.distance_km))
    for i, p in enumerate(targets, 1):
        near = sorted((dist(p, q), j) for j, q in enumerate(stations, 1))
        mine = sorted(got[i])
        assert [d for _, _, d in mine] == pytest.approx([d for d, _ in near[:7]], abs=1e-9)
        # on one spot all distances are equal and the lowest ids count
        if near[6][0] + 1e-9 < near[7][0] and kind != "crowded":
            assert {n for _, n, _ in mine} == {j for _, j in near[:7]}


def test_fewer_stations_than_wanted_and_missing_places(spark):
    t, s = frames(spark, [(0.0, 0.0), (10.0, 170.0)], [(1.0, 1.0), (None, 2.0), (-80.0, -170.0)])
    rows = nb.nearest_stations(t, s, 5).collect()
    assert sorted((r.cell_id, r.neighbor_id) for r in rows) == [(1, 1), (1, 3), (2, 1), (2, 3)]


def test_a_pile_on_one_spot_gives_the_lowest_ids(spark):
    t, s = frames(spark, [(32.0, 35.0)], [(32.5, 35.0)] * 40)
    assert sorted(r.neighbor_id for r in nb.nearest_stations(t, s, 4).collect()) == [1, 2, 3, 4]


def brute_triangle(p, stations, k, skip=()):
    near = sorted((dist(p, q), j) for j, q in stations.items() if j not in skip)[:k]
    d = {j: x for x, j in near}
    ids = [j for _, j in near]
    trios = [c for c in combinations(ids, 3) if holds(p, *[stations[j] for j in c])]
    return (min(trios, key=lambda c: d[c[0]] + d[c[1]] + d[c[2]]), False) if trios else (tuple(ids[:3]), True)


def test_triangles_equal_brute_force(spark):
    targets, places = scatter("even", 60, 3), scatter("even", 25, 4)
    t, s = frames(spark, targets, places)
    stations = dict(enumerate(places, 1))
    rows = {r.cell_id: r for r in nb.triangle_neighbors(t, s, exclude=[7]).collect()}
    seen = set()
    for i, p in enumerate(targets, 1):
        trio, boundary = brute_triangle(p, stations, 10, skip=(7,))
        r = rows[i]
        assert ((r.neighbor_1_id, r.neighbor_2_id, r.neighbor_3_id), r.is_boundary) == (trio, boundary)
        seen.add(boundary)
    assert seen == {True, False}


def test_station_neighbors_and_folds_equal_brute_force(spark):
    places = scatter("even", 18, 8)
    _, s = frames(spark, [(0.0, 0.0)], places)
    stations = dict(enumerate(places, 1))
    base = {r.station_id: r for r in nb.station_neighbors(s, holdout=5, k=6).collect()}
    for i, p in stations.items():
        trio, boundary = brute_triangle(p, stations, 6, skip=(i, 5))
        assert ((base[i].neighbor_1_id, base[i].neighbor_2_id, base[i].neighbor_3_id), base[i].is_boundary) == (trio, boundary)
    folds = nb.leave_location_out(s, k=6).collect()
    assert len(folds) == 18 * 6
    for r in folds:
        trio, boundary = brute_triangle(stations[r.station_id], stations, 6, skip=(r.station_id, r.fold))
        assert ((r.neighbor_1_id, r.neighbor_2_id, r.neighbor_3_id), r.is_boundary) == (trio, boundary)


def test_reference_grid_shape(spark):
    grid = nb.grid_cells(spark)
    assert lattice_shape(32.45, 32.75, 35.05, 35.45, 0.01) == (31, 41)
    assert grid.count() == 1271
    cell = grid.filter("cell_id = 639").first()
    assert (cell.lat, cell.lon) == (32.6, 35.28)


def test_required_and_available(spark):
    wide = spark.createDataFrame([(1, 10, 11, 12, 1.0, 2.0, 3.0), (2, 10, 11, 13, 1.0, 2.0, 3.0)],
                                 "cell_id long, neighbor_1_id long, neighbor_2_id long, neighbor_3_id long, "
                                 "neighbor_1_distance double, neighbor_2_distance double, neighbor_3_distance double")
    assert sorted(r.station_id for r in nb.required_stations(wide, [178, 10]).collect()) == [10, 11, 12, 13, 178]
    hourly = spark.createDataFrame([(10,), (11,), (12,)], "station_id long")
    assert [r.cell_id for r in nb.available_cells(wide, hourly).collect()] == [1]
    assert nb.long_neighbors(wide).filter("cell_id = 2 AND rank = 3").first().station_id == 13


def crowd(n, seed):
    """Nine in ten within a few metres, and targets around them."""
    rng = random.Random(seed)
    dense = [(32 + rng.uniform(0, 3e-4), 35 + rng.uniform(0, 3e-4)) for _ in range(n * 9 // 10)]
    return dense + scatter("even", n - len(dense), seed + 1)


@pytest.mark.parametrize("k", [1, 7])
def test_targets_beside_a_crowd_meet_few_of_it(spark, k):
    stations, targets = crowd(4000, 3), crowd(60, 4) + scatter("even", 60, 8)
    t, s = frames(spark, targets, stations)
    met = nb.closest_cubes(t, nb._pyramid(s, k), k).groupBy("_t").sum("n").collect()
    assert len(met) == len(targets) and max(r[1] for r in met) <= 200 * k  # of 3,600 in the crowd
    got = {}
    for r in nb.nearest_stations(t, s, k).collect():
        got.setdefault(r.cell_id, []).append((r.distance_km, r.neighbor_id))
    for i, p in enumerate(targets, 1):
        near = sorted((dist(p, q), j) for j, q in enumerate(stations, 1))[:k]
        assert [d for d, _ in sorted(got[i])] == pytest.approx([d for d, _ in near], abs=1e-9)
