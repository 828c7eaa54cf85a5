import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import raster as rs
from isohyet.operators.clean import normalize_readings
from isohyet.schemas import STATION_METADATA
from isohyet.sources import observations as ob
from isohyet.sources import rasters as ra
from isohyet.sources import tables as tt
from isohyet.sources.snapshots import Conflict, Snapshots


def test_payload_rules(spark, tmp_path):
    def ch(name, valid, value):
        return {"name": name, "valid": valid, "value": value}

    docs = [
        {"stationId": 7, "data": [
            {"datetime": "2024-07-01T10:00:00+03:00", "channels": [
                ch("Rain", True, 1.0), ch("rain", True, 2.0), ch("RAIN", False, 9.0), ch("TD", False, 5.0),
                ch("Grad", True, 3.0), ch("ws", None, 4.0), ch("RH", True, None)]},
            {"datetime": "2024-07-01T10:10:00+03:00", "channels": []}]},
        {"stationId": 8, "data": []},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    flat = ob.flatten_observations(ob.read_payloads(spark, str(tmp_path)))
    rows = sorted(flat.collect(), key=lambda r: r.timestamp)
    assert [(r.station_id, r.rain, r.td, r.ws, r.rh) for r in rows] == [(7, 2.0, None, None, None), (7, None, None, None, None)]
    raw = normalize_readings(flat)
    assert "wsmax" not in raw.columns and str(raw.orderBy("ts").first().ts) == "2024-07-01 08:00:00"


def test_payload_date_range(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        folder = tmp_path / f"date={day}"
        folder.mkdir()
        doc = {"stationId": 1, "data": [{"datetime": f"{day}T00:00:00+02:00", "channels": []}]}
        (folder / "x.json").write_text(json.dumps(doc))
    df = ob.read_payloads(spark, str(tmp_path), start="2024-01-02", end="2024-01-03")
    assert [r.timestamp[:10] for r in ob.flatten_observations(df).collect()] == ["2024-01-02"]


def test_catalog_drops_names_with_digits(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([
        {"stationId": 1, "name": "Port East", "location": {"latitude": 32.0, "longitude": 35.0}},
        {"stationId": 2, "name": "Port 2", "location": {"latitude": 32.0, "longitude": 35.0}},
        {"stationId": 3, "name": "Hill", "location": None}]))
    rows = {r.station_id: r for r in ob.read_catalog(spark, str(path)).collect()}
    assert set(rows) == {1, 3} and rows[1].file_name == "Port_East" and rows[3].latitude is None


def test_archive_round_trip_and_backfill_resumes(spark, tmp_path):
    catalog = spark.createDataFrame([(1, "One", 32.0, 35.0), (2, "Two", 33.0, 35.5)],
                                    "station_id long, name string, latitude double, longitude double")
    rows = spark.createDataFrame([(s, f"2024-01-01T0{h}:00:00+02:00", float(h)) for s in (1, 2) for h in range(3)],
                                 "station_id long, timestamp string, rain double")
    for c in ("wsmax", "wdmax", "ws", "wd", "stdwd", "td", "rh", "tdmax", "tdmin", "ws1mm", "ws10mm"):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    archive, manifest = str(tmp_path / "archive"), str(tmp_path / "manifest")
    first = tt.backfill(spark, catalog.filter("station_id = 1"), rows, archive, manifest)
    assert [(r.station_name, r.total_rows) for r in first.collect()] == [("One", 3)]
    done = tt.backfill(spark, catalog, rows, archive, manifest)
    assert sorted((r.station_id, r.total_rows) for r in done.collect()) == [(1, 3), (2, 3)]
    back = ob.read_archive(spark, archive)
    assert back.count() == 6 and sorted({r.latitude for r in back.collect()}) == [32.0, 33.0]
    assert sum(r.rain for r in back.collect()) == 6.0


def test_bootstrap_only_fills_an_empty_table(spark, tmp_path):
    source, table = tmp_path / "s.json", str(tmp_path / "table")
    source.write_text(json.dumps([{"station_id": 2, "latitude": 32.8, "longitude": 35.7, "elevation": 378}]))
    assert ob.bootstrap(spark, str(source), table, STATION_METADATA) is True
    source.write_text(json.dumps([{"station_id": 3}]))
    assert ob.bootstrap(spark, str(source), table, STATION_METADATA) is False
    assert [(r.station_id, r.elevation) for r in spark.read.parquet(table).collect()] == [(2, 378.0)]


def test_ordered_export_and_replace(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in random.Random(1).sample(range(200), 200)], "cell_id long, v double")
    ob.export_json(df, str(tmp_path / "out"), ["cell_id"])
    lines = [json.loads(x)["cell_id"] for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split()]
    assert lines == list(range(200))
    tt.replace_table(df, str(tmp_path / "t"))
    tt.replace_table(df.filter("cell_id < 3"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_insert_ignore_keeps_the_first_and_is_idempotent(spark):
    schema = "k long, t long, v double, seq long"
    target = spark.createDataFrame([(1, 1, 10.0, 0)], schema)
    batch = spark.createDataFrame([(1, 1, 99.0, 1), (1, 2, 5.0, 3), (1, 2, 4.0, 2), (2, 1, None, 4), (2, 1, 7.0, 5)], schema)
    once = tt.insert_ignore(target, batch, ["k", "t"], "seq", time_col="t")
    want = [(1, 1, 10.0, 0), (1, 2, 4.0, 2), (2, 1, None, 4)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, tt.insert_ignore(once, batch, ["k", "t"], "seq").collect())) == want


def test_upsert_replaces_and_never_loses_a_key(spark):
    schema = "k long, v double, seq long"
    target = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 1)], schema)
    batch = spark.createDataFrame([(2, 8.0, 5), (2, None, 6), (3, 3.0, 2)], schema)
    assert sorted(map(tuple, tt.upsert_latest(target, batch, ["k"], "seq").collect())) == [(1, 1.0, 1), (2, None, 6), (3, 3.0, 2)]


def test_partitioned_write_and_trim(spark, tmp_path):
    df = spark.sql("SELECT id AS station_id, timestamp_ntz'2024-01-01 20:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(10)")
    tt.write_partitioned(df, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02"]
    assert tt.retention_trim(back, "2024-01-02 06:00:00", 4, ts="ts").count() == 4


def brute_stats(grid, r, row, col):
    part = grid[max(0, row - r):row + r + 1, max(0, col - r):col + r + 1]
    return np.nanmean(part), np.nanstd(part)


def test_elevation_tiles_and_focal_stats(spark, tmp_path):
    rng = np.random.default_rng(3)
    grids = {}
    for name in ("N32E035.hgt", "N32E036.hgt"):
        grid = rng.integers(-300, 900, (24, 24)).astype("float64")
        grid[rng.random((24, 24)) < 0.1] = np.nan
        np.where(np.isnan(grid), -32768, grid).astype(">i2").tofile(tmp_path / name)
        grids[name] = grid
    pixels = ra.read_elevation(spark, str(tmp_path))
    assert pixels.count() == 2 * 24 * 24
    rows = rs.focal_stats(pixels, {"local": 2, "regional": 5}).collect()
    assert len(rows) == sum(int((~np.isnan(g)).sum()) for g in grids.values())
    for r in rows:
        grid = grids[r.tile]
        assert r.elevation == grid[r["row"], r.col]
        for name, radius in (("local", 2), ("regional", 5)):
            mean, std = brute_stats(grid, radius, r["row"], r.col)
            assert r[f"tpi_{name}"] == pytest.approx(r.elevation - mean, abs=1e-9)
            assert r[f"roughness_{name}"] == pytest.approx(std, abs=1e-9)
    points = spark.createDataFrame([(1, 32.5, 35.5), (2, 10.0, 10.0)], "cell_id long, lat double, lon double")
    got = {r.cell_id: r for r in rs.terrain_stats(rs.pixel_of(points, 24), pixels, {"local": 2}).collect()}
    at = (got[1]["row"], got[1].col)
    assert at == (12, 12) and got[2].elevation is None
    want = grids["N32E035.hgt"][at]
    assert got[1].elevation == (None if np.isnan(want) else want)


def test_nearest_lattice_takes_the_lower_of_a_tie_and_clamps(spark):
    grid = spark.createDataFrame([(0.5 * i, 10 + 0.25 * j, float(100 * i + j)) for i in range(4) for j in range(5)],
                                 "lat double, lon double, dist double")
    points = [(1, 0.24, 10.1), (2, 0.25, 10.125), (3, 0.26, 10.13), (4, -9.0, 99.0), (5, 1.5, 11.0)]
    p = spark.createDataFrame(points, "cell_id long, lat double, lon double")
    got = {r.cell_id: r.dist for r in rs.nearest_lattice(p, ra.lattice_table(grid)).collect()}
    lats, lons = np.arange(4) * 0.5, 10 + np.arange(5) * 0.25
    for i, lat, lon in points:
        assert got[i] == 100.0 * np.argmin(abs(lats - lat)) + np.argmin(abs(lons - lon))


def test_nearest_lattice_takes_the_nearest_on_uneven_axes(spark):
    lats, lons = np.array([0.0, 0.125, 4.0, 4.5, 64.0]), np.array([-8.0, 1.0, 1.5, 2.0])
    grid = spark.createDataFrame([(float(a), float(b), float(100 * i + j)) for i, a in enumerate(lats) for j, b in enumerate(lons)],
                                 "lat double, lon double, dist double")
    rng = random.Random(4)
    points = [(n, rng.uniform(-10, 80), rng.uniform(-12, 4)) for n in range(200)] + [(200, 4.25, 1.25), (201, 2.0625, -3.5)]
    p = spark.createDataFrame(points, "cell_id long, lat double, lon double")
    got = {r.cell_id: r.dist for r in rs.nearest_lattice(p, ra.lattice_table(grid)).collect()}
    for i, lat, lon in points:
        assert got[i] == 100.0 * np.argmin(abs(lats - lat)) + np.argmin(abs(lons - lon))


def test_terrain_from_stored_sums_equals_the_full_pass(spark, tmp_path):
    rng = random.Random(7)
    rows = [(t, r, c, None if rng.random() < 0.1 else rng.randrange(-50, 900)) for t in ("A", "B") for r in range(150) for c in range(140)
            if not (t == "B" and r > 120 and c > 90)]  # a ragged end
    pixels = spark.createDataFrame(rows, "tile string, row int, col int, elev int")
    radii = {"local": 3, "regional": 70}
    full = {(x.tile, x.row, x.col): x for x in rs.focal_stats(pixels.filter("tile = 'A'"), radii).collect()}
    ragged = np.full((150, 140), np.nan)
    for t, r, c, e in rows:
        if t == "B" and e is not None:
            ragged[r, c] = e
    rs.store_sums(pixels, str(tmp_path / "sums"))
    asked = [(i, rng.choice("AB"), rng.randrange(-3, 155), rng.randrange(-3, 145)) for i in range(300)] + [(300, "C", 1, 1), (301, "A", 0, 0)] * 2
    points = spark.createDataFrame(asked, "id int, tile string, row int, col int")
    got = rs.terrain_by_sums(points, str(tmp_path / "sums"), radii).collect()
    assert len(got) == len(asked)
    for p in got:
        if p.tile == "B" and 0 <= p.row < 150 and 0 <= p.col < 140 and not np.isnan(ragged[p.row, p.col]):
            for name, radius in radii.items():
                mean, std = brute_stats(ragged, radius, p.row, p.col)
                assert (p[f"tpi_{name}"], p[f"roughness_{name}"]) == pytest.approx((p.elevation - mean, std), abs=1e-9)
            continue
        want = full.get((p.tile, p.row, p.col))
        for c in ("elevation", "tpi_local", "roughness_local", "tpi_regional", "roughness_regional"):
            assert p[c] == (want[c] if want else None)


def test_few_points_read_few_strips(spark, tmp_path, monkeypatch):
    pixels = spark.range(640 * 130).selectExpr("'A' AS tile", "CAST(id DIV 130 AS INT) AS row", "CAST(id % 130 AS INT) AS col", "CAST(id % 97 AS INT) AS elev")
    rs.store_sums(pixels, str(tmp_path / "sums"))
    points = spark.createDataFrame([(1, "A", 300, 50)], "id int, tile string, row int, col int")
    out = rs.terrain_by_sums(points, str(tmp_path / "sums"), {"local": 2})
    assert out.first().elevation == (300 * 130 + 50) % 97
    scans = [line for line in out._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in line and "part" in line]
    assert any("A/4" in line and "A/9" not in line for line in scans)


def test_tile_files_round_trip(spark):
    rows = [("N01E002.hgt", r, c, None if (r + c) % 5 == 0 else (r * 37 + c) * (-1) ** c) for r in range(9) for c in range(9) if (r, c) != (4, 4)]
    pixels = spark.createDataFrame(rows, "tile string, row int, col int, elev int")
    files = ra.tile_files(pixels, 9)
    assert len(files.first().content) == 2 * 81
    got = {(r["row"], r.col): r.elev for r in ra.decode_tiles(files).collect()}
    assert len(got) == 81 and got == {**{(r, c): e for _, r, c, e in rows}, (4, 4): None}


def snapshot_rows(table):
    return {(r.k, r.v) for r in table.read().collect()}


def test_a_crash_between_the_steps_leaves_the_old_snapshot(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k int, v int")
    assert snapshot_rows(table) == set() and table.version() == 0
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int")
    assert table.replace(frame([(1, 1), (2, 2)])) == 1
    table.write(frame([(9, 9)]))  # the writer dies before it publishes
    assert snapshot_rows(table) == {(1, 1), (2, 2)}
    assert table.upsert(frame([(2, 5), (2, 7), (3, 3)]), ["k"], "v") == 2
    assert snapshot_rows(table) == {(1, 1), (2, 7), (3, 3)} and table.read(1).count() == 2
    assert table.clean(1) == 2 and snapshot_rows(table) == {(1, 1), (2, 7), (3, 3)}


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    table, other = (Snapshots(spark, str(tmp_path / "t"), "k int, v int") for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int")
    table.replace(frame([(1, 1)]))
    mine, theirs = table.write(frame([(1, 2)])), other.write(frame([(1, 3)]))
    table.publish(mine, 2)
    with pytest.raises(Conflict):
        other.publish(theirs, 2)
    assert snapshot_rows(other) == {(1, 2)}
    publish, raced = Snapshots.publish, []

    def late(self, name, version):
        if not raced:
            raced.append(1)
            publish(table, table.write(frame([(1, 2), (4, 4)])), version)
        publish(self, name, version)

    monkeypatch.setattr(Snapshots, "publish", late)
    assert other.upsert(frame([(5, 5)]), ["k"], "v") == 4  # starts anew on what the other writer left
    assert snapshot_rows(table) == {(1, 2), (4, 4), (5, 5)}


def test_axes_in_many_blocks_give_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(ra, "AXIS_BLOCK", 7)
    rng = random.Random(2)
    lats = sorted({round(rng.expovariate(1), 3) for _ in range(60)})  # crowded at one end
    grid = spark.createDataFrame([(i, j, lat, 0.5 * j, float(100 * i + j)) for i, lat in enumerate(lats) for j in range(4)],
                                 "lat_idx long, lon_idx long, lat double, lon double, dist double")
    asked = [(n, rng.uniform(-1, 6), rng.uniform(-1, 3)) for n in range(200)] + [(200 + n, lat, 0.25) for n, lat in enumerate(lats)] + [(999, None, 1.0)]
    got = {r.cell_id: r for r in rs.nearest_lattice(spark.createDataFrame(asked, "cell_id long, lat double, lon double"), grid).collect()}
    assert len(got) == len(asked) and got[999].dist is None
    for n, lat, lon in asked[:-1]:
        i = min(range(len(lats)), key=lambda k: (abs(lats[k] - lat), k))
        j = min(range(4), key=lambda k: (abs(0.5 * k - lon), k))
        assert got[n].dist == 100 * i + j
    back = {(r.lat, r.lon): (r.lat_idx, r.lon_idx) for r in ra.lattice_table(grid.select("lat", "lon", "dist")).collect()}
    assert back == {(lat, 0.5 * j): (i, j) for i, lat in enumerate(lats) for j in range(4)}
