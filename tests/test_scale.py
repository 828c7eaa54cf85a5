"""Large tables: what is moved, stored and carried along."""

import random

import pytest
from pyspark.sql import functions as F

from isohyet.operators import interpolate as ip
from isohyet.operators import raster as rs
from isohyet.plans import models as ml
from isohyet.plans import registry
from isohyet.plans import testbed as tb
from isohyet.schemas import MEASURES, STATIC, TERRAIN
from isohyet.sources import rasters as ra

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def grid(spark):
    """Cells with three of twelve stations in order of distance, and series with holes over two blocks of hours."""
    rng = random.Random(11)
    places = {s: (rng.uniform(32, 33), rng.uniform(35, 36)) for s in range(1, 13)}
    cells = []
    for c in range(60):
        lat, lon = rng.uniform(32, 33), rng.uniform(35, 36)
        near = sorted(places, key=lambda s: (places[s][0] - lat) ** 2 + (places[s][1] - lon) ** 2)[:3]
        cells.append((c, lat, lon, *near, 1.0, 2.0, 4.0))
    cells.append((60, 32.5, 35.5, 1, 2, None, 1.0, 2.0, None))
    hourly = {(s, h): [None if rng.random() < 0.2 else float(rng.randrange(64)) for _ in MEASURES]
              for s in places for h in range(715, 727) if rng.random() < 0.6}
    names = "cell_id long, lat double, lon double, " + ", ".join([*[f"{c} long" for c in ip.TRIO], *[f"{c} double" for c in ip.DISTANCES]])
    series = spark.createDataFrame([(s, h, *v) for (s, h), v in hourly.items()], "station_id long, h long, " + ", ".join(f"{m} double" for m in MEASURES))
    return cells, hourly, spark.createDataFrame(cells, names), series


@pytest.mark.parametrize("most", [5, 1000])
def test_series_of_cells_equal_a_walk_over_them(grid, most):
    cells, hourly, near, series = grid
    for frame in (near, near.drop("lat", "lon")):
        got = {(r.cell_id, r.h): tuple(r[f"{m}_n{i}"] for i in (1, 2, 3) for m in MEASURES) for r in ip.cell_series(frame, series, cells_per_salt=most).collect()}
        nothing = [None] * len(MEASURES)
        want = {(c[0], h): tuple(v for s in c[3:6] for v in hourly.get((s, h), nothing)) for c in cells[:-1] for h in {h for s, h in hourly if s in c[3:6]}}
        assert got == want


def test_neither_trios_nor_cells_of_a_series_move(spark, grid):
    _, _, near, series = grid
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ip.cell_series(near, series))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(neighbor" not in text and "hashpartitioning(_group" in text


def test_features_of_station_targets_bring_their_label(spark, grid):
    _, hourly, near, series = grid
    rows = ip.cell_series(near.filter("cell_id BETWEEN 1 AND 12"), series, own=True)
    got = {(r.cell_id, r.h): r.td_own for r in rows.collect()}
    at = MEASURES.index("td")
    assert got and all(v == hourly.get(k, [None] * 8)[at] for k, v in got.items())
    labelled = ip.training_rows(rows, series, "td")
    joined = ip.training_rows(rows.drop(*[f"{m}_own" for m in MEASURES]), series, "td")
    assert not any(c.endswith("_own") for c in labelled.columns)
    assert sorted(map(str, labelled.select(joined.columns).collect())) == sorted(map(str, joined.collect()))
    assert plan(labelled).count("Join") < plan(joined).count("Join")


def test_linear_folds_store_sums_and_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    extra = [*STATIC, *TERRAIN]
    st = spark.createDataFrame([(s, rng.uniform(32, 33), rng.uniform(35, 36), *[rng.uniform(0, 9) for _ in extra]) for s in range(1, 8)],
                               "station_id long, latitude double, longitude double, " + ", ".join(f"{c} double" for c in extra))
    series = spark.createDataFrame([(s, h, *[float(s + h + i) for i in range(len(MEASURES))]) for s in range(1, 8) for h in range(40)],
                                   "station_id long, h long, " + ", ".join(f"{m} double" for m in MEASURES))
    stored, cut = [], ml.cut_lineage

    def counted(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(ml, "cut_lineage", counted)
    assert ml.linear_cross_validate(st, series, "td").count() == 7
    assert max(df.count() for df in stored) <= 7 * 8  # a station and fold


@pytest.mark.parametrize("name", ["tweedie_rain", "hurdle_rain"])
def test_rain_models_store_only_their_inputs(spark, monkeypatch, name):
    widths = []

    def width(df):
        widths.append(len(df.columns))
        raise Stop

    monkeypatch.setattr(registry, "cut_lineage", width)
    with pytest.raises(Stop):
        registry.QUERIES[name](spark, SF)
    assert widths[0] <= 10


@pytest.mark.parametrize("name", ["local_lags", "upstream_features", "forecast_features", "lag_correlation"])
def test_a_grid_that_is_read_once_is_not_stored(spark, monkeypatch, name):
    def stored(*_):
        raise AssertionError("the grid was stored")

    monkeypatch.setattr(tb, "stored_grid", stored)
    registry.QUERIES[name](spark, SF)


def test_baseline_scores_join_no_rows_by_measure(spark):
    text = plan(registry.QUERIES["idw_leave_out_scores"](spark, SF))
    assert not any("Join" in line and "measure" in line for line in text.splitlines())


def test_a_point_never_carries_a_block_of_an_axis(spark, monkeypatch):
    lattice = spark.range(400 * 3).selectExpr("id DIV 3 AS lat_idx", "id % 3 AS lon_idx", "(id DIV 3) * (id DIV 3) / 100D AS lat", "id % 3 + 0D AS lon", "id + 0D AS dist")
    monkeypatch.setattr(ra, "AXIS_BLOCK", 150)
    monkeypatch.setattr(ra, "AXIS_PART", 8)
    at = [-5.0, 0.0, 0.3, 77.77, 640.09, 1591.0, 1e6, None]
    points = spark.createDataFrame([(n, v, 1.2) for n, v in enumerate(at)], "cell_id long, lat double, lon double")
    got = {r.cell_id: r.lat_idx for r in rs.nearest_lattice(points, lattice).collect()}
    axis = [i * i / 100 for i in range(400)]
    assert got == {n: None if v is None else min(range(400), key=lambda i: (abs(axis[i] - v), i)) for n, v in enumerate(at)}
    placed = ra.Axis(lattice, "lat").attach(points, "lat")
    assert placed.agg(F.max(F.size("_axis.v"))).first()[0] <= 8


def test_forecast_training_stores_no_second_table(spark, monkeypatch):
    """Features with their targets are one table, made with one shuffle of the cells."""
    names = ", ".join(f"{m} double" for m in MEASURES)
    cells = spark.createDataFrame([(c, h, *[float((c * h + i) % 7) for i in range(len(MEASURES))]) for c in (1, 2) for h in range(473400, 473460)], f"cell_id long, h long, {names}")
    made = registry.lg.horizon_targets(registry.lg.forecast_features(cells, cells.withColumnRenamed("cell_id", "station_id"), {"west": 1}))
    assert plan(made).count("Exchange hashpartitioning(cell_id") == 1
    features = made.cache()
    plain = ml.train_forecast(features.drop(*[c for c in features.columns if c.startswith("target_t")]), {"west": 1}, [1], kind="forest", numTrees=2, maxDepth=2)

    def stored(_):
        raise AssertionError("stored again")

    monkeypatch.setattr(ml, "cut_lineage", stored)
    models = ml.train_forecast(features, {"west": 1}, [1], kind="forest", numTrees=2, maxDepth=2)
    assert str(models[1].stages[-1].featureImportances) == str(plain[1].stages[-1].featureImportances)


def test_a_day_of_one_batch_is_read_without_an_aggregation(spark, tmp_path):
    from isohyet.streaming import hourly as st
    values = ", ".join(f"{float(n)}D AS {m}" for n, m in enumerate(MEASURES))
    for batch, hours in ((0, "0L, 24L"), (1, "24L, 48L")):
        rows = spark.sql(f"SELECT 7L AS cell_id, explode(array({hours})) AS h, {values}").withColumn("rain", F.lit(float(batch)))
        st._write(rows.withColumn("date", st.index_hour("h").cast("date")), f"{tmp_path}/grid", ["date", "batch"], batch)
    got = {r.h: r.rain for r in st.current_grid(spark, str(tmp_path)).collect()}
    assert got == {0: 0.0, 24: 1.0, 48: 1.0}
    one = st.current_grid(spark, str(tmp_path), [st._date(0)])
    rows = one.collect()
    assert [(r.h, r.rain) for r in rows] == [(0, 0.0)]
    st._write(spark.sql(f"SELECT 7L AS cell_id, 0L AS h, {values}, DATE'1970-01-01' AS date"), f"{tmp_path}/alone", ["date", "batch"], 0)
    assert "Aggregate" not in plan(st._versions(spark, f"{tmp_path}/alone", st.GRID_SCHEMA, ["cell_id", "h"], None))


def test_triangles_are_chosen_on_all_cores(spark):
    """Few bytes, much work: merged by size the candidate lists of thousands of targets were one task."""
    from isohyet.operators import neighbors as nb
    st = spark.range(1, 400).selectExpr("id AS station_id", "32 + id * 37 % 400 / 400D AS latitude", "35 + id * 91 % 397 / 397D AS longitude")
    sizes = [r["count"] for r in nb.station_neighbors(st).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 399
