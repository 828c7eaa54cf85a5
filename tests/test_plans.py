"""The physical plans are the ones the operators promise."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from isohyet.operators import clean as cl
from isohyet.operators import interpolate as ip
from isohyet.operators import lags as lg
from isohyet.operators import neighbors as nb
from isohyet.operators import raster as rs
from isohyet.plans import testbed as tb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_python(spark):
    st, ce, hourly = tb.stored_stations(spark, SF), tb.cells(spark, SF), tb.stored_clean(spark, SF)
    near = tb.neighbors(spark, SF)
    for df in (
        nb.nearest_stations(ce, st), nb.triangle_neighbors(ce, st), nb.leave_location_out(st), tb.clean(spark, SF),
        ip.idw_grid(near, hourly), lg.forecast_features(ip.idw_grid(near, hourly), hourly, tb.UPSTREAM),
        rs.focal_stats(tb.pixels(spark, SF), tb.LOCAL_RADII),
    ):
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert bad not in text


def test_nearest_keeps_only_the_best_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(nb.nearest_stations(tb.cells(spark, SF), tb.stored_stations(spark, SF)))


def test_cleaning_shuffles_twice_and_reads_only_its_columns(spark):
    df = cl.hourly_clean(tb.readings(spark, SF))
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 2  # roll-up by station and hour, windows by station
    assert text.count("partial_sum") >= 1
    narrow = plan(cl.hourly_rollup(tb.readings(spark, SF)).select("station_id", "h", "tdmax"))
    assert "value" not in narrow.split("ReadSchema: ")[1]


def test_all_lags_share_one_sort(spark):
    grid = tb.stored_grid(spark, SF)
    text = plan(lg.local_lags(grid))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1 and text.count("Window [") == 1


def test_upstream_columns_do_not_move_the_cells(spark):
    hourly, grid = tb.stored_clean(spark, SF), tb.stored_grid(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lg.forecast_features(grid, hourly, tb.UPSTREAM))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text  # the lags' own


def test_time_filters_reach_the_scan(spark):
    o = tb.table(spark, SF, "orders")
    text = plan(o.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


@pytest.mark.parametrize("name", [
    "flatten_observations", "station_catalog", "hourly_clean", "insert_ignore", "upsert_latest", "incremental_filter",
    "grid_cells", "knn_join", "triangle_neighbors", "idw_grid", "forecast_features", "now_layer", "demo_page",
    "persistence_skill", "terrain_stats", "nearest_lattice", "replay"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(r[cols.index(c)] for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_with_sql_exists():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"cell_id", "hour", "rain", "band"} <= set(df.columns)
