"""Registered queries over the driver's tables, one or more per operator."""

from __future__ import annotations

import math
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.functions import geo, weather
from isohyet.functions.calendar import cyclic_time, horizon_times, index_hour, local_time, text_time
from isohyet.operators import clean as cl
from isohyet.operators import interpolate as ip
from isohyet.operators import lags as lg
from isohyet.operators import layers as ly
from isohyet.operators import neighbors as nb
from isohyet.operators import raster as rs
from isohyet.operators import verify as vf
from isohyet.plans import models as ml
from isohyet.plans import pipeline as pl
from isohyet.plans import testbed as tb
from isohyet.schemas import (
    HORIZONS, LOCAL_ZONE, MAX_MISSING_SHARE, MAX_TEMPERATURE, MEASURES, STATION_METADATA, WINDOW_HOURS,
)
from isohyet.session import checkpoint_root, cut_lineage
from isohyet.sources import observations as ob
from isohyet.sources import rasters as ra
from isohyet.sources import tables as tt
from isohyet.sources.snapshots import Snapshots
from isohyet.streaming.hourly import (
    current_bins, current_forecasts, current_grid, hourly_batch, hourly_bins, run_hourly, unique_readings, use_rocksdb,
)


def shown(df: DataFrame, drop=("h",)) -> DataFrame:
    """Six decimals and no negative zero, for comparison between engines."""
    return df.selectExpr(*[
        f"rint(`{f.name}` * 1e6D) / 1e6D + 0D AS `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields if f.name not in drop
    ])


def flatten_observations(spark, sf):
    return shown(ob.flatten_observations(tb.payloads(spark, sf)))


def normalize_time(spark, sf):
    return shown(cl.normalize_readings(ob.flatten_observations(tb.payloads(spark, sf))))


def station_catalog(spark, sf):
    """Catalogue rows from customer, nation and region names; names with a digit go."""
    nations, regions, customers = (tb.table(spark, sf, t) for t in ("nation", "region", "customer"))
    names = (
        regions.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("n"))
        .unionByName(nations.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("n")))
        .unionByName(customers.select((F.col("c_custkey") + 1000).alias("id"),
                                      F.concat(F.col("c_mktsegment"), F.lit(" post")).alias("n")))
    )
    raw = names.select(
        F.col("id").alias("stationId"), F.col("n").alias("name"),
        F.struct((F.col("id") / 4).alias("latitude"), (F.col("id") / 8).alias("longitude")).alias("location"),
    )
    return shown(ob.station_catalog(raw))


def range_rules(spark, sf):
    return shown(weather.apply_ranges(tb.readings(spark, sf)))


def wind_components(spark, sf):
    df = weather.apply_ranges(tb.readings(spark, sf))
    return shown(df.select("event_id", weather.wind_u("ws", "wd").alias("u_vec"),
                           weather.wind_v("ws", "wd").alias("v_vec")))


def hourly_rollup(spark, sf):
    df = cl.hourly_rollup(tb.readings(spark, sf))
    return shown(df.withColumn("hour", index_hour("h")))


def hourly_spine(spark, sf):
    df = cl.fill_gaps(cl.hourly_rollup(tb.readings(spark, sf)), limit=0)
    return shown(df.select("station_id", index_hour("h").alias("hour"), "rain", "td"))


def gap_fill(spark, sf):
    df = cl.fill_gaps(cl.hourly_rollup(tb.readings(spark, sf)))
    return shown(df.withColumn("hour", index_hour("h")))


def hourly_clean(spark, sf):
    return shown(tb.clean(spark, sf))


def daily_clean(spark, sf):
    """The same cleaning with one-day bins, suppliers as stations and shipments as readings."""
    q = F.col("l_quantity")
    df = tb.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("station_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("l_returnflag") == "R", q).otherwise(0.0).alias("rain"), (q / 2).alias("ws"),
        (F.col("l_linenumber") * 45.0).alias("wd"), q.alias("td"), (q * 2.5).alias("rh"),
        (q + F.col("l_linenumber") - 2).alias("tdmax"), (q - F.col("l_linenumber") + 2).alias("tdmin"),
    )
    return shown(cl.hourly_clean(df, bin_hours=24))


def _orders(spark, sf):
    """Stored rows (before the cut) and a batch (from a week before it), several per key in both."""
    o = tb.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderkey", "o_totalprice"
    )
    return o, "2000-01-01", "1999-12-25"


def insert_ignore(spark, sf):
    """Orders per (customer, date): the first order key is kept, stored keys win over the batch."""
    o, cut, start = _orders(spark, sf)
    keys = ["o_custkey", "o_orderdate"]
    target = cl.first_per_key(o.filter(F.col("o_orderdate") < cut), keys, "o_orderkey")
    batch = o.filter(F.col("o_orderdate") >= start)
    return shown(tt.insert_ignore(target, batch, keys, "o_orderkey", time_col="o_orderdate"))


def upsert_latest(spark, sf):
    """Newest order per customer; customers without a new order keep their row."""
    o, cut, _ = _orders(spark, sf)
    target = cl.latest_per_key(o.filter(F.col("o_orderdate") < cut), ["o_custkey"], "o_orderkey")
    batch = o.filter(F.col("o_orderdate") >= cut)
    return shown(tt.upsert_latest(target, batch, ["o_custkey"], "o_orderkey"))


def snapshot_upsert(spark, sf):
    """The same as two upserts into a table of snapshots, read back."""
    o, cut, _ = _orders(spark, sf)
    target = cl.latest_per_key(o.filter(F.col("o_orderdate") < cut), ["o_custkey"], "o_orderkey")
    batch = o.filter(F.col("o_orderdate") >= cut)
    table = Snapshots(spark, f"{checkpoint_root(spark)}/snapshots-{uuid.uuid4().hex}", target.schema)
    half = F.floor(batch.agg(F.avg("o_orderkey")).scalar())
    table.replace(target)
    table.upsert(batch.filter(F.col("o_orderkey") < half), ["o_custkey"], "o_orderkey")
    table.upsert(batch.filter(F.col("o_orderkey") >= half), ["o_custkey"], "o_orderkey")
    return shown(table.read())


def retention_trim(spark, sf):
    return shown(tt.retention_trim(tb.clean(spark, sf), tb.NOW, WINDOW_HOURS))


def backfill_manifest(spark, sf):
    """Suppliers not loaded yet, with the number of line items each would add."""
    s = tb.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"),
                                               "s_acctbal")
    done = s.filter("s_acctbal < 2000")
    todo = tt.pending(s, done)
    rows = tb.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station_id"))
    return tt.manifest_rows(rows.join(todo.select("station_id"), "station_id", "left_semi"), todo)


def archive_run(spark, sf):
    """Readings through the CSV archive: a backfill of half the stations, one of all, read back and normalised."""
    root = f"{checkpoint_root(spark)}/archive-{uuid.uuid4().hex}"
    rows = cut_lineage(ob.flatten_observations(tb.payloads(spark, sf)))
    st = tb.stored_stations(spark, sf)
    catalog = st.select("station_id", F.concat(F.lit("Post "), F.col("station_id")).alias("name"), "latitude", "longitude")
    for some in (catalog.filter("station_id % 2 = 0"), catalog):  # the second run leaves out what the first has done
        tt.backfill(spark, some, rows, f"{root}/rows", f"{root}/manifest")
    return shown(cl.normalize_readings(ob.read_archive(spark, f"{root}/rows")))


def bootstrap_stations(spark, sf):
    """The station table filled from its JSON document; a second document finds it filled."""
    root = f"{checkpoint_root(spark)}/bootstrap-{uuid.uuid4().hex}"
    st = tb.stations(spark, sf).select(*STATION_METADATA.names)
    for n, rows in enumerate((st, st.filter("station_id = 1"))):  # a document is one array, one row a station
        rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(f"{root}/{n}")
        ob.bootstrap(spark, f"{root}/{n}", f"{root}/table", STATION_METADATA)
    return shown(spark.read.schema(STATION_METADATA).parquet(f"{root}/table"))


def replaced_table(spark, sf):
    """A table replaced as a whole, read back."""
    path = f"{checkpoint_root(spark)}/replaced-{uuid.uuid4().hex}"
    df = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    tt.replace_table(df, path)
    tt.replace_table(df.filter("o_orderkey % 3 = 0"), path)
    return shown(spark.read.schema(df.schema).parquet(path))


def ordered_export(spark, sf):
    """Rows of a JSON export in order of two columns, and whether files and the lines in them keep it."""
    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    df = tb.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    ob.export_json(df, path, ["o_custkey", "o_orderkey"])
    back = spark.read.schema(df.schema).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    at = F.struct("o_custkey", "o_orderkey")
    lines = back.withColumn("before", F.lag(at).over(Window.partitionBy("file").orderBy("line"))).withColumn("at", at)
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"),
                                      F.count_if(F.col("before") > F.col("at")).alias("wrong"))
    files = files.withColumn("wrong", F.col("wrong") + F.coalesce(F.lag("last").over(Window.orderBy("file")) > F.col("first"), F.lit(False)).cast("long"))
    return files.agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))  # a row a file


def incremental_filter(spark, sf):
    """Readings newer than the clean table of the station; that table stops at a different day each."""
    r = tb.readings(spark, sf)
    stop = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("station_id") % 20 + 5).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    have = cl.hourly_rollup(r.filter(F.col("ts") < stop)).withColumn("hour", index_hour("h"))
    return shown(cl.newer_than_clean(r, have))


def incremental_filter_global(spark, sf):
    r = tb.readings(spark, sf)
    have = cl.hourly_rollup(r.filter(F.col("ts") < "2024-01-20")).withColumn("hour", index_hour("h"))
    return shown(cl.newer_than_clean(r, have, scope="global"))


def closed_hours(spark, sf):
    df = cl.hourly_rollup(tb.readings(spark, sf)).withColumn("hour", index_hour("h"))
    return shown(cl.closed_hours(df, "2024-01-30 22:40:00"))


def required_stations(spark, sf):
    return nb.required_stations(tb.neighbors(spark, sf), tb.UPSTREAM.values())


def active_stations(spark, sf):
    wet = tb.clean(spark, sf).filter("rain > 20")
    return shown(nb.active_stations(tb.stations(spark, sf), wet, left_out=[tb.HOLDOUT]))


def grid_cells(spark, sf):
    """Cells of a lattice over all points that hold at least one of them, with their number."""
    box = {"lat_min": 32.0, "lat_max": 33.0, "lon_min": 35.0, "lon_max": 36.0, "step": 0.01}
    grid = nb.grid_cells(spark, **box)
    counts = tb.points(spark, sf).groupBy(
        geo.cell_id_of(F.col("lat"), F.col("lon"), **box).alias("cell_id")
    ).agg(F.count(F.lit(1)).alias("points"))
    return shown(grid.join(counts, "cell_id"))


def haversine_pairs(spark, sf):
    """Distance of every order's customer point to the cell of its line items' suppliers."""
    o = tb.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("cell_id"))
    l = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + 1).alias("_cell"))
    p = tb.points(spark, sf)
    c = tb.cells(spark, sf).select(F.col("cell_id").alias("_cell"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    df = l.join(o, l.l_orderkey == o.o_orderkey).join(p, "cell_id").join(c, "_cell")
    return shown(df.select("l_orderkey", "l_linenumber", F.col("_cell").alias("to_id"), geo.haversine(
        "lat", "lon", "_lat", "_lon").alias("distance_km")))


def knn_join(spark, sf):
    df = nb.nearest_stations(tb.points(spark, sf), tb.stored_stations(spark, sf))
    return shown(df.select("cell_id", "rank", F.col("neighbor_id").alias("station_id"), "distance_km"))


def triangle_neighbors(spark, sf):
    return shown(nb.triangle_neighbors(tb.points(spark, sf), tb.stored_stations(spark, sf)))


def station_neighbors(spark, sf):
    return shown(nb.station_neighbors(tb.stored_stations(spark, sf), holdout=tb.HOLDOUT))


def leave_location_out(spark, sf):
    return shown(nb.leave_location_out(tb.stored_stations(spark, sf)))


def available_cells(spark, sf):
    """Cells whose three neighbours all had rain of 30 mm in some hour."""
    wet = tb.stored_clean(spark, sf).filter("rain > 30")
    df = nb.available_cells(tb.neighbors(spark, sf), wet)
    return df.select("cell_id", *ip.TRIO)


def neighbor_features(spark, sf):
    near = tb.neighbors(spark, sf).select("cell_id", *ip.TRIO)
    df = ip.cell_series(near, tb.clean(spark, sf))
    return shown(df.withColumn("hour", index_hour("h")))


def static_features(spark, sf):
    df = ip.static_features(tb.neighbors(spark, sf), tb.stored_stations(spark, sf))
    return shown(df.drop(*ip.DISTANCES))


def bearing_elevation(spark, sf):
    df = ip.static_features(tb.neighbors(spark, sf), tb.stored_stations(spark, sf), terrain=False, relative=True)
    return shown(df.select("cell_id", *[f"{c}_n{i}" for c in ("elevation_diff", "bearing") for i in (1, 2, 3)]))


def interpolation_features(spark, sf):
    df = ip.interpolation_features(tb.neighbors(spark, sf), tb.stored_clean(spark, sf), tb.stored_stations(spark, sf))
    return shown(df.drop("lat", "lon"))


def idw_grid(spark, sf):
    return shown(tb.interpolated(spark, sf))


def cyclic_time_features(spark, sf):
    """Calendar encoding of every order's date."""
    o = tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("hour"))
    return shown(cyclic_time(o))


def local_lags(spark, sf):
    df = lg.local_lags(tb.interpolated(spark, sf).select("cell_id", "h", "hour", *["rain", "u_vec", "v_vec", "td", "rh"]))
    return shown(df)


def upstream_features(spark, sf):
    hourly = tb.stored_clean(spark, sf)
    df = lg.upstream_features(tb.interpolated(spark, sf, hourly).select("cell_id", "h", "hour", "u_vec", "v_vec"),
                              hourly, tb.UPSTREAM)
    return shown(df)


def forecast_features(spark, sf):
    hourly = tb.stored_clean(spark, sf)
    return shown(lg.forecast_features(tb.interpolated(spark, sf, hourly), hourly, tb.UPSTREAM))


def neighbor_lags(spark, sf):
    return shown(lg.neighbor_lags(tb.clean(spark, sf).select("station_id", "h", "hour", "rain", "td"), ["rain", "td"]))


def latest_per_cell(spark, sf):
    return shown(lg.latest_row(tb.stored_grid(spark, sf), order="hour"))


def now_layer(spark, sf):
    df = ly.now_layer(tb.newest_grid(spark, sf), tb.cells(spark, sf))
    return shown(ly.cell_rectangles(df).drop("label"))


def forecast_layer(spark, sf):
    df = ly.forecast_layer(tb.forecasts(spark, sf), tb.cells(spark, sf))
    return shown(ly.forecast_bands(df, HORIZONS).drop("label"))


def time_index(spark, sf):
    return ly.time_index(tb.stored_grid(spark, sf))


def demo_page(spark, sf):
    grid = tb.stored_grid(spark, sf).select("cell_id", "hour", "rain")
    return shown(ly.demo_page(grid, 100, "right"))


def demo_page_end(spark, sf):
    """Stepping right from the last page stays there."""
    grid = tb.stored_grid(spark, sf).select("cell_id", "hour", "rain")
    return shown(ly.demo_page(grid, 100000, "right"))


def horizon_labels(spark, sf):
    o = tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("hour"))
    return horizon_times(o)


def text_times(spark, sf):
    """Stored text form and local clock of every event."""
    e = tb.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return e.select("event_id", text_time(F.col("ts")).alias("stored"),
                    F.date_format(local_time(F.col("ts")), "yyyy-MM-dd HH:mm").alias("local"))


def rain_bands(spark, sf):
    df = tb.readings(spark, sf)
    return df.select("event_id", weather.rain_band("rain").alias("band"),
                     weather.rain_class("rain").alias("rain_class"))


def missingness_report(spark, sf):
    df = weather.apply_ranges(tb.readings(spark, sf)).withColumn("td", F.when(F.col("event_id") % 3 > 0, F.col("td")))
    return shown(cl.missingness(df, ["rain", "ws", "td", "rh"], MAX_MISSING_SHARE))


def quality_report(spark, sf):
    return cl.quality_report(tb.readings(spark, sf), MAX_TEMPERATURE / 2)


def longest_segment(spark, sf):
    df = cl.longest_segment(tb.stored_clean(spark, sf), ["td", "ws"])
    return df.select("station_id", "hours", index_hour("start_h").alias("start_hour"),
                     index_hour("end_h").alias("end_hour"), "ends_at_end")


def targets_by_horizon(spark, sf):
    return shown(lg.horizon_targets(tb.stored_grid(spark, sf).select("cell_id", "h", "hour", "rain")))


def _pairs(spark, sf, hourly):
    """Grid forecasts by persistence beside station rain at the closest cell's station."""
    st = tb.stored_stations(spark, sf)
    assigned = cut_lineage(nb.nearest_target(tb.cells(spark, sf), st))
    # only cells that a station is compared with are interpolated
    cells = cut_lineage(tb.cells(spark, sf).join(assigned.select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "lat", "lon"))
    near = cut_lineage(nb.triangle_neighbors(cells, st))
    grid = cut_lineage(ip.idw_grid(near, hourly).select("cell_id", "h", F.col("rain").alias("forecast")))
    made = grid.withColumn("horizon", F.explode(F.array(*[F.lit(n) for n in HORIZONS])))
    return vf.verification_pairs(made, hourly, assigned)


def nearest_cell(spark, sf):
    return shown(nb.nearest_target(tb.points(spark, sf), tb.stored_stations(spark, sf)))


def verification_pairs(spark, sf):
    df = _pairs(spark, sf, tb.stored_clean(spark, sf)).withColumn("hour", index_hour("h"))
    return shown(df.select("station_id", "cell_id", "hour", "horizon", "forecast", "observed"))


def forecast_errors(spark, sf):
    return shown(vf.error_metrics(_pairs(spark, sf, tb.stored_clean(spark, sf)), ["horizon"]))


def persistence_forecast(spark, sf):
    df = lg.persistence(tb.clean(spark, sf), key="station_id")
    return shown(df.withColumn("hour", index_hour("h")))


def persistence_skill(spark, sf):
    """Grid forecast against station persistence, per horizon."""
    hourly = tb.stored_clean(spark, sf)
    own = lg.persistence(hourly, key="station_id").select(
        "station_id", "h", "horizon", F.col("forecast").alias("persistence"))
    return shown(vf.skill(_pairs(spark, sf, hourly).join(own, ["station_id", "h", "horizon"]), ["horizon"]))


def event_scores(spark, sf):
    return shown(vf.event_scores(lg.persistence(tb.clean(spark, sf), key="station_id"), ["horizon"]))


def rain_class_weights(spark, sf):
    return shown(vf.rain_class_weights(tb.clean(spark, sf)))


def lag_correlation(spark, sf):
    grid = tb.interpolated(spark, sf).select("cell_id", "h", *["rain", "u_vec", "v_vec", "td", "rh"])
    df = lg.horizon_targets(lg.local_lags(grid))
    names = [f"{c}_t-{n}h" for c in ("rain", "td", "rh") for n in (1, 6, 24)]
    return shown(vf.lag_correlation(df, names, {f"target_t{n}": n for n in HORIZONS}))


def temporal_split(spark, sf):
    train, test = vf.temporal_split(tb.stored_clean(spark, sf))
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return shown(parts.select("part", "station_id", "hour", "rain"))


def bias_correction(spark, sf):
    """Persistence residuals by season on the other stations, subtracted at the held-out one."""
    pairs = lg.persistence(tb.clean(spark, sf), "td", key="station_id").filter(
        "forecast IS NOT NULL AND observed IS NOT NULL"
    ).withColumn("hour", index_hour("h"))
    pairs = pairs.withColumn("season", vf.season(F.col("hour"), LOCAL_ZONE))
    held = F.col("station_id") == tb.HOLDOUT
    bias = vf.bias_table(pairs.filter(~held), ["horizon", "season"])
    df = vf.bias_correct(pairs.filter(held), bias, ["horizon", "season"])
    return shown(df.select("station_id", "hour", "horizon", "season", "forecast", "observed", "corrected"))


def sensor_flags(spark, sf):
    hourly = tb.stored_clean(spark, sf)
    up = tb.stored_grid(spark, sf, hourly).select("cell_id", "h", "hour", "u_vec", "v_vec")
    df = lg.upstream_features(up, hourly, tb.UPSTREAM, hours=[])
    inputs = {"local_wind": "u_vec", **{name: f"u_vec_{name}" for name in tb.UPSTREAM}}
    return vf.sensor_flags(df, inputs).select("cell_id", "hour", "missing_sensors", "n_missing", "low_confidence")


def nearest_lattice(spark, sf):
    df = rs.nearest_lattice(tb.points(spark, sf), tb.lattice(spark, sf))
    return shown(df)


def lattice_index(spark, sf):
    grid = tb.lattice(spark, sf).select("lat", "lon", "dist")
    return shown(ra.lattice_table(grid))


def terrain_stats(spark, sf):
    return shown(rs.focal_stats(tb.pixels(spark, sf), tb.LOCAL_RADII))


def terrain_at_points(spark, sf):
    """Terrain of the pixel under every line item's part; parts beyond the raster give null."""
    at = F.floor((F.col("l_partkey") + 25) / tb.PIXEL_COLUMNS)
    p = tb.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("l_partkey").alias("point_id"), "n", F.floor(at / tb.PIXEL_ROWS).alias("tile"),
        (at % tb.PIXEL_ROWS).alias("row"), ((F.col("l_partkey") + 25) % tb.PIXEL_COLUMNS).alias("col"))
    return shown(rs.terrain_stats(p, tb.pixels(spark, sf), tb.LOCAL_RADII))


def build_cells(spark, sf):
    """The cell table end to end: tile bytes written and decoded, their sums stored, cells placed on pixels, exported in order, read back."""
    root = f"{checkpoint_root(spark)}/cells-{uuid.uuid4().hex}"
    parts = tb.table(spark, sf, "part")
    size = max(2, math.isqrt(max(parts.count() - 1, 0)) + 1)  # the square that holds every part
    drawn = parts.select(F.lit("N32E035.hgt").alias("tile"), F.floor(F.col("p_partkey") / size).alias("row"), (F.col("p_partkey") % size).alias("col"),
                         F.when(F.col("p_size") != 13, F.col("p_size") * 10).alias("elev")).filter(F.col("row") < size)
    ra.tile_files(drawn, size).write.parquet(f"{root}/tiles")
    rs.store_sums(ra.decode_tiles(spark.read.parquet(f"{root}/tiles")), f"{root}/sums")
    cells = tb.cells(spark, sf).select("cell_id", "lat", "lon")
    made = pl.build_cells(cells, tb.stored_stations(spark, sf), tb.clean(spark, sf), f"{root}/sums", tb.lattice(spark, sf), (), size, tb.LOCAL_RADII)
    ob.export_json(made, f"{root}/cells", ["cell_id"])
    return shown(spark.read.schema(made.schema).json(f"{root}/cells"))


def tile_names(spark, sf):
    """Elevation tile of points spread over both hemispheres."""
    p = tb.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 170 - 85.25).alias("lat"),
                                               (F.col("c_custkey") % 350 - 175.75).alias("lon"))
    return p.select("c_custkey", geo.tile_name(F.col("lat"), F.col("lon")).alias("tile"))


def idw_leave_out_scores(spark, sf):
    """The distance-weighted baseline scored at every station from its neighbours alone."""
    hourly = tb.stored_clean(spark, sf)
    near = nb.station_neighbors(tb.stored_stations(spark, sf)).withColumnRenamed("station_id", "cell_id")
    own = [f"{c}_own" for c in MEASURES]
    series = ip.cell_series(ip.with_weights(near.select("cell_id", "lat", "lon", *ip.TRIO, *ip.DISTANCES)), hourly, own=True)
    est = ip.idw(series, keep=("cell_id", *own)).filter(F.coalesce(*own).isNotNull())  # each value beside the observed one
    pairs = est.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("forecast"), F.col(f"{c}_own").alias("observed")) for c in MEASURES])).alias("e")).select("e.*")
    return shown(vf.error_metrics(pairs, ["measure"]))


def rfsi_train_score(spark, sf):
    """Train the learned interpolation on all stations and score every cell and hour."""
    hourly, st = tb.stored_clean(spark, sf), tb.stored_stations(spark, sf)
    train = ml.target_features(nb.station_neighbors(st, holdout=tb.HOLDOUT).filter(F.col("station_id") != tb.HOLDOUT), hourly, st)
    models = ml.train_interpolation(train, hourly)
    return shown(ml.score_interpolation(ip.interpolation_features(tb.neighbors(spark, sf), hourly, st), models))


def forecast_train_score(spark, sf):
    """Train the four horizon models on the earlier hours and forecast from every cell's newest row."""
    hourly = tb.stored_clean(spark, sf)
    features = cut_lineage(lg.horizon_targets(lg.forecast_features(tb.interpolated(spark, sf, hourly), hourly, tb.UPSTREAM)))
    models = ml.train_forecast(features, tb.UPSTREAM)
    return shown(ml.latest_forecast(features, models))


def importance_shift(spark, sf):
    """Feature importance at every horizon, and its change from the first to the last."""
    hourly = tb.stored_clean(spark, sf)
    features = cut_lineage(lg.horizon_targets(lg.forecast_features(tb.interpolated(spark, sf, hourly), hourly, tb.UPSTREAM)))
    models = ml.train_forecast(features, tb.UPSTREAM, kind="forest")
    return shown(vf.importance_shift(ml.importances(models, ml.forecast_columns(tb.UPSTREAM)), *HORIZONS))


def tweedie_rain(spark, sf):
    """Zero-inflated rain model scored at the station targets beside the distance-weighted value."""
    hourly, st = tb.stored_clean(spark, sf), tb.stored_stations(spark, sf)
    table = ml.target_features(nb.station_neighbors(st), hourly, st)
    columns = [*[f"rain_n{i}" for i in (1, 2, 3)], *[f"dist_n{i}" for i in (1, 2, 3)], "elevation_target"]
    rows = cut_lineage(ip.training_rows(table, hourly, "rain").select("cell_id", "hour", "label", *columns))
    model = ml.regression(columns, "tweedie", "estimate").fit(rows)
    return shown(model.transform(rows).select("cell_id", "hour", "label", "estimate"))


def cross_validation(spark, sf):
    """Scores of the learned wind speed at every station, each held out in a fold of its own."""
    hourly, st = tb.stored_clean(spark, sf), tb.stored_stations(spark, sf)
    return shown(ml.cross_validate(st, hourly, "ws"))


def linear_cross_validation(spark, sf):
    """A linear correction of the distance-weighted wind speed, fitted without each station and scored there, all folds at once."""
    return shown(ml.linear_cross_validate(tb.stored_stations(spark, sf), tb.stored_clean(spark, sf), "ws"))


def hurdle_rain(spark, sf):
    """Rows, wet hours and share of dry ones at every station, and whether the hurdle model keeps to its rules there.

    Its forecasts are whole and not negative, and over all stations its error in wet hours is no worse than the Tweedie model's.
    """
    hourly, st = tb.stored_clean(spark, sf), tb.stored_stations(spark, sf)
    columns = [*[f"rain_n{i}" for i in (1, 2, 3)], *[f"dist_n{i}" for i in (1, 2, 3)], "elevation_target"]
    rows = ip.training_rows(ml.target_features(nb.station_neighbors(st), hourly, st), hourly, "rain")
    rows = cut_lineage(rows.select("cell_id", "label", *columns))
    scored = ml.hurdle(columns, "hurdle").fit(rows).transform(rows)
    scored = ml.regression(columns, "tweedie", "glm").fit(rows).transform(scored.select(*rows.columns, "hurdle"))
    scored = cut_lineage(scored.select("cell_id", "label", "hurdle", "glm"))
    wet = scored.filter("label >= 0.1").agg(F.struct(*[F.sqrt(F.avg((F.col(c) - F.col("label")) ** 2)).alias(c) for c in ("hurdle", "glm")])).scalar()
    return shown(scored.groupBy(F.col("cell_id").alias("station_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") >= 0.1).alias("wet"), F.avg((F.col("label") < 0.1).cast("double")).alias("dry_share"),
        F.coalesce(F.min("hurdle") >= 0, F.lit(False)).alias("not_negative"), (F.count("hurdle") == F.count(F.lit(1))).alias("whole"),
    ).withColumn("no_worse", wet["hurdle"] <= wet["glm"]))


def null_routing(spark, sf):
    """Nulls of every input of a temperature forest, a fifth of them made, and whether directions learned at the splits do no worse than flags.

    Both forests learn from the earlier hours and are scored on the later ones.
    """
    hourly, st = tb.stored_clean(spark, sf), tb.stored_stations(spark, sf)
    columns = [*[f"td_n{i}" for i in (1, 2, 3)], *[f"dist_n{i}" for i in (1, 2, 3)]]
    rows = ip.training_rows(ml.target_features(nb.station_neighbors(st), hourly, st), hourly, "td").select("cell_id", "h", "hour", "label", *columns)
    rows = cut_lineage(rows.withColumns({c: F.when((F.col("h") * 7 + F.col("cell_id") * 13 + n) % 5 != 0, F.col(c)) for n, c in enumerate(columns)}))
    early, late = vf.temporal_split(rows)
    either = ml.nullable_columns(early, columns)
    error = {}
    for name, more in (("either", {"either": either}), ("flags", {"flags": either})):
        model = ml.regression(columns, "forest", "guess", **more).fit(early)
        error[name] = model.transform(late).agg(F.sqrt(F.avg((F.col("guess") - F.col("label")) ** 2))).first()[0]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("nulls")) for c in columns]))
    return counts.select("n", each.alias("e")).select("e.input", "e.nulls", "n", F.lit(error["either"] <= 1.02 * error["flags"]).alias("no_worse"))


def _streamed(spark, sf):
    events = spark.readStream.schema(tb.table(spark, sf, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(sf)
    return tb.as_readings(events).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly(spark, sf):
    """The whole event table through the hourly stream; the newest version of every bin."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    run_hourly(_streamed(spark, sf), root, f"{root}/checkpoint", series=False).awaitTermination()
    bins = current_bins(spark, root)
    return shown(bins.select("station_id", index_hour("h").alias("hour"), *MEASURES))


def stream_closed_bins(spark, sf):
    """Bins that a one-hour watermark has closed, as the append stream emits them."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    hourly_bins(_streamed(spark, sf), "1 hour").writeStream.outputMode("append").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(
        f"{root}/bins").awaitTermination()
    return shown(spark.read.parquet(f"{root}/bins").withColumn("hour", F.col("hour").cast("timestamp_ntz")))


def stream_unique(spark, sf):
    """Readings without repeats, by state that a watermark bounds (on RocksDB).

    Three loads of ten days.  Repeats come a load later; a sixth of the readings is held back to the last load, where those more than
    48 hours older than the first load's newest are late and do not count.
    """
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    load = F.when(F.col("ts") < F.lit("2024-01-11"), 0).when(F.col("ts") < F.lit("2024-01-21"), 1).otherwise(2)
    rows = tb.readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "station_id", "ts", load.alias("load"))
    rows = rows.withColumn("load", F.when(F.col("event_id") % 6 == 1, F.lit(2)).otherwise(F.col("load")))
    rows = rows.unionByName(rows.filter("event_id % 4 = 0 AND load < 2").withColumn("load", F.col("load") + 1))
    files = 4  # of each load
    for n in range(3):
        rows.filter(F.col("load") == n).select("station_id", "ts").repartition(files).write.parquet(f"{root}/in/{n}")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    use_rocksdb(spark)
    try:
        stream = spark.readStream.schema("station_id long, ts timestamp").option("maxFilesPerTrigger", files).option(
            "recursiveFileLookup", True).parquet(f"{root}/in")
        unique_readings(stream).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(
            availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_now():
    return datetime.strptime(tb.NOW, "%Y-%m-%d %H:%M:%S")


def _gridded(spark, sf):
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    run_hourly(_streamed(spark, sf), root, f"{root}/checkpoint", tb.neighbors(spark, sf), now=_stream_now).awaitTermination()
    return root


def stream_forecasts(spark, sf):
    """Latest forecast of every cell from the last 27 closed hours."""
    return shown(current_forecasts(spark, _gridded(spark, sf)).withColumn("hour", index_hour("h")))


def stream_grid(spark, sf):
    """Every closed hour that the stream has interpolated."""
    return shown(current_grid(spark, _gridded(spark, sf)).withColumn("hour", index_hour("h")))


def stream_late(spark, sf):
    """The grid after three batches: every third reading comes late, repeats with other values and readings ahead of time too."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = tb.readings(spark, sf)
    ahead = rows.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts + INTERVAL 40 DAYS"))
    copies = rows.filter("event_id % 7 = 0").withColumns({"rain": F.col("rain") + 8, "event_id": F.col("event_id") + 3 * 10**9})
    step = hourly_batch(root, tb.neighbors(spark, sf), now=_stream_now, order="event_id")
    step(rows.filter("event_id % 3 > 0").unionByName(ahead), 0)
    step(rows.filter("event_id % 3 = 0 AND event_id % 2 = 0").unionByName(copies.filter("event_id % 3 > 0")), 1)
    step(rows.filter("event_id % 3 = 0 AND event_id % 2 = 1").unionByName(copies.filter("event_id % 3 = 0")), 2)
    return shown(current_grid(spark, root).withColumn("hour", index_hour("h")))


def stream_metrics(spark, sf):
    """What the batches of a stream with repeats and readings ahead of time count."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = tb.readings(spark, sf)
    step = hourly_batch(root, now=_stream_now, order="event_id", series=False)
    step(rows.filter("event_id % 3 > 0"), 0)
    ahead = rows.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts + INTERVAL 40 DAYS"))
    step(rows.filter("event_id % 2 = 0").unionByName(ahead), 1)
    step(rows.filter("event_id % 3 = 0"), 2)
    counts = spark.read.parquet(f"{root}/metrics")
    return counts.select(F.col("batch").cast("long").alias("batch"), "readings", "repeats", "rejected", "late", "newest")


def placed_readings(spark, sf):
    """Readings of stations with coordinates; low stations have lost theirs."""
    st = tb.stations(spark, sf).withColumn("latitude", F.when(F.col("elevation") >= 200, F.col("latitude")))
    return shown(ob.with_coordinates(tb.readings(spark, sf).select("event_id", "station_id", "rain"), st))


def skipped_stations(spark, sf):
    st = tb.stations(spark, sf).withColumn("latitude", F.when(F.col("elevation") >= 200, F.col("latitude")))
    return ob.without_coordinates(tb.readings(spark, sf), st)


def table_state(spark, sf):
    """Rows, stations and time range of the clean table."""
    return tb.clean(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station_id").alias("stations"),
                                   F.min("hour").alias("first"), F.max("hour").alias("last"))


def replay(spark, sf):
    """Replay of three days with persistence, without the drizzle cutoff."""
    df = pl.replay(tb.clean(spark, sf), tb.neighbors(spark, sf), tb.stations(spark, sf), tb.UPSTREAM,
                   "2024-01-10 05:00:00", "2024-01-12 23:00:00")
    return shown(df)


def noisy_rain(spark, sf):
    """Clean rain and temperature with the noise of a training augmentation."""
    df = tb.clean(spark, sf).select("station_id", "h", "hour", "rain", "td")
    return shown(ml.add_noise(df, {"rain": 0.33, "td": 1.8}, ["station_id", "h"]))


NAMES = {"cyclic_time_features": "cyclic_time", "horizon_labels": "horizon_times"}
QUERIES = {
    NAMES.get(f.__name__, f.__name__): f for f in (
        flatten_observations, normalize_time, station_catalog, range_rules, wind_components, hourly_rollup,
        hourly_spine, gap_fill, hourly_clean, daily_clean, insert_ignore, upsert_latest, snapshot_upsert, retention_trim,
        backfill_manifest, archive_run, bootstrap_stations, replaced_table, ordered_export, incremental_filter, incremental_filter_global, closed_hours, required_stations,
        active_stations, grid_cells, haversine_pairs, knn_join, triangle_neighbors, station_neighbors,
        leave_location_out, available_cells, neighbor_features, static_features, bearing_elevation,
        interpolation_features, idw_grid, cyclic_time_features, local_lags, upstream_features, forecast_features,
        neighbor_lags, latest_per_cell, now_layer, forecast_layer, time_index, demo_page, demo_page_end,
        horizon_labels, text_times, rain_bands, missingness_report, quality_report, longest_segment,
        targets_by_horizon, nearest_cell, verification_pairs, forecast_errors, persistence_forecast,
        persistence_skill, event_scores, rain_class_weights, lag_correlation, temporal_split, bias_correction,
        sensor_flags, nearest_lattice, lattice_index, terrain_stats, terrain_at_points, build_cells, tile_names,
        idw_leave_out_scores, rfsi_train_score, forecast_train_score, importance_shift, tweedie_rain,
        cross_validation, linear_cross_validation, hurdle_rain, null_routing,
        placed_readings, skipped_stations, table_state, replay, noisy_rain, stream_hourly, stream_closed_bins, stream_forecasts,
        stream_grid, stream_late, stream_metrics, stream_unique,
    )
}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the newest hour of the interpolated rain map, banded."""
    return now_layer(spark, sf)
