import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from isohyet.functions import geo, weather
from isohyet.functions.calendar import cyclic_time, horizon_times, hour_index, index_hour, source_time, text_time


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["x"])
    return row.select(expr.alias("v")).first()["v"]


def test_haversine_known_distances(spark):
    assert one(spark, geo.haversine("0D", "0D", "0D", "90D")) == pytest.approx(6371 * math.pi / 2)
    assert one(spark, geo.haversine("10D", "20D", "10D", "20D")) == 0
    assert one(spark, geo.haversine("0D", "0D", "0D", "180D")) == pytest.approx(6371 * math.pi)


@pytest.mark.parametrize("to, degrees", [(("1D", "0D"), 0), (("0D", "1D"), 90), (("-1D", "0D"), 180), (("0D", "-1D"), 270)])
def test_bearing(spark, to, degrees):
    assert one(spark, geo.bearing("0D", "0D", *to)) == pytest.approx(degrees)


@pytest.mark.parametrize("p, inside", [
    ((1, 1), True), ((0, 0), True), ((2, 0), True), ((2, 2), True), ((3, 3), False), ((-1, 0), False)])
def test_point_in_triangle(spark, p, inside):
    place = lambda x, y: (f"{x}D", f"{y}D")
    test = geo.point_in_triangle(place(*p), place(0, 0), place(4, 0), place(0, 4))
    assert one(spark, test) is inside


def test_degenerate_triangle_holds_its_line(spark):
    place = lambda x, y: (f"{x}D", f"{y}D")
    flat = [place(0, 0), place(1, 1), place(2, 2)]
    assert one(spark, geo.point_in_triangle(place(5, 5), *flat)) is True
    assert one(spark, geo.point_in_triangle(place(1, 2), *flat)) is False


@pytest.mark.parametrize("lat, lon, name", [
    (32.6, 35.2, "N32E035.hgt"), (-0.5, 10.0, "S01E010.hgt"), (5.0, -0.1, "N05W001.hgt"), (0.0, 0.0, "N00E000.hgt")])
def test_tile_name(spark, lat, lon, name):
    assert one(spark, geo.tile_name(F.col("lat"), F.col("lon")), lat=lat, lon=lon) == name


@pytest.mark.parametrize("wd, u, v", [(0, 0, -5), (90, -5, 0), (180, 0, 5), (270, 5, 0), (360, 0, -5)])
def test_wind_components(spark, wd, u, v):
    df = spark.createDataFrame([(5.0, float(wd))], "ws double, wd double")
    got = df.select(weather.wind_u("ws", "wd").alias("u"), weather.wind_v("ws", "wd").alias("v")).first()
    assert (got.u, got.v) == (pytest.approx(u, abs=1e-12), pytest.approx(v, abs=1e-12))


@pytest.mark.parametrize("mm, band", [
    (0.0999, -1), (0.1, 0), (0.2, 1), (1.19, 2), (199.9, 14), (200.0, 15), (250.0, 15), (None, None)])
def test_rain_band(spark, mm, band):
    df = spark.createDataFrame([(mm,)], "rain double")
    assert df.select(weather.rain_band("rain").alias("b")).first().b == band


def test_ranges_and_clamps_keep_null(spark):
    rows = [(-59994.0, -0.1, -1.0), (0.0, 100.0, 0.0), (1.0, 100.1, 3.0), (None, None, None), (float("nan"), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "rain double, rh double, ws double")
    got = [tuple(r) for r in weather.apply_ranges(df).collect()]
    assert got == [(None, None, None), (0.0, 100.0, 0.0), (1.0, None, 3.0), (None, None, None), (None, 0.0, 1.0)]
    df = spark.createDataFrame([(-1.0,), (0.005,), (0.01,), (None,)], "rain double")
    assert [r.r for r in df.select(weather.clamp_estimate("rain", "rain").alias("r")).collect()] == [0.0, 0.0, 0.01, None]
    df = spark.createDataFrame([(-1.0,), (120.0,), (None,)], "rh double")
    assert [r.r for r in df.select(weather.clamp_estimate("rh", "rh").alias("r")).collect()] == [0.0, 100.0, None]


def test_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r.n for r in df.select(weather.to_number("v").alias("n")).collect()] == [1.5, None, None, None]


def test_source_time_ignores_the_written_offset(spark):
    df = spark.createDataFrame([("2024-07-01T10:00:00+03:00",), ("2024-01-01T01:30:00+02:00",), ("bad",)], "t string")
    got = [r.t for r in df.select(source_time(F.col("t")).alias("t")).collect()]
    assert got == [datetime(2024, 7, 1, 8), datetime(2023, 12, 31, 23, 30), None]


def test_hour_index_round_trip_before_and_after_epoch(spark):
    df = spark.createDataFrame([("1969-12-31 22:59:59",), ("1970-01-01 00:00:00",), ("2024-02-29 23:10:00",)], "t string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("t")).withColumn("h", hour_index("t"))
    got = df.select("h", index_hour("h").alias("hour")).collect()
    assert got[0].h == -2 and got[1].h == 0
    assert [r.hour for r in got] == [datetime(1969, 12, 31, 22), datetime(1970, 1, 1), datetime(2024, 2, 29, 23)]


def test_cyclic_time_uses_local_calendar_and_leap_years(spark):
    # 2024-12-31 22:30 UTC is already 2025 in local time
    df = spark.createDataFrame([("2024-12-31 22:30:00",), ("2024-12-31 12:00:00",), ("2023-12-31 12:00:00",)], "t string")
    rows = cyclic_time(df.select(F.col("t").cast("timestamp_ntz").alias("hour"))).collect()
    assert rows[0].day_sin == pytest.approx(math.sin(2 * math.pi / 365))
    assert rows[0].month_cos == pytest.approx(math.cos(2 * math.pi / 12))
    for r in rows[1:]:
        assert r.day_cos == pytest.approx(1.0)


def test_horizon_labels_add_to_the_wall_clock(spark):
    # the night of 29 March 2024 has no local 02:00
    df = spark.createDataFrame([("2024-03-28 23:30:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("hour"))
    got = {r.label: (r.local_time, r.day) for r in horizon_times(df).collect()}
    assert got["Now"] == ("2024-03-29 01:30", "Fri")
    assert got["t+1h"] == ("2024-03-29 02:30", "Fri")
    assert got["t+12h"] == ("2024-03-29 13:30", "Fri")
    assert len(got) == 5


def test_text_time_sorts_like_time(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.6",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert df.select(text_time(F.col("t")).alias("s")).first().s == "2024-01-02 03:04:05.600000"
