import random

import pytest
from pyspark.sql import functions as F

from isohyet.operators import interpolate as ip
from isohyet.operators import lags as lg
from isohyet.operators import layers as ly
from isohyet.operators import verify as vf
from isohyet.schemas import MEASURES

WIDE = ("cell_id long, neighbor_1_id long, neighbor_2_id long, neighbor_3_id long, "
        "neighbor_1_distance double, neighbor_2_distance double, neighbor_3_distance double")


def hourly(spark, values):
    """values: {(station, h): rain}; every other measure is rain plus its position."""
    rows = [(s, h, *[None if v is None else v + i for i in range(len(MEASURES))]) for (s, h), v in values.items()]
    return spark.createDataFrame(rows, "station_id long, h long, " + ", ".join(f"{m} double" for m in MEASURES))


def test_idw_weights_nulls_and_distance_zero(spark):
    cells = spark.createDataFrame([(1, 1, 2, 3, 1.0, 2.0, 4.0), (2, 1, 2, 3, 5.0, 0.0, 4.0)], WIDE)
    h = hourly(spark, {(1, 0): 1.0, (2, 0): 3.0, (3, 0): 5.0, (1, 1): None, (2, 1): None, (3, 1): 8.0, (1, 2): None,
                       (2, 2): None, (3, 2): None})
    got = {(r.cell_id, r.h): r.td for r in ip.idw_grid(cells, h).collect()}
    assert got[1, 0] == pytest.approx((3 / 1 + 5 / 2 + 7 / 4) / (1 + 1 / 2 + 1 / 4))
    assert got[2, 0] == 5.0  # the station on the spot alone
    assert got[1, 1] == pytest.approx(10.0) and got[2, 1] == pytest.approx(10.0)
    assert got[1, 2] is None


def test_idw_stays_between_neighbors_and_clamps(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(c, 1, 2, 3, *[rng.uniform(0.1, 9) for _ in range(3)]) for c in range(20)], WIDE)
    values = {(s, h): rng.uniform(-5, 120) for s in (1, 2, 3) for h in range(5)}
    for r in ip.idw_grid(cells, hourly(spark, values)).collect():
        near = [values[s, r.h] + 2 for s in (1, 2, 3)]
        assert min(near) - 1e-9 <= r.td <= max(near) + 1e-9
        assert 0 <= r.rh <= 100 and r.rain >= 0 and r.ws >= 0


def test_salted_fan_out_changes_nothing(spark):
    cells = spark.createDataFrame([(c, 1, 2, 3, 1.0, 2.0, 3.0) for c in range(40)] + [(99, 2, 3, 4, 1.0, 2.0, 3.0)], WIDE)
    h = hourly(spark, {(s, t): float(s + t) for s in (1, 2, 3, 4) for t in range(6)})
    plain = sorted(map(tuple, ip.cell_series(cells, h).collect()))
    assert sorted(map(tuple, ip.cell_series(cells, h, cells_per_salt=7).collect())) == plain
    assert len(plain) == 41 * 6


def test_series_is_an_outer_join(spark):
    cells = spark.createDataFrame([(1, 1, 2, 3, 1.0, 2.0, 3.0)], WIDE)
    h = hourly(spark, {(1, 0): 1.0, (2, 1): 2.0, (3, 2): 3.0})
    rows = {r.h: (r.rain_n1, r.rain_n2, r.rain_n3) for r in ip.cell_series(cells, h).collect()}
    assert rows == {0: (1.0, None, None), 1: (None, 2.0, None), 2: (None, None, 3.0)}


def test_lags_are_times_and_not_rows(spark):
    hours = [0, 1, 2, 5, 6, 30]
    df = spark.createDataFrame([(1, h, float(h)) for h in hours], "cell_id long, h long, rain double")
    out = {r.h: r for r in lg.local_lags(df, measures=["rain"], hours=[1, 3, 24]).collect()}
    for h in hours:
        for n in (1, 3, 24):
            assert out[h][f"rain_t-{n}h"] == (float(h - n) if h - n in hours else None)
    out = {r.h: r for r in lg.horizon_targets(df, hours=[1, 3]).collect()}
    assert (out[2].target_t3, out[2].target_t1, out[30].target_t1) == (5.0, None, None)


def test_forecast_features_warm_up_and_missing_upstream(spark):
    h = hourly(spark, {(7, t): float(t) for t in range(30)})
    cells = h.withColumnRenamed("station_id", "cell_id")
    out = lg.forecast_features(cells, h, {"here": 7, "gone": 500}).orderBy("h").collect()
    assert [r.h for r in out] == list(range(24, 30))
    r = out[0]
    assert r["rain_here_t-3h"] == 21.0 and r["rain_gone"] is None and r["u_convergence_gone_t-1h"] is None
    assert r["u_convergence_here"] == 0.0 and r["v_convergence_here_t-2h"] == 0.0
    assert r["moisture_flux_here"] == r.u_vec * r.rh
    # 8 measures, 4 calendar, 30 local lags, 2 x 28 upstream, key and hour
    assert len(r) == 98 + 3


def test_latest_row_is_whole(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 4, 2.0), (2, 1, 3.0)], "cell_id long, h long, rain double")
    assert {tuple(r) for r in lg.latest_row(df).collect()} == {(1, 5, None), (2, 1, 3.0)}


def test_paging_stops_at_the_ends(spark):
    df = spark.createDataFrame([(c, f"2024-0{m}-01 00:00:00") for c in (1, 2) for m in (1, 2, 3)], "cell_id long, t string")
    df = df.select("cell_id", F.col("t").cast("timestamp_ntz").alias("hour"))
    assert [r.idx for r in ly.time_index(df).orderBy("hour").collect()] == [0, 1, 2]

    def page(idx, direction=None):
        return {(r.idx, r.hour.month) for r in ly.demo_page(df, idx, direction).collect()}

    assert page(0) == {(0, 1)} and page(0, "left") == {(0, 1)} and page(0, "right") == {(1, 2)}
    assert page(2, "right") == {(2, 3)} and page(1, "left") == {(0, 1)}


def test_rectangles(spark):
    df = spark.createDataFrame([(5, 32.6, 35.28, 1.234), (6, 32.6, 35.29, None)], "cell_id long, lat double, lon double, rain double")
    a, b = ly.cell_rectangles(df).collect()
    assert a.label == "Cell 5: 1.23mm" and a.band == 3 and a.south == pytest.approx(32.595) and a.east == pytest.approx(35.285)
    assert b.label is None and b.band is None


def test_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0), (1, 0.0, 0.0, 0.0), (1, 3.0, 0.05, 1.0), (1, 0.0, 4.0, 1.0)],
                               "g int, forecast double, observed double, persistence double")
    e = vf.error_metrics(df, ["g"]).first()
    assert e.n == 4 and e.event_n == 2 and e.event_mae == pytest.approx(2.5)
    assert e.bias == pytest.approx((-1 + 0 + 2.95 - 4) / 4)
    s = vf.event_scores(df, ["g"]).first()
    assert (s.hits, s.misses, s.false_alarms, s.missed_mm) == (1, 1, 1, 4.0)
    assert (s.recall, s.precision, s.f1) == (0.5, 0.5, 0.5)
    k = vf.skill(df, ["g"]).first()
    assert k.event_skill == pytest.approx(1 - ((1 + 16) / 2) ** 0.5 / ((4 + 9) / 2) ** 0.5)


def test_split_weights_bias_flags(spark):
    df = spark.createDataFrame([(h, float(h % 3)) for h in range(10)] + [(9, 0.0)], "h long, rain double")
    df = df.withColumn("hour", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(h AS INT))"))
    train, test = vf.temporal_split(df)
    assert sorted(r.h for r in train.collect()) == list(range(8)) and sorted(r.h for r in test.collect()) == [8, 9, 9]
    w = {r.rain_class: r for r in vf.rain_class_weights(df).collect()}
    assert w["dry"].n == 5 and w["dry"].weight == pytest.approx(11 / (6 * 5)) and w["2-5"].n == 3
    pairs = spark.createDataFrame([("a", 3.0, 1.0), ("a", 5.0, 4.0), ("b", 1.0, 2.0)], "g string, forecast double, observed double")
    bias = vf.bias_table(pairs.filter("g = 'a'"), ["g"])
    assert sorted(r.corrected for r in vf.bias_correct(pairs, bias, ["g"]).collect()) == [1.0, 1.5, 3.5]
    flags = vf.sensor_flags(spark.createDataFrame([(None, 1.0)], "a double, b double"), {"west": "a", "north": "b"}).first()
    assert (flags.missing_sensors, flags.n_missing, flags.low_confidence) == ("west", 1, True)
