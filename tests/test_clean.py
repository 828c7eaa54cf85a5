import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import clean as cl
from isohyet.schemas import MEASURES

START = datetime(2024, 1, 1)
SCHEMA = "station_id long, ts timestamp_ntz, rain double, ws double, wd double, td double, rh double, tdmax double, tdmin double, seq long"


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def reading(station, minutes, rain=0.0, ws=1.0, wd=90.0, td=10.0, rh=50.0, tdmax=12.0, tdmin=8.0, seq=0):
    return (station, START + timedelta(minutes=minutes), rain, ws, wd, td, rh, tdmax, tdmin, seq)


def random_readings(seed, stations=4, hours=60):
    rng = random.Random(seed)
    rows = []
    for s in range(1, stations + 1):
        for k in range(hours * 2):
            if rng.random() < 0.35:
                maybe = lambda v: None if rng.random() < 0.25 else v
                rows.append(reading(s, k * 30 + rng.randrange(29), maybe(rng.choice([0.0, 1.5, -59994.0])),
                                    maybe(rng.uniform(-1, 9)), maybe(rng.uniform(0, 360)), maybe(rng.uniform(0, 30)),
                                    maybe(rng.uniform(-10, 120)), maybe(rng.uniform(5, 35)), maybe(rng.uniform(-5, 25)), k))
    return rows


def with_pandas(rows, limit=2):
    """The same cleaning with pandas resampling, as an independent check."""
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for c in df.columns[2:9]:
        df[c] = df[c].astype(float)
    df["rain"] = df["rain"].where(df["rain"] >= 0)
    df["rh"] = df["rh"].where((df["rh"] >= 0) & (df["rh"] <= 100))
    df["ws"] = df["ws"].where(df["ws"] >= 0)
    rad = np.deg2rad(df["wd"])
    df["u_vec"], df["v_vec"] = -df["ws"] * np.sin(rad), -df["ws"] * np.cos(rad)
    how = {"rain": "sum", "ws": "mean", "td": "mean", "rh": "mean", "tdmax": "max", "tdmin": "min", "u_vec": "mean", "v_vec": "mean"}
    out = []
    for sid, part in df.groupby("station_id"):
        h = part.set_index("ts").sort_index().resample("1h").agg(how)
        h = h.interpolate(method="linear", limit=limit)
        h["tdmax"] = np.where(h["td"] > h["tdmax"], h["td"], h["tdmax"])
        h["tdmin"] = np.where(h["td"] < h["tdmin"], h["td"], h["tdmin"])
        out.append(h.assign(station_id=sid).reset_index().rename(columns={"ts": "hour"}))
    return pd.concat(out).sort_values(["station_id", "hour"]).reset_index(drop=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_hourly_clean_equals_pandas(spark, seed):
    rows = random_readings(seed)
    got = cl.hourly_clean(readings(spark, rows)).toPandas().sort_values(["station_id", "hour"]).reset_index(drop=True)
    want = with_pandas(rows)
    assert list(got["hour"]) == list(want["hour"])
    for c in MEASURES:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_fill_limits(spark):
    hours = {0: 1.0, 2: 3.0, 6: 11.0, 10: None, 13: None}  # gap of 1, gap of 3, tail without values
    df = spark.createDataFrame([(1, h, 0.0, v) for h, v in hours.items()], "station_id long, h long, rain double, td double")
    got = {r.h: r.td for r in cl.fill_gaps(df).collect()}
    assert [got[h] for h in range(7)] == [1.0, 2.0, 3.0, 5.0, 7.0, None, 11.0]
    assert [got[h] for h in range(7, 14)] == [11.0, 11.0, None, None, None, None, None]


def test_leading_gap_stays_empty_and_empty_rain(spark):
    df = spark.createDataFrame([(1, 0, 2.0, None), (1, 3, 0.0, 4.0)], "station_id long, h long, rain double, td double")
    rows = sorted(cl.fill_gaps(df).collect(), key=lambda r: r.h)
    assert [(r.rain, r.td) for r in rows] == [(2.0, None), (0.0, None), (0.0, None), (0.0, 4.0)]
    rows = sorted(cl.fill_gaps(df, empty_rain="null").collect(), key=lambda r: r.h)
    assert [r.rain for r in rows] == [2.0, None, None, 0.0]


def test_first_reading_wins_before_the_roll_up(spark):
    rows = [reading(1, 5, rain=2.0, seq=1), reading(1, 5, rain=9.0, seq=2), reading(1, 15, rain=1.0, seq=3)]
    assert cl.hourly_clean(readings(spark, rows), dedupe_order="seq").first().rain == 3.0


def test_all_null_hour_has_zero_rain(spark):
    rows = [(1, START, None, None, None, None, None, None, None, 0)]
    row = cl.hourly_clean(readings(spark, rows)).first()
    assert row.rain == 0.0 and row.td is None
    assert cl.hourly_rollup(readings(spark, rows), empty_rain="null").first().rain is None


def test_closed_hours_and_increment(spark):
    rows = [reading(1, 0), reading(1, 65), reading(1, 125), reading(2, 10)]
    clean = cl.hourly_clean(readings(spark, rows[:2] + rows[3:]))
    assert cl.closed_hours(clean, "2024-01-01 01:30:00").count() == 2
    newer = cl.newer_than_clean(readings(spark, rows), clean)
    assert [r.ts for r in newer.collect()] == [START + timedelta(minutes=125)]
    # one mark for all stations: the reading on the mark's hour itself is taken only after it
    newer = cl.newer_than_clean(readings(spark, rows), clean, scope="global")
    assert {r.ts for r in newer.collect()} == {START + timedelta(minutes=m) for m in (65, 125)}


def test_longest_segment_prefers_the_later_of_equal_runs(spark):
    df = spark.createDataFrame([(1, h, None if h in (2, 5) else 1.0) for h in range(8)], "station_id long, h long, td double")
    row = cl.longest_segment(df, ["td"]).first()
    assert (row.hours, row.start_h, row.end_h, row.ends_at_end) == (2, 6, 7, True)


def test_missing_share_and_quality(spark):
    rows = [reading(1, m, td=None if m < 30 else 60.0) for m in range(0, 60, 10)] + [reading(2, 0)]
    kept = {r.station_id: r.kept for r in cl.missingness(readings(spark, rows), ["td", "ws"], 0.4).collect()}
    assert kept == {1: False, 2: True}
    report = {r.rule: r.n_bad for r in cl.quality_report(readings(spark, rows), 50.0).collect()}
    assert report["too_hot"] == 3 and report["td_null"] == 3 and report["td_above_tdmax"] == 3 and report["negative_rain"] == 0


def test_readings_before_1970_fall_in_the_right_hour(spark):
    df = readings(spark, [reading(1, 0)]).withColumn("ts", F.lit("1969-12-31 23:30:00").cast("timestamp_ntz"))
    assert cl.hourly_clean(df).first().hour == datetime(1969, 12, 31, 23)
