import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from isohyet.operators.clean import first_per_key, hourly_clean, hourly_rollup
from isohyet.operators.interpolate import idw_grid
from isohyet.schemas import MEASURES, RAW
from isohyet.functions.calendar import hour_index
from isohyet.streaming import hourly as st

START = datetime(2024, 1, 1)


def make_rows(n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + timedelta(minutes=5 * i, seconds=rng.randrange(60))
        v = float(rng.randrange(8))
        rows.append((rng.randrange(1, 5), ts, v, v / 2, 90.0, 10 + v, 50.0, 12 + v, 8 + v))
    return rows


def land(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/*")


def bins_of(df):
    return {(r.station_id, r.h): tuple(None if r[c] is None else round(r[c], 9) for c in MEASURES) for r in df.collect()}


@pytest.mark.parametrize("how", ["one", "three", "shuffled"])
def test_stream_equals_batch(spark, tmp_path, how):
    rows = make_rows()
    want = bins_of(hourly_rollup(spark.createDataFrame(rows, RAW)))
    if how == "one":
        parts = [rows]
    elif how == "three":
        parts = [rows[:100], rows[90:200], rows[200:] + rows[:5]]  # repeats, some of them late
    else:
        mixed = rows[:]
        random.Random(1).shuffle(mixed)
        parts = [mixed[i::3] for i in range(3)]
    stream = land(spark, tmp_path / "in", parts)
    st.run_hourly(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert bins_of(st.current_bins(spark, str(tmp_path / "out"))) == want
    metrics = spark.read.parquet(str(tmp_path / "out/metrics"))
    assert metrics.agg(F.sum("readings")).first()[0] == len(rows)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = make_rows(60)
    run = st.hourly_batch(str(tmp_path))
    df = spark.createDataFrame(rows, RAW)
    run(df, 0)
    once = bins_of(st.current_bins(spark, str(tmp_path)))
    run(df, 0)  # the same batch again after a failure
    run(df, 1)  # the same readings again in a later batch
    assert bins_of(st.current_bins(spark, str(tmp_path))) == once
    assert spark.read.parquet(str(tmp_path / "raw")).count() == len(rows)


def test_first_reading_wins_over_later_batches(spark, tmp_path):
    row = make_rows(1)[0]
    other = row[:2] + (99.0,) + row[3:]
    run = st.hourly_batch(str(tmp_path))
    run(spark.createDataFrame([row], RAW), 0)
    run(spark.createDataFrame([other], RAW), 1)
    assert st.current_bins(spark, str(tmp_path)).first().rain == row[2]


def test_closed_bins_only(spark, tmp_path):
    rows = make_rows(60)
    stream = land(spark, tmp_path / "in", [rows])
    st.hourly_bins(stream, "30 minutes").writeStream.outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(
        str(tmp_path / "out")).awaitTermination()
    mark = max(r[1] for r in rows) - timedelta(minutes=30)
    got = {(r.station_id, r.hour): r.rain for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = hourly_rollup(spark.createDataFrame(rows, RAW)).collect()
    want = {(r.station_id, datetime(1970, 1, 1) + timedelta(hours=r.h)): r.rain for r in batch
            if datetime(1970, 1, 1) + timedelta(hours=r.h + 1) <= mark}
    assert got == want


CELL_SCHEMA = ("cell_id long, neighbor_1_id long, neighbor_2_id long, neighbor_3_id long, "
               "neighbor_1_distance double, neighbor_2_distance double, neighbor_3_distance double")
CELLS = [(1, 1, 2, 3, 1.0, 2.0, 3.0), (2, 2, 3, 4, 1.0, 1.0, 1.0), (3, 1, 2, 77, 1.0, 1.0, 1.0)]


def grid_of(df):
    return {(r.cell_id, r.h): tuple(None if r[c] is None else round(r[c], 9) for c in MEASURES) for r in df.collect()}


def batch_grid(spark, rows, now):
    hourly = hourly_clean(spark.createDataFrame(rows, RAW).dropDuplicates(["station_id", "ts"]))
    grid = idw_grid(spark.createDataFrame(CELLS, CELL_SCHEMA), hourly)
    return grid_of(grid.filter(F.col("hour") < F.lit(now.replace(minute=0, second=0))))


def run_batches(spark, root, parts, now, **options):
    step = st.hourly_batch(str(root), spark.createDataFrame(CELLS, CELL_SCHEMA), now=lambda: now, **options)
    for i, rows in enumerate(parts):
        step(spark.createDataFrame(rows, RAW), i)


NOW = START + timedelta(days=6, minutes=20)


def long_rows(n=1400):
    return make_rows(n)  # nearly five days: far more than the window of the forecast


def test_every_closed_hour_is_interpolated(spark, tmp_path):  # probe A, and the grid equal to the batch
    rows = long_rows()
    run_batches(spark, tmp_path, [rows], NOW)
    got = grid_of(st.current_grid(spark, str(tmp_path)))
    assert got == batch_grid(spark, rows, NOW)
    assert len({h for _, h in got}) > 100


def test_any_order_of_batches_gives_the_batch_grid(spark, tmp_path):  # probe D
    rows = long_rows(500)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    run_batches(spark, tmp_path, [mixed[i::3] for i in range(3)], NOW)
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, NOW)


def test_readings_from_the_future_are_set_aside(spark, tmp_path):  # probes B and C
    rows = make_rows(120)
    wrong = (1, START + timedelta(days=40), *rows[0][2:])
    run_batches(spark, tmp_path, [rows[:40] + [wrong], rows[40:]], NOW)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == len(rows)
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 1
    metrics = spark.read.parquet(str(tmp_path / "metrics")).orderBy("batch").collect()
    assert [(m.readings, m.rejected) for m in metrics] == [(40, 1), (80, 0)]
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, NOW)


def test_a_silent_station_is_filled_as_in_batch(spark, tmp_path):  # probe E
    rows = [r for r in long_rows() if r[0] != 2 or r[1] < START + timedelta(hours=20) or r[1] > START + timedelta(hours=95)]
    late = [r for r in rows if r[0] == 2 and r[1] > START + timedelta(hours=95)]
    run_batches(spark, tmp_path, [[r for r in rows if r not in late], late], NOW)
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, NOW)


def test_hours_close_by_the_clock(spark, tmp_path):
    rows = make_rows(200)
    cells = spark.createDataFrame(CELLS, CELL_SCHEMA)
    clock = [START + timedelta(hours=5, minutes=59)]
    step = st.hourly_batch(str(tmp_path), cells, now=lambda: clock[0], ahead=timedelta(days=3))
    step(spark.createDataFrame(rows, RAW), 0)
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, clock[0])
    clock[0] += timedelta(hours=7)
    step(spark.createDataFrame(rows[:0], RAW), 1)  # nothing new but the time
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, clock[0])


def test_a_new_station_completes_old_hours(spark, tmp_path):
    rows = make_rows(300)
    run_batches(spark, tmp_path, [[r for r in rows if r[0] != 4], [r for r in rows if r[0] == 4]], NOW)
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, NOW)


def test_own_models_run_in_the_stream(spark, tmp_path):
    rows = make_rows(120)
    flat = lambda cells, hourly: idw_grid(cells, hourly, checked=False).withColumn("rain", F.lit(1.5))
    run_batches(spark, tmp_path, [rows], START + timedelta(hours=10, minutes=1), interpolate=flat)
    out = st.current_forecasts(spark, str(tmp_path)).collect()
    assert len(out) == 2 and all(r.precipitation_t12 == 1.5 for r in out)


def test_compaction_and_retention(spark, tmp_path):
    rows = make_rows(240)
    run_batches(spark, tmp_path, [rows[i::3] for i in range(3)], START + timedelta(hours=21))
    grid, bins = grid_of(st.current_grid(spark, str(tmp_path))), bins_of(st.current_bins(spark, str(tmp_path)))
    latest = st.current_forecasts(spark, str(tmp_path)).collect()
    assert st.compact(spark, str(tmp_path)) > 0
    assert grid_of(st.current_grid(spark, str(tmp_path))) == grid and bins_of(st.current_bins(spark, str(tmp_path))) == bins
    assert st.current_forecasts(spark, str(tmp_path)).collect() == latest
    for name in ("bins", "hourly", "grid"):
        for day in st.folders(spark, str(tmp_path / name), "date"):
            assert len(st.folders(spark, str(tmp_path / name / f"date={day}"), "batch")) == 1
    assert len(st.folders(spark, str(tmp_path / "forecasts"), "batch")) == 2
    assert st.retain(spark, str(tmp_path), START.date()) == 0 and st.retain(spark, str(tmp_path), NOW.date()) > 0
    assert st.current_bins(spark, str(tmp_path)).count() == 0


def test_forecasts_follow_the_newest_closed_hour(spark, tmp_path):
    cells = spark.createDataFrame(CELLS, CELL_SCHEMA)
    rows = make_rows()
    clock = spark.createDataFrame(rows, RAW).agg(F.max("ts")).first()[0]
    run = st.hourly_batch(str(tmp_path), cells, now=lambda: clock)
    run(spark.createDataFrame(rows[:150], RAW), 0)
    run(spark.createDataFrame(rows[150:], RAW), 1)
    out = {r.cell_id: r for r in st.current_forecasts(spark, str(tmp_path)).collect()}
    newest = spark.createDataFrame(rows, RAW).agg(F.max(hour_index("ts"))).first()[0]
    assert set(out) == {1, 2} and all(newest - 3 <= r.h < newest for r in out.values())  # cell 3 lacks a neighbour


def test_unique_readings_within_the_watermark(spark, tmp_path):
    rows = make_rows(20)
    stream = land(spark, tmp_path / "in", [rows, rows])
    st.unique_readings(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == first_per_key(got, ["station_id", "ts"], "rain").count() == len(rows)


def test_progress_log(spark, tmp_path):
    class Progress:
        id, batchId, numInputRows, durationMs = "q", 3, 42, {"addBatch": 5}

    class Event:
        progress = Progress

    st.ProgressLog(spark, str(tmp_path / "log")).onQueryProgress(Event)
    assert spark.read.json(str(tmp_path / "log")).first().rows == 42


def rows_written(spark, root, name, batch):
    return spark.read.parquet(str(root / name)).filter(F.col("batch") == batch).count()


def test_a_missing_sensor_does_not_make_a_batch_write_history(spark, tmp_path):  # probe F
    def at(h, station):
        v = float((h * 7 + station) % 11)
        td = None if station == 2 or (station == 3 and h > 30) else 10 + v
        return (station, START + timedelta(hours=h), v, v / 2, 90.0, td, 50.0, 12 + v, 8 + v)

    first, more = 400, 3
    parts = [[at(h, s) for h in range(first) for s in (1, 2, 3)]] + [[at(first + n, s) for s in (1, 2, 3)] for n in range(more)]
    run_batches(spark, tmp_path, parts, START + timedelta(hours=first + more + 2))
    for n in range(1, more + 1):
        assert rows_written(spark, tmp_path, "hourly", n) == 3 and rows_written(spark, tmp_path, "grid", n) == 1
    late = [at(100, 1)[:3] + (1.5, 80.0, 7.0, 40.0, 9.0, 3.0)]  # another reading of a known hour
    late = [(1, START + timedelta(hours=100, minutes=30), *late[0][2:])]
    st.hourly_batch(str(tmp_path), spark.createDataFrame(CELLS, CELL_SCHEMA), now=lambda: START + timedelta(hours=first + more + 2))(
        spark.createDataFrame(late, RAW), more + 1)
    assert rows_written(spark, tmp_path, "hourly", more + 1) <= 5 and rows_written(spark, tmp_path, "grid", more + 1) <= 5
    rows = [r for p in parts for r in p] + late
    assert grid_of(st.current_grid(spark, str(tmp_path))) == batch_grid(spark, rows, START + timedelta(hours=first + more + 2))


def series_of(df):
    return {(r.station_id, r.h): tuple(None if r[c] is None else round(r[c], 9) for c in MEASURES) for r in df.collect()}


def test_sensors_with_holes_in_any_order(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for h in range(500):
        for s in (1, 2):
            if rng.random() < 0.35 and not (s == 2 and 60 < h < 420):
                v = [float(rng.randrange(9)) if rng.random() < 0.5 else None for _ in range(7)]
                rows.append((s, START + timedelta(hours=h), *v))
    mixed = rows[:]
    rng.shuffle(mixed)
    step = st.hourly_batch(str(tmp_path), now=lambda: START + timedelta(days=30))
    for i, part in enumerate([mixed[:40], mixed[40:44], mixed[44:150], mixed[150:]]):
        step(spark.createDataFrame(part, RAW), i)
    want = series_of(hourly_clean(spark.createDataFrame(rows, RAW)))
    assert series_of(st.current_hourly(spark, str(tmp_path))) == want
    assert st.compact(spark, str(tmp_path)) > 0
    step(spark.createDataFrame([(2, START + timedelta(hours=200), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)], RAW), 4)
    rows.append((2, START + timedelta(hours=200), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0))
    assert series_of(st.current_hourly(spark, str(tmp_path))) == series_of(hourly_clean(spark.createDataFrame(rows, RAW)))


def test_a_reading_years_late_reads_two_dates(spark, tmp_path, monkeypatch):
    from isohyet.streaming import series

    rows = make_rows(100)
    old = [(1, START - timedelta(days=730), *rows[0][2:])]
    step = st.hourly_batch(str(tmp_path), now=lambda: NOW)
    step(spark.createDataFrame(rows, RAW), 0)
    asked = []
    monkeypatch.setattr(st, "dates_in", lambda df: asked.append(series.dates_in(df)) or asked[-1])
    step(spark.createDataFrame(old + [(2, NOW - timedelta(hours=1), *rows[0][2:])], RAW), 1)
    assert asked and all(len(days) == 2 for days in asked)
