import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import lags as lg
from isohyet.operators import verify as vf
from isohyet.plans import models as ml
from isohyet.plans import registry
from isohyet.schemas import HORIZONS, MEASURES, STATIC, TERRAIN
from isohyet.operators.neighbors import station_neighbors


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(6)
    places = [(s, rng.uniform(32, 33), rng.uniform(35, 36)) for s in range(1, 9)]
    st = spark.createDataFrame([(*p, *[rng.uniform(0, 50) for _ in [*STATIC, *TERRAIN]]) for p in places],
                               "station_id long, latitude double, longitude double, " + ", ".join(f"{c} double" for c in [*STATIC, *TERRAIN]))
    rows = []
    for s, lat, _ in places:
        for h in range(473400, 473400 + 60):
            base = lat * 3 + (h % 24)
            rows.append((s, h, max(0.0, base % 5 - 2), *[None if rng.random() < 0.05 else base + i for i in range(7)]))
    hourly = spark.createDataFrame(rows, "station_id long, h long, " + ", ".join(f"{m} double" for m in MEASURES))
    return st.cache(), hourly.cache()


def test_interpolation_models_train_and_score_with_missing_inputs(spark, network, tmp_path):
    st, hourly = network
    features = ml.target_features(station_neighbors(st), hourly, st)
    models = ml.train_interpolation(features, hourly, ["rain", "td"], numTrees=5, maxDepth=4)
    scored = ml.score_interpolation(features, models)
    assert scored.count() == features.count() and scored.filter("rain IS NULL OR td IS NULL OR rain < 0").count() == 0
    ml.save_models(models, str(tmp_path))
    again = ml.score_interpolation(features, ml.load_models(str(tmp_path), ["rain", "td"]))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
    assert "tpi_local_n1" in ml.interpolation_columns("ws") and "tpi_local_n1" not in ml.interpolation_columns("td")
    assert len(ml.interpolation_columns("rain")) == 55


def test_forecast_models(spark, network):
    st, hourly = network
    cells = hourly.withColumnRenamed("station_id", "cell_id")
    features = lg.forecast_features(cells, hourly, {"west": 1, "gone": 500})
    up = {"west": 1, "gone": 500}
    assert len(ml.forecast_columns(up)) == 98
    models = ml.train_forecast(features, up, horizons=[1, 3], kind="forest", numTrees=4, maxDepth=3)
    out = ml.latest_forecast(features, models)
    assert out.count() == 8 and out.filter("precipitation_t1 < 0 OR precipitation_t3 IS NULL").count() == 0
    pct = ml.importances(models, ml.forecast_columns(up)).groupBy("horizon").agg(F.sum("importance").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in pct.collect())


def test_tweedie_takes_nulls_and_gives_no_negative(spark, network):
    _, hourly = network
    rows = hourly.withColumn("label", F.col("rain"))
    model = ml.regression(["td", "rh"], "tweedie", "out", maxIter=5).fit(rows)
    assert model.transform(rows).filter("out < 0 OR out IS NULL").count() == 0


def test_cross_validation_leaves_the_fold_out(spark, network):
    st, hourly = network
    out = ml.cross_validate(st, hourly, "td", [3], numTrees=4, maxDepth=3).first()
    assert out.fold == 3 and out.n > 30 and out.baseline_rmse < 5


def test_registered_training_is_not_cut(spark, network, monkeypatch):
    """The learners of the registered queries have Spark's default sizes at least, and all horizons."""
    built = []

    class Stop(Exception):
        pass

    def kept(columns, kind, *_, **params):
        made = regression(columns, kind, "out", **{k: v for k, v in params.items() if k != "weight"})
        built.append(made.getStages()[-1])
        raise Stop

    def horizons(features, upstream, horizons=HORIZONS, **params):
        assert list(horizons) == list(HORIZONS)
        kept(ml.forecast_columns(upstream), params.pop("kind", "boosted"), **params)

    def measures(features, hourly, measures=MEASURES, **params):
        assert list(measures) == list(MEASURES)
        kept(ml.interpolation_columns("rain"), "forest", **params)

    regression = ml.regression
    monkeypatch.setattr(ml, "regression", kept)
    monkeypatch.setattr(ml, "train_forecast", horizons)
    monkeypatch.setattr(ml, "train_interpolation", measures)
    for name in ("forecast_train_score", "rfsi_train_score", "importance_shift", "tweedie_rain"):
        with pytest.raises(Stop):
            registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    for learner in built:
        for name, least in (("numTrees", 20), ("maxIter", 20), ("maxDepth", 5)):
            assert not learner.hasParam(name) or learner.getOrDefault(name) >= least
    assert len(built) == 4


def test_importance_shift_shows_every_horizon(spark):
    rows = [(n, c, float(v)) for n, a, b in ((1, 1, 3), (3, 2, 2), (6, 1, 1), (12, 4, 1)) for c, v in (("a", a), ("b", b))]
    df = vf.importance_shift(spark.createDataFrame(rows, "horizon int, feature string, importance double"), 1, 3, 6, 12)
    got = {r.feature: (r.pct_t1, r.pct_t3, r.pct_t6, r.pct_t12, r.change) for r in df.collect()}
    assert got["a"] == (25.0, 50.0, 50.0, 80.0, 55.0) and got["b"][-1] == -55.0


def test_cross_validation_scores_every_station(spark, network):
    st, hourly = network
    rows = {r.fold: r for r in ml.cross_validate(st, hourly, "td", numTrees=2, maxDepth=2).collect()}
    assert sorted(rows) == list(range(1, 9)) and all(r.n > 30 and r.rmse > 0 for r in rows.values())
    assert rows[3].n == ml.cross_validate(st, hourly, "td", [3], numTrees=2, maxDepth=2).first().n


def test_cross_validation_keeps_a_station_without_rows(spark, network):
    st, hourly = network
    silent = hourly.withColumn("td", F.when(F.col("station_id") != 5, F.col("td")))
    rows = {r.fold: r for r in ml.cross_validate(st, silent, "td", numTrees=2, maxDepth=2).collect()}
    assert sorted(rows) == list(range(1, 9)) and (rows[5].n, rows[5].event_n, rows[5].rmse) == (0, 0, None)


def test_fold_rows_never_meet_the_held_out_station(spark, network):
    st, hourly = network
    table = ml.fold_features(st, hourly.withColumn("td", F.col("station_id") * 1000.0), "td")
    for fold in (1, 5, 8):
        train, test = ml.fold_rows(table, fold)
        near = F.array("td_n1", "td_n2", "td_n3")
        assert train.filter((F.col("cell_id") == fold) | F.array_contains(near, fold * 1000.0)).count() == 0
        assert train.count() == train.select("cell_id", "h").distinct().count() == 7 * 60
        assert test.count() == 60


def test_noise_is_a_function_of_the_key(spark, network):
    _, hourly = network
    a = ml.add_noise(hourly, {"td": 2.0}, ["station_id", "h"])
    b = ml.add_noise(hourly.repartition(3, "h"), {"td": 2.0}, ["station_id", "h"])
    key = lambda df: sorted((r.station_id, r.h, r.td) for r in df.filter("td IS NOT NULL").collect())
    assert key(a) == key(b)
    moved = a.select("station_id", "h", F.col("td").alias("x")).join(hourly, ["station_id", "h"]).agg(
        F.stddev(F.col("x") - F.col("td")).alias("s"), F.avg(F.col("x") - F.col("td")).alias("m")).first()
    assert moved.s == pytest.approx(2.0, rel=0.15) and abs(moved.m) < 0.4


def test_linear_folds_in_one_pass_equal_separate_fits(spark, network):
    st, hourly = network
    inputs = {"near": "td_n1", "rise": "elevation_target - elevation_n1"}
    got = {r.fold: r for r in ml.linear_cross_validate(st, hourly, "td", inputs).collect()}
    table = ml.fold_features(st, hourly, "td")
    assert sorted(got) == list(range(1, 9))
    for fold in (1, 4, 8):
        train, test = (df.selectExpr("label", *inputs.values()).dropna().toPandas().to_numpy() for df in ml.fold_rows(table, fold))
        x = np.column_stack([np.ones(len(train)), train[:, 1:]])
        w = np.linalg.lstsq(x, train[:, 0], rcond=None)[0]
        r = got[fold]
        assert (r.n, r.train_rows) == (len(test), len(train))
        assert [r.intercept, r.near, r.rise] == pytest.approx(list(w), abs=1e-6)
        error = test[:, 0] - np.column_stack([np.ones(len(test)), test[:, 1:]]) @ w
        assert r.rmse == pytest.approx(float(np.sqrt((error ** 2).mean())), abs=1e-6)


def test_linear_folds_keep_a_station_without_rows(spark, network):
    st, hourly = network
    silent = hourly.withColumn("td", F.when(F.col("station_id") != 5, F.col("td")))
    rows = {r.fold: r for r in ml.linear_cross_validate(st, silent, "td").collect()}
    assert sorted(rows) == list(range(1, 9)) and (rows[5].n, rows[5].rmse) == (0, None)


def test_hurdle_forecasts_are_whole_and_not_negative(spark, network):
    _, hourly = network
    rows = hourly.withColumn("label", F.col("rain"))
    out = ml.hurdle(["td", "rh"], "out", maxIter=3).fit(rows).transform(rows)
    assert out.filter("out < 0 OR out IS NULL").count() == 0
    r = out.agg(F.avg(F.when(F.col("label") == 0, F.col("out"))).alias("dry"), F.avg(F.when(F.col("label") > 1, F.col("out"))).alias("wet")).first()
    assert r.dry < r.wet


def test_nulls_go_to_the_side_that_the_rows_ask_for(spark):
    # half of the nulls behave like large values, which one value below all others cannot say in one split
    rows = [(float(i % 10) if i % 3 else None, 1.0 if (i % 10 >= 5 or i % 3 == 0) else 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, label double")
    assert ml.nullable_columns(df, ["x"]) == ["x"]
    stump = dict(numTrees=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all", bootstrap=False)
    error = {}
    for name, either in (("low", []), ("either", ["x"])):
        out = ml.regression(["x"], "forest", "out", either=either, **stump).fit(df).transform(df)
        error[name] = out.agg(F.avg((F.col("out") - F.col("label")) ** 2)).first()[0]
    assert error["either"] < 1e-9 < error["low"]
