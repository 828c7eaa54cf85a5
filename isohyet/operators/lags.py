"""Lagged features, forecast targets and the persistence forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.calendar import cyclic_time, index_hour
from isohyet.schemas import (
    HORIZONS, LAG_HOURS, LAG_MEASURES, UPSTREAM_LAG_HOURS, UPSTREAM_MEASURES, WARM_UP_ROWS,
)
from isohyet.session import small


def _at(column: str, offset: int, key: str) -> str:
    """SQL of the value exactly ``offset`` hours away; null where that hour has no row."""
    place = f"{abs(offset)} {'FOLLOWING' if offset > 0 else 'PRECEDING'}"
    return f"first({column}) OVER (PARTITION BY {key} ORDER BY h RANGE BETWEEN {place} AND {place})"


def local_lags(df: DataFrame, key: str = "cell_id", measures=LAG_MEASURES, hours=LAG_HOURS,
               number: str | None = None) -> DataFrame:
    """Add measure_t-Nh columns, and the row's position in time from 1 under the name ``number``.

    All lags sit in one Window node over (key, h): one shuffle and one sort.
    Frames are ranges of the hour index, so a lag is a time and not a row
    count, and needs no gap-free series.
    """
    position = [f"row_number() OVER (PARTITION BY {key} ORDER BY h) AS {number}"] if number else []
    return df.selectExpr("*", *position, *[f"{_at(c, -n, key)} AS `{c}_t-{n}h`" for c in measures for n in hours])


def upstream_series(hourly: DataFrame, upstream: dict[str, int], hours=UPSTREAM_LAG_HOURS) -> DataFrame:
    """Upstream stations side by side by hour: measures, moisture flux and their lags.

    At most one row per hour of the archive, however many cells use it.
    """
    ids = list(upstream.values())
    flow = hourly.filter(F.col("station_id").isin(ids)).selectExpr(
        "station_id", "h", *UPSTREAM_MEASURES, "u_vec * rh AS moisture_flux"
    )
    steps = [0, *hours]
    # a lag exists also at hours where the station itself is silent
    shifted = flow.selectExpr("*", f"explode(array({', '.join(map(str, steps))})) AS n")
    return shifted.groupBy(F.expr("h + n AS h")).agg(*[
        F.expr(f"max(CASE WHEN station_id = {s} AND n = {n} THEN {c} END) AS `{c}_{name}{_lag(n)}`")
        for name, s in upstream.items() for c in flow.columns[2:] for n in steps
    ])


def _lag(n: int) -> str:
    return f"_t-{n}h" if n else ""


def upstream_features(cells: DataFrame, hourly: DataFrame, upstream: dict[str, int],
                      hours=UPSTREAM_LAG_HOURS, key: str = "cell_id") -> DataFrame:
    """Left-join the upstream series to every cell hour and add the convergence columns.

    Lags of the upstream columns are taken once per station.  Convergence is
    relative to the cell, and its lag is the difference of the two lags, so no
    second window over the cells is needed when the local wind lags exist.  The series, a row an hour, is stored and
    counted: up to ``SMALL_ROWS`` hours it is broadcast and the wide cells stay where they are, beyond it joins by sort.
    """
    out = cells
    missing = [n for n in hours for c in ("u_vec", "v_vec") if f"{c}_t-{n}h" not in cells.columns]
    if missing:
        out = local_lags(out, key, ["u_vec", "v_vec"], sorted(set(missing)))
    out = out.join(small(upstream_series(hourly, upstream, hours)), "h", "left").selectExpr("*", *[
        f"`{axis}_vec_{name}{_lag(n)}` - `{axis}_vec{_lag(n)}` AS `{axis}_convergence_{name}{_lag(n)}`"
        for name in upstream for axis in ("u", "v") for n in [0, *hours]
    ])
    return out if not missing else out.drop(*[f"{c}_t-{n}h" for c in ("u_vec", "v_vec") for n in set(missing)])


def forecast_features(cells: DataFrame, hourly: DataFrame, upstream: dict[str, int],
                      warm_up: int = WARM_UP_ROWS, key: str = "cell_id") -> DataFrame:
    """Feature matrix of the forecast: measures, cyclic time, local lags, upstream columns.

    The first ``warm_up`` rows of every cell are left out.
    """
    base = cells if "hour" in cells.columns else cells.withColumn("hour", index_hour("h"))
    lagged = local_lags(base, key, number="_row").filter(f"_row > {warm_up}").drop("_row")
    return upstream_features(cyclic_time(lagged, "hour"), hourly, upstream, key=key)


def neighbor_lags(hourly: DataFrame, measures, hours=(1, 2, 3)) -> DataFrame:
    """Station series with lags, to be used as neighbour series for training."""
    return local_lags(hourly, "station_id", measures, hours)


def horizon_targets(df: DataFrame, measure: str = "rain", hours=HORIZONS, key: str = "cell_id") -> DataFrame:
    """Add the value found ``n`` hours later as target_tN."""
    return df.selectExpr("*", *[f"{_at(measure, n, key)} AS target_t{n}" for n in hours])


def persistence(df: DataFrame, measure: str = "rain", hours=HORIZONS, key: str = "cell_id") -> DataFrame:
    """Long rows (key, h, horizon, forecast, observed): the value ``horizon`` hours before h."""
    wide = df.selectExpr(key, "h", f"{measure} AS observed", *[f"{_at(measure, -n, key)} AS p{n}" for n in hours])
    each = ", ".join(f"{n}, p{n}" for n in hours)
    return wide.selectExpr(key, "h", f"stack({len(hours)}, {each}) AS (horizon, forecast)", "observed")


def latest_row(df: DataFrame, key: str = "cell_id", order: str = "h") -> DataFrame:
    """The newest row of every key, by partial aggregation (no sort)."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest]).select(
        *df.columns
    )
