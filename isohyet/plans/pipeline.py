"""Whole runs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.calendar import ntz, plus_hours
from isohyet.operators import interpolate as ip
from isohyet.operators import lags as lg
from isohyet.operators.layers import time_index
from isohyet.operators.neighbors import active_stations, station_neighbors, triangle_neighbors
from isohyet.operators.raster import nearest_lattice, pixel_of, terrain_by_sums
from isohyet.plans.models import score_forecast, score_interpolation
from isohyet.schemas import HOLDOUT_STATION, HORIZONS, RASTER_RADII, STATIONS_LEFT_OUT, WARM_UP_ROWS
from isohyet.session import cut_lineage


def build_cells(cells: DataFrame, stations: DataFrame, hourly: DataFrame, sums: str, lattice: DataFrame,
                left_out=STATIONS_LEFT_OUT, tile_size: int = 3601, radii=RASTER_RADII) -> DataFrame:
    """Cell table: neighbours, boundary flag, elevation, terrain and distance to the coast.

    ``sums`` is where ``store_sums`` has written the pixels of the elevation tiles.
    """
    usable = cut_lineage(active_stations(stations, hourly, left_out))
    near = triangle_neighbors(cells, usable).drop("lat", "lon")
    terrain = terrain_by_sums(pixel_of(cells, tile_size), sums, radii).drop("tile", "row", "col", "lat", "lon")
    coast = nearest_lattice(cells, lattice).select("cell_id", F.col("dist").alias("dist_to_coast"))
    return cells.join(near, "cell_id").join(terrain, "cell_id").join(coast, "cell_id")


def build_station_neighbors(stations: DataFrame, hourly: DataFrame, holdout: int = HOLDOUT_STATION,
                            left_out=(500,)) -> DataFrame:
    """Neighbours of every station with clean data; the held-out station is nobody's neighbour."""
    return station_neighbors(cut_lineage(active_stations(stations, hourly, left_out)), holdout)


def time_slice(hourly: DataFrame, start: str, end: str, lag_hours: int = WARM_UP_ROWS, ts: str = "hour") -> DataFrame:
    """Rows from ``lag_hours`` before the start to the end, both inclusive (feeds lags of the first hour)."""
    return hourly.filter(F.col(ts).between(plus_hours(ntz(start), -lag_hours), ntz(end)))


def replay(hourly: DataFrame, cells: DataFrame, stations: DataFrame, upstream: dict[str, int], start: str, end: str,
           interpolation: dict | None = None, forecast: dict | None = None,
           cutoff: float | None = None) -> DataFrame:
    """Every hour's forecast of a past window with cell places and the replay position.

    Without models the interpolation is distance-weighted and the forecast
    persistence.  The replay has no drizzle cutoff unless one is given.
    """
    window = cut_lineage(time_slice(hourly, start, end))
    if interpolation:
        grid = score_interpolation(ip.interpolation_features(cells, window, stations), interpolation, cutoff)
    else:
        grid = ip.idw_grid(cells, window, cutoff=cutoff)
    if forecast:
        rows = score_forecast(lg.forecast_features(cut_lineage(grid), window, upstream), forecast, cutoff)
    else:
        rows = grid.select("cell_id", "h", "hour", *[F.col("rain").alias(f"precipitation_t{n}") for n in HORIZONS])
    rows = rows.filter(F.col("hour").between(ntz(start), ntz(end))).join(cells.select("cell_id", "lat", "lon"), "cell_id")
    stored = cut_lineage(rows)
    return stored.join(time_index(stored), "hour")


def learned_forecast(hourly: Callable[[], DataFrame], upstream: dict[str, int], models: dict) -> Callable[[DataFrame], DataFrame]:
    """A forecast model for the stream: newest feature row of every cell through the horizon models.

    ``hourly`` gives the clean station series of the moment (for the upstream columns).
    """

    def run(grid: DataFrame) -> DataFrame:
        features = lg.forecast_features(grid, hourly(), upstream)
        return score_forecast(lg.latest_row(features), models).drop("hour")

    return run
