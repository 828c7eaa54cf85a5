"""Schemas, measure lists and rule tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and numbers that results depend on -----------------
# Clean hourly measures, in table order.
MEASURES = ["rain", "ws", "td", "rh", "tdmax", "tdmin", "u_vec", "v_vec"]
# Channels of the archive, in file order.
CHANNELS = [
    "rain", "wsmax", "wdmax", "ws", "wd", "stdwd",
    "td", "rh", "tdmax", "tdmin", "ws1mm", "ws10mm",
]
# Archive columns that no model uses.
UNUSED_CHANNELS = ["latitude", "longitude", "wsmax", "wdmax", "stdwd", "ws1mm", "ws10mm"]
TERRAIN = ["tpi_local", "tpi_regional", "roughness_local", "roughness_regional"]
STATIC = ["elevation", "dist_to_coast"]
# Physical limits (low, high), both inclusive; None is open.
RANGE_RULES = {"rain": (0.0, None), "rh": (0.0, 100.0), "ws": (0.0, None)}
# Limits for estimates; rain below the drizzle cutoff becomes 0.
ESTIMATE_LIMITS = {"rain": (0.0, None), "ws": (0.0, None), "rh": (0.0, 100.0)}
DRIZZLE_CUTOFF = 0.01
# Hours of the forecast, and of the lags that feed it.
HORIZONS = [1, 3, 6, 12]
LAG_HOURS = [1, 2, 3, 6, 12, 24]
LAG_MEASURES = ["rain", "u_vec", "v_vec", "td", "rh"]
UPSTREAM_LAG_HOURS = [1, 2, 3]
UPSTREAM_MEASURES = ["rain", "u_vec", "v_vec", "rh"]
WARM_UP_ROWS = 24
WINDOW_HOURS = 27
FILL_LIMIT = 2
RAIN_EVENT_MM = 0.1
LOCAL_ZONE = "Asia/Jerusalem"
SOURCE_OFFSET_HOURS = 2
RAIN_LEVELS = [
    0.1, 0.2, 0.7, 1.2, 2.0, 4.0, 6.0, 9.0,
    13.0, 18.0, 24.0, 30.0, 40.0, 50.0, 100.0, 200.0,
]
# Rain classes of the training weights (lower bounds).
RAIN_CLASSES = [("dry", 0.0), ("0.1-2", 0.1), ("2-5", 2.0), ("5-10", 5.0), ("10-20", 10.0), ("20+", 20.0)]
# Grid box, step and station lists of the reference region.
GRID_BOX = {"lat_min": 32.45, "lat_max": 32.75, "lon_min": 35.05, "lon_max": 35.45}
GRID_STEP = 0.01
UPSTREAM_STATIONS = {"tel_aviv": 178, "haifa": 43}
STATIONS_LEFT_OUT = [500, 20]
HOLDOUT_STATION = 16
NEIGHBOR_CANDIDATES = 10
RASTER_NODATA = -32768
RASTER_RADII = {"local": 83, "regional": 167}
MAX_MISSING_SHARE = 0.4
MAX_TEMPERATURE = 50.0
# -----------------------------------------------------------------------------

PAYLOAD = T.StructType([
    T.StructField("stationId", T.LongType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("datetime", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("valid", T.BooleanType()),
            T.StructField("value", T.DoubleType()),
        ]))),
    ]))),
])

CATALOG = T.StructType([
    T.StructField("stationId", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ])),
])

STATION_METADATA = T.StructType(
    [T.StructField("station_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ["latitude", "longitude", "elevation", *TERRAIN, "dist_to_coast"]]
)

ARCHIVE = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("station_id", T.LongType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in CHANNELS]
)

RAW = T.StructType(
    [T.StructField("station_id", T.LongType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ["rain", "ws", "wd", "td", "rh", "tdmax", "tdmin"]]
)
