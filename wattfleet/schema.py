"""Column contract, enum domains and typed schemas of the hourly meter data."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: names and domains every job agrees on -------------------

SERIES_KEYS = ["building_id", "meter"]
IDENTIFIERS = ["building_id", "meter", "timestamp"]
BUILDING_ATTRIBUTES = ["site_id", "primary_use", "square_feet", "year_built", "floor_count"]
WEATHER_MEASURES = [
    "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
    "sea_level_pressure", "wind_direction", "wind_speed",
]
FILLED_WEATHER = ["air_temperature", "dew_temperature", "wind_speed", "sea_level_pressure"]
CALENDAR_FEATURES = [
    "hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_business_hours",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
]
LAG_FEATURES = ["lag_1hr", "lag_24hr", "lag_168hr"]
ROLLING_FEATURES = ["rolling_mean_6hr", "rolling_mean_24hr", "rolling_std_24hr", "rolling_mean_168hr"]
INTERACTION_FEATURES = ["temp_x_hour", "temp_x_weekend", "occupancy_proxy"]
TARGET_LOG = "meter_reading_log"
READING = "meter_reading"

ALL_COLUMNS = (
    IDENTIFIERS + [READING] + BUILDING_ATTRIBUTES + WEATHER_MEASURES + [TARGET_LOG]
    + CALENDAR_FEATURES + LAG_FEATURES + ROLLING_FEATURES + INTERACTION_FEATURES
)
# the order is part of the model contract
MODEL_FEATURES = (
    CALENDAR_FEATURES + LAG_FEATURES + ROLLING_FEATURES + INTERACTION_FEATURES
    + ["air_temperature", "square_feet"]
)
ANOMALY_FEATURES = [
    "meter_reading_log", "rolling_mean_6hr", "rolling_std_24hr", "lag_1hr", "lag_24hr",
    "hour", "is_weekend", "air_temperature",
]
CORRELATION_COLUMNS = [
    "meter_reading_log", "hour", "dayofweek", "month", "is_weekend", "lag_1hr", "lag_24hr", "lag_168hr",
    "rolling_mean_6hr", "rolling_std_24hr", "air_temperature", "temp_x_hour", "occupancy_proxy",
]
METER_NAMES = {0: "Electricity", 1: "Chilled Water", 2: "Steam", 3: "Hot Water"}
SEVERITIES = ["NORMAL", "WARNING", "CRITICAL"]
STATE_STATUSES = ["NORMAL", "WARNING", "CRITICAL", "UNAVAILABLE"]
PRIORITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4, "INFO": 5}
CATEGORIES = ["ENERGY", "ANOMALY", "COST", "CARBON", "OPERATIONS"]
YEAR_MONTH = "year_month"     # folder column of stored tables, beside meter
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# ---- types -----------------------------------------------------------------

_LONGS = {
    "building_id", "meter", "site_id", "square_feet", "hour", "dayofweek", "month", "dayofyear",
    "is_weekend", "is_business_hours",
}
_STRINGS = {"primary_use", "floor_count"}


def column_type(name: str) -> T.DataType:
    """Spark type of a contract column."""
    if name == "timestamp":
        return T.TimestampNTZType()
    if name in _LONGS:
        return T.LongType()
    return T.StringType() if name in _STRINGS else T.DoubleType()


def struct_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c)) for c in columns])


FEATURE_TABLE = struct_of(ALL_COLUMNS)
RAW_READINGS = struct_of(IDENTIFIERS + [READING])
RAW_BUILDINGS = struct_of(
    ["site_id", "building_id", "primary_use", "square_feet", "year_built", "floor_count"])
RAW_WEATHER = struct_of(["site_id", "timestamp"] + WEATHER_MEASURES)


def require_columns(available: list[str], wanted: list[str], what: str = "table") -> None:
    """Reject a request for columns the table does not have."""
    missing = sorted(set(wanted) - set(available))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
