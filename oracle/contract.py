"""The contract's values as the SQL twins use them, written out here and not taken from the library under test."""

# fixed values: column names in contract order
FILLED_WEATHER = ["air_temperature", "dew_temperature", "wind_speed", "sea_level_pressure"]
ANOMALY_FEATURES = ["meter_reading_log", "rolling_mean_6hr", "rolling_std_24hr", "lag_1hr", "lag_24hr", "hour", "is_weekend", "air_temperature"]
MODEL_FEATURES = [
    "hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_business_hours", "hour_sin", "hour_cos", "month_sin", "month_cos",
    "lag_1hr", "lag_24hr", "lag_168hr", "rolling_mean_6hr", "rolling_mean_24hr", "rolling_std_24hr", "rolling_mean_168hr",
    "temp_x_hour", "temp_x_weekend", "occupancy_proxy", "air_temperature", "square_feet",
]
ALL_COLUMNS = [
    "building_id", "meter", "timestamp", "meter_reading", "site_id", "primary_use", "square_feet", "year_built", "floor_count",
    "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr", "sea_level_pressure", "wind_direction", "wind_speed",
    "meter_reading_log", "hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_business_hours", "hour_sin", "hour_cos",
    "month_sin", "month_cos", "lag_1hr", "lag_24hr", "lag_168hr", "rolling_mean_6hr", "rolling_mean_24hr", "rolling_std_24hr",
    "rolling_mean_168hr", "temp_x_hour", "temp_x_weekend", "occupancy_proxy",
]
CORRELATION_COLUMNS = [
    "meter_reading_log", "hour", "dayofweek", "month", "is_weekend", "lag_1hr", "lag_24hr", "lag_168hr", "rolling_mean_6hr",
    "rolling_std_24hr", "air_temperature", "temp_x_hour", "occupancy_proxy",
]
CRITICAL_COLUMNS = ["building_id", "meter", "timestamp", *MODEL_FEATURES, "meter_reading_log", "meter_reading"]
WHOLE_NUMBERS = {"building_id", "meter", "site_id", "square_feet", "hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_business_hours"}
TEXTS = {"primary_use", "floor_count"}

# fixed values: weights of the linear scorer
BLEND = {
    "intercept": 0.1, "lag_1hr": 0.25, "lag_24hr": 0.2, "lag_168hr": 0.15, "rolling_mean_6hr": 0.1, "rolling_mean_24hr": 0.15,
    "rolling_mean_168hr": 0.1, "rolling_std_24hr": 0.05, "hour_sin": 0.02, "is_business_hours": 0.03, "air_temperature": 0.0005,
    "temp_x_weekend": -0.0002,
}

# fixed values: code, priority and category of each rule, in the order that numbers recommendations
RULES = [
    ("CRIT", "CRITICAL", "ANOMALY"), ("ANOM", "HIGH", "ANOMALY"), ("SPIKE", "HIGH", "ANOMALY"), ("PERS", "HIGH", "OPERATIONS"),
    ("LOW", "MEDIUM", "OPERATIONS"), ("COST", "MEDIUM", "COST"), ("CARB", "MEDIUM", "CARBON"), ("SIM", "LOW", "ENERGY"),
    ("NORM", "INFO", "ENERGY"),
]
PRIORITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4, "INFO": 5}

# the meter-shaped views over the order tables
HOURS = 2160
SCENARIOS = [
    ("ENERGY_MULTIPLIER", 1.1), ("ENERGY_REDUCTION", 0.15), ("FIXED_KWH_ADDITION", -60.0), ("FIXED_KWH_ADDITION", 5.0),
    ("EFFICIENCY_MULTIPLIER", 0.9), ("OCCUPANCY_CHANGE", 0.2), ("TEMPERATURE_CHANGE", 3.0),
]


def is_double(name: str) -> bool:
    return name not in WHOLE_NUMBERS and name not in TEXTS and name != "timestamp"
