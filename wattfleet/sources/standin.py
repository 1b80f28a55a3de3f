"""Meter-shaped views over the order tables of the test data.

One order line is one raw reading: 2,160 consecutive order keys form the hours of one
building, the line number gives the meter, so the fleet grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattfleet.functions.scalars import hours
from wattfleet.schema import RAW_BUILDINGS, RAW_WEATHER

TABLES = ("lineitem", "customer")      # the tables the views read
HOURS = 2160
SITES = 4
SCENARIOS = [
    ("ENERGY_MULTIPLIER", 1.1), ("ENERGY_REDUCTION", 0.15), ("FIXED_KWH_ADDITION", -60.0), ("FIXED_KWH_ADDITION", 5.0),
    ("EFFICIENCY_MULTIPLIER", 0.9), ("OCCUPANCY_CHANGE", 0.2), ("TEMPERATURE_CHANGE", 3.0),
]
_START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start() -> Column:
    return F.lit(_START).cast("timestamp_ntz")


def _hour_index() -> Column:
    return F.col("l_orderkey") % HOURS


def readings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per hour; untaxed lines read zero."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(f"l_orderkey DIV {HOURS}").alias("building_id"),
        ((F.col("l_linenumber") - 1) % 4).cast("long").alias("meter"),
        (_start() + hours(_hour_index())).alias("timestamp"),
        F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_quantity") + 40).alias("meter_reading"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive readings summed per hour: one row per building, meter and hour, with gaps."""
    return (
        readings_raw(spark, sf_dir).where("meter_reading > 0")
        .groupBy("building_id", "meter", "timestamp")
        .agg(F.round(F.sum("meter_reading"), 2).alias("meter_reading"))
    )


def building_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One building per customer; nation 16 has no weather site."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_nationkey") != 16, F.col("c_nationkey") % SITES).cast("long").alias("site_id"),
        key.alias("building_id"),
        F.col("c_mktsegment").alias("primary_use"),
        (1000 + key * 7).cast("long").alias("square_feet"),
        F.when(key % 2 == 0, 1950 + key % 60).cast("double").alias("year_built"),
        F.when(key % 5 == 0, (key % 9 + 1).cast("string")).alias("floor_count"),
    ).select(*RAW_BUILDINGS.names)


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of four sites with holes; site 3 never reports pressure."""
    h, site = _hour_index(), F.col("l_suppkey") % SITES
    measure = lambda keep, value: F.max(F.when(keep, value))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(site.cast("long").alias("site_id"), (_start() + hours(h)).alias("timestamp"))
        .agg(
            measure((h % 5 != 0) & (h >= 3), F.col("l_quantity") - 10).alias("air_temperature"),
            F.max(F.round(F.col("l_discount") * 100, 0)).alias("cloud_coverage"),
            measure(h % 7 != 0, F.col("l_quantity") - 20).alias("dew_temperature"),
            F.lit(None).cast("double").alias("precip_depth_1_hr"),
            measure((site != 3) & (h % 6 != 0), F.col("l_quantity") + 1000).alias("sea_level_pressure"),
            F.lit(None).cast("double").alias("wind_direction"),
            measure(h % 11 != 0, F.round(F.col("l_tax") * 100, 0)).alias("wind_speed"),
        )
        .select(*RAW_WEATHER.names)
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free series: every hour of the covered time for every series, 60 where nothing was read.

    Each reading unfolds the hours up to the next one of its series, the first also those before it. So the hours arise where the
    readings lie, spread by series; from the list of series, a few bytes each, they would all arise in one task.
    """
    rows = readings(spark, sf_dir)
    hour = F.expr("INTERVAL 1 HOUR")
    span = rows.agg(F.struct(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))).scalar()
    ts, by_time = F.col("timestamp"), Window.partitionBy("building_id", "meter").orderBy("timestamp")
    reach = rows.withColumns({
        "__span": span, "__place": F.row_number().over(by_time), "__next": F.lead("timestamp").over(by_time)})
    start = F.when(F.col("__place") == 1, F.col("__span")["first"]).otherwise(ts)
    stop = F.coalesce(F.col("__next") - hour, F.col("__span")["last"])
    # a reading counts where its keys are known, as in a join
    known = F.col("building_id").isNotNull() & F.col("meter").isNotNull()
    return (
        reach.withColumn("__hour", F.explode(F.sequence(start, stop, hour)))
        .select("building_id", "meter", F.col("__hour").alias("timestamp"),
                F.when(known & (F.col("__hour") == ts), F.col("meter_reading")).alias("meter_reading"))
        .fillna(60.0, ["meter_reading"]))
