"""Data-contract checks and profiles. Every check reads the whole table.

Checks come back as rows (check, passed, metrics); all but the uniqueness check share one
aggregation pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.schema import (
    ALL_COLUMNS, ANOMALY_FEATURES, IDENTIFIERS, METER_NAMES, MODEL_FEATURES, READING, TARGET_LOG,
)

LOG_TOLERANCE = 1e-4
CRITICAL_COLUMNS = list(dict.fromkeys(IDENTIFIERS + MODEL_FEATURES + [TARGET_LOG, READING]))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_count) of each column, one pass."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_count")


def dataset_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.countDistinct("building_id").alias("buildings"), F.count(F.lit(1)).alias("readings"),
        F.array_sort(F.collect_set("meter")).alias("meters"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; ``top`` keeps the first few."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), F.asc(column))
    return out.limit(top) if top else out


def unexpected_meters(df: DataFrame) -> DataFrame:
    return df.where(F.col("meter").isNotNull() & ~F.col("meter").isin(list(METER_NAMES))).select("meter").distinct()


def duplicate_surplus(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier (building_id, meter, timestamp)."""
    per_key = df.groupBy(*IDENTIFIERS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def _metrics(**values: Column) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return F.create_map(*flat)


def _check(name: str, passed: Column, metrics: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
                    metrics.alias("metrics"))


def _feature_check(name: str, features: Sequence[str], present: set[str]) -> Column:
    missing = sorted(set(features) - present)
    if missing:
        return _check(name, F.lit(False), _metrics(missing=F.lit(", ".join(missing))))
    nulls = sum((F.col(f"null_{c}") for c in features), F.lit(0))
    return _check(name, nulls == 0, _metrics(
        total_features=F.lit(len(features)), null_values=nulls))


def validate_all(df: DataFrame, required: Sequence[str] = ALL_COLUMNS) -> DataFrame:
    """The nine contract checks as rows. Checks whose columns are absent fail with the names."""
    present = set(df.columns)
    have = lambda *cols: set(cols) <= present
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    if have("timestamp"):
        aggs += [F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")]
    if have("building_id"):
        aggs += [F.countDistinct("building_id").alias("n_buildings"), F.min("building_id").alias("min_building")]
    if have("meter"):
        aggs += [F.count("meter").alias("n_meter"),
                 F.count_if(~F.col("meter").isin(list(METER_NAMES))).alias("bad_meter")]
    if have(READING, TARGET_LOG):
        aggs += [F.count_if(F.col(READING) <= 0).alias("non_positive"),
                 F.coalesce(F.max(F.abs(F.col(TARGET_LOG) - F.log1p(READING))), F.lit(0.0)).alias("log_diff")]
    one = df.agg(*aggs)
    if have(*IDENTIFIERS):
        one = one.withColumn("surplus", duplicate_surplus(df).scalar())

    absent = lambda name, cols: _check(
        name, F.lit(False), _metrics(missing=F.lit(", ".join(sorted(set(cols) - present)))))
    missing = sorted(set(required) - present)
    critical = [c for c in CRITICAL_COLUMNS if c in present]
    bad_critical = sum((F.col(f"null_{c}") for c in critical), F.lit(0))
    checks = [
        _check("required_columns", F.lit(not missing), _metrics(
            missing=F.lit(", ".join(missing)), found_count=F.lit(len(present)), required_count=F.lit(len(required)))),
        _check("timestamps", (F.col("null_timestamp") == 0) & F.col("min_ts").isNotNull(), _metrics(
            null_count=F.col("null_timestamp"), min_timestamp=F.col("min_ts"), max_timestamp=F.col("max_ts")))
        if have("timestamp") else absent("timestamps", ["timestamp"]),
        _check("building_ids", (F.col("null_building_id") == 0) & (F.col("n_buildings") > 0)
               & (F.col("min_building") >= 0), _metrics(
            null_count=F.col("null_building_id"), unique_buildings=F.col("n_buildings"),
            min_building_id=F.col("min_building")))
        if have("building_id") else absent("building_ids", ["building_id"]),
        _check("meters", (F.col("bad_meter") == 0) & (F.col("null_meter") == 0) & (F.col("n_meter") > 0), _metrics(
            unexpected_rows=F.col("bad_meter"), null_count=F.col("null_meter")))
        if have("meter") else absent("meters", ["meter"]),
        _check("target", (F.col(f"null_{READING}") == 0) & (F.col(f"null_{TARGET_LOG}") == 0)
               & (F.col("non_positive") == 0) & (F.col("log_diff") < LOG_TOLERANCE), _metrics(
            null_raw=F.col(f"null_{READING}"), null_log=F.col(f"null_{TARGET_LOG}"),
            non_positive_count=F.col("non_positive"), max_log1p_diff=F.round("log_diff", 6)))
        if have(READING, TARGET_LOG) else absent("target", [READING, TARGET_LOG]),
        _feature_check("model_features", MODEL_FEATURES, present),
        _feature_check("anomaly_features", ANOMALY_FEATURES, present),
        _check("missing_values", bad_critical == 0, _metrics(critical_nulls=bad_critical)),
        _check("unique_timestamps", F.col("surplus") == 0, _metrics(duplicate_timestamp_count=F.col("surplus")))
        if have(*IDENTIFIERS) else absent("unique_timestamps", IDENTIFIERS),
    ]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def validation_summary(results: DataFrame) -> DataFrame:
    """One row: whether every check passed, and how many did."""
    return results.agg(
        F.every("passed").alias("passed"), F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"))
