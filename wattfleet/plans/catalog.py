"""Every job by name, over the meter-shaped views of the test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattfleet.functions.scalars import hours
from wattfleet.operators import (
    advice, anomaly, cleaning, explain, features, forecast, forest, impact, model, quality, scenario, state, summaries,
)
from wattfleet.plans import offline, reports
from wattfleet.schema import (
    ALL_COLUMNS, ANOMALY_FEATURES, CORRELATION_COLUMNS, IDENTIFIERS, MODEL_FEATURES, RAW_READINGS, RAW_WEATHER, READING,
    SERIES_KEYS, YEAR_MONTH,
)
from wattfleet.session import configure, materialize, scratch_path
from wattfleet.sources import slices, standin, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

MONTH = 2
SPLIT = "2024-03-01"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark, tables.stored_bytes(spark, f"{sf_dir}/lineitem.parquet")), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (negative zero made positive), integers as long: comparable between engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- inputs --------------------------------------------------------------------

def merged(spark, sf) -> DataFrame:
    return offline.merged_table(*_sources(spark, sf))


def _sources(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    return standin.readings(spark, sf), standin.building_meta(spark, sf), standin.weather_raw(spark, sf)


def _written(spark, sf, rows: Query = standin.readings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources with the hourly readings and the weather written: limits, medians and windows read them, and each would sum the order lines again."""
    return source_once(spark, sf, rows), standin.building_meta(spark, sf), source_once(spark, sf, standin.weather_raw)


def source_once(spark, sf, make: Query) -> DataFrame:
    """A source as it was written for the first table made of it."""
    def write() -> tuple[str, T.StructType]:
        table, path = make(spark, sf), scratch_path(spark, make.__name__)
        table.write.parquet(path)
        return path, table.schema

    path, schema = written_once(spark, sf, f"source {make.__name__}", write)
    return spark.read.schema(schema).parquet(path)


def built_features(spark, sf) -> DataFrame:
    return offline.build_features(*_written(spark, sf))


def model_rows(spark, sf) -> DataFrame:
    return offline.build_model_table(*_written(spark, sf))


def dense_features(spark, sf) -> DataFrame:
    return offline.build_features(*_written(spark, sf, standin.dense))


# Reports and models read tables and models that were made once, as they would in operation.
_ONCE: dict[tuple, object] = {}


def _key(spark, sf, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf, name, *(tables.stored_state(spark, f"{sf}/{t}.parquet") for t in standin.TABLES)


def known(spark, sf, name: str) -> bool:
    return _key(spark, sf, name) in _ONCE


def once(spark, sf, name: str, make: Callable[[], object]):
    key = _key(spark, sf, name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def written_once(spark, sf, name: str, write: Callable[[], tuple[str, T.StructType]]) -> tuple[str, T.StructType]:
    """Path and schema of a table that is written again if it is gone."""
    path, schema = once(spark, sf, name, write)
    if not tables.path_exists(spark, path):
        for key in [k for k, v in _ONCE.items() if v == (path, schema)]:
            del _ONCE[key]
        path, schema = once(spark, sf, name, write)
    return path, schema


def stored(spark, sf, build: Query, columns: Sequence[str] | None = None) -> DataFrame:
    """A table stored for the reports. Jobs that read a few of its columns name them: if the whole table is not at hand, these alone are
    computed and stored, with the same rows."""
    narrow = columns is not None and not known(spark, sf, build.__name__)
    kept = list(dict.fromkeys([*IDENTIFIERS, *columns])) if narrow else None

    def write() -> tuple[str, T.StructType]:
        table, path = build(spark, sf), scratch_path(spark, build.__name__)
        table = table.select(*kept) if narrow else table
        tables.write_feature_table(table, path)
        return path, table.schema

    path, schema = written_once(spark, sf, " ".join([build.__name__, *(kept or [])]), write)
    return tables.read_feature_table(spark, path, schema, folders=True)


def featured(spark, sf, columns: Sequence[str] | None = None) -> DataFrame:
    return stored(spark, sf, built_features, columns)


def dense_table(spark, sf) -> DataFrame:
    return stored(spark, sf, dense_features)


def model_table_once(spark, sf, columns: Sequence[str] | None = None) -> DataFrame:
    return stored(spark, sf, model_rows, columns)


def build_forecast(spark, sf) -> DataFrame:
    return forecast.forecast_24h(dense_table(spark, sf))[0]


def forecast_rows(spark, sf) -> DataFrame:
    return stored(spark, sf, build_forecast)


def fitted(spark, sf) -> model.TreeModel:
    def fit() -> model.TreeModel:
        train, test = model.temporal_split(model_table_once(spark, sf), SPLIT)
        return model.with_nodes(spark, model.train_gbt(train, test))

    return once(spark, sf, "boosted trees", fit)


def isolation(spark, sf) -> forest.IsolationForest:
    return once(spark, sf, "isolation forest", lambda: forest.fit(model_table_once(spark, sf, ANOMALY_FEATURES)))


# ---- slices and sources ----------------------------------------------------------

_SLICE = ["building_id", "meter", "timestamp", "meter_reading"]


@query
def load_slice(spark, sf):
    return tables.load_slice(standin.readings(spark, sf), building_id=1, meter=0, start_time="2024-01-10",
                             end_time="2024-01-20 23:00:00", columns=_SLICE, limit=150)


@query
def load_slice_inlist(spark, sf):
    return tables.load_slice(standin.readings(spark, sf), building_id=[0, 2, 5], meter=[0, 1], columns=_SLICE)


@query
def parse_timestamps(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = standin.table(spark, sf, "events").select(
        "event_id", text.alias("strict_time"),
        F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(text).alias("lenient_time"))
    return tables.parse_timestamps(tables.parse_timestamps(rows, ["strict_time"]), ["lenient_time"], strict=False)


@query
def scan_csv_roundtrip(spark, sf):
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "converted")
    tables.write_csv(standin.readings_raw(spark, sf), csv)
    tables.convert_csv_to_parquet(spark, csv, parquet, RAW_READINGS)
    return tables.read_parquet(spark, parquet, RAW_READINGS)


@query
def sample_extract(spark, sf):
    path = scratch_path(spark, "sample")
    tables.create_sample(standin.readings(spark, sf), path)
    return tables.read_parquet(spark, path)


@query
def building_metadata(spark, sf):
    rows = standin.readings(spark, sf).join(standin.building_meta(spark, sf), "building_id", "left")
    return tables.building_metadata(rows)


@query
def buildings_list(spark, sf):
    ids, meters = summaries.buildings_list(standin.readings(spark, sf))
    none = F.lit(None).cast("string").alias("name")
    return (
        ids.select(F.lit("building").alias("kind"), F.col("building_id").alias("id"), none)
        .unionByName(meters.select(F.lit("meter").alias("kind"), F.col("meter").alias("id"), "name"))
        .unionByName(ids.select(F.lit("total").alias("kind"), F.col("building_id").alias("id"))
                     .groupBy("kind").agg(F.count("id").alias("id")).select("kind", "id", none)))


@query
def latest_timestamps(spark, sf):
    return tables.latest_timestamps(standin.readings(spark, sf))


@query
def reject_unknown_series(spark, sf):
    requests = standin.table(spark, sf, "customer").select(
        (F.col("c_custkey") - 3).alias("building_id"), (F.col("c_nationkey") % 6 - 1).cast("long").alias("meter"))
    return tables.split_requests(requests, standin.readings(spark, sf))[1]


# ---- profiles and checks ------------------------------------------------------------

@query
def dataset_overview(spark, sf):
    out = quality.dataset_overview(standin.readings_raw(spark, sf))
    return out.withColumn("meters", F.concat_ws(",", F.transform("meters", lambda m: m.cast("string"))))


@query
def null_profile(spark, sf):
    return quality.null_counts(merged(spark, sf), ALL_COLUMNS[:17])


@query
def value_counts(spark, sf):
    part = lambda df, field, column: df.select(
        F.lit(field).alias("field"), F.col(column).cast("string").alias("value"), "n")
    month = quality.value_counts(model_table_once(spark, sf).where("meter = 0"), "month")
    return (
        part(quality.value_counts(standin.readings_raw(spark, sf), "meter"), "meter", "meter")
        .unionByName(part(quality.value_counts(standin.building_meta(spark, sf), "primary_use", 8), "primary_use", "primary_use"))
        .unionByName(part(month, "month", "month")))


@query
def validate_all(spark, sf):
    return quality.validate_all(featured(spark, sf).drop(YEAR_MONTH)).select(
        "check", "passed", F.explode("metrics").alias("metric", "value"))


@query
def unexpected_meters(spark, sf):
    """Meter codes outside the contract, by name."""
    codes = standin.table(spark, sf, "customer").select((F.col("c_nationkey") % 9 - 2).cast("long").alias("meter"))
    return quality.unexpected_meters(codes)


@query
def validation_verdict(spark, sf):
    return quality.validation_summary(quality.validate_all(featured(spark, sf).drop(YEAR_MONTH)))


# ---- cleaning and features -------------------------------------------------------------

@query
def clean_readings(spark, sf):
    return cleaning.filter_outliers(standin.readings(spark, sf))


@query
def fill_weather(spark, sf):
    return cleaning.fill_weather(standin.weather_raw(spark, sf)).select(*RAW_WEATHER.names)


@query
def merge_sources(spark, sf):
    return rounded(merged(spark, sf).select(*ALL_COLUMNS[:17]))


@query
def calendar_features(spark, sf):
    return rounded(features.calendar_features(standin.readings(spark, sf)))


@query
def lag_features(spark, sf):
    out = features.lag_features(merged(spark, sf).select(*IDENTIFIERS, "meter_reading_log"))
    return rounded(out.drop("meter_reading_log"))


@query
def rolling_features(spark, sf):
    out = features.rolling_features(merged(spark, sf).select(*IDENTIFIERS, "meter_reading_log"))
    return rounded(out.drop("meter_reading_log"))


@query
def interactions(spark, sf):
    rows, fill = offline.merged_with_fill(*_sources(spark, sf))
    rows = features.calendar_features(rows.select(*IDENTIFIERS, "meter_reading_log", "air_temperature"))
    out = features.interaction_features(features.rolling_features(rows), fill)
    return rounded(out.select(*IDENTIFIERS, "temp_x_hour", "temp_x_weekend", "occupancy_proxy"))


@query
def feature_table(spark, sf):
    return rounded(built_features(spark, sf))


@query
def model_table(spark, sf):
    return rounded(model_rows(spark, sf))


@query
def band_baseline(spark, sf):
    return rounded(features.band_baseline(standin.readings(spark, sf)).drop("meter_reading"))


@query
def correlation_matrix(spark, sf):
    return rounded(features.correlation_matrix(featured(spark, sf), CORRELATION_COLUMNS))


# ---- summaries ------------------------------------------------------------------------------

@query
def monthly_summary(spark, sf):
    return rounded(summaries.monthly_summary(standin.readings(spark, sf)))


@query
def median_by_timestamp(spark, sf):
    return rounded(summaries.median_by(standin.readings(spark, sf), "timestamp"))


@query
def median_week(spark, sf):
    return rounded(summaries.median_week(standin.readings(spark, sf), "2024-01-08", "2024-01-14"))


@query
def median_patterns(spark, sf):
    return rounded(summaries.median_patterns(standin.readings(spark, sf)))


@query
def hourly_pattern(spark, sf):
    return rounded(summaries.hourly_pattern(standin.readings(spark, sf)))


@query
def available_months(spark, sf):
    out = summaries.available_months(standin.readings(spark, sf))
    return out.withColumn("months", F.concat_ws(",", F.transform("months", lambda m: m.cast("string"))))


# ---- model and forecast ------------------------------------------------------------------------

@query
def temporal_split(spark, sf):
    train, test = model.temporal_split(featured(spark, sf), SPLIT)
    part = lambda df, name: df.select(*IDENTIFIERS, F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


@query
def forecast_eligibility(spark, sf):
    part = lambda df, name: forecast.forecast_eligibility(df).withColumn("source", F.lit(name))
    return rounded(part(standin.readings(spark, sf), "gappy").unionByName(part(standin.dense(spark, sf), "dense")))


@query
def forecast_24h(spark, sf):
    return rounded(build_forecast(spark, sf))


@query
def forecast_rejects(spark, sf):
    """Series without a forecast; with ``forecast_24h`` they make up the fleet."""
    return forecast.forecast_24h(dense_table(spark, sf))[1].select(*SERIES_KEYS, "reason")


@query
def forecast_given_weather(spark, sf):
    table = dense_table(spark, sf)
    cutoffs = forecast.default_cutoffs(table)
    temps = forecast.weather_from_list(cutoffs, [18.5 + i % 5 for i in range(24)])
    return rounded(forecast.forecast_24h(table, cutoffs, temps)[0])


def _table_weather(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Weather given per site, with holes, for forecasts from three days before the end."""
    table = dense_table(spark, sf)
    cutoffs = forecast.default_cutoffs(table, 72)
    given = standin.weather_raw(spark, sf).where("air_temperature IS NOT NULL OR site_id = 2")
    temps = forecast.weather_from_table(cutoffs, given, standin.building_meta(spark, sf))
    return forecast.forecast_24h(table, cutoffs, temps)


@query
def forecast_table_weather(spark, sf):
    return rounded(_table_weather(spark, sf)[0])


@query
def forecast_table_weather_rejects(spark, sf):
    """Series whose given weather does not serve, or whose history does not, and why."""
    return _table_weather(spark, sf)[1].select(*SERIES_KEYS, "reason")


@query
def forecast_summary(spark, sf):
    return rounded(summaries.forecast_summary(forecast_rows(spark, sf)))


@query
def forecast_band(spark, sf):
    return rounded(forecast.forecast_band(forecast_rows(spark, sf).select(*IDENTIFIERS, "predicted_kwh")))


@query
def model_eval(spark, sf):
    _, test = model.temporal_split(featured(spark, sf), SPLIT)
    rows = test.dropna(subset=MODEL_FEATURES).withColumn("predicted_log", forecast.linear_log())
    return rounded(forecast.evaluate(rows))


@query
def train_gbt(spark, sf):
    """Hold-out scores of the fitted trees."""
    _, test = model.temporal_split(model_table_once(spark, sf), SPLIT)
    return forecast.evaluate(model.predict(test, fitted(spark, sf).model))


@query
def predict_kwh(spark, sf):
    rows = model.predict(model_table_once(spark, sf), fitted(spark, sf).model)
    return rows.select(*IDENTIFIERS, "predicted_log", "predicted_kwh")


@query
def forecast_24h_trees(spark, sf):
    """The recursive forecast with the fitted trees as scorer."""
    score = fitted(spark, sf).forest.predict
    return forecast.forecast_24h(dense_table(spark, sf), scorer=score)[0]


@query
def model_persist(spark, sf):
    """Predictions of the saved and reloaded model."""
    path = scratch_path(spark, "saved-model")
    model.save_model(fitted(spark, sf).model, path)
    rows = model.predict(model_table_once(spark, sf), model.load_model(path))
    return rows.select(*IDENTIFIERS, "predicted_log", "predicted_kwh")


@query
def model_metadata(spark, sf):
    trees = model.model_metadata(spark, fitted(spark, sf))
    return trees.unionByName(forest.forest_metadata(spark, _saved_forest(spark, sf), "all meters"), allowMissingColumns=True)


@query
def feature_importance(spark, sf):
    nodes = fitted(spark, sf).nodes(spark)
    return model.feature_importance(nodes).unionByName(model.feature_importance(nodes, "split"))


@query
def explain_target(spark, sf):
    return rounded(reports.explain_targets(featured(spark, sf), MONTH).select(
        *IDENTIFIERS, "meter_reading", "rolling_mean_6hr"))


@query
def shap_instance(spark, sf):
    """Explanation of the row picked for each building."""
    return explain.explain(reports.explain_targets(featured(spark, sf), MONTH), fitted(spark, sf).forest)


@query
def shap_summary(spark, sf):
    _, test = model.temporal_split(model_table_once(spark, sf), SPLIT)
    return explain.mean_attribution(explain.explain_sample(test, fitted(spark, sf).forest))


# ---- anomalies --------------------------------------------------------------------------------------

_RESIDUAL = ["actual_kwh", "expected_kwh", "residual", "deviation_ratio", "abs_deviation_ratio", "severity",
             "is_anomaly", "anomaly_direction"]


@query
def anomaly_residual(spark, sf):
    return rounded(anomaly.add_residual(featured(spark, sf)).select(*IDENTIFIERS, *_RESIDUAL))


@query
def anomaly_streak(spark, sf):
    return rounded(anomaly.add_streak(anomaly.add_residual(featured(spark, sf))).select(
        *IDENTIFIERS, "is_anomaly", "streak_hours"))


@query
def anomaly_classify(spark, sf):
    return rounded(anomaly.analyze(featured(spark, sf)).select(
        *IDENTIFIERS, *_RESIDUAL, "streak_hours", "anomaly_type", "priority_rank"))


@query
def anomaly_points(spark, sf):
    points = standin.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 40).alias("actual_kwh"),
        (F.col("l_suppkey") % 40 + 50.0).alias("expected_kwh"),
        (F.col("l_discount") * 500 + 40).alias("rolling_mean_6hr_kwh"),
        (F.col("l_tax") * 1000 + 40).alias("rolling_mean_24hr_kwh"),
        F.col("l_linenumber").cast("long").alias("streak_hours"))
    return rounded(anomaly.analyze_points(points).select(
        "l_orderkey", "l_linenumber", "l_partkey", *_RESIDUAL, "anomaly_type", "priority_rank"))


@query
def anomaly_reason(spark, sf):
    return anomaly.analyze(featured(spark, sf)).select(*IDENTIFIERS, "anomaly_type", "classification_reason")


@query
def anomaly_model(spark, sf):
    """Expectations by a model: per row, per frame (no series is complete from its first row on), and per frame of complete rows."""
    table = featured(spark, sf)
    whole = table.dropna(subset=MODEL_FEATURES)
    model = F.greatest(F.expm1(forecast.linear_log()), F.lit(0.0))
    part = lambda rows, rule, frame: anomaly.add_residual(rows, model=model, frame=frame).select(
        F.lit(rule).alias("rule"), *IDENTIFIERS, *_RESIDUAL)
    return rounded(part(table, "row", None).unionByName(part(table, "frame", SERIES_KEYS))
                   .unionByName(part(whole, "complete frame", SERIES_KEYS)))


@query
def monthly_kpis_model(spark, sf):
    return rounded(reports.monthly_kpis(featured(spark, sf), MONTH, expect_model=True))


@query
def month_alerts_model(spark, sf):
    return rounded(reports.month_alerts(featured(spark, sf), MONTH, forecast.linear_log()).select(
        *IDENTIFIERS, "place", "more", "severity", "residual", "shown_time"))


@query
def anomaly_report(spark, sf):
    counts, _ = reports.anomaly_report(featured(spark, sf))
    entry = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))
    return counts.select(
        *SERIES_KEYS, "total_records", "anomaly_count", "forest_count",
        *[entry("counts_by_severity", s).alias(f"n_{s.lower()}") for s in ("NORMAL", "WARNING", "CRITICAL")],
        *[entry("counts_by_type", t).alias(f"t_{t.lower()}") for t in anomaly.TYPE_RANK])


@query
def anomaly_flagged(spark, sf):
    """The flagged rows of the anomaly report."""
    return rounded(reports.anomaly_report(featured(spark, sf))[1].select(*IDENTIFIERS, *_RESIDUAL, "anomaly_type"))


@query
def anomaly_overlay(spark, sf):
    return rounded(reports.anomaly_overlay(featured(spark, sf), MONTH))


@query
def top_anomalies(spark, sf):
    scored = anomaly.add_residual(slices.calendar_month(featured(spark, sf), MONTH))
    return rounded(reports.top_anomalies(scored).select(
        *IDENTIFIERS, "place", "more", "severity", "residual", "shown_time"))


@query
def monthly_kpis(spark, sf):
    return rounded(reports.monthly_kpis(featured(spark, sf), MONTH))


def _saved_forest(spark, sf) -> str:
    def save() -> str:
        path = scratch_path(spark, "saved-forest")
        forest.save_forest(spark, isolation(spark, sf), path)
        return path

    return once(spark, sf, "saved forest", save)


@query
def isoforest_fit(spark, sf):
    """Rows, nodes and depth of each stored tree, and the forest's cut."""
    nodes = spark.read.parquet(_saved_forest(spark, sf))
    return rounded(nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("cover"))).cast("long").alias("sample_rows"), F.count(F.lit(1)).alias("nodes"),
        F.sum(F.when(F.col("left") < 0, F.col("value"))).alias("leaf_depths"), F.max("offset").alias("cut")))


@query
def isoforest_score(spark, sf):
    return rounded(forest.score(featured(spark, sf, ANOMALY_FEATURES), isolation(spark, sf)).select(
        *IDENTIFIERS, "isoforest_score", "anomaly_score", "isoforest_anomaly"))


@query
def isoforest_persist(spark, sf):
    """Flags of the forest after saving and loading it."""
    back = forest.load_forest(spark, _saved_forest(spark, sf))
    return forest.score(featured(spark, sf, ANOMALY_FEATURES), back).where("isoforest_anomaly = 1").select(*IDENTIFIERS)


@query
def isoforest_summary(spark, sf):
    return rounded(forest.forest_summary(forest.score(featured(spark, sf, ANOMALY_FEATURES), isolation(spark, sf))))


@query
def anomaly_detect(spark, sf):
    found = isolation(spark, sf)
    rows = featured(spark, sf, [*ANOMALY_FEATURES, READING, "rolling_mean_24hr"])
    return rounded(anomaly.detect(rows, forest_score=lambda df: forest.score(df, found)).select(
        *IDENTIFIERS, *_RESIDUAL, "anomaly_type", "isoforest_anomaly", "isoforest_score", "anomaly_score"))


# ---- impact, scenarios, states, recommendations ---------------------------------------------------------

@query
def impact_hourly(spark, sf):
    return rounded(impact.hourly_impact(forecast_rows(spark, sf)).select(
        *IDENTIFIERS, "predicted_kwh", "hourly_cost", "hourly_carbon_kg"))


@query
def impact_points(spark, sf):
    points = standin.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 10).alias("energy_kwh"))
    return rounded(impact.point_impact(points, 12.5, 0.5).drop("energy_kwh"))


@query
def impact_summary(spark, sf):
    return rounded(reports.impact_report(forecast_rows(spark, sf)))


@query
def scenario_sweep(spark, sf):
    return rounded(scenario.sweep(forecast_rows(spark, sf), standin.SCENARIOS)[0])


@query
def scenario_rejects(spark, sf):
    """Series and scenarios without a projection, and why."""
    return rounded(scenario.sweep(forecast_rows(spark, sf), standin.SCENARIOS)[1])


@query
def scenario_summary(spark, sf):
    return rounded(reports.scenario_report(forecast_rows(spark, sf), standin.SCENARIOS).drop(
        "tariff_per_kwh", "carbon_intensity_kg_per_kwh"))


def _states(spark, sf) -> DataFrame:
    return reports.fleet_state(dense_table(spark, sf), forecast_rows=forecast_rows(spark, sf))


@query
def twin_state(spark, sf):
    return rounded(_states(spark, sf).drop("classification_reason"))


@query
def twin_state_json(spark, sf):
    """States written as JSON and read back."""
    shape = ("timestamp string, actual_kwh double, severity string, anomaly_type string, forecast_total_kwh double, "
             "forecast_peak_hour string, state_status string")
    text = state.state_json(_states(spark, sf), stamp=False)
    return rounded(text.select(*SERIES_KEYS, F.from_json("state", shape).alias("s")).select(*SERIES_KEYS, "s.*"))


@query
def twin_state_checks(spark, sf):
    nation, nothing = F.col("c_nationkey"), F.lit(None).cast("double")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = standin.table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") < 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("building_id"),
        (nation % 6 - 1).cast("long").alias("meter"),
        F.when(nation % 7 != 0, start + hours(F.col("c_custkey") % 720)).alias("timestamp"),
        F.when(nation == 3, F.lit(float("nan"))).when(nation == 4, F.lit(float("inf")))
        .otherwise(F.col("c_acctbal")).alias("actual_kwh"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("ODD")).otherwise(F.lit("NORMAL")).alias("state_status"),
        *[nothing.alias(c) for c in ("expected_kwh", "residual_kwh", "deviation_ratio", "forecast_total_kwh",
                                     "forecast_peak_kwh", "forecast_total_cost", "forecast_total_carbon_kg")])
    return state.state_faults(rows).select("building_id", "meter", "timestamp", "fault")


def _advised(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = forecast_rows(spark, sf)
    sweep, _ = scenario.sweep(rows, [("FIXED_KWH_ADDITION", -60.0)])
    states = _states(spark, sf)
    return states, advice.recommendations(states, scenario.scenario_summary(sweep), cost_threshold=13000.0)


@query
def recommendation_lists(spark, sf):
    """The list of each state as ids in order, and its length."""
    out = advice.recommendation_lists(*_advised(spark, sf), stamp=False)
    ids = F.array_join(F.transform("recommendations", lambda r: r["recommendation_id"]), ",")
    return out.select(*SERIES_KEYS, "timestamp", "state_status", ids.alias("ids"), "total_count")


@query
def recommendations(spark, sf):
    out = _advised(spark, sf)[1]
    return rounded(out.select(*SERIES_KEYS, "rank", "priority", "category", "priority_rank", "number", "recommendation_id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
