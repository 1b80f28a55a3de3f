"""Time slices read only the folders they can need, and give the rows that filters alone give."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_text, rows_of
from wattfleet.operators import forecast
from wattfleet.plans import catalog, reports
from wattfleet.schema import FEATURE_TABLE, SERIES_KEYS
from wattfleet.sources import slices, tables

SF = "/root/testdata/sf0.001"
FOLDER = "year_month"


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """A year of two series, and one meter that fell silent in February; stored, and as plain rows."""
    parts = []
    for building, meter, end in ((1, 0, "2023-12-31 23:00"), (2, 0, "2023-12-20 10:00"), (3, 1, "2023-02-10 05:00")):
        ts = pd.date_range("2023-01-01", end, freq="h")
        parts.append(pd.DataFrame({"building_id": building, "meter": meter, "timestamp": ts, "meter_reading": 50.0 + ts.hour,
                                   "meter_reading_log": 4.0, "air_temperature": 1.0 + ts.day, "rolling_mean_6hr": 4.0}))
    plain = rows_of(spark, pd.concat(parts, ignore_index=True))
    full = plain.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in plain.columns else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in FEATURE_TABLE])
    path = str(tmp_path_factory.mktemp("fleet") / "features")
    tables.write_feature_table(full, path)
    return plain, path


def with_junk(spark, path, tmp_path, keep):
    """A copy in which every folder but the kept (meter, month) pairs holds a file that no reader can open."""
    import shutil

    out = str(tmp_path / "copy")
    shutil.copytree(path, out)
    for f in glob.glob(f"{out}/meter=*/{FOLDER}=*/part-*"):
        meter, month = (int(p.split("=")[1]) for p in f.split("/")[-3:-1])
        if (meter, month) not in keep:
            with open(f, "wb") as g:
                g.write(b"no parquet")
    for crc in glob.glob(f"{out}/**/.*.crc", recursive=True):
        os.remove(crc)
    return tables.read_feature_table(spark, out, FEATURE_TABLE, folders=True)


def same(a, b, columns):
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert key(a) == key(b)


KEYS = [*SERIES_KEYS, "timestamp", "meter_reading"]


def test_look_back_opens_the_months_of_its_references(spark, fleet, tmp_path):
    plain, path = fleet
    refs = reports.references_at_latest(plain)
    rows = with_junk(spark, path, tmp_path, {(0, 202312), (1, 202302)})
    got = slices.look_back(rows, refs, 167)
    same(got, slices.look_back(plain, refs, 167), KEYS)
    assert got.count() == 3 * 168


def test_look_back_over_the_turn_of_a_month(spark, fleet, tmp_path):
    plain, path = fleet
    refs = plain.select(*SERIES_KEYS).distinct().withColumn("reference", F.lit("2023-02-02 03:00:00").cast("timestamp_ntz"))
    rows = with_junk(spark, path, tmp_path, {(0, 202301), (0, 202302), (1, 202301), (1, 202302)})
    assert slices.look_back(rows, refs, 100).count() == 3 * 101
    same(slices.look_back(rows, refs, 100), slices.look_back(plain, refs, 100), KEYS)


def test_calendar_month_and_ranges(spark, fleet, tmp_path):
    plain, path = fleet
    rows = with_junk(spark, path, tmp_path, {(0, 202305), (1, 202305)})
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    same(slices.calendar_month(rows, 5), slices.calendar_month(plain, 5), KEYS)
    same(slices.between(rows, at("2023-05-03 04:00:00"), at("2023-05-31 23:00:00")), slices.between(plain, at("2023-05-03 04:00:00"), at("2023-05-31 23:00:00")), KEYS)
    got = tables.load_slice(rows, building_id=1, start_time="2023-05-10", end_time="2023-05-11", columns=KEYS)
    same(got, tables.load_slice(plain, building_id=1, start_time="2023-05-10", end_time="2023-05-11", columns=KEYS), KEYS)
    whole = tables.read_feature_table(spark, path, FEATURE_TABLE, folders=True)
    assert slices.before(whole, at("2023-02-01")).count() == plain.where("timestamp < '2023-02-01'").count()


def test_forecast_inputs_open_the_months_of_their_cutoffs(spark, fleet, tmp_path):
    plain, path = fleet
    cutoffs = forecast.default_cutoffs(plain)
    rows = with_junk(spark, path, tmp_path, {(0, 202312), (1, 202302)})
    same(forecast.history_buffers(rows, cutoffs), forecast.history_buffers(plain, cutoffs), [*SERIES_KEYS, "history_rows", "history_hours", "reason"])
    same(forecast.observed_weather(rows, cutoffs), forecast.observed_weather(plain, cutoffs), [*SERIES_KEYS, "step", "air_temperature"])


def test_no_references_open_nothing(spark, fleet, tmp_path):
    plain, path = fleet
    rows = with_junk(spark, path, tmp_path, set())
    assert slices.look_back(rows, reports.references_at_latest(plain).limit(0), 24).count() == 0


SLICED = ["monthly_kpis", "anomaly_overlay", "top_anomalies", "explain_target", "anomaly_report", "anomaly_flagged", "twin_state",
          "twin_state_json", "recommendations", "forecast_24h", "forecast_rejects", "forecast_given_weather", "temporal_split", "model_eval"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SLICED)
def test_reports_prune_folders(spark, name):
    """Every scan of the stored table but those for the references, which read keys and times alone, filters on the month folder."""
    limits = {"spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        text = plan_text(catalog.queries()[name](spark, SF))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    scans = [s for s in text.split("\n\n") if "Scan parquet" in s.strip().split("\n")[0] and ("built_features" in s or "dense_features" in s)]
    part = lambda s, field: s.split(field)[1].split("\n")[0] if field in s else ""
    pruned = [s for s in scans if FOLDER in part(s, "PartitionFilters:")]
    others = [s for s in scans if s not in pruned]
    assert pruned, text
    read = lambda s: {f.split(":")[0] for f in part(s, "ReadSchema:").strip()[7:-1].split(",") if f}
    assert all(read(s) <= {"building_id", "timestamp"} for s in others), name


def test_a_changed_source_is_prepared_anew(spark, tmp_path):
    """Tables made once belong to one state of their source."""
    import time

    for t in ("lineitem", "customer"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    made = []
    once = lambda: catalog.once(spark, str(tmp_path), "x", lambda: made.append(1) or len(made))
    assert once() == once() == 1
    time.sleep(0.01)
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert once() == 2
