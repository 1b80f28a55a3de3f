"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is run twice and written to Spark's no-op sink; the better run counts. Stored
feature tables and fitted models are prepared first and timed under ``prepare_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "load_slice", "monthly_summary", "median_by_timestamp", "median_patterns", "validate_all", "clean_readings",
    "fill_weather", "merge_sources", "rolling_features", "feature_table", "model_table", "band_baseline",
    "correlation_matrix", "anomaly_classify", "anomaly_report", "top_anomalies", "monthly_kpis", "forecast_24h",
    "forecast_24h_trees", "impact_summary", "scenario_summary", "twin_state", "recommendations", "predict_kwh",
    "shap_summary", "isoforest_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wattfleet.plans import catalog
    from wattfleet.session import configure

    configure(spark)
    times: dict[str, float] = {}

    def timed(label: str, run) -> None:
        t0 = time.perf_counter()
        run()
        times[label] = min(times.get(label, float("inf")), round(time.perf_counter() - t0, 3))

    prepare = {
        "prepare_features": lambda: catalog.featured(spark, sf_dir),
        "prepare_dense_features": lambda: catalog.dense_table(spark, sf_dir),
        "prepare_forecast": lambda: catalog.forecast_rows(spark, sf_dir),
        "prepare_model_table": lambda: catalog.model_table_once(spark, sf_dir),
        "prepare_gbt": lambda: catalog.fitted(spark, sf_dir),
        "prepare_isolation_forest": lambda: catalog.isolation(spark, sf_dir),
    }
    for label, run in prepare.items():
        timed(label, run)
    queries = catalog.queries()
    for name in names:
        for _ in range(2):
            timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
