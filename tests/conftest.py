import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from wattfleet.session import configure

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Three gappy series of different length, as pandas and as Spark rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for building, meter, n in ((1, 0, 900), (1, 1, 400), (2, 0, 30)):
        ts = pd.date_range("2024-01-20", periods=n, freq="h")
        keep = rng.random(n) > 0.1
        parts.append(pd.DataFrame({
            "building_id": building, "meter": meter, "timestamp": ts[keep],
            "meter_reading": np.round(rng.uniform(20, 120, n)[keep], 2)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["meter_reading_log"] = np.log1p(pdf["meter_reading"])
    return pdf, rows_of(spark, pdf)


def rows_of(spark, pdf):
    """Spark rows of a pandas frame; naive times stay without a zone."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    times = [c for c in pdf.columns if str(pdf[c].dtype).startswith("datetime")]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else df


def plan_text(df):
    """The formatted plan, untruncated."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
