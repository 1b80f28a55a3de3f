"""Scans, slices and sinks of meter tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattfleet.functions.scalars import null_if_nan
from wattfleet.schema import BUILDING_ATTRIBUTES, IDENTIFIERS, SERIES_KEYS, YEAR_MONTH, require_columns
from wattfleet.sources import slices

SAMPLE_BUILDINGS = [0, 1, 2, 20, 100, 500]      # fixed value: the default extract


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats}) if floats else df


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema; timestamps in ISO or blank-separated form."""
    return nan_to_null(
        spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd[ ]['T']HH:mm:ss").csv(path, header=True))


def parse_timestamps(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Text to time. ``strict`` fails the job on a bad value; otherwise it becomes NULL."""
    types = dict(df.dtypes)
    parse = (lambda c: F.to_timestamp_ntz(c)) if strict else (
        lambda c: F.try_to_timestamp(c).cast("timestamp_ntz"))
    return df.withColumns({c: parse(F.col(c)) for c in columns if types[c] == "string"})


def _matches(column: str, wanted: int | Iterable[int]) -> Column:
    if isinstance(wanted, (int, float)):
        return F.col(column) == int(wanted)
    return F.col(column).isin([int(w) for w in wanted])


def _time(value) -> Column:
    """A time bound with its full precision; a bare date means its midnight."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def load_slice(
    df: DataFrame,
    building_id: int | Iterable[int] | None = None,
    meter: int | Iterable[int] | None = None,
    start_time=None,
    end_time=None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    validate_columns: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Rows of a slice, both time ends included, in time order.

    Filters and columns reach the Parquet scan; with ``limit`` the order is a per-task top-n.
    ``ordered=False`` leaves out the global sort for callers that aggregate next.
    """
    if columns is not None and validate_columns:
        require_columns(df.columns, list(columns))
    out = df
    if building_id is not None:
        out = out.where(_matches("building_id", building_id))
    if meter is not None:
        out = out.where(_matches("meter", meter))
    out = slices.between(out, *[None if t is None else _time(t) for t in (start_time, end_time)])
    if limit is not None or ordered:
        out = out.orderBy("timestamp", *[k for k in SERIES_KEYS if k in out.columns])
    if limit is not None:
        out = out.limit(int(limit))
    if columns is not None:
        out = out.select(*[c for c in columns if c in out.columns])
    return out


def building_ids(df: DataFrame, meter: int | None = 0) -> DataFrame:
    rows = df if meter is None else df.where(F.col("meter") == int(meter))
    return rows.select("building_id").distinct()


def meters(df: DataFrame) -> DataFrame:
    return df.select("meter").distinct()


def building_metadata(
    df: DataFrame, building_id: int | Iterable[int] | None = None, strict: bool = False,
) -> DataFrame:
    """Metadata per building: the values of its first row in time (one pre-aggregated pass).

    ``strict`` stops the job when a requested building has no row.
    """
    require_columns(df.columns, ["building_id", *BUILDING_ATTRIBUTES, "timestamp"])
    rows = df if building_id is None else df.where(_matches("building_id", building_id))
    tie = [F.col("meter")] if "meter" in df.columns else []
    first = F.min_by(F.struct(*BUILDING_ATTRIBUTES), F.struct(F.col("timestamp"), *tie))
    found = rows.groupBy("building_id").agg(first.alias("m"))
    if strict and building_id is not None:
        ids = [building_id] if isinstance(building_id, int) else [int(b) for b in building_id]
        asked = df.sparkSession.createDataFrame([(b,) for b in ids], "building_id long")
        absent = F.raise_error(F.concat(F.lit("no rows of building "), F.col("building_id").cast("string")))
        kind = found.schema["m"].dataType
        found = asked.join(found, "building_id", "left").withColumn(
            "m", F.when(F.col("m").isNull(), absent.cast(kind)).otherwise(F.col("m")))
    return found.select("building_id", "m.*")


def latest_timestamps(df: DataFrame) -> DataFrame:
    return df.groupBy(*SERIES_KEYS).agg(F.max("timestamp").alias("latest"))


def split_requests(requests: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of requested (building_id, meter) pairs, with the reason of each reject."""
    known = df.select(*SERIES_KEYS).distinct().withColumn("__known", F.lit(True))
    judged = requests.join(known, SERIES_KEYS, "left").withColumn(
        "reason",
        F.when((F.col("building_id") < 0) | (F.col("meter") < 0), F.lit("negative id"))
        .when(F.col("__known").isNull(), F.lit("unknown series"))).drop("__known")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


# ---- sinks -----------------------------------------------------------------

def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd",
    mode: str = "errorifexists",
) -> None:
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def write_feature_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The table the reports slice: folders by meter and month, in them rows of a series together and in time order.

    Rows leave the window stage hashed by series, so they are only sorted, not moved again.
    """
    (df.withColumn(YEAR_MONTH, slices.year_month(F.col("timestamp")))
       .sortWithinPartitions("meter", YEAR_MONTH, "building_id", "timestamp")
       .write.mode(mode).option("compression", "zstd").partitionBy("meter", YEAR_MONTH).parquet(path))


def read_feature_table(spark: SparkSession, path: str, schema: T.StructType, folders: bool = False) -> DataFrame:
    """A stored feature table in its own column order (the folder columns would come last).

    With ``folders`` the month of the folder follows as ``year_month``, by which slices prune.
    """
    names = [c for c in schema.names if c != YEAR_MONTH]
    stored = T.StructType([*[schema[c] for c in names], T.StructField(YEAR_MONTH, T.IntegerType())])
    return spark.read.schema(stored).parquet(path).select(*names, *([YEAR_MONTH] if folders else []))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def stored_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of the last change of a table, by which a later version can be told apart."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength()), int(fs.getFileStatus(target).getModificationTime())


def stored_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength())


def convert_csv_to_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType, compression: str = "zstd",
) -> DataFrame:
    """Convert and report: one row of both sizes and their ratio (0 for an empty result)."""
    write_parquet(read_csv(spark, csv_path, schema), parquet_path, compression=compression.lower())
    sizes = stored_bytes(spark, csv_path), stored_bytes(spark, parquet_path)
    return spark.createDataFrame(
        [(*sizes, sizes[0] / sizes[1] if sizes[1] else 0.0)],
        "csv_bytes long, parquet_bytes long, ratio double")


def create_sample(df: DataFrame, path: str, buildings: Sequence[int] = SAMPLE_BUILDINGS) -> None:
    """Extract the listed buildings, ordered over the files by building, meter and time."""
    (df.where(F.col("building_id").isin([int(b) for b in buildings]))
       .repartitionByRange(*IDENTIFIERS).sortWithinPartitions(*IDENTIFIERS)
       .write.option("compression", "zstd").parquet(path))
