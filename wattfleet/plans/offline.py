"""From the three raw sources to the table models train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from wattfleet.operators import cleaning, features


def merged_table(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    return cleaning.merge_sources(readings, buildings, cleaning.fill_weather(weather))


def merged_with_fill(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> tuple[DataFrame, Column]:
    """The merged table and its temperature median, which is found without merging a second time."""
    filled = cleaning.fill_weather(weather)
    return cleaning.merge_sources(readings, buildings, filled), features.joined_median(readings, buildings, filled)


def build_features(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    """Features of readings that already are one row per series and hour."""
    merged, fill = merged_with_fill(readings, buildings, weather)
    return features.feature_table(merged, temperature_fill=fill)


def build_model_table(readings: DataFrame, buildings: DataFrame, weather: DataFrame, quantile_cutoff: float = 0.999) -> DataFrame:
    """Outlier cut, join, features, and only the rows a model can learn from."""
    kept = cleaning.filter_outliers(readings, quantile_cutoff=quantile_cutoff)
    return features.model_table(build_features(kept, buildings, weather))
