"""Numeric facts by company and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_facts(facts: DataFrame, data_points: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """(ticker, data_point, series): the values as an array of (year, value) by year.

    `facts` has one row per ticker, data point and year, so a series is as long as its years.
    """
    rows = facts
    if data_points:
        rows = rows.filter(F.col("data_point").isin(data_points))
    if years:
        rows = rows.filter(F.col("year").isin(years))
    return rows.groupBy("ticker", "data_point").agg(
        F.array_sort(F.collect_list(F.struct("year", "value"))).alias("series")
    )


def yoy_trend(facts: DataFrame) -> DataFrame:
    """Percent change to the previous point of every series.

    Adds previous_year, previous_value, pct_change (two decimals; null without a previous
    point or when it is 0) and is_latest.
    """
    by_year = Window.partitionBy("ticker", "data_point").orderBy("year")
    newest = Window.partitionBy("ticker", "data_point").orderBy(F.desc("year"))
    value = F.col("value").cast("double")
    before = F.lag(value).over(by_year)
    return facts.select(
        "ticker", "data_point", "year", "value",
        F.lag("year").over(by_year).alias("previous_year"),
        F.lag("value").over(by_year).alias("previous_value"),
        F.round(F.try_divide(value - before, before) * 100, 2).alias("pct_change"),
        (F.row_number().over(newest) == 1).alias("is_latest"),
    )


def trend_text(trends: DataFrame) -> DataFrame:
    """(ticker, data_point, message) for the latest point of every series."""
    latest = trends.filter("is_latest")
    change = F.concat(
        F.lit("Placeholder: "), "data_point", F.lit(" changed by "), F.format_string("%.2f", "pct_change"),
        F.lit("% between "), F.col("previous_year").cast("string"), F.lit(" and "), F.col("year").cast("string"),
        F.lit("."),
    )
    message = (
        F.when(F.col("previous_year").isNull(), F.lit("Need at least two data points to calculate trend."))
        .when(F.col("pct_change").isNull(), F.lit("Could not calculate trend: division by zero"))
        .otherwise(change)
    )
    return latest.select("ticker", "data_point", message.alias("message"))
