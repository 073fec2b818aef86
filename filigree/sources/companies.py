"""Company dimension and the lists shown to a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import rules as R
from filigree.functions.text import company_label
from filigree.schemas import COMPANIES


def companies_dim(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or R.COMPANIES, COMPANIES)


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(R.DISPLAY_NAMES.items()), "ticker string, display string")


def list_companies(chunks: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """(ticker, name) of the companies that have chunks; the dimension's name wins."""
    # Distinct first: hashed without a sort, and all that is left to sort is one row per name.
    seen = chunks.select("ticker", "company").distinct().groupBy("ticker").agg(F.min("company").alias("company"))
    if companies is None:
        return seen.select("ticker", F.coalesce("company", "ticker").alias("name"))
    named = companies.groupBy("ticker").agg(F.min("name").alias("name"))
    return seen.join(named, "ticker", "left").select("ticker", F.coalesce("name", "company", "ticker").alias("name"))


def company_display_name(df: DataFrame, names: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Add `display_name`: the friendly name, or the ticker itself when it is not known."""
    lookup = names.groupBy(F.col("ticker").alias("_t")).agg(F.min("display").alias("_d"))
    joined = df.join(lookup, F.col(ticker) == F.col("_t"), "left")
    return joined.withColumn("display_name", F.coalesce("_d", ticker)).drop("_t", "_d")


def search_companies(companies: DataFrame, text: str) -> DataFrame:
    """Companies whose label contains the typed text, any case."""
    labelled = companies.withColumn("label", company_label(F.col("name"), F.col("ticker")))
    return labelled.filter(F.contains(F.lower("label"), F.lit(text.lower())))


def selectable_company(selections: DataFrame, companies: DataFrame) -> DataFrame:
    """Selections whose ticker is on the list."""
    return selections.join(companies.select("ticker"), "ticker", "left_semi")
