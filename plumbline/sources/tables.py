"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters chosen later are pushed to the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def instant(text: Column) -> Column:
    """The instant of an ISO text, with or without fraction and offset; null where there is none."""
    return F.try_to_timestamp(F.trim(text))
