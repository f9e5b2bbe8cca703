"""Parquet tables of a data folder and the key rule they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that may surround a key, as one set of characters.
BLANKS = " \t\r\n\u00a0\u3000"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key_of(col: str | Column) -> Column:
    """A key without surrounding blanks, in lower case; a null or blank key becomes null, for it refers to nothing."""
    col = F.col(col) if isinstance(col, str) else col
    key = F.lower(F.btrim(col, F.lit(BLANKS)))
    return F.when(key != "", key)
