"""Helpers of the registered queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, as sums of doubles differ in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def columns(found: dict) -> list:
    return [c.alias(name) for name, c in found.items()]
