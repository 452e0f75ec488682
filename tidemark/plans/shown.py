"""What a query shows: doubles rounded to six places and whole numbers as longs, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(df: DataFrame, names: str) -> DataFrame:
    types = dict(df.dtypes)
    one = lambda c: F.round(c, 6).alias(c) if types[c] == "double" else F.col(c).cast("long").alias(c) if types[c] in ("int", "bigint", "smallint") else F.col(c)
    return df.select(*[one(c) for c in names.split()])


def picked(names: str, doubles: str, whole: str = "") -> str:
    """The select list of the same."""
    return ", ".join([*names.split(), *[f"round({c}, 6) AS {c}" for c in doubles.split()], *[f"{c}::BIGINT AS {c}" for c in whole.split()]])
