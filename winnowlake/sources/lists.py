"""Lists of file names, and which arguments are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def names(text: str) -> list[str]:
    """The white-space separated names of a list; a name's place is its document id."""
    return text.split()


def is_list(inputs: list[str]) -> bool:
    """Whether inputs are one list file, for building and for querying alike."""
    return len(inputs) == 1 and inputs[0].endswith(".list")


def resolve(spark: SparkSession, inputs: list[str]) -> list[str]:
    if not is_list(inputs):
        return inputs
    return names(spark.read.text(inputs[0], wholetext=True).first()[0])


def frame(texts: DataFrame, column: str = "value") -> DataFrame:
    """doc_id, uri from a one-row DataFrame that holds a list's text."""
    trimmed = F.regexp_replace(column, r"^\s+|\s+$", "")
    parts = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    return texts.select(F.posexplode(parts).alias("doc_id", "uri"))
