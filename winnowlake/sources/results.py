"""Result files: ``name \\t n \\t (doc,score) ...``, one query a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pairs(line: Column) -> Column:
    """The (doc_id, score) pairs of a line, in file order."""
    docs = F.regexp_extract_all(line, F.lit(r"\((-?\d+),(-?\d+)\)"), F.lit(1))
    score = F.regexp_extract_all(line, F.lit(r"\((-?\d+),(-?\d+)\)"), F.lit(2))
    return F.zip_with(docs, score, lambda d, s: F.struct(d.cast("long").alias("doc_id"), s.cast("long").alias("score")))


def parse(lines: DataFrame) -> DataFrame:
    """line_no, name, pairs from (line_no, line)."""
    return lines.select("line_no", F.split("line", "\\s")[0].alias("name"), pairs(F.col("line")).alias("pairs"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), line of a text file, or of several in the order of their names.

    A file is read in splits, each by a task of its own; a line's number is its place in the split
    and the number of lines in the splits before it. Only those counts meet in one task."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return rows.join(F.broadcast(base), ["file", "block"]).select((F.col("base") + F.col("at")).alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in the order of qid per range of queries."""
    lines.repartitionByRange("qid").sortWithinPartitions("qid").select("line").write.mode("overwrite").text(path)
