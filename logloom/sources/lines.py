"""Lines of log files, as batch and as stream."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger("logloom")

HEAD_LINES = 300
LINE_SCHEMA = "value string, path string, line_no long"


def existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths (or globs of paths) that there are, in any file system that Spark reads; the others are named in the log."""
    found, conf = [], spark._jsc.hadoopConfiguration()
    for path in [paths] if isinstance(paths, str) else paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(conf).globStatus(there):
            found.append(path)
        else:
            log.warning("skipped, not there: %s", path)
    return found


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, numbered: bool = True) -> DataFrame:
    """(value, path, line_no): bad bytes replaced, line ends of any kind dropped, numbers from 1 within each file.

    Numbers are row numbers in the order of the splits of a file: one narrow shuffle-free pass counts the lines of each
    split, the other adds up; both read the files in the same splits, as these depend on the files and the session alone. Without
    `numbered`, line_no is NULL and nothing is counted. Paths that are not there are skipped, with a word in the log.
    """
    paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    reader = spark.read.option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(paths)
    value = F.make_valid_utf8("value").alias("value")
    if not numbered:
        return text.select(value, F.col("_metadata.file_path").alias("path"), F.lit(None).cast("long").alias("line_no"))
    return number_lines(text.select(value, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start")))


def number_lines(split: DataFrame) -> DataFrame:
    """(value, path, line_no) of lines (value, path, split_start): numbers from 1 within each file.

    A split is a range of bytes of one file; within it lines come in order.
    """
    split = split.withColumn("at", F.monotonically_increasing_id())
    bounds = split.groupBy("path", "split_start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounds.select("path", "split_start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = split.join(F.broadcast(offsets) if offsets.count() <= 100_000 else offsets, ["path", "split_start"])
    return joined.select("value", "path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"))


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The lines of files as they arrive in a folder: (value, path, line_no, split_start). line_no is NULL until a batch is numbered (`number_lines`), as a whole file comes in one batch."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    names = {"path": F.col("_metadata.file_path"), "line_no": F.lit(None).cast("long"), "split_start": F.col("_metadata.file_block_start")}
    return reader.load(path).select(F.make_valid_utf8("value").alias("value"), *[column.alias(name) for name, column in names.items()])


def not_empty(lines: DataFrame) -> DataFrame:
    """Without empty lines; lines of white space stay."""
    return lines.where(F.length("value") > 0)


def not_blank(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Lines for learning: stripped, without blank ones, the first `most` of each file."""
    lines = lines.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).where("value <> ''")
    if most is None:
        return lines
    order = Window.partitionBy("path").orderBy("line_no")
    return lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def head(lines: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    return lines.where(F.col("line_no") <= n)


def message_samples(matched: DataFrame, n: int = 6) -> DataFrame:
    """(pattern_name, message): the first n messages of each pattern, in the order of lines."""
    order = Window.partitionBy("pattern_name").orderBy("path", "line_no")
    numbered = matched.where("message IS NOT NULL").withColumn("_n", F.row_number().over(order))
    return numbered.where(F.col("_n") <= n).select("pattern_name", "message", "path", "line_no")
