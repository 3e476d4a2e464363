"""Writers of events and of lines that no pattern matches, and the counts of a run."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp_text(value: Column, tz: str) -> Column:
    """A timestamp on the clock of `tz` with its offset, with microseconds where there are any."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(value, F.current_timezone()), tz)
    micros = F.date_format(local, "SSSSSS")
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(value)) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, STAMP), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), offset)


def as_json(events: DataFrame, tz: str = "Asia/Shanghai", kept: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text (`value`) for each event; optional fields that are missing are left out. kept: columns that stay beside it."""
    columns = [stamp_text(F.col(f.name), tz).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in events.schema if f.name not in kept]
    return events.select(F.to_json(F.struct(*columns)).alias("value"), *kept)


def write_jsonl(events: DataFrame, folder: str, tz: str = "Asia/Shanghai") -> None:
    as_json(events, tz).write.mode("overwrite").text(folder)


def write_json_array(events: DataFrame, path: str, tz: str = "Asia/Shanghai") -> None:
    """One indented JSON array in a file of any file system that Spark writes to.

    Tasks write their events side by side into a folder beside it, with commas between them; the parts, in their order, are then put behind
    each other as bytes, by the file system and not row by row. Only the last line of an event is a closing brace without a margin (see `read_json_array`).
    """
    spark = events.sparkSession

    @F.pandas_udf("string")
    def indented(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(found, ensure_ascii=False, indent=2) if (found := json.loads(v)) else "{\n}")

    # The lower 33 bits of the id number the rows of a task.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    numbered = as_json(events, tz).select("value", first.alias("first"))
    texts = numbered.select(F.concat(F.when(F.col("first"), "").otherwise(","), F.when(F.col("first"), "").otherwise("\n"), indented("value")).alias("value"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    texts.write.option("lineSep", "\u0020").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    try:
        found = sorted((s.getPath().getName(), s.getLen()) for s in folder.getFileSystem(conf).listStatus(folder))
        put = lambda text: out.write(bytearray(text.encode()))
        out = files.create(target, True)
        separator = "[\n"
        for name in [name for name, size in found if name.startswith("part-") and size]:
            put(separator)
            separator = ",\n"
            part = files.open(hadoop.fs.Path(folder, name))
            hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        put("[]" if separator == "[\n" else "\n]")
        out.close()
    finally:
        files.delete(folder, True)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of an array that `write_json_array` wrote, by many tasks: a file is split at the ends of events, so none reads it whole."""
    held = spark.read.option("lineSep", "\n}").text(path).select(F.regexp_replace("value", r"^[\s,\[]+", "").alias("value"))
    return held.where(F.col("value").startswith("{")).select(F.from_json(F.concat("value", F.lit("\n}")), schema).alias("event")).select("event.*")


def error_entries(unmatched: DataFrame) -> DataFrame:
    meta = F.struct(F.lit("no_pattern_matched").alias("reason"), F.col("line_no")).alias("_meta")
    return unmatched.select(meta, F.col("value").alias("raw"))


def write_errors(unmatched: DataFrame, folder: str) -> None:
    error_entries(unmatched).select(F.to_json(F.struct("_meta", "raw")).alias("value")).write.mode("overwrite").text(folder)


def observed(matched: DataFrame, name: str = "parse") -> tuple[DataFrame, Observation]:
    """The same rows; the observation gets total, matched and unmatched counts while they are written."""
    seen = Observation(name)
    return matched.observe(seen, F.count(F.lit(1)).alias("total"), F.count("pattern_idx").alias("matched"), F.count_if(F.col("pattern_idx").isNull()).alias("unmatched")), seen
