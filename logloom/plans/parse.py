"""Lines to events."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.extract import Options, add_records
from logloom.operators.nested import with_nested
from logloom.sources.library import Pattern, Rule
from logloom.sources.lines import not_empty

from .schema import event


def parse(lines: DataFrame, patterns: list[Pattern], rules: list[Rule] = (), options: Options = Options(), nested: int = 0, fields: Collection[str] | None = None) -> DataFrame:
    """All non-empty lines with pattern_idx, pattern_name and event (a struct; NULL where no pattern matches).

    The same plan runs over batches and streams: no shuffle, no state. nested: levels of inner lines to unwrap. fields: those
    of the event that are asked for; a struct is built whole, so with fewer of them a query evaluates less.
    """
    df = add_records(not_empty(lines), patterns, list(rules), options)
    inner = None
    if nested:
        df = with_nested(df, patterns, list(rules), options, levels=nested)
        inner = F.col("_nested_nested")
    return df.select(*lines.columns, "pattern_idx", F.col("record_pattern_name").alias("pattern_name"), F.col("record_extra").alias("extra"), event("record", "value", options, inner, fields).alias("event"))


def events(parsed: DataFrame) -> DataFrame:
    """The events alone."""
    return parsed.where("pattern_idx IS NOT NULL").select("event.*")


def unmatched(parsed: DataFrame) -> DataFrame:
    return parsed.where("pattern_idx IS NULL")
