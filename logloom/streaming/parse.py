"""The parse plan over a stream of files, with libraries read anew for each batch where that is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logloom.operators.extract import Options
from logloom.plans.parse import parse
from logloom.sources.library import Pattern, Rule, load_patterns, load_rules
from logloom.sources.lines import number_lines
from logloom.sources.sinks import as_json, error_entries


def parse_stream(lines: DataFrame, patterns: list[Pattern], rules: list[Rule] = (), options: Options = Options(), nested: int = 0) -> DataFrame:
    """The same plan as for a batch: it keeps no state."""
    return parse(lines, patterns, rules, options, nested)


def stream_to_jsonl(lines: DataFrame, patterns_path: str, output: str, checkpoint: str, rules_path: str = "", errors: str = "", options: Options = Options(), after: Callable[[DataFrame, int], None] | None = None, nested: int = 0) -> DataStreamWriter:
    """A writer that parses each batch with the libraries as they are then. A batch that is tried again overwrites its own folder.

    Lines of read_stream get their numbers within their file. A batch is parsed once, for events and errors. after: called with each
    batch's unmatched lines (value, path, line_no), e.g. to learn from them; nested: levels of inner lines to unwrap.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        numbered = number_lines(df) if "split_start" in df.columns else df
        parsed = parse(numbered, load_patterns(patterns_path), load_rules(rules_path) if rules_path else [], options, nested)
        # What is written of a line: its event as text, or itself.
        event = as_json(parsed.select("event.*", *[F.col(c).alias(f"_{c}") for c in ("value", "path", "line_no", "pattern_idx")]), options.tz, kept=("_value", "_path", "_line_no", "_pattern_idx"))
        event.persist()
        try:
            event.where("_pattern_idx IS NOT NULL").select("value").write.mode("overwrite").text(f"{output}/batch={number}")
            left = event.where("_pattern_idx IS NULL").select(F.col("_value").alias("value"), F.col("_path").alias("path"), F.col("_line_no").alias("line_no"))
            if errors:
                error_entries(left).write.mode("overwrite").json(f"{errors}/batch={number}")
            if after:
                after(left, number)
        finally:
            event.unpersist()
            df.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
