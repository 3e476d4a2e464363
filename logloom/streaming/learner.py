"""Learning from a stream: lines without a pattern are gathered for each file, and a learner is called once there are enough of them, or no more come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.match import match
from logloom.plans.learn import learn
from logloom.settings import Settings
from logloom.sources.library import load_patterns, save

GROUPS = "path string, reason string, first long, lines array<string>"


def gathered(lines: DataFrame, after_lines: int = Settings.learn_after_lines, idle_seconds: float = Settings.learn_after_idle_seconds) -> DataFrame:
    """(path, reason, first, lines) of a stream of unmatched lines (value, path): groups of `after_lines` lines (reason `enough`), or what
    is there when no line has come for `idle_seconds` (reason `idle`). first: how many lines of the file came before the group.

    The state of a file holds fewer than `after_lines` lines and a number, whatever its length.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        held = list(held)

        def group(reason: str) -> pd.DataFrame:
            return pd.DataFrame({"path": [key[0]], "reason": [reason], "first": [seen - len(held)], "lines": [held.copy()]})

        if state.hasTimedOut:
            if held:
                yield group("idle")
            state.update(([], seen))
            return
        for frame in frames:
            for line in frame["value"]:
                held.append(line)
                seen += 1
                if len(held) == after_lines:
                    yield group("enough")
                    held.clear()
        state.update((held, seen))
        if held:
            state.setTimeoutDuration(max(1, int(idle_seconds * 1000)))

    narrow = lines.select("path", "value").groupBy("path")
    return narrow.applyInPandasWithState(run, GROUPS, "held array<string>, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def learner_of(patterns_path: str, **options) -> Callable[[DataFrame, int], None]:
    """What to do with each batch of gathered groups: learn from them, and save what comes of it in the library, for streams that read it anew.

    Lines that the library matches by then are left out. options: those of `learn`.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            if df.isEmpty():
                return
            lines = df.select("path", "first", F.posexplode("lines").alias("at", "value")).select("value", "path", (F.col("first") + F.col("at") + 1).alias("line_no"))
            held = load_patterns(patterns_path)
            left = match(lines, held).where("pattern_idx IS NULL").select("value", "path", "line_no") if held else lines
            if not left.isEmpty():
                library = learn(left, held, **options)
                save(patterns_path, library, "1.1", total=len(library))
        finally:
            df.unpersist()

    return batch


def learn_from(groups: DataFrame, patterns_path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer that learns from gathered groups as they come (see `learner_of`)."""
    return groups.writeStream.foreachBatch(learner_of(patterns_path, **options)).option("checkpointLocation", checkpoint)
