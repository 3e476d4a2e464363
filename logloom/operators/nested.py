"""Syslog lines inside syslog lines: forwarded originals are parsed like outer lines, two levels deep at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.plans.schema import event
from logloom.sources.library import Pattern, Rule

from .extract import Options, add_records
from .match import match

CANDIDATES = ("original_data", "message_content")


def candidates(record: str) -> Column:
    """The distinct texts of a record that look like whole lines, two at most."""
    texts = F.array_distinct(F.array_compact(F.array(*[F.col(f"{record}_{c}") for c in CANDIDATES])))
    return F.slice(F.filter(texts, S.nested_shape), 1, 2)


def with_nested(df: DataFrame, patterns: list[Pattern], rules: list[Rule], options: Options, record: str = "record", prefix: str = "_nested_", levels: int = 1) -> DataFrame:
    """The rows with <prefix>nested: the JSON of the inner events (one object, or a list of two), NULL where there is none.

    An inner line is stripped; one that nothing matches is tried once more with its white space made single spaces, and is shown like that.
    """
    names = []
    for k in range(2):
        own = f"{prefix}{k}"
        line, flat = F.col(f"{own}line"), F.col(f"{own}flat")
        df = df.withColumn(f"{own}line", S.stripped(F.try_element_at(candidates(record), F.lit(k + 1))))
        df = df.withColumn(f"{own}flat", F.regexp_replace(line, r"(?U)\s+", " "))
        df = match(df, patterns, f"{own}line", f"{own}first")
        again = F.col(f"{own}firstpattern_idx").isNull() & (line != flat)
        df = df.withColumn(f"{own}text", F.when(again, flat).otherwise(line))
        df = match(df.withColumn(f"{own}again", F.when(again, flat)), patterns, f"{own}again", f"{own}again")
        # The groups of Python patterns are those of the text that matched.
        kept = [c.removeprefix(f"_{own}first") for c in df.columns if c.startswith(f"_{own}firstpy")]
        df = df.withColumns({f"_{own}{c}": F.when(again, F.col(f"_{own}again{c}")).otherwise(F.col(f"_{own}first{c}")) for c in kept})
        df = df.withColumn(f"{own}pattern_idx", F.coalesce(f"{own}firstpattern_idx", f"{own}againpattern_idx"))
        df = add_records(df, patterns, rules, options, f"{own}text", own)
        inner = None
        if levels > 1:
            df = with_nested(df, patterns, rules, options, f"{own}record", f"{own}_", levels - 1)
            inner = F.col(f"{own}_nested")
        df = df.withColumn(f"{own}event", F.to_json(event(f"{own}record", f"{own}text", options, inner)))
        names.append(f"{own}event")
    both = F.array_compact(F.array(*names))
    nested = F.when(F.size(both) == 1, both[0]).when(F.size(both) == 2, F.concat(F.lit("["), F.array_join(both, ","), F.lit("]")))
    return df.withColumn(f"{prefix}nested", nested).drop(*[c for c in df.columns if c.startswith((f"{prefix}0", f"{prefix}1", f"_{prefix}"))])
