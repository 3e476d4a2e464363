"""First match of lines against a pattern library."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.regex import JavaPattern, translate
from logloom.functions.scalars import filled
from logloom.sources.library import Pattern

from .literals import candidates, literal


def python_groups(source: str, anchored: bool = True):
    """All groups of a match, from the start of the text if it is anchored, as an array; NULL without a match."""

    @F.pandas_udf("array<string>")
    def groups(values):
        compiled = re.compile(source)
        look = compiled.match if anchored else compiled.search
        found = (None if v is None else look(v) for v in values)
        return values.__class__([None if m is None else [m.group(i) for i in range(compiled.groups + 1)] for m in found])

    return groups


#: What parts the groups of a match in one text. A line that holds it has its groups read one by one.
PART = "\ue000\ue001"


#: Libraries of more patterns are searched by the index of their literal texts, and looked up in arrays: their plan has one size.
CHAINED = 16


def first_of(patterns: list[Pattern], text: Column, python: Callable[[int], Column] | None = None) -> Column:
    """The number of the first pattern that matches the text from its start, or NULL: a small library is one flat chain, tried in order until one matches."""
    java = [translate(p.regex) for p in patterns]
    if len(patterns) > CHAINED:
        own = [i for i, j in enumerate(java) if not j.python_only]
        sources, numbers = literal([java[i].java for i in own], "array<string>"), literal(own, "array<int>")
        hits = F.filter(candidates(text, [patterns[i].regex for i in own]), lambda k: F.rlike(text, F.element_at(sources, k + 1)))
        found = [F.element_at(numbers, F.try_element_at(hits, F.lit(1)) + 1)] + [F.when(python(i).isNotNull(), F.lit(i)) for i, j in enumerate(java) if j.python_only]
        return F.least(*found, F.lit(None).cast("int"))
    chain = None
    for i, j in enumerate(java):
        hit = python(i).isNotNull() if j.python_only else text.rlike(j.java)
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return F.lit(None).cast("int") if chain is None else chain


def match(lines: DataFrame, patterns: list[Pattern], text: str = "value", prefix: str = "") -> DataFrame:
    """The lines with <prefix>pattern_idx, the number of the first pattern that matches from the start, or NULL.

    Python is used only for patterns that Java cannot evaluate, on lines that no earlier pattern matches; their groups are kept in a
    column of their own.
    """
    slow = [i for i, p in enumerate(patterns) if translate(p.regex).python_only]
    if not slow:
        return lines.withColumn(f"{prefix}pattern_idx", first_of(patterns, F.col(text)))
    fast = [i for i in range(len(patterns)) if i not in slow]
    number = F.element_at(literal(fast, "array<int>"), first_of([patterns[i] for i in fast], F.col(text)) + 1)
    out = lines.withColumn(f"_{prefix}java", number)
    left = lambda i: F.col(f"_{prefix}java").isNull() | (F.col(f"_{prefix}java") > i)
    out = out.withColumns({f"_{prefix}py{i}": python_groups(patterns[i].regex)(F.when(left(i), F.col(text))) for i in slow})
    hits = [F.when(F.col(f"_{prefix}py{i}").isNotNull(), F.lit(i)) for i in slow]
    return out.withColumn(f"{prefix}pattern_idx", F.least(F.col(f"_{prefix}java"), *hits)).drop(f"_{prefix}java")


def all_of(patterns: list[Pattern], text: Column, python: Callable[[int], Column]) -> Column:
    """The numbers of all patterns that match the text from its start, in order."""
    java = [translate(p.regex) for p in patterns]
    own = [i for i, j in enumerate(java) if not j.python_only]
    slow = [F.when(python(i).isNotNull(), F.lit(i)) for i, j in enumerate(java) if j.python_only]
    if len(patterns) > CHAINED:
        sources, numbers = literal([java[i].java for i in own], "array<string>"), literal(own, "array<int>")
        hits = F.filter(candidates(text, [patterns[i].regex for i in own]), lambda k: F.rlike(text, F.element_at(sources, k + 1)))
        fast = F.transform(hits, lambda k: F.element_at(numbers, k + 1))
    else:
        fast = F.array_compact(F.array(*[F.when(text.rlike(java[i].java), F.lit(i)) for i in own], F.lit(None).cast("int")))
    return F.array_sort(F.concat(fast, F.array_compact(F.array(*slow, F.lit(None).cast("int")))))


def with_all(lines: DataFrame, patterns: list[Pattern], text: str = "value") -> DataFrame:
    """The lines with `hits`, the numbers of all patterns that match, and what `match_groups` needs of patterns that only Python can evaluate."""
    slow = {f"_py{i}": python_groups(p.regex)(F.col(text)) for i, p in enumerate(patterns) if translate(p.regex).python_only}
    out = lines.withColumns(slow) if slow else lines
    return out.withColumn("hits", all_of(patterns, F.col(text), lambda i: F.col(f"_py{i}")))


def match_groups(patterns: list[Pattern], text: str = "value", prefix: str = "") -> Column:
    """All groups of the pattern that matched, as an array of texts: its pattern is evaluated once, whatever the number of fields."""
    line, index, chain = F.col(text), F.col(f"{prefix}pattern_idx"), None
    java: list[JavaPattern] = [translate(p.regex) for p in patterns]
    parted = lambda n: PART.join(f"${k}" for k in range(1, n + 1))
    if large := len(patterns) > CHAINED:
        source, number = (F.element_at(literal(x, kind), index + 1) for x, kind in (([j.java for j in java], "array<string>"), ([j.n_groups for j in java], "array<int>")))
        whole = F.regexp_replace(line, F.concat(source, F.lit(r"(?s:.*)\z")), F.element_at(literal([parted(j.n_groups) for j in java], "array<string>"), index + 1))
        one_by_one = F.transform(F.sequence(F.lit(1), number), lambda k: F.call_function("regexp_extract", line, source, k))
        chain = F.when(number > 0, F.when(line.contains(PART), one_by_one).otherwise(F.split(whole, PART, -1)))
    for i, (p, j) in enumerate(zip(patterns, java, strict=True)):
        if not j.groups or (large and not j.python_only):
            continue
        if j.python_only:
            got = F.slice(F.col(f"_{prefix}py{i}"), 2, j.n_groups)
        else:
            whole = F.regexp_replace(line, j.java + r"(?s:.*)\z", parted(j.n_groups))
            one_by_one = F.array(*[F.regexp_extract(line, j.java, n) for n in range(1, j.n_groups + 1)])
            got = F.when(line.contains(PART), one_by_one).otherwise(F.split(whole, PART, -1))
        if large:
            chain = F.when(index == i, got).otherwise(chain)
        else:
            chain = F.when(index == i, got) if chain is None else chain.when(index == i, got)
    return F.lit(None).cast("array<string>") if chain is None else chain


def _numbers(patterns: list[Pattern], name: str) -> list[int]:
    return [translate(p.regex).groups.get(name, 0) for p in patterns]


def group_column(patterns: list[Pattern], name: str, text: str = "value", prefix: str = "", groups: Column | None = None) -> Column:
    """The text of the named group in the pattern that matched; NULL where it has no such group or the group is empty. groups: match_groups, where it is a column already."""
    numbers = _numbers(patterns, name)
    if not any(numbers):
        return F.lit(None).cast("string")
    groups = match_groups(patterns, text, prefix) if groups is None else groups
    if len(set(numbers)) == 1:
        return filled(F.try_element_at(groups, F.lit(numbers[0])))
    at = F.try_element_at(literal(numbers, "array<int>"), F.col(f"{prefix}pattern_idx") + 1)
    return F.when(at > 0, filled(F.try_element_at(groups, at)))


def by_pattern(patterns: list[Pattern], value, prefix: str = "") -> Column:
    """A text that each pattern has, for the pattern that matched."""
    return F.try_element_at(literal([value(p) for p in patterns], "array<string>"), F.col(f"{prefix}pattern_idx") + 1)


def match_join(lines: DataFrame, library: DataFrame) -> DataFrame:
    """The same as a join with a library table (java, priority, ord, name), for SQL access; the chain is the fast way."""
    hits = lines.join(F.broadcast(library), F.expr("rlike(value, java)"))
    best = hits.groupBy("path", "line_no").agg(F.min_by("name", F.struct("priority", "ord")).alias("pattern_name"))
    return lines.join(best, ["path", "line_no"], "left")


def statistics(matched: DataFrame) -> DataFrame:
    """(total, matched, unmatched, rate)."""
    total, hit = F.count("*"), F.count("pattern_idx")
    return matched.agg(total.alias("total"), hit.alias("matched"), (total - hit).alias("unmatched"), (hit / F.nullif(total, F.lit(0))).alias("rate"))


def files_with_match(lines: DataFrame, pattern: Pattern, n: int = 300) -> DataFrame:
    """(path): files one of whose first n lines the pattern matches."""
    return lines.where(F.col("line_no") <= n).where(F.col("value").rlike(translate(pattern.regex).java)).select("path").distinct()
