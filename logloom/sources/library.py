"""Pattern and rule libraries: YAML files of header patterns (stage 1) and of field rules (stage 2)."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields, replace

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger("logloom")

MERGED_SAMPLES = 500


@dataclass(frozen=True)
class Pattern:
    """A header pattern (Python syntax, named groups); the smaller priority is tried first."""

    name: str
    regex: str
    description: str = ""
    priority: int = 999
    extractor: str = "generic"
    format: str = ""
    sample: str = ""
    count: int = 0
    sample_logs: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Rule:
    """How a field is taken from the message of lines that the pattern `type` matches (all lines where it is empty)."""

    name: str
    field_name: str = ""
    type: str = ""
    format: str = ""
    extract_method: str = "regex"
    regex: str = ""
    kv_key: str = ""
    json_key: str = ""
    source: str = ""
    description: str = ""


def _read(path: str) -> list[dict]:
    if not os.path.exists(path):
        log.warning("no library at %s", path)
        return []
    with open(path, encoding="utf-8") as f:
        return (yaml.safe_load(f) or {}).get("patterns") or []


def _made(kind: type, entry: dict):
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k in known and v is not None})


def load_patterns(path: str) -> list[Pattern]:
    """Patterns by priority, equal ones in the order of the file; broken entries are reported and left out."""
    found = []
    for entry in _read(path):
        try:
            pattern = _made(Pattern, entry)
            re.compile(pattern.regex)
            found.append(replace(pattern, priority=int(pattern.priority)))
        except (TypeError, ValueError, re.error) as e:
            log.error("pattern %r left out: %s", entry.get("name"), e)
    return by_priority(found)


def load_rules(path: str) -> list[Rule]:
    """Rules in the order of the file; those that lack what their method needs are left out."""
    found = []
    for entry in _read(path):
        try:
            rule = _made(Rule, entry)
            rule = replace(rule, field_name=rule.field_name or rule.name)
            if rule.extract_method == "regex":
                if not rule.regex:
                    raise ValueError("no regex")
                re.compile(rule.regex)
            if rule.extract_method == "kv_parse" and not (rule.kv_key or rule.json_key):
                raise ValueError("no key")
            found.append(rule)
        except (TypeError, ValueError, re.error) as e:
            log.error("rule %r left out: %s", entry.get("name"), e)
    return found


def by_priority(patterns: Iterable[Pattern]) -> list[Pattern]:
    return sorted(patterns, key=lambda p: p.priority)


def save(path: str, entries: Iterable[Pattern | Rule], version: str, **metadata) -> None:
    """Write a library beside its place, then put it there at once."""
    kept = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(e).items() if v not in ("", 0, ())} for e in entries]
    held = {"metadata": {"version": version, **metadata}, "patterns": kept}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        yaml.safe_dump(held, f, allow_unicode=True, sort_keys=False, width=10_000)
    os.replace(f"{path}.tmp", path)


def add_pattern(patterns: list[Pattern], new: Pattern, path: str = "") -> list[Pattern]:
    """The library with `new` in place of its namesake, whose samples it inherits; written to `path` if that is given."""
    old = next((p for p in patterns if p.name == new.name), None)
    samples = dict.fromkeys([*(old.sample_logs if old else ()), *new.sample_logs])
    new = replace(new, sample_logs=tuple(samples)[:MERGED_SAMPLES])
    out = by_priority([*(p for p in patterns if p.name != new.name), new])
    if path:
        save(path, [replace(p, description="", count=0, sample_logs=()) for p in out], "1.0", total=len(out))
    return out


def next_names(existing: Iterable[Pattern], new: list[Pattern]) -> list[Pattern]:
    """New patterns named <format>_<three digits>, counting on from the largest number of each format."""
    largest: dict[str, int] = {}
    for p in existing:
        if m := re.fullmatch(r"(.+)_(\d+)", p.name):
            largest[m[1]] = max(largest.get(m[1], -1), int(m[2]))
    out = []
    for p in new:
        stem = p.format or "generic"
        largest[stem] = largest.get(stem, -1) + 1
        out.append(replace(p, name=f"{stem}_{largest[stem]:03d}"))
    return out


def merge_patterns(existing: list[Pattern], new: list[Pattern]) -> list[Pattern]:
    """Union by regex: an existing pattern keeps its name, format and priority, counts add up; by count, largest first."""
    counts = {p.regex: p for p in new}
    kept = [replace(p, count=p.count + counts[p.regex].count) if p.regex in counts else p for p in existing]
    held = {p.regex for p in existing}
    fresh = sorted((p for p in new if p.regex not in held), key=lambda p: -p.count)
    return sorted([*kept, *next_names(existing, fresh)], key=lambda p: -p.count)


def merge_rules(existing: list[Rule], new: list[Rule]) -> list[Rule]:
    """New rules replace those with the same field, type and format."""
    keys = {(r.field_name, r.type, r.format) for r in new}
    return [*(r for r in existing if (r.field_name, r.type, r.format) not in keys), *new]


def to_frame(spark: SparkSession, entries: list[Pattern] | list[Rule], kind: type = Pattern) -> DataFrame:
    """A library as a table, `ord` holding its order."""
    types = {"int": "int", "str": "string"}
    schema = ", ".join(f"`{f.name}` {types.get(f.type, 'array<string>')}" for f in fields(kind)) + ", ord int"
    rows = [(*(list(v) if isinstance(v, tuple) else v for v in asdict(e).values()), i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, schema)


NAMED = r"^(.+)_(\d+)$"


def largest_numbers(library: DataFrame) -> DataFrame:
    """(stem, largest): the largest number in the names <stem>_<number> of a library table."""
    stem, number = F.regexp_extract("name", NAMED, 1), F.regexp_extract("name", NAMED, 2).cast("int")
    return library.where(F.col("name").rlike(NAMED)).groupBy(stem.alias("stem")).agg(F.max(number).alias("largest"))


def merge_frames(existing: DataFrame, new: DataFrame) -> DataFrame:
    """merge_patterns for libraries kept as tables (regex, name, format, priority, count, ord); regexes are unique in each."""
    both = existing.alias("a").join(new.select("regex", F.col("count").alias("more")).alias("b"), "regex", "left")
    kept = both.select("regex", "name", "format", "priority", (F.col("count") + F.coalesce("more", F.lit(0))).alias("count"), F.lit(0).alias("side"), "ord")
    fresh = new.join(existing.select("regex"), "regex", "left_anti").withColumn("stem", F.coalesce(F.nullif("format", F.lit("")), F.lit("generic")))
    fresh = fresh.join(F.broadcast(largest_numbers(existing)), "stem", "left")  # a row for each format
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("count"), "ord"))
    name = F.format_string("%s_%03d", "stem", F.coalesce("largest", F.lit(-1)) + place)
    fresh = fresh.select("regex", name.alias("name"), "format", "priority", "count", F.lit(1).alias("side"), "ord")
    # A library is small: its order is a window over all of it.
    order = F.row_number().over(Window.orderBy(F.desc("count"), "side", "ord")) - 1
    return kept.unionByName(fresh).select("regex", "name", "format", "priority", "count", order.alias("ord"))


def upsert_frames(existing: DataFrame, new: DataFrame) -> DataFrame:
    """add_pattern for libraries kept as tables (name, regex, priority, sample_logs, ord): new ones replace their namesakes and inherit their samples; by priority."""
    old = existing.select("name", F.col("sample_logs").alias("held"))
    samples = F.slice(F.array_distinct(F.concat(F.coalesce("held", F.array().cast("array<string>")), "sample_logs")), 1, MERGED_SAMPLES)
    put = new.join(old, "name", "left").select("name", "regex", "priority", samples.alias("sample_logs"), F.lit(1).alias("side"), "ord")
    left = existing.join(new.select("name"), "name", "left_anti").select("name", "regex", "priority", "sample_logs", F.lit(0).alias("side"), "ord")
    order = F.row_number().over(Window.orderBy("priority", "side", "ord")) - 1
    return left.unionByName(put).select("name", "regex", "priority", "sample_logs", order.alias("ord"))


def merge_rule_frames(existing: DataFrame, new: DataFrame) -> DataFrame:
    """merge_rules over tables."""
    return existing.join(new, ["field_name", "type", "format"], "left_anti").unionByName(new)
