"""Libraries from lines: patterns, and rules with an annotator's help."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import numeric_kv
from logloom.functions.tokens import format_category, path_key, tokens
from logloom.operators import drain
from logloom.operators.match import group_column, match, with_all
from logloom.operators.rules import NUMERIC, build_rules, copied, guide_forms, message_groups, usable_mappings
from logloom.operators.semantics import LEAST_LINES, MOST_QUESTIONS, Annotator, annotated, preset
from logloom.sources.library import Pattern, Rule, load_patterns, load_rules, merge_patterns, merge_rules, save
from logloom.sources.lines import existing as existing_paths
from logloom.sources.lines import head, not_blank, read_lines

log = logging.getLogger("logloom")

SAMPLED_PATTERNS, SAMPLED_MESSAGES = 20, 6


def _provider(semantics: str, annotator: Annotator | None, templates: DataFrame) -> Callable | None:
    """What names header fields. An annotator is asked here, about the forms of the largest templates; workers get its answers."""
    if semantics == "none":
        return None
    if semantics == "annotator" and annotator:
        asked = templates.where(F.col("count") >= LEAST_LINES).orderBy("path", "first_line")
        return annotated(annotator, [drain.Template(list(r["tokens"]), list(r["seps"]), r["count"], list(r["samples"])) for r in unknown_forms(asked).collect()])
    return preset


def unknown_forms(templates: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """The first template of each header form, in the order of files and lines; more than can be asked about, as layouts answer many."""
    form = path_key(tokens(F.col("samples")[0]))
    own = F.struct("path", "first_line", "tokens", "seps", "count", "samples")
    firsts = templates.withColumn("form", form).groupBy("form").agg(F.min_by(own, F.struct("path", "first_line")).alias("t"))
    return firsts.select("t.*").orderBy("path", "first_line").limit(64 * most)


def learn(lines: DataFrame, existing: list[Pattern] = (), semantics: str = "preset", annotator: Annotator | None = None, max_lines: int | None = None, least: int = drain.LEAST_COUNT) -> list[Pattern]:
    """The library with what the lines of each file teach, file after file. semantics: none, preset or annotator."""
    return learn_with_report(lines, existing, semantics, annotator, max_lines, least)[0]


def learn_with_report(lines: DataFrame, existing: list[Pattern] = (), semantics: str = "preset", annotator: Annotator | None = None, max_lines: int | None = None, least: int = drain.LEAST_COUNT) -> tuple[list[Pattern], list[dict]]:
    """The library, and for each file its path, the numbers of its templates and patterns, and the size of the library after it."""
    library, report = list(existing), []
    templates = drain.learn_templates(not_blank(lines, max_lines)).persist(StorageLevel.DISK_ONLY)
    try:
        counts = dict(templates.groupBy("path").count().collect())
        by_file = drain.collect_groups(drain.regroup(templates, _provider(semantics, annotator, templates)))
    finally:
        templates.unpersist()
    patterns = {path: drain.to_patterns(by_file[path], least) for path in sorted(by_file)}
    for path, own in _categorised(lines.sparkSession, patterns).items():
        library = merge_patterns(library, own)
        report.append({"path": path, "templates": counts[path], "patterns": len(own), "library": len(library)})
    return library, report


def _categorised(spark: SparkSession, patterns: dict[str, list[Pattern]]) -> dict[str, list[Pattern]]:
    """The patterns of all files with the format category of their samples, which are read in one go."""
    every = [(path, i, p.sample) for path, own in patterns.items() for i, p in enumerate(own)]
    if not every:
        return patterns
    frame = spark.createDataFrame(every, "path string, i int, sample string")
    found = {(r["path"], r["i"]): r["category"] for r in frame.select("path", "i", format_category(F.col("sample")).alias("category")).collect()}
    return {path: [Pattern(**{**p.__dict__, "format": found[path, i]}) for i, p in enumerate(own)] for path, own in patterns.items()}


def learn_to_file(lines: DataFrame, path: str, **options) -> list[Pattern]:
    library = learn(lines, load_patterns(path), **options)
    save(path, library, "1.1", total=len(library))
    return library


def learn_files(spark: SparkSession, paths: list[str], output: str, **options) -> list[dict]:
    """Learn from files into a library file, and the report on each. Files that are not there are skipped; if learning fails, it is tried file by file, and what fails is skipped."""
    there = existing_paths(spark, paths)
    if not there:
        return []
    try:
        library, report = learn_with_report(read_lines(spark, there), load_patterns(output), **options)
    except Exception:
        log.warning("learning from all files failed, trying each", exc_info=True)
        library, report = load_patterns(output), []
        for path in there:
            try:
                library, own = learn_with_report(read_lines(spark, path), library, **options)
                report += own
            except Exception as e:
                log.warning("skipped, learning failed: %s: %s", path, e)
                report.append({"path": path, "templates": 0, "patterns": 0, "library": len(library), "failed": str(e).split("\n")[0][:200]})
    save(output, library, "1.1", total=len(library))
    return report


def rebuild_rules(lines: DataFrame, patterns: list[Pattern], annotator: Annotator, existing: list[Rule] | None = None) -> list[Rule]:
    return rebuild_with_report(lines, patterns, annotator, existing)[0]


def file_samples(lines: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(path, known, position, message, line_no): of each file the numbers of the patterns that match in its head, and the first messages of the first of these.

    One plan for all files: known patterns by grouping on the file; a line's pattern is the first known one of its file that matches.
    """
    hits = with_all(lines, patterns)
    known = head(hits).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("known"))
    number = F.try_element_at(F.array_intersect("hits", "known"), F.lit(1))
    matched = hits.join(known, "path").withColumn("pattern_idx", number)
    matched = matched.withColumns({"message": group_column(patterns, "message"), "position": F.array_position("known", F.col("pattern_idx"))})
    order = Window.partitionBy("path", "position").orderBy("line_no")
    some = matched.where(F.col("message").isNotNull() & F.col("position").between(1, SAMPLED_PATTERNS)).select("path", "position", "message", "line_no")
    some = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLED_MESSAGES).drop("n")
    return known.join(some, "path", "left")


def rebuild_with_report(lines: DataFrame, patterns: list[Pattern], annotator: Annotator, existing: list[Rule] | None = None) -> tuple[list[Rule], list[dict]]:
    """Rules for the patterns of each file, from an annotator's mappings of sample messages, merged with existing ones if given; and each file's numbers of patterns and rules.

    Spark runs the same few jobs for any number of files. The driver gets what the annotator is asked about: some messages of each file.
    """
    new: list[Rule] = []
    report: list[dict] = []
    samples = file_samples(lines, patterns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = {r["path"]: r["known"] for r in samples.select("path", "known").distinct().collect()}
        messages = samples.where("message IS NOT NULL")
        verdicts = {r["path"]: r["verdict"] for r in guide_forms(messages, by=("path",)).collect()}
        order = Window.partitionBy("path").orderBy("line_no")
        firsts = messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLED_MESSAGES)
        asked: dict[str, list[list[str]]] = {}
        for r in firsts.orderBy("path", "line_no").collect():
            asked.setdefault(r["path"], [[]])[0].append(r["message"])
        mixed: dict[str, list[list[str]]] = {}
        for r in message_groups(messages, by=("path",)).orderBy("path", "rank").collect():
            mixed.setdefault(r["path"], []).append(r["samples"])
        asked |= {path: groups for path, groups in mixed.items() if verdicts[path] != "stable"}
        mappings = {path: [m for group in asked.get(path, []) for m in annotator.field_mappings(group)] for path in sorted(known) if known[path]}
        keys = sorted({m["kv_key"] for own in mappings.values() for m in own if m.get("kv_key") and m.get("field_name") in NUMERIC})
        # Whether each key of a numeric field has a number in the messages of each file.
        numbers = {r["path"]: r for r in messages.groupBy("path").agg(F.count("*").alias("n"), *[F.max(numeric_kv(F.col("message"), k)).alias(f"k{i}") for i, k in enumerate(keys)]).collect()} if keys else {}
    finally:
        samples.unpersist()
    for number, path in enumerate(sorted(known)):
        own, tag = [patterns[i] for i in known[path]], f"src{number + 1}"
        if not own:
            log.info("%s: no pattern matches its head", path)
            report.append({"path": path, "patterns": 0, "rules": 0})
            continue
        rules = build_rules("", usable_mappings(mappings[path], has_number=lambda key, path=path: path in numbers and numbers[path][f"k{keys.index(key)}"]), tag)
        new += copied(rules, own, tag)
        report.append({"path": path, "patterns": len(own), "rules": len(rules)})
        log.info("%s: %d patterns, %d rules", path, len(own), len(rules))
    return (new if existing is None else merge_rules(existing, new)), report


def rebuild_to_file(lines: DataFrame, patterns: list[Pattern], annotator: Annotator, path: str, merge: bool = True) -> list[Rule]:
    rules = rebuild_rules(lines, patterns, annotator, load_rules(path) if merge and os.path.exists(path) else None)
    save(path, rules, "2.1", total=len(rules))
    return rules


def failing_samples(pattern: Pattern, samples: DataFrame) -> int:
    """How many of the sample lines (value) a pattern does not match."""
    return match(samples, [pattern]).agg(F.count_if(F.col("pattern_idx").isNull())).first()[0]
