"""Command line: transform lines to events, learn a pattern library from files, rebuild field rules."""

from __future__ import annotations

import argparse
import importlib
import os
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.extract import Options
from logloom.operators.semantics import Annotator
from logloom.plans.learn import learn_files, rebuild_with_report
from logloom.plans.parse import parse
from logloom.settings import Settings
from logloom.sources.library import load_patterns, load_rules, save
from logloom.sources.lines import read_lines
from logloom.sources.sinks import as_json, error_entries, observed, write_json_array


def _files(own: argparse.Namespace) -> list[str]:
    return [*own.files, *([f"{own.dir.rstrip('/')}/*.log"] if own.dir else [])]


def _annotator(name: str, enabled: bool) -> Annotator | None:
    """What package.module:name gives when it is called."""
    if not name or not enabled:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    settings = Settings.read()
    parser = argparse.ArgumentParser(prog="logloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    t = commands.add_parser("transform", help="lines to events")
    t.add_argument("-i", "--input", required=True, nargs="+")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-e", "--errors")
    t.add_argument("-p", "--patterns", default=settings.patterns)
    t.add_argument("-r", "--rules", default=settings.rules)
    t.add_argument("--tz", default=settings.tz)
    t.add_argument("--year", type=int)
    t.add_argument("--nested", type=int, default=0, choices=(0, 1, 2))
    t.add_argument("--array", action="store_true", help="one JSON array in a local file instead of a folder of JSON lines")
    t.add_argument("--progress", action="store_true", help="say how many lines matched, and how fast")
    for name, text in (("learn", "a pattern library from files, and rules if there is an annotator"), ("rebuild", "field rules for the patterns of files")):
        n = commands.add_parser(name, help=text)
        n.add_argument("files", nargs="*")
        n.add_argument("--dir", help="a folder whose *.log files are read too")
        n.add_argument("--stage2", default=settings.rules, help="the library of rules")
        n.add_argument("--annotator", default=settings.annotator, help="package.module:name of a callable that gives an annotator")
        n.add_argument("--no-llm", action="store_true", help="no annotator")
        if name == "learn":
            n.add_argument("--max-lines", type=int)
            n.add_argument("--output", default=settings.patterns)
            n.add_argument("--semantics", default="preset", choices=("none", "preset"))
        else:
            n.add_argument("-p", "--patterns", default=settings.patterns)
            n.add_argument("--replace", action="store_true", help="drop rules that are there")
    own = parser.parse_args(args)
    if own.command != "transform" and not _files(own):
        parser.error("no files")
    spark = spark or SparkSession.builder.appName("logloom").getOrCreate()
    return {"transform": _transform, "learn": _learn, "rebuild": _rebuild}[own.command](own, spark, settings)


def _learn(own: argparse.Namespace, spark: SparkSession, settings: Settings) -> int:
    began, annotator = time.monotonic(), _annotator(own.annotator, settings.annotator_enabled and not own.no_llm)
    semantics = "annotator" if annotator else own.semantics
    for r in learn_files(spark, _files(own), own.output, semantics=semantics, annotator=annotator, max_lines=own.max_lines):
        print(f"{os.path.basename(r['path'])}: " + (f"failed: {r['failed']}" if "failed" in r else f"{r['templates']} templates, {r['patterns']} patterns, {r['library']} in all"))
    print(f"{len(load_patterns(own.output))} patterns in {own.output}, {time.monotonic() - began:.1f} s")
    if annotator:
        _rules(read_lines(spark, _files(own)), own.output, own.stage2, annotator, True)
    else:
        print(f"no annotator: {own.stage2} stays as it is")
    return 0


def _rebuild(own: argparse.Namespace, spark: SparkSession, settings: Settings) -> int:
    if not (annotator := _annotator(own.annotator, settings.annotator_enabled and not own.no_llm)):
        print(f"no annotator: {own.stage2} stays as it is")
        return 0
    _rules(read_lines(spark, _files(own)), own.patterns, own.stage2, annotator, not own.replace)
    return 0


def _rules(lines: DataFrame, patterns: str, output: str, annotator: Annotator, merge: bool) -> None:
    rules, report = rebuild_with_report(lines, load_patterns(patterns), annotator, load_rules(output) if merge and os.path.exists(output) else None)
    save(output, rules, "2.1", total=len(rules))
    for r in report:
        print(f"{os.path.basename(r['path'])}: {r['patterns']} patterns, {r['rules']} rules")
    print(f"{len(rules)} rules in {output}")


def _transform(own: argparse.Namespace, spark: SparkSession, settings: Settings) -> int:
    began = time.monotonic()
    rules = load_rules(own.rules) if own.rules and os.path.exists(own.rules) else []
    parsed = parse(read_lines(spark, own.input, numbered=bool(own.errors)), load_patterns(own.patterns), rules, Options(own.tz, own.year), own.nested)
    parsed, seen = observed(parsed)
    # Events and errors come from one evaluation.
    if own.errors:
        parsed = parsed.persist(StorageLevel.DISK_ONLY)
    found = parsed.where("pattern_idx IS NOT NULL").select("event.*")
    if own.array:
        write_json_array(found, own.output, own.tz)
    else:
        as_json(found, own.tz).write.mode("overwrite").text(own.output)
    if own.errors:
        error_entries(parsed.where("pattern_idx IS NULL")).select(F.to_json(F.struct("_meta", "raw")).alias("value")).write.mode("overwrite").text(own.errors)
        parsed.unpersist()
    if own.progress:
        counts, seconds = seen.get, time.monotonic() - began
        print(f"{counts['total']} lines, {counts['matched']} matched, {counts['unmatched']} unmatched, {seconds:.1f} s, {counts['total'] / max(seconds, 1e-9):.0f} lines/s")
        if counts["matched"] < settings.coverage * counts["total"]:
            print(f"fewer than {settings.coverage:.0%} matched")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
