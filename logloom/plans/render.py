"""Log lines rendered from the driver's tables, with the columns they came from, and a hand-written library for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.extract import Options
from logloom.sources.library import Pattern, Rule

OPTIONS = Options(tz="UTC", reference_year=2024, processing_time="2024-06-01 00:00:00+00:00")

STAMP, CLOCK = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?", r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
RFC = Pattern("rfc", rf"^<(?P<priority>\d+)>\d+\ (?P<timestamp>{STAMP})\ (?P<hostname>\S+)(?P<message>.+)$", priority=10, format="rfc5424_json")
WINDOWS = Pattern("windows", rf"^<(?P<priority>\d+)>\S+\ \d+\ (?P<timestamp>{CLOCK})\ (?P<hostname>\S+)\ (?P<program>\S+:)\ (?P<event_id>\d+):(?P<message>.+)$", priority=20, format="windows_event")
KV = Pattern("kv", rf"^[A-Z][a-z][a-z]\ \d+\ {CLOCK}\ (?P<source_ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?P<message>.+)$", priority=30, extractor="kv_parser", format="tianrongxin_structured")
LIBRARY = [RFC, WINDOWS, KV]
#: The same headers for the other extractors.
JSON_ONLY = Pattern("json", rf"^<(?P<priority>\d+)>\d+\ (?P<timestamp>{STAMP})\ (?P<hostname>\S+)[^{{]*(?P<json_msg>\{{.*\}})$", extractor="rfc5424_json")
PLAIN = Pattern("plain", RFC.regex, extractor="rfc5424_plain")
EVENT = Pattern("event", WINDOWS.regex, extractor="ip_prefix_syslog")
RULES = [
    Rule("dev_ip", "device_ip", type="rfc", extract_method="kv_parse", json_key="dev_ip"),
    Rule("level", "severity", type="rfc", extract_method="kv_parse", json_key="level"),
    Rule("dvc", "device_ip", type="kv", extract_method="kv_parse", kv_key="DVC_ADDRESS"),
    Rule("value", "reading", type="windows", regex=r"\bvalue[=:\s]+\s*(\S+)"),
]


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the numbers that lines are made of. kind: 0 RFC 5424, 1 BSD, 2 key-value, 3 noise."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mod = {"kind": 4, "p": 192, "n": 50, "level": 8, "low": 256}
    columns = {k: (F.col("event_id") % v).cast("int") for k, v in mod.items()} | {"high": (F.col("user_id") % 256).cast("int")}
    return e.withColumns(columns | {"ts": F.col("ts").cast("timestamp_ntz")})


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def line(c=F.col) -> Column:
    bsd, iso = F.date_format(c("ts"), "MMM d HH:mm:ss"), F.date_format(c("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rfc = _joined("<", c("p"), ">1 ", iso, " host", c("user_id"), " ", c("event_id"), ' - - {"dev_ip":"10.0.', c("high"), ".", c("low"), '","level":', c("level"), ',"event_content":"', c("event_type"), ' port scan"}')
    windows = _joined("<", c("p"), ">", bsd, " HOST", c("n"), " Security-Auditing: ", c("n") + 4600, ": ", c("event_type"), " value=", c("n"))
    kv = _joined(bsd, " 192.0.2.", c("n"), ' DVC_ADDRESS="10.1.', c("high"), ".", c("low"), '" MESSAGE="', c("event_type"), ' by user" SEVERITY="', c("level"), '" ORIGINAL_DATA="<', c("p"), ">", bsd, " HOST", c("n"), ' Security-Auditing: 4663: inner"')
    noise = _joined(c("event_type"), " without a header ", c("event_id"))
    return F.when(c("kind") == 0, rfc).when(c("kind") == 1, windows).when(c("kind") == 2, kv).otherwise(noise)


def lines(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """(value, path, line_no, and the source's columns): one file for each kind."""
    own = source(spark, sf_dir)
    if kinds:
        own = own.where(F.col("kind").isin(list(kinds)))
    return own.select(line().alias("value"), F.concat(F.lit("src"), "kind").alias("path"), (F.floor(F.col("event_id") / 4) + 1).alias("line_no"), F.col("event_id").alias("row_id"), "kind")
