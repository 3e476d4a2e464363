"""Queries of the log engine over rendered lines and the driver's tables, and the SQL that gives the same from the source columns."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.functions.scalars import numeric_kv
from logloom.functions import tokens as T
from logloom.operators import drain
from logloom.operators.annotator import Asking, ModelAnnotator, without_noise
from logloom.operators.extract import Options
from logloom.operators.match import by_pattern, files_with_match, group_column, match, match_join, statistics
from logloom.operators.rules import build_rules, guide_forms, message_groups
from logloom.operators.semantics import LEAST_LINES, MONTH_NAMES, preset
from logloom.functions.regex import translate
from logloom.sources import library as L
from logloom.sources.lines import head, message_samples, not_blank, not_empty, read_lines
from logloom.sources.sinks import as_json, error_entries, read_json_array, write_json_array

from . import render as R
from .learn import failing_samples, file_samples, learn, rebuild_with_report, unknown_forms
from .parse import events, parse, unmatched

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The source columns, as render.source makes them.
E = "e AS (SELECT *, event_id % 4 AS kind, event_id % 192 AS p, event_id % 50 AS n, event_id % 8 AS level, event_id % 256 AS low, user_id % 256 AS high, date_trunc('second', ts) AS sec, strftime(ts, '%b %-d %H:%M:%S') AS bsd, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events)"
LINE = """l AS (SELECT *, CASE kind WHEN 0 THEN '<' || p || '>1 ' || iso || ' host' || user_id || ' ' || event_id || ' - - {"dev_ip":"10.0.' || high || '.' || low || '","level":' || level || ',"event_content":"' || event_type || ' port scan"}'
 WHEN 1 THEN '<' || p || '>' || bsd || ' HOST' || n || ' Security-Auditing: ' || (n + 4600) || ': ' || event_type || ' value=' || n
 WHEN 2 THEN bsd || ' 192.0.2.' || n || ' DVC_ADDRESS="10.1.' || high || '.' || low || '" MESSAGE="' || event_type || ' by user" SEVERITY="' || level || '" ORIGINAL_DATA="<' || p || '>' || bsd || ' HOST' || n || ' Security-Auditing: 4663: inner"'
 ELSE event_type || ' without a header ' || event_id END AS line FROM e)"""
NAME = "CASE kind WHEN 0 THEN 'rfc' WHEN 1 THEN 'windows' WHEN 2 THEN 'kv' END"
RISK = "CASE WHEN {0} <= 1 THEN 'CRITICAL' WHEN {0} = 2 THEN 'HIGH' WHEN {0} = 3 THEN 'MEDIUM' WHEN {0} = 4 THEN 'LOW' ELSE 'INFO' END"
KINDS = "CASE WHEN contains(t, 'security_audit') OR contains(t, 'audit_') OR contains(t, 'security-auditing') THEN 'SECURITY_ALERT' WHEN contains(t, 'login') OR contains(t, 'auth') OR contains(t, 'logout') THEN 'AUTHENTICATION' WHEN contains(t, 'alert') THEN 'SECURITY_ALERT' WHEN contains(t, 'network') OR contains(t, 'packet') OR contains(t, 'mac') THEN 'NETWORK_ALERT' WHEN contains(t, 'service_control') OR contains(t, 'error') OR contains(t, 'fail') THEN 'SYSTEM_ERROR' WHEN contains(t, 'system') OR contains(t, 'startup') OR contains(t, 'shutdown') OR contains(t, 'config') THEN 'SYSTEM_EVENT' ELSE 'UNKNOWN' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parsed(spark, sf_dir, *kinds, patterns=None, rules=(), nested=0, fields=None) -> DataFrame:
    return parse(R.lines(spark, sf_dir, *kinds), patterns or R.LIBRARY, list(rules), R.OPTIONS, nested, fields)


def _epoch(name: str = "event.timestamp"):
    return F.unix_timestamp(name).alias("epoch")


@query(f"WITH {E} SELECT event_id AS row_id, {NAME} AS pattern_name FROM e")
def first_match(spark, sf_dir):
    return _parsed(spark, sf_dir, fields=["log_format"]).select("row_id", "pattern_name")


@query(f"WITH {E} SELECT event_id AS row_id, CASE WHEN kind < 3 THEN {NAME} WHEN event_id < 2000 THEN 'n' || event_id END AS pattern_name, CASE kind WHEN 0 THEN 'host' || user_id WHEN 1 THEN 'HOST' || n END AS hostname FROM e")
def first_match_large(spark, sf_dir):
    """A library of 2,003 patterns, whose literal texts say which few are tried."""
    patterns = [L.Pattern(f"n{i}", rf"^(?P<message>\w+\ without\ a\ header\ {i})$") for i in range(2000)] + R.LIBRARY
    matched = match(R.lines(spark, sf_dir), patterns)
    return matched.select("row_id", by_pattern(patterns, lambda p: p.name).alias("pattern_name"), group_column(patterns, "hostname").alias("hostname"))


@query(f"WITH {E} SELECT event_id AS row_id, {NAME} AS pattern_name FROM e")
def first_match_join(spark, sf_dir):
    library = L.to_frame(spark, R.LIBRARY)
    java = spark.createDataFrame([(p.name, translate(p.regex).java) for p in R.LIBRARY], "name string, java string")
    lines = R.lines(spark, sf_dir)
    return match_join(lines, library.join(java, "name")).select("row_id", "pattern_name")


@query(f"WITH {E} SELECT event_id AS row_id, p::INT AS priority, (p // 8)::INT AS facility, (p % 8)::INT AS severity FROM e WHERE kind = 1")
def pri_decode(spark, sf_dir):
    return _parsed(spark, sf_dir, 1).select("row_id", "event.priority", "event.facility", "event.severity")


@query(
    f"""WITH {E} SELECT event_id AS row_id, p::INT AS priority, CASE kind WHEN 0 THEN 'host' || user_id ELSE 'HOST' || n END AS hostname, CASE kind WHEN 1 THEN (4600 + n)::VARCHAR ELSE '' END AS event_id,
 CASE kind WHEN 1 THEN 'Security-Auditing:' ELSE '' END AS dvc_event_category, CASE kind WHEN 0 THEN event_type || ' port scan' ELSE event_type || ' value=' || n END AS message_content, epoch(sec)::BIGINT AS epoch FROM e WHERE kind < 2"""
)
def generic_extract(spark, sf_dir):
    fields = ["priority", "hostname", "event_id", "dvc_event_category", "message_content"]
    return _parsed(spark, sf_dir, 0, 1, fields=[*fields, "timestamp"]).select("row_id", *[f"event.{c}" for c in fields], _epoch())


@query(
    f"""WITH {E} SELECT event_id AS row_id, '192.0.2.' || n AS syslog_ip, p::INT AS priority, (p // 8)::INT AS facility, level::INT AS severity, event_type || ' by user' AS message_content,
 '<' || p || '>' || bsd || ' HOST' || n || ' Security-Auditing: 4663: inner' AS original_data, {RISK.format("level")} AS risk_level, epoch(sec)::BIGINT AS epoch FROM e WHERE kind = 2"""
)
def kv_extract(spark, sf_dir):
    fields = ["syslog_ip", "priority", "facility", "severity", "message_content", "original_data", "risk_level"]
    return _parsed(spark, sf_dir, 2, fields=[*fields, "timestamp"]).select("row_id", *[f"event.{c}" for c in fields], _epoch())


@query(
    f"""WITH {E} SELECT event_id AS row_id, p::INT AS priority, 'host' || user_id AS hostname, '{{"dev_ip":"10.0.' || high || '.' || low || '","level":' || level || ',"event_content":"' || event_type || ' port scan"}}' AS message_content, 'rfc5424_json' AS log_format, epoch(sec)::BIGINT AS epoch FROM e WHERE kind = 0"""
)
def rfc5424_json_extract(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, 0, patterns=[R.JSON_ONLY])
    return parsed.select("row_id", "event.priority", "event.hostname", F.col("event.structured_data")["json_msg"].alias("message_content"), "event.log_format", _epoch())


@query(f"WITH {E} SELECT event_id AS row_id, (p // 8)::INT AS facility, 'host' || user_id AS hostname, ' ' || event_id || ' - - {{\"dev_ip\":\"10.0.' || high || '.' || low || '\",\"level\":' || level || ',\"event_content\":\"' || event_type || ' port scan\"}}' AS message_content, 'rfc5424_plain' AS log_format FROM e WHERE kind = 0")
def rfc5424_plain_extract(spark, sf_dir):
    return _parsed(spark, sf_dir, 0, patterns=[R.PLAIN]).select("row_id", "event.facility", "event.hostname", "event.message_content", "event.log_format")


@query(f"WITH {E} SELECT event_id AS row_id, (4600 + n)::VARCHAR AS event_id, 'SECURITY_ALERT' AS event_type, {RISK.format('(p % 8)')} AS risk_level, event_type || ' value=' || n AS message_content, epoch(sec)::BIGINT AS epoch FROM e WHERE kind = 1")
def windows_extract(spark, sf_dir):
    return _parsed(spark, sf_dir, 1, patterns=[R.EVENT]).select("row_id", "event.event_id", "event.event_type", "event.risk_level", "event.message_content", _epoch())


KV_SQL = r"""k AS (SELECT page_id, unnest(regexp_extract_all(html, '(\w+)="((?:[^"\\]|\\.)*)"', 1)) AS key, unnest(regexp_extract_all(html, '(\w+)="((?:[^"\\]|\\.)*)"', 2)) AS value FROM pages)"""


@query(f"WITH {KV_SQL} SELECT page_id, upper(key) AS key, value FROM k")
def kv_pairs_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(S.kv_pairs(F.col("html"))).alias("kv")).select("page_id", "kv.key", "kv.value")


@query(f"WITH {KV_SQL} SELECT upper(key) AS key, count(*) AS pairs, count(DISTINCT value) AS n_values FROM k GROUP BY 1")
def kv_key_counts(spark, sf_dir):
    return kv_pairs_html(spark, sf_dir).groupBy("key").agg(F.count("*").alias("pairs"), F.count_distinct("value").alias("n_values"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k') IS NOT NULL) AS is_object FROM events")
def json_key(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", S.kv_or_json(F.col("props"), "K").alias("k"), S.is_json_object(F.col("props")).alias("is_object"))


@query(f"WITH {E} SELECT event_id AS row_id, CASE kind WHEN 0 THEN 'rfc5424_json' WHEN 1 THEN 'windows_event' ELSE 'tianrongxin_structured' END AS log_format FROM e WHERE kind < 3")
def log_format_refine(spark, sf_dir):
    return _parsed(spark, sf_dir, 0, 1, 2).select("row_id", "event.log_format")


@query(f"WITH {E} SELECT event_id AS row_id, CASE kind WHEN 0 THEN '10.0.' WHEN 2 THEN '10.1.' END || high || '.' || low AS device_ip, CASE kind WHEN 0 THEN level WHEN 2 THEN level END::INT AS severity, CASE kind WHEN 0 THEN 'INFO' ELSE {RISK.format('level')} END AS risk_level FROM e WHERE kind IN (0, 2)")
def stage2_fields(spark, sf_dir):
    fields = ["device_ip", "severity", "risk_level"]
    return _parsed(spark, sf_dir, 0, 2, rules=R.RULES, fields=fields).select("row_id", *[f"event.{c}" for c in fields])


@query(f"WITH {E} SELECT event_id AS row_id, n::VARCHAR AS reading FROM e WHERE kind = 1")
def stage2_extra_field(spark, sf_dir):
    return _parsed(spark, sf_dir, 1, rules=R.RULES).select("row_id", F.col("extra")["reading"].alias("reading"))


@query(f"WITH {E} SELECT event_id AS row_id, CASE kind WHEN 0 THEN event_type || ' port scan' WHEN 1 THEN ' ' || event_type || ' value=' || n ELSE event_type || ' by user' END AS message_content FROM e WHERE kind < 3")
def stage2_message(spark, sf_dir):
    whole = L.Rule("m", "message_content", extract_method="message_content", source="whole")
    keyed = [L.Rule("m", "message_content", type="rfc", extract_method="message_content", json_key="event_content"), L.Rule("m", "message_content", type="kv", extract_method="message_content", kv_key="MESSAGE")]
    return _parsed(spark, sf_dir, 0, 1, 2, rules=[whole, *keyed]).select("row_id", "event.message_content")


MAPPINGS = {
    "windows": [{"field_name": "reading", "keyword": "value", "kind": "number"}, {"field_name": "word", "keyword": "value", "kind": "text"}, {"field_name": "severity", "keyword": "value", "kind": "text"}, {"field_name": "reading", "kv_key": "LATE"}],
    "kv": [{"field_name": "address", "token": 'DVC_ADDRESS="', "kind": "ip"}, {"field_name": "label", "token": 'MESSAGE="', "kind": "text"}, {"field_name": "bare", "kind": "ip"}, {"field_name": "message_content", "kind": "text"}],
    "rfc": [{"field_name": "message_content", "json_key": "event_content"}, {"field_name": "address", "json_key": "dev_ip"}],
}


@query(
    f"""WITH {E} SELECT event_id AS row_id, CASE kind WHEN 1 THEN n::VARCHAR END AS reading, CASE kind WHEN 1 THEN n::VARCHAR END AS word, (CASE kind WHEN 0 THEN p % 8 WHEN 1 THEN n ELSE level END)::INT AS severity,
 CASE kind WHEN 0 THEN '10.0.' || high || '.' || low WHEN 2 THEN '10.1.' || high || '.' || low END AS address, CASE kind WHEN 2 THEN event_type END AS label,
 CASE kind WHEN 0 THEN event_type || ' port scan' WHEN 1 THEN event_type || ' value=' || n ELSE event_type || ' by user' END AS message_content FROM e WHERE kind < 3"""
)
def rules_from_mappings(spark, sf_dir):
    """Rules built from an annotator's mappings: kinds of labels and keywords, fields that are numbers, and mappings without a guide."""
    rules = [r for name, mappings in MAPPINGS.items() for r in build_rules(name, mappings)]
    parsed = _parsed(spark, sf_dir, 0, 1, 2, rules=rules)
    return parsed.select("row_id", *[F.col("extra")[c].alias(c) for c in ("reading", "word", "address", "label")], "event.severity", "event.message_content")


@query(f"WITH {E} SELECT event_id AS row_id, n::VARCHAR AS digits FROM e WHERE kind = 1")
def python_only_rule(spark, sf_dir):
    rule = L.Rule("d", "digits", type="windows", regex=r"value=([[0-9]+)")
    return _parsed(spark, sf_dir, 1, rules=[rule]).select("row_id", F.col("extra")["digits"].alias("digits"))


@query(f"WITH {E}, {LINE} SELECT kind::INT AS kind, count(*) FILTER (kind = 2) AS severity, 0::BIGINT AS message, count(*) FILTER (kind = 0) AS level, 0::BIGINT AS content, count(*) FILTER (kind = 1) AS reading, 0::BIGINT AS tail FROM l GROUP BY 1")
def numeric_mappings(spark, sf_dir):
    """In how many lines a key has a whole number: SEVERITY="n", "level":n, value=n, and not where the key is the end of a longer word."""
    keys = {"severity": "SEVERITY", "message": "MESSAGE", "level": "level", "content": "event_content", "reading": "value", "tail": "_ADDRESS"}
    lines = R.lines(spark, sf_dir)
    return lines.groupBy("kind").agg(*[F.count_if(numeric_kv(F.col("value"), key)).alias(name) for name, key in keys.items()])


@query(f"WITH {E} SELECT event_id AS row_id, epoch(sec)::BIGINT + CASE event_id % 5 WHEN 0 THEN -3600 WHEN 1 THEN -3600 WHEN 2 THEN -19800 ELSE 0 END AS epoch FROM e WHERE event_id % 5 < 5")
def rule_timestamps(spark, sf_dir):
    """Times as rules take them: without a zone in two forms (on a clock one hour ahead), with an offset, with Z, and in seconds."""
    k, iso = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, iso).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(iso, F.lit("+0530"))).when(k == 3, F.concat(iso, F.lit("Z")))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    return R.source(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.unix_timestamp(S.rule_moment(F.coalesce(text, seconds), "+01:00")).alias("epoch"))


@query(f"WITH {E} SELECT event_id AS row_id, (CASE event_id % 8 WHEN 3 THEN epoch(TIMESTAMP '2024-06-01 00:00:00') ELSE epoch(sec) END)::BIGINT AS epoch, CASE event_id % 8 WHEN 3 THEN 0 ELSE n END::INT AS severity FROM e WHERE kind = 1 OR event_id % 8 = 3")
def rule_overrides(spark, sf_dir):
    """A rule's value replaces the header's: one that can be read, and one that cannot (the processing time, 0)."""
    windows = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    at = R.source(spark, sf_dir).where("kind = 1 OR event_id % 8 = 3").select("event_id", "n", F.when(F.col("event_id") % 8 == 3, "soon").otherwise(windows).alias("t"), F.when(F.col("event_id") % 8 == 3, "x").otherwise(F.col("n").cast("string")).alias("s"))
    lines = at.select(F.col("event_id").alias("row_id"), F.format_string("<13>Jan 1 01:02:03 HOST1 app: 17: at=%s; level=%s;", "t", "s").alias("value"), F.lit("f").alias("path"), F.col("event_id").alias("line_no"))
    rules = [L.Rule("t", "timestamp", regex=r"at=([^;]+);"), L.Rule("s", "severity", regex=r"level=([^;]+);")]
    return parse(lines, R.LIBRARY, rules, R.OPTIONS).select("row_id", _epoch(), "event.severity")


@query(f"SELECT event_id, {KINDS} AS event_type FROM (SELECT event_id, lower(event_type || ' ' || CASE event_id % 5 WHEN 0 THEN 'Login' WHEN 1 THEN 'network packet' WHEN 2 THEN 'disk failed' WHEN 3 THEN 'config' ELSE '' END) AS t FROM events)")
def event_type_map(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 5
    text = F.concat_ws(" ", "event_type", F.when(k == 0, "Login").when(k == 1, "network packet").when(k == 2, "disk failed").when(k == 3, "config").otherwise(""))
    return e.select("event_id", S.event_type(F.lit(None).cast("string"), text).alias("event_type"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'HIGH' WHEN event_id % 3 = 1 THEN {RISK.format('(event_id % 8)')} ELSE 'INFO' END AS risk_level FROM events")
def risk_level_map(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 3
    return e.select("event_id", S.risk_level(F.when(k == 0, "High"), F.col("event_id") % 8, k == 1).alias("risk_level"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'windows_server' WHEN 1 THEN 'operating_system' WHEN 2 THEN 'network_device' ELSE event_type END AS device_type FROM events")
def device_type_map(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 4
    return e.select("event_id", S.device_type(F.when(k == 0, "Microsoft OS").when(k == 1, "some OS").when(k == 2, "a NETWORK box").otherwise(F.col("event_type"))).alias("device_type"))


@query(f"WITH {E} SELECT event_id AS row_id, epoch(sec)::BIGINT AS epoch, (epoch(sec) - 19800)::BIGINT AS with_offset, NULL::BIGINT AS bare FROM e")
def ts_iso(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = lambda suffix: F.unix_timestamp(S.moment(F.concat(iso, F.lit(suffix)), "UTC", F.lit(2024)))
    return R.source(spark, sf_dir).select(F.col("event_id").alias("row_id"), stamp("Z").alias("epoch"), stamp("+05:30").alias("with_offset"), stamp("").alias("bare"))


@query(f"WITH {E} SELECT event_id AS row_id, epoch(sec)::BIGINT AS epoch FROM e WHERE kind IN (1, 2)")
def ts_bsd(spark, sf_dir):
    lines = R.lines(spark, sf_dir, 1, 2)
    return lines.select("row_id", F.unix_timestamp(S.moment(S.bsd_stamp(F.col("value")), "UTC", F.lit(2024))).alias("epoch"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS short FROM documents")
def truncate_alert(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.truncated(F.col("text")).alias("short"))


@query("SELECT event_id, event_type || ' 用' || chr(9) || 'x' AS once, event_type || '用' AS twice, event_type || ' C:\\users' AS kept FROM events")
def decode_escapes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda tail: S.unescape(F.concat("event_type", F.lit(tail)))
    return e.select("event_id", text(r" \u7528\tx").alias("once"), text(r"\\u7528").alias("twice"), text(r" C:\users").alias("kept"))


@query(f"WITH {E} SELECT event_id AS row_id, CASE kind WHEN 0 THEN 'rfc5424_json' WHEN 1 THEN 'windows_event' WHEN 2 THEN 'tianrongxin_structured' ELSE 'generic' END AS category FROM e")
def format_category(spark, sf_dir):
    return R.lines(spark, sf_dir).select("row_id", T.format_category(F.col("value")).alias("category"))


@query(r"SELECT doc_id, len(t)::INT AS n_tokens, t[1] AS first, t[-1] AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\v]+'), lambda x: x <> '')[1:64] AS t FROM documents) WHERE len(t) > 0")
def tokenize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", T.tokens(F.col("text"))).where(F.size("t") > 0)
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.col("t")[0].alias("first"), F.element_at("t", -1).alias("last"))


CLASS_SQL = r"""CASE WHEN regexp_matches(x, '^<\d+>(\d+|\w+)?$') THEN '<PRI>' WHEN regexp_matches(x, '^\d{1,3}(\.\d{1,3}){3}$') THEN '<IP>' WHEN regexp_matches(x, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') THEN '<ISOTIME>'
 WHEN regexp_matches(x, '^\d{2}:\d{2}(:\d{2}(\.\d+)?)?$') THEN '<TIME>' WHEN regexp_matches(x, '^\d+(\.\d+)?$') THEN '<NUM>' WHEN regexp_matches(x, '^[A-Za-z]+$') THEN '<WORD>'
 WHEN regexp_matches(x, '^[A-Z][A-Z0-9_]{2,}="') THEN 'KV:' || regexp_extract(x, '^([A-Z][A-Z0-9_]{2,})="', 1) ELSE '<OTHER>' END"""


@query(f"WITH {E}, {LINE}, t AS (SELECT kind, unnest(regexp_split_to_array(line, '\\s+')) AS x FROM l) SELECT kind::INT AS kind, {CLASS_SQL} AS class, count(*) AS n FROM t GROUP BY 1, 2")
def token_class_counts(spark, sf_dir):
    exploded = R.lines(spark, sf_dir).select("kind", F.explode(T.tokens(F.col("value"))).alias("t"))
    return exploded.groupBy("kind", T.token_class(F.col("t")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {E}, {LINE}, t AS (SELECT event_id, kind, list_aggregate(list_transform(regexp_split_to_array(line, '\\s+')[1:6], lambda x: {CLASS_SQL}), 'string_agg', ' ') AS path_key FROM l) SELECT kind::INT AS kind, path_key, count(*) AS n FROM t GROUP BY 1, 2")
def path_key_counts(spark, sf_dir):
    keyed = R.lines(spark, sf_dir).select("kind", T.path_key(T.tokens(F.col("value"))).alias("path_key"))
    return keyed.groupBy("kind", "path_key").agg(F.count("*").alias("n"))


# What learning gives for these lines, worked out from its rules. Typed places agree as long as they are typed, and a wildcard agrees with nothing,
# so two lines of one kind (for kind 1: of one n, which is in two places) make a template that no third one joins: more than one place is a
# wildcard. Noise is different: of two lines of one type only the number becomes a wildcard, so all later lines of that type join; those of types
# that have no such template pair up. `est` finds one such type after another: the first pair of equal types among the lines that are left.
TEMPLATES = f"""{E}, {LINE}, f AS (SELECT *, event_id // 4 + 1 AS no FROM l), w AS (SELECT no, event_type FROM f WHERE kind = 3),
 est(k, s, first, types) AS (SELECT 0, 0::BIGINT, 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT k + 1, no2, no, list_append(types, event_type) FROM (SELECT * FROM (SELECT est.k, est.types, w.no, w.event_type, lead(w.no) OVER (ORDER BY w.no) AS no2, lead(w.event_type) OVER (ORDER BY w.no) AS type2, row_number() OVER (ORDER BY w.no) AS r
   FROM w, est WHERE w.no > est.s AND NOT list_contains(est.types, w.event_type)) WHERE r % 2 = 1 AND event_type = type2 ORDER BY no LIMIT 1)),
 noise AS (SELECT w.no, x.first, (SELECT max(k) FROM est WHERE s < w.no) AS k FROM w LEFT JOIN est x ON x.k > 0 AND x.types[-1] = w.event_type AND w.no >= x.first),
 leaf AS (SELECT f.kind, f.no, f.line, noise.first, CASE f.kind WHEN 1 THEN f.n WHEN 3 THEN noise.k ELSE 0 END AS part FROM f LEFT JOIN noise ON f.kind = 3 AND f.no = noise.no),
 numbered AS (SELECT *, (row_number() OVER (PARTITION BY kind, part, first IS NULL ORDER BY no) - 1) // 2 AS pair FROM leaf),
 placed AS (SELECT kind, no, line, coalesce(first, min(no) OVER (PARTITION BY kind, part, first IS NULL, pair)) AS first_line FROM numbered),
 words AS (SELECT kind, no, first_line, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS place FROM placed),
 places AS (SELECT kind, first_line, place, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS word, count(*) AS n FROM words GROUP BY 1, 2, 3),
 templates AS (SELECT kind, first_line, string_agg(word, ' ' ORDER BY place) AS template, max(n) AS count FROM places GROUP BY 1, 2)"""
# Templates with the same head form one group: the head of noise has its type, that of kind 2 its month and its type.
GROUPS = f"""{TEMPLATES}, signed AS (SELECT *, CASE WHEN kind > 1 THEN split_part(template, ' ', 1) ELSE '' END AS first_word, first_word || CASE kind WHEN 2 THEN split_part(template, ' ', 6) ELSE '' END AS sig FROM templates),
 folded AS (SELECT kind, sig, place, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS word FROM words JOIN signed USING (kind, first_line) GROUP BY 1, 2, 3),
 texts AS (SELECT kind, sig, string_agg(word, ' ' ORDER BY place) AS template FROM folded GROUP BY 1, 2),
 groups AS (SELECT kind, first_word, sig, t.template, sum(count)::BIGINT AS count, min(first_line) AS first_line FROM signed JOIN texts t USING (kind, sig) GROUP BY 1, 2, 3, 4)"""
PATH_KEYS = "CASE kind WHEN 0 THEN '<PRI> <ISOTIME> <OTHER> <NUM> <OTHER> <OTHER>' WHEN 1 THEN '<PRI> <NUM> <TIME> <OTHER> <OTHER> <OTHER>' WHEN 2 THEN '<WORD> <NUM> <TIME> <IP> KV:DVC_ADDRESS KV:MESSAGE' ELSE '<WORD> <WORD> <WORD> <WORD> <NUM>' END"


@query(f"WITH RECURSIVE {TEMPLATES} SELECT 'src' || kind AS path, {PATH_KEYS} AS path_key, first_line, template, count FROM templates")
def drain_templates(spark, sf_dir):
    return drain.learn_templates(R.lines(spark, sf_dir)).select("path", "path_key", "first_line", F.array_join("tokens", " ").alias("template"), "count")


@query(f"WITH RECURSIVE {GROUPS} SELECT 'src' || kind AS path, g.first_line, template, count, least(count, 50)::INT AS n_samples, p.line AS sample, len(string_split(template, ' ')) - 1 AS n_seps FROM groups g JOIN (SELECT kind, no AS first_line, line FROM placed) p USING (kind, first_line)")
def template_groups(spark, sf_dir):
    """Templates put together by head signature: their tokens folded, counts summed, the first distinct samples kept."""
    groups = drain.regroup(drain.learn_templates(R.lines(spark, sf_dir)), preset)
    return groups.select("path", "first_line", F.array_join("tokens", " ").alias("template"), "count", F.size("samples").alias("n_samples"), F.col("samples")[0].alias("sample"), F.size("seps").cast("long").alias("n_seps"))


CLOCK_SQL = r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
REGEXES = rf"""CASE kind WHEN 0 THEN '^<(?P<priority>\d+)>\d+\ (?P<timestamp>\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?Z?)\ (?P<hostname>\S+)(?P<message>.+)$'
 WHEN 1 THEN '^<(?P<priority>\d+)>\S+\ \d+\ (?P<timestamp>{CLOCK_SQL})\ (?P<hostname>\S+)\ (?P<program>Security\-Auditing:)\ (?P<event_id>\d+):(?P<message>.+)$'
 WHEN 2 THEN '^' || CASE first_word WHEN '<*>' THEN '\S+' ELSE '(?:{'|'.join(MONTH_NAMES)})' END || '\ \d+\ {CLOCK_SQL}\ (?P<source_ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?P<message>.+)$'
 ELSE '^' || CASE first_word WHEN '<*>' THEN '\S+' ELSE first_word END || '\ without\ a\ header\ \d+$' END"""


@query(
    f"""WITH RECURSIVE {GROUPS}, r AS (SELECT kind, {REGEXES} AS regex, count, row_number() OVER (PARTITION BY kind ORDER BY count DESC, first_line) AS place FROM groups WHERE count >= 3),
 d AS (SELECT kind, regex, min(place) AS place, max(count) AS largest, sum(count)::BIGINT AS count FROM r GROUP BY 1, 2)
 SELECT 'src' || kind AS path, regex, 'fmt_' || lpad((row_number() OVER (PARTITION BY kind ORDER BY place) - 1)::VARCHAR, 3, '0') AS name, greatest(1, least(100, 100 - largest // 10))::BIGINT AS priority, CASE kind WHEN 2 THEN 'kv_parser' ELSE 'generic' END AS extractor, count FROM d"""
)
def learned_patterns(spark, sf_dir):
    """The patterns of each file: groups of three lines or more, largest first, one for each regex, with extractors by the share of key-value lines."""
    groups = drain.collect_groups(drain.regroup(drain.learn_templates(R.lines(spark, sf_dir)), preset))
    # A few patterns for each of four files.
    rows = [(path, p.regex, p.name, p.priority, p.extractor, p.count) for path, own in groups.items() for p in drain.to_patterns(own)]
    return spark.createDataFrame(rows, "path string, regex string, name string, priority long, extractor string, count long")


class Reviewer:
    """A client that answers as a model would: patterns of one or two lines are noise, and so is a name that does not exist."""

    def ask(self, prompt: str, system: str) -> str:
        shown = [json.loads(line) for line in prompt.split("\n") if line.startswith('{"name"')]
        return json.dumps({"noise_names": [*[p["name"] for p in shown if p["count"] <= 2], "fmt_none"], "forwarded": False})


@query(
    f"""WITH RECURSIVE {GROUPS}, r AS (SELECT kind, {REGEXES} AS regex, count, row_number() OVER (PARTITION BY kind ORDER BY count DESC, first_line) AS place FROM groups),
 d AS (SELECT kind, regex, min(place) AS place, sum(count)::BIGINT AS count FROM r GROUP BY 1, 2) SELECT 'src' || kind AS path, regex, 'fmt_' || lpad((row_number() OVER (PARTITION BY kind ORDER BY place) - 1)::VARCHAR, 3, '0') AS name, count FROM d QUALIFY count > 2"""
)
def reviewed_patterns(spark, sf_dir):
    """The patterns of each file, rare ones too, without those that a model's review calls noise."""
    groups = drain.collect_groups(drain.regroup(drain.learn_templates(R.lines(spark, sf_dir)), preset))
    review = ModelAnnotator(Asking(Reviewer(), cooldown=0))
    # A few patterns for each of four files.
    rows = [(path, p.regex, p.name, p.count) for path, own in groups.items() for p in without_noise(drain.to_patterns(own, least=1), review)]
    return spark.createDataFrame(rows, "path string, regex string, name string, count long")


@query(f"WITH {E} SELECT name, count(*) FILTER (kind <> k) AS failing FROM e, (VALUES ('rfc', 0), ('windows', 1), ('kv', 2)) v(name, k) GROUP BY 1")
def failing_lines(spark, sf_dir):
    """How many lines each pattern fails on."""
    lines = R.lines(spark, sf_dir)
    return spark.createDataFrame([(p.name, failing_samples(p, lines)) for p in R.LIBRARY], "name string, failing long")


@query(f"WITH RECURSIVE {TEMPLATES} SELECT 'src' || kind AS path, first_line, template, count FROM templates WHERE count >= 20 ORDER BY kind, first_line LIMIT 1")
def header_questions(spark, sf_dir):
    """What an annotator is asked about: of the templates with 20 lines or more one for each form of header."""
    templates = drain.learn_templates(R.lines(spark, sf_dir))
    asked = unknown_forms(templates.where(F.col("count") >= LEAST_LINES))
    return asked.select("path", "first_line", F.array_join("tokens", " ").alias("template"), "count")


class Positions:
    """A client that answers as a model would, from the numbered tokens of the question: the first token is a program, whole numbers are event numbers."""

    def ask(self, prompt: str, system: str) -> str:
        numbered = re.findall(r"(?m)^(\d+): (\S+)$", prompt)
        fields = [{"position": int(i), "field_name": "event_id" if token.isdigit() else "program"} for i, token in numbered if token.isdigit() or i == "0"]
        return f"<think>header</think>```json\n{json.dumps({'fields': [*fields, {'position': 99, 'field_name': 'program'}, {'position': 1, 'field_name': 'colour'}]})}\n```"


# Noise of at least two types has templates with enough lines: together they stand for all noise.
@query(f"WITH {E} SELECT event_id AS row_id, event_type AS program, event_id::VARCHAR AS number FROM e WHERE kind = 3")
def annotated_headers(spark, sf_dir):
    """An annotator names the places of headers that no layout knows; the patterns learned with its answers give the fields."""
    lines = R.lines(spark, sf_dir)
    patterns = [p for p in learn(lines, semantics="annotator", annotator=ModelAnnotator(Asking(Positions(), cooldown=0))) if "(?P<event_id>" in p.regex and "(?P<program>" in p.regex and "(?P<hostname>" not in p.regex]
    matched = match(lines, patterns).where("pattern_idx IS NOT NULL")
    return matched.select("row_id", group_column(patterns, "program").alias("program"), group_column(patterns, "event_id").alias("number"))


# Noise has the same words everywhere but the first and a number at the end, so its lines teach a pattern too.
@query(f"WITH {E} SELECT kind::INT AS kind, count(*) AS n, count(*) AS matched FROM e GROUP BY 1")
def learn_then_parse(spark, sf_dir):
    lines = R.lines(spark, sf_dir)
    patterns = learn(lines, semantics="preset")
    return match(lines, patterns).groupBy("kind").agg(F.count("*").alias("n"), F.count("pattern_idx").alias("matched"))


def _messages(spark, sf_dir, *kinds):
    matched = match(R.lines(spark, sf_dir, *kinds), R.LIBRARY)
    return matched.withColumns({"pattern_name": by_pattern(R.LIBRARY, lambda p: p.name), "message": group_column(R.LIBRARY, "message")})


@query(
    f"""WITH {E}, {LINE}, m AS (SELECT list_sort(list_distinct(regexp_extract_all(line, '(\\w+)="', 1))) AS keys FROM l WHERE kind = 2 ORDER BY event_id LIMIT 500), k AS (SELECT DISTINCT unnest(keys) AS key FROM m)
 SELECT '[' || (SELECT string_agg(key, ', ' ORDER BY key) FROM k) || ']' AS kv_keys, (count(*) FILTER (len(keys) = 0) / count(*))::DOUBLE AS free_text_ratio, (SELECT count(*) FROM k)::INT AS total_forms,
 count(DISTINCT keys) AS n_line_sigs, CASE WHEN (SELECT count(*) FROM k) <= 4 THEN 'stable' ELSE 'mixed' END AS verdict FROM m"""
)
def guide_form_profile(spark, sf_dir):
    found = guide_forms(_messages(spark, sf_dir, 2))
    return found.select(F.concat(F.lit("["), F.array_join("kv_keys", ", "), F.lit("]")).alias("kv_keys"), "free_text_ratio", "total_forms", "n_line_sigs", "verdict")


LABELS = "甲乙丙丁戊己"


@query(
    f"""WITH {E}, m AS (SELECT kind, event_id, CASE WHEN kind = 2 THEN CASE level % 2 WHEN 0 THEN ['AAA'] ELSE ['AAA', 'BB_2'] END ELSE [] END AS k,
  CASE kind WHEN 0 THEN ['用户', '级别'] WHEN 1 THEN [substring('{LABELS}', n % 6 + 1, 1)] WHEN 2 THEN ['用户'] ELSE [] END AS l, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS r FROM e),
 f AS (SELECT * FROM m WHERE r <= 500), g AS (SELECT kind, list_sort(list_distinct(flatten(list(k)))) AS ks, list_sort(list_distinct(flatten(list(l)))) AS ls, count(DISTINCT k) AS kf, count(DISTINCT l) AS lf, count(*) FILTER (len(k) = 0 AND len(l) = 0) / count(*) AS free FROM f GROUP BY 1)
 SELECT 'src' || kind AS path, array_to_string(ks, ',') AS kv_keys, array_to_string(ls, ',') AS cn_labels, free::DOUBLE AS free_text_ratio, (CASE WHEN len(ks) >= 2 THEN len(ks) ELSE len(ls) END)::INT AS total_forms,
 CASE WHEN len(ks) >= 2 THEN kf ELSE lf END AS n_line_sigs, CASE WHEN CASE WHEN len(ks) >= 2 THEN kf ELSE lf END <= 4 THEN 'stable' ELSE 'mixed' END AS verdict FROM g"""
)
def guide_labels(spark, sf_dir):
    """Chinese labels and keys of four files' messages: labels behind white space of eight characters at most, keys of three capitals or more; kept, varying, by keys, and none."""
    word = lambda c: F.col(c).cast("string")
    texts = [
        F.concat(F.lit("用户:"), "event_type", F.lit(" 级别："), word("level")),
        F.concat(F.substring(F.lit(LABELS), F.col("n") % 6 + 1, F.lit(1)), F.lit("："), word("n")),
        F.concat(F.lit('用户: AAA="'), "event_type", F.lit('" AB="x" low="y"'), F.when(F.col("level") % 2 == 1, ' BB_2="z"').otherwise("")),
        F.concat("event_type", F.lit("用户: 一二三四五六七八九: "), word("n")),
    ]
    message = F.when(F.col("kind") == 0, texts[0]).when(F.col("kind") == 1, texts[1]).when(F.col("kind") == 2, texts[2]).otherwise(texts[3])
    found = guide_forms(R.source(spark, sf_dir).select(F.concat(F.lit("src"), "kind").alias("path"), F.col("event_id").alias("line_no"), message.alias("message")), by=("path",))
    return found.select("path", F.array_join("kv_keys", ",").alias("kv_keys"), F.array_join("cn_labels", ",").alias("cn_labels"), "free_text_ratio", "total_forms", "n_line_sigs", "verdict")


class Guides:
    """A client that answers as a model would, from the sample messages: what their keys and words guide to, and some that are no use."""

    GUIDED = {
        'SEVERITY="': {"field_name": "severity", "kv_key": "SEVERITY"},
        'MESSAGE="': {"field_name": "priority", "kv_key": "MESSAGE"},
        'ORIGINAL_DATA="': {"field_name": "raw_message", "kv_key": "ORIGINAL_DATA"},
        'DVC_ADDRESS="': {"field_name": "device_ip", "kv_key": "DVC_ADDRESS"},
        '"level":': {"field_name": "severity", "json_key": "level"},
        " value=": {"field_name": "reading", "keyword": "value", "kind": "number"},
        "view": {"field_name": "long", "token": "x" * 41, "kind": "text"},
    }

    def ask(self, prompt: str, system: str) -> str:
        messages = prompt.rpartition("Messages:")[2]
        return "Here: " + json.dumps({"mappings": [m for text, m in self.GUIDED.items() if text in messages]})


@query(
    f"""WITH {E}, v(kind, name, method, guide) AS (VALUES (0, 'severity', 'kv_parse', 'level'), (1, 'reading', 'regex', '\\bvalue[=:\\s]+\\s*(\\d+)'), (2, 'severity', 'kv_parse', 'SEVERITY'), (2, 'device_ip', 'kv_parse', 'DVC_ADDRESS')),
 p(kind, type) AS (VALUES (0, 'rfc'), (0, 'json'), (1, 'windows'), (2, 'kv')), c AS (SELECT kind, count(*) AS n FROM e GROUP BY 1)
 SELECT 'src' || (kind + 1) AS tag, type, name, method, guide, (SELECT count(*) FROM p WHERE p.kind = c.kind) AS patterns, (SELECT count(*) FROM v WHERE v.kind = c.kind) AS rules FROM c LEFT JOIN p USING (kind) LEFT JOIN v USING (kind)"""
)
def rebuilt_rules(spark, sf_dir):
    """Rules from an annotator's mappings: those without a use left out, each file's rules copied to each of its patterns, and its numbers of both."""
    rules, report = rebuild_with_report(R.lines(spark, sf_dir), [*R.LIBRARY, R.JSON_ONLY], ModelAnnotator(Asking(Guides(), cooldown=0)))
    # A few rules for each of four files.
    schema = "tag string, type string, name string, method string, guide string"
    made = spark.createDataFrame([(r.format, r.type, r.field_name, r.extract_method, r.kv_key or r.json_key or r.regex) for r in rules], schema)
    files = spark.createDataFrame([(f"src{i + 1}", f["patterns"], f["rules"]) for i, f in enumerate(report)], "tag string, patterns long, rules long")
    return files.join(made, "tag", "left").select(*made.columns, "patterns", "rules")


@query(
    f"""WITH {E}, s AS (SELECT event_type || ' value=' || n || ' ' AS t, event_type || ' value=' || n AS signature, event_id FROM e WHERE kind = 1),
 g AS (SELECT signature, count(*) AS size, min(event_id) AS f FROM s GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, f)::INT AS rank, signature, size FROM g ORDER BY size DESC, f LIMIT 8"""
)
def message_clusters(spark, sf_dir):
    return message_groups(_messages(spark, sf_dir, 1)).select("rank", "signature", "size")


@query(f"WITH {E}, r AS (SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS k FROM e WHERE kind < 3) SELECT CASE kind WHEN 0 THEN 'rfc' WHEN 1 THEN 'windows' ELSE 'kv' END AS pattern_name, count(*) AS n, max(event_id // 4 + 1) AS last_line FROM r WHERE k <= 6 GROUP BY 1")
def sampled_messages(spark, sf_dir):
    return message_samples(_messages(spark, sf_dir), 6).groupBy("pattern_name").agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"))


MESSAGE = """CASE kind WHEN 0 THEN substring(line, instr(line, ' ' || event_id || ' - - ')) WHEN 1 THEN ' ' || event_type || ' value=' || n ELSE substring(line, instr(line, ' DVC_ADDRESS=')) END"""


@query(
    f"""WITH {E}, {LINE}, m AS (SELECT 'src' || kind || '-' || (event_id // 4 % 5) AS path, kind, (event_id // 20 + 1)::BIGINT AS line_no, {MESSAGE} AS message FROM l),
 r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM m) SELECT path, CASE WHEN kind < 3 THEN '' || kind ELSE '' END AS known, CASE WHEN kind < 3 THEN message END AS message, CASE WHEN kind < 3 THEN line_no END AS line_no FROM r WHERE k <= CASE WHEN kind < 3 THEN 6 ELSE 1 END"""
)
def rebuild_samples(spark, sf_dir):
    """What rules are rebuilt from: of each of 20 files the patterns that match in its head, and the first messages of each."""
    part = F.pmod(F.floor(F.col("row_id") / 4), F.lit(5))
    lines = R.lines(spark, sf_dir).withColumns({"path": F.concat("path", F.lit("-"), part.cast("string")), "line_no": F.floor(F.col("row_id") / 20) + 1})
    found = file_samples(lines.select("value", "path", "line_no"), R.LIBRARY)
    return found.select("path", F.array_join(F.col("known").cast("array<string>"), ",").alias("known"), "message", "line_no")


@query(
    f"""WITH {E}, f AS (SELECT 'f' || (event_id % 64 + CASE WHEN event_id // 64 > 20 THEN 100 ELSE 0 END) AS path, kind, event_id FROM e), h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) AS line_no FROM f)
 SELECT DISTINCT path FROM h WHERE line_no <= 300 AND kind = 1"""
)
def files_of_pattern(spark, sf_dir):
    """Of 128 files those that have a line of the pattern in their head."""
    later = F.when(F.col("row_id").cast("long") / 64 >= 21, 100).otherwise(0)
    lines = R.lines(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), F.col("row_id") % 64 + later))
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("row_id")))
    return files_with_match(head(numbered), R.WINDOWS)


# Libraries as tables, of patterns that events give: those of the first users, and those of later ones, with some of both.
LIBRARIES = """p AS (SELECT '^' || event_type || (user_id % 20) AS regex, CASE WHEN user_id % 20 % 3 = 0 THEN 'huawei' WHEN user_id % 20 % 3 = 1 THEN 'generic' ELSE '' END AS format, user_id % 20 AS u, event_id FROM events),
 old AS (SELECT *, row_number() OVER (ORDER BY regex, format) - 1 AS ord FROM (SELECT regex, min(format) AS format, count(*) AS count FROM p WHERE u < 12 GROUP BY 1)),
 a AS (SELECT regex, CASE WHEN format = '' THEN 'odd' ELSE format || '_' || lpad((3 * ord)::VARCHAR, 3, '0') END AS name, format, (10 + count % 7)::INT AS priority, count, ord FROM old),
 b AS (SELECT *, row_number() OVER (ORDER BY count DESC, regex) - 1 AS ord FROM (SELECT regex, max(format) AS format, count(*) AS count FROM p WHERE u >= 8 GROUP BY 1))"""


def _libraries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    third = F.col("user_id") % 20 % 3
    form = F.when(third == 0, "huawei").when(third == 1, "generic").otherwise("")
    p = e.select(F.concat(F.lit("^"), "event_type", F.col("user_id") % 20).alias("regex"), form.alias("format"), (F.col("user_id") % 20).alias("u"))
    grouped = lambda where, pick: p.where(where).groupBy("regex").agg(pick("format").alias("format"), F.count("*").alias("count"))
    number = lambda *by: (F.row_number().over(Window.orderBy(*by)) - 1).alias("ord")
    old = grouped("u < 12", F.min).select("*", number("regex", "format"))
    name = F.when(F.col("format") == "", "odd").otherwise(F.format_string("%s_%03d", "format", 3 * F.col("ord")))
    old = old.select("regex", name.alias("name"), "format", (10 + F.col("count") % 7).cast("int").alias("priority"), "count", "ord")
    new = grouped("u >= 8", F.max).select("regex", F.lit("fmt").alias("name"), "format", F.lit(90).alias("priority"), "count", number(F.desc("count"), "regex"))
    return old, new


MERGED = f"""{LIBRARIES}, m AS (SELECT format, max(split_part(name, '_', 2)::INT) AS largest FROM a WHERE name LIKE '%\\_%' ESCAPE '\\' GROUP BY 1),
 n AS (SELECT b.*, CASE WHEN b.format = '' THEN 'generic' ELSE b.format END AS stem FROM b WHERE regex NOT IN (SELECT regex FROM a)),
 f AS (SELECT regex, stem || '_' || lpad((coalesce((SELECT largest FROM m WHERE m.format = stem), -1) + row_number() OVER (PARTITION BY stem ORDER BY count DESC, ord))::VARCHAR, 3, '0') AS name, format, 90::INT AS priority, count, ord FROM n),
 u AS (SELECT a.regex, a.name, a.format, a.priority, a.count + coalesce(b.count, 0) AS count, 0 AS side, a.ord FROM a LEFT JOIN b USING (regex) UNION ALL SELECT regex, name, format, priority, count, 1, ord FROM f)"""


@query(f"WITH {MERGED} SELECT regex, name, format, priority, count, (row_number() OVER (ORDER BY count DESC, side, ord) - 1)::INT AS ord FROM u")
def library_merge(spark, sf_dir):
    return L.merge_frames(*_libraries(spark, sf_dir))


@query(f"WITH {MERGED} SELECT regexp_extract(name, '^(.+)_(\\d+)$', 1) AS stem, max(regexp_extract(name, '^(.+)_(\\d+)$', 2)::INT)::INT AS largest FROM u WHERE regexp_matches(name, '^(.+)_(\\d+)$') GROUP BY 1")
def category_index(spark, sf_dir):
    """The largest number of each category's names, after a merge has counted on from those of the library."""
    return L.largest_numbers(L.merge_frames(*_libraries(spark, sf_dir)))


@query(
    """WITH r AS (SELECT event_type AS field_name, 'p' || (user_id % 50) AS type, CASE WHEN user_id % 2 = 0 THEN 's' ELSE '' END AS format, event_id FROM events),
 o AS (SELECT DISTINCT field_name, type, format FROM r WHERE event_id % 2 = 0), n AS (SELECT DISTINCT field_name, type, format FROM r WHERE event_id % 7 = 0)
 SELECT *, 'old' AS regex FROM o WHERE (field_name, type, format) NOT IN (SELECT (field_name, type, format) FROM n) UNION ALL SELECT *, 'new' FROM n"""
)
def rules_antijoin(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rules = e.select(F.col("event_type").alias("field_name"), F.concat(F.lit("p"), F.col("user_id") % 50).alias("type"), F.when(F.col("user_id") % 2 == 0, "s").otherwise("").alias("format"), "event_id")
    some = lambda n, text: rules.where(F.col("event_id") % n == 0).select("field_name", "type", "format", F.lit(text).alias("regex")).distinct()
    return L.merge_rule_frames(some(2, "old"), some(7, "new"))


@query(
    """WITH p AS (SELECT event_type || (user_id % 20) AS name, user_id, event_id FROM events),
 x AS (SELECT *, row_number() OVER (ORDER BY name) AS ord FROM (SELECT name, list_sort(list_distinct(list((user_id % 7)::VARCHAR))) AS s, (count(*) % 5)::INT AS priority FROM p WHERE user_id % 20 < 12 GROUP BY 1)),
 y AS (SELECT *, row_number() OVER (ORDER BY name) AS ord FROM (SELECT name, list_sort(list_distinct(list((user_id % 11)::VARCHAR))) AS s, (count(*) % 3)::INT AS priority FROM p WHERE user_id % 20 >= 8 GROUP BY 1)),
 z AS (SELECT name, 'old' AS regex, priority, s, 0 AS side, ord FROM x WHERE name NOT IN (SELECT name FROM y)
  UNION ALL SELECT y.name, 'new', y.priority, CASE WHEN x.s IS NULL THEN y.s ELSE x.s || list_filter(y.s, lambda v: NOT list_contains(x.s, v)) END, 1, y.ord FROM y LEFT JOIN x USING (name))
 SELECT name, regex, priority, list_aggregate(s, 'string_agg', ',') AS samples, (row_number() OVER (ORDER BY priority, side, ord) - 1)::INT AS ord FROM z"""
)
def pattern_upsert(spark, sf_dir):
    """Patterns that replace their namesakes, inherit their samples (distinct, in order) and are put in order of priority."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat("event_type", F.col("user_id") % 20).alias("name"), "user_id")

    def library(where: str, n: int, most: int, text: str) -> DataFrame:
        samples = F.array_sort(F.collect_set((F.col("user_id") % n).cast("string")))
        found = e.where(where).groupBy("name").agg(samples.alias("sample_logs"), (F.count("*") % most).cast("int").alias("priority"))
        return found.select("*", F.lit(text).alias("regex"), F.row_number().over(Window.orderBy("name")).alias("ord"))

    out = L.upsert_frames(library("user_id % 20 < 12", 7, 5, "old"), library("user_id % 20 >= 8", 11, 3, "new"))
    return out.select("name", "regex", "priority", F.array_join("sample_logs", ",").alias("samples"), "ord")


@query("SELECT event_type, n, printf('fmt_%03d', (row_number() OVER (ORDER BY n DESC, event_type) - 1)::INT) AS name FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def seq_naming(spark, sf_dir):
    # One row for each type: few.
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()
    groups = [(drain.Template([r["event_type"]], [], r["n"], [r["event_type"]]), {}) for r in counts]
    return spark.createDataFrame([(p.sample, p.count, p.name) for p in drain.to_patterns(groups, least=1)], "event_type string, n long, name string")


@query(f"WITH {E} SELECT count(*) AS total, count(*) FILTER (kind < 3) AS matched, count(*) FILTER (kind = 3) AS unmatched, (count(*) FILTER (kind < 3))::DOUBLE / count(*) AS rate FROM e")
def match_stats(spark, sf_dir):
    return statistics(match(R.lines(spark, sf_dir), R.LIBRARY))


@query(f"WITH {E}, {LINE} SELECT 'no_pattern_matched' AS reason, (event_id // 4 + 1)::BIGINT AS line_no, line AS raw FROM l WHERE kind = 3")
def unmatched_errors(spark, sf_dir):
    return error_entries(unmatched(_parsed(spark, sf_dir))).select("_meta.reason", "_meta.line_no", "raw")


@query(f"WITH {E} SELECT event_id AS row_id, 'HOST' || n AS hostname, '4663' AS event_id, 'inner' AS message_content FROM e WHERE kind = 2")
def nested_unwrap(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, 2, nested=1, fields=["structured_data"])
    inner = F.col("event.structured_data")["nested_syslog"]
    return parsed.select("row_id", *[F.get_json_object(inner, f"$.{c}").alias(c) for c in ("hostname", "event_id", "message_content")])


@query(f"WITH {E} SELECT event_id AS row_id, 'HOST' || n AS hostname, 'inner' AS message_content, '<' || p || '>' || bsd || ' HOST' || n || ' Security-Auditing: 4663: inner' AS syslog FROM e WHERE kind = 2")
def nested_padded(spark, sf_dir):
    """Inner lines with blanks in front and double ones within are stripped, matched once the blanks are single, and shown like that."""
    lines = R.lines(spark, sf_dir, 2).withColumn("value", F.regexp_replace("value", r'ORIGINAL_DATA="(<\d+>\w+) (.*)"$', 'ORIGINAL_DATA="  $1  $2 "'))
    inner = F.col("event.structured_data")["nested_syslog"]
    parsed = parse(lines, R.LIBRARY, [], R.OPTIONS, nested=1)
    return parsed.select("row_id", *[F.get_json_object(inner, f"$.{c}").alias(c) for c in ("hostname", "message_content")], F.get_json_object(inner, "$.parsed_content.syslog").alias("syslog"))


@query(f"WITH {E} SELECT event_id AS row_id, p::INT AS priority, (p // 8)::INT AS facility, (p % 8)::INT AS severity FROM e WHERE kind < 2")
def leading_pri(spark, sf_dir):
    """Headers without a group for the priority: it is read from the beginning of the line."""
    bare = [L.Pattern("rfc", rf"^<\d+>\d+\ (?P<timestamp>{R.STAMP})\ (?P<message>.+)$"), L.Pattern("bsd", rf"^<\d+>\S+\ \d+\ (?P<timestamp>{R.CLOCK})\ (?P<message>.+)$")]
    fields = ["priority", "facility", "severity"]
    parsed = _parsed(spark, sf_dir, patterns=bare, fields=fields).where("pattern_idx IS NOT NULL")
    return parsed.select("row_id", *[f"event.{c}" for c in fields])


@query(f"WITH {E} SELECT event_id AS row_id, year(current_date)::INT AS year, CASE WHEN bsd NOT LIKE 'Feb 29 %' THEN strftime(sec, '%m-%d %H:%M:%S') END AS stamp FROM e WHERE kind IN (1, 2)")
def current_year_stamps(spark, sf_dir):
    """Stamps without a year are of the current one on the source's clock (29 February has none in most years)."""
    parsed = parse(R.lines(spark, sf_dir), R.LIBRARY, [], Options(tz="UTC"), fields=["timestamp"]).where("pattern_name IN ('windows', 'kv')")
    stamp = F.when(~F.col("value").contains("Feb 29 "), F.date_format("event.timestamp", "MM-dd HH:mm:ss"))
    return parsed.select("row_id", F.year("event.timestamp").alias("year"), stamp.alias("stamp"))


@query(
    f"""WITH {E} SELECT event_id AS row_id, event_type AS hostname, event_type AS device_name, event_type AS source_device_name, '10.1.' || high || '.' || low AS device_ip, '10.1.' || high || '.' || low AS source_device_ip,
 level::VARCHAR AS event_id, 'user' AS device_type, 'user' AS source_device_type FROM e WHERE kind = 2"""
)
def rule_devices(spark, sf_dir):
    """Rules that set a device's fields and the event's number also set what is taken from them where a header has none."""
    rules = [
        L.Rule("n", "device_name", type="kv", regex=r'MESSAGE="(\w+) by'),
        L.Rule("i", "device_ip", type="kv", extract_method="kv_parse", kv_key="DVC_ADDRESS"),
        L.Rule("e", "event_id", type="kv", extract_method="kv_parse", kv_key="SEVERITY"),
        L.Rule("t", "device_type", type="kv", regex=r'by (user)"'),
    ]
    fields = ["hostname", "device_name", "source_device_name", "device_ip", "source_device_ip", "event_id", "device_type", "source_device_type"]
    parsed = _parsed(spark, sf_dir, rules=rules, fields=fields).where("pattern_name = 'kv'")
    return parsed.select("row_id", *[f"event.{c}" for c in fields])


def _folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/logloom-{name}-{uuid.uuid4().hex}"


@query(f"WITH {E}, {LINE} SELECT line, p::BIGINT AS priority, CASE kind WHEN 0 THEN 'host' || user_id WHEN 1 THEN 'HOST' || n ELSE '' END AS hostname FROM l WHERE kind < 3")
def json_array_sink(spark, sf_dir):
    """The one JSON array that tasks wrote together, read again."""
    path = _folder(spark, "array")
    write_json_array(events(_parsed(spark, sf_dir, fields=["priority", "hostname", "parsed_content"])), path, R.OPTIONS.tz)
    held = read_json_array(spark, path, "priority long, hostname string, parsed_content struct<syslog: string>")
    return held.select(F.col("parsed_content.syslog").alias("line"), "priority", "hostname")


def _text_files(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of the shared file system with the lines as text files, one for each kind, in the order of their numbers."""
    folder = _folder(spark, "lines")
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(number, "kind").sortWithinPartitions("kind", "line_no").select("kind", "value").write.partitionBy("kind").text(folder)
    return folder


@query(f"WITH {E}, {LINE}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS no FROM l) SELECT kind::INT AS kind, count(*) AS n, max(no) AS last_line, sum(no * length(line))::BIGINT AS weighed FROM r GROUP BY 1")
def text_file_lines(spark, sf_dir):
    """Lines of text files with their numbers; a file that is not there is skipped."""
    folder = _text_files(spark, R.lines(spark, sf_dir))
    lines = read_lines(spark, [f"{folder}/kind=*", f"{folder}/missing.log"], "*.txt")
    kind = F.regexp_extract("path", r"kind=(\d)", 1).cast("int")
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"), F.sum(F.col("line_no") * F.length("value")).alias("weighed"))


BLANKED = "b AS (SELECT kind, event_id // 4 + 1 AS no, CASE WHEN (event_id // 4) % 5 = 0 THEN '' WHEN (event_id // 4) % 5 = 1 THEN ' \t ' ELSE '  ' || line || ' ' END AS line FROM l)"


@query(
    f"""WITH {E}, {LINE}, {BLANKED}, c AS (SELECT kind, no, trim(line, ' ' || chr(9)) AS line FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY no) AS k FROM c WHERE line <> '')
 SELECT kind::INT AS kind, (SELECT count(*) FROM b WHERE b.kind = f.kind AND line <> '') AS not_empty, count(*) AS learned, max(no)::BIGINT AS last_line, sum(length(line))::BIGINT AS characters FROM f WHERE k <= 40 GROUP BY kind"""
)
def blank_lines(spark, sf_dir):
    """Empty lines are not parsed, blank ones not learned from; learning takes the first stripped lines of each file."""
    k = (F.col("line_no") - 1) % 5
    lines = R.lines(spark, sf_dir).withColumn("value", F.when(k == 0, "").when(k == 1, " \t ").otherwise(F.concat(F.lit("  "), "value", F.lit(" "))))
    parsed = not_empty(lines).groupBy("kind").agg(F.count("*").alias("not_empty"))
    learned = not_blank(lines, 40).groupBy("kind").agg(F.count("*").alias("learned"), F.max("line_no").alias("last_line"), F.sum(F.length("value")).alias("characters"))
    return parsed.join(learned, "kind")


@query(
    f"""WITH {E}, {LINE} SELECT event_id AS row_id, p::INT AS priority, (p // 8)::INT AS facility, (CASE kind WHEN 2 THEN level ELSE p % 8 END)::INT AS severity, epoch(sec)::BIGINT AS epoch,
 CASE kind WHEN 2 THEN '192.0.2.' || n ELSE '' END AS syslog_ip, CASE kind WHEN 0 THEN 'host' || user_id WHEN 1 THEN 'HOST' || n ELSE '' END AS device_name,
 CASE kind WHEN 0 THEN event_type || ' port scan' WHEN 1 THEN event_type || ' value=' || n ELSE event_type || ' by user' END AS raw_message,
 CASE kind WHEN 0 THEN {RISK.format("(p % 8)")} WHEN 1 THEN {RISK.format("(p % 8)")} ELSE {RISK.format("level")} END AS risk_level, true AS parse_success, 0::INT AS n_errors, line AS syslog FROM l WHERE kind < 3"""
)
def standardized_event(spark, sf_dir):
    names = ("priority", "facility", "severity", "syslog_ip", "device_name", "raw_message", "risk_level", "parse_success")
    e = _parsed(spark, sf_dir, 0, 1, 2, fields=[*names, "timestamp", "parse_errors", "parsed_content"])
    return e.select("row_id", *[f"event.{n}" for n in names], _epoch(), F.size("event.parse_errors").alias("n_errors"), "event.parsed_content.syslog")


@query(
    f"""WITH {E}, {LINE} SELECT line, strftime(sec, '%Y-%m-%d %H:%M:%S') || '+00:00' AS timestamp, p::VARCHAR AS priority, (CASE kind WHEN 2 THEN level ELSE p % 8 END)::VARCHAR AS severity, CASE kind WHEN 0 THEN 'host' || user_id WHEN 1 THEN 'HOST' || n ELSE '' END AS hostname,
 CASE kind WHEN 0 THEN event_type || ' port scan' WHEN 1 THEN event_type || ' value=' || n ELSE event_type || ' by user' END AS message_content, 'true' AS parse_success, '[]' AS parse_errors, '2024-06-01 00:00:00+00:00' AS received_at, 32::INT AS n_keys FROM l WHERE kind < 3"""
)
def jsonl_sink(spark, sf_dir):
    """The lines of the JSON sink read again: texts of times, fields, and no key for optional fields that are missing."""
    out = as_json(events(_parsed(spark, sf_dir)), R.OPTIONS.tz)
    names = ("timestamp", "priority", "severity", "hostname", "message_content", "parse_success", "parse_errors", "received_at")
    return out.select(F.get_json_object("value", "$.parsed_content.syslog").alias("line"), *[F.get_json_object("value", f"$.{n}").alias(n) for n in names], F.size(F.json_object_keys("value")).alias("n_keys"))


@query(
    f"""WITH {E}, v AS (SELECT kind, lower(event_type || CASE kind WHEN 0 THEN ' port scan ' ELSE ' security-auditing: ' END) AS t, CASE kind WHEN 2 THEN level ELSE p % 8 END AS s FROM e WHERE kind < 3)
 SELECT {KINDS} AS event_type, {RISK.format("s")} AS risk_level, CASE kind WHEN 0 THEN 'rfc5424_json' WHEN 1 THEN 'windows_event' ELSE 'tianrongxin_structured' END AS log_format, count(*) AS n FROM v GROUP BY 1, 2, 3"""
)
def event_rollup(spark, sf_dir):
    fields = ["event_type", "risk_level", "log_format"]
    return events(_parsed(spark, sf_dir, fields=fields)).groupBy(*fields).agg(F.count("*").alias("n"))
