"""Whole events from hand-derived lines."""

import json

import pytest

from logloom.operators.extract import Options
from logloom.plans.parse import events, parse, unmatched
from logloom.sources.library import Pattern, Rule
from logloom.sources.sinks import as_json, error_entries

PW = Pattern("win", r"^<(?P<priority>\d+)>\S+\ \d+\ (?P<timestamp>\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\ (?P<hostname>\S+)\ (?P<program>Security\-Auditing:)\ (?P<event_id>\d+):(?P<message>.+)$", format="windows_event")
PR = Pattern("rfc", r"^<(?P<priority>\d+)>\d+\ (?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\ (?P<hostname>\S+)(?P<message>.+)$", format="rfc5424_json")
PK = Pattern("kv", r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\ \d+\ \d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\ (?P<source_ip>\d{1,3}(?:\.\d{1,3}){3})(?P<message>.+)$", extractor="kv_parser", format="tianrongxin_structured")
LIBRARY = [PW, PR, PK]
OPTIONS = Options(reference_year=2023, processing_time="2001-02-03 04:05:06+00:00")
G1 = "<29>Jun 19 15:04:51 HOST01 Security-Auditing: 4656: handle requested"
G2 = '<25>1 2025-06-19T15:04:51Z DVC01 2 - - {"dev_ip":"192.0.2.5","level":3,"event_content":"port scan"}'
G4 = 'Jun 1 00:04:18 192.0.2.254 DVC_ADDRESS="192.0.2.7" MESSAGE="user login" SEVERITY="4" ORIGINAL_DATA="<29>Apr  2 09:31:05 HOST01 Security-Auditing: 4663: x"'


def one(spark, line, patterns=LIBRARY, rules=(), nested=0):
    lines = spark.createDataFrame([(line, "f", 1)], "value string, path string, line_no long")
    parsed = parse(lines, patterns, list(rules), OPTIONS, nested)
    return json.loads(as_json(events(parsed)).first()["value"])


def has(event, **wanted):
    assert {k: event.get(k) for k in wanted} == wanted


def test_generic_windows_line(spark):
    e = one(spark, G1)
    has(e, priority=29, facility=3, severity=5, timestamp="2023-06-19 15:04:51+08:00", event_id="4656", syslog_ip="", dvc_event_category="Security-Auditing:")
    has(e, **dict.fromkeys(("hostname", "device_ip", "device_name", "source_device_ip", "source_device_name"), "HOST01"))
    has(e, message_content="handle requested", raw_message="handle requested", event_type="SECURITY_ALERT", risk_level="INFO", log_format="windows_event", parse_success=True, parse_errors=[])
    assert e["parsed_content"] == {"syslog": G1} and "username" not in e and len(e) == 32


def test_json_payload(spark):
    has(one(spark, G2), priority=25, facility=3, severity=1, hostname="DVC01", timestamp="2025-06-19 15:04:51+08:00", message_content="port scan", message_content_decision="JSON 载荷 event_content 字段", log_format="rfc5424_json", event_type="UNKNOWN", risk_level="CRITICAL")


def test_rules_set_fields_and_text_severity_gives_info(spark):
    rules = [Rule("dev_ip", "device_ip", extract_method="kv_parse", json_key="dev_ip"), Rule("level", "severity", extract_method="kv_parse", json_key="level")]
    has(one(spark, G2, rules=rules), device_ip="192.0.2.5", source_device_ip="192.0.2.5", severity=3, facility=3, risk_level="INFO")


def test_kv_line(spark):
    has(one(spark, G4), syslog_ip="192.0.2.254", source_ip="", hostname="", timestamp="2023-06-01 00:04:18+08:00", priority=29, facility=3, severity=4, risk_level="LOW", message_content="user login", message_content_decision="KV 的 MESSAGE 字段", event_type="SECURITY_ALERT", log_format="tianrongxin_structured")


def test_nested_line_is_found_after_white_space_is_made_single(spark):
    inner = json.loads(one(spark, G4, nested=1)["structured_data"]["nested_syslog"])
    has(inner, event_id="4663", hostname="HOST01", message_content="x")


def test_plain_text(spark):
    has(one(spark, "<14>1 2025-06-19T15:04:51Z DVC01 plain text"), log_format="generic", message_content="plain text", severity=6, risk_level="INFO")


@pytest.mark.parametrize("line", ["<14>1 2025-06-19T15:04:51 DVC01 x", "<29>Feb 29 01:01:01 HOST01 Security-Auditing: 4656: x"])
def test_unreadable_time_is_processing_time(spark, line):
    has(one(spark, line), timestamp="2001-02-03 12:05:06+08:00")


def test_empty_lines_and_errors(spark):
    lines = spark.createDataFrame([("", "f", 1), ("   ", "f", 2), (G1, "f", 3)], "value string, path string, line_no long")
    parsed = parse(lines, LIBRARY, [], OPTIONS)
    assert parsed.count() == 2
    assert [tuple(r["_meta"]) + (r["raw"],) for r in error_entries(unmatched(parsed)).collect()] == [("no_pattern_matched", 2, "   ")]


def test_missing_group_is_an_error_in_the_event(spark):
    broken = Pattern("b", PR.regex, extractor="rfc5424_json")
    e = one(spark, G2, [broken])
    has(e, parse_success=False, message_content="")
    assert len(e["parse_errors"]) == 1


def test_first_match_by_order_and_python_only_pattern(spark):
    odd = Pattern("odd", r"^(<)?(?(1)\d+>|\d+ )(?P<message>[[a-z].+)$")
    has(one(spark, "<3>abc", [PW, odd]), message_content="abc", priority=3)


def test_message_rules(spark):
    rules = [Rule("m", "message_content", extract_method="message_content", source="whole"), Rule("m", "message_content", type="rfc", extract_method="message_content", json_key="event_content")]
    has(one(spark, G2, rules=rules), message_content="port scan", message_content_decision="JSON 载荷 event_content 字段(LLM 标注)")
    has(one(spark, G1, rules=rules), message_content=" handle requested", message_content_decision="整个 message 即告警信息(LLM 标注 whole)")


def test_empty_library(spark):
    lines = spark.createDataFrame([(G1, "f", 1)], "value string, path string, line_no long")
    assert unmatched(parse(lines, [], [], OPTIONS)).count() == 1


def test_inner_line_is_stripped_and_shown_as_matched(spark):
    line = G4.replace('"<29>Apr  2', '"  <29>Apr  2')
    inner = json.loads(one(spark, line, nested=1)["structured_data"]["nested_syslog"])
    has(inner, event_id="4663", parsed_content={"syslog": "<29>Apr 2 09:31:05 HOST01 Security-Auditing: 4663: x"})


@pytest.mark.parametrize("text, stamp", [("2025-06-19 15:04:51", "2025-06-19 15:04:51+08:00"), ("2025-06-19T15:04:51", "2025-06-19 15:04:51+08:00"), ("2025-06-19T15:04:51+0200", "2025-06-19 21:04:51+08:00"), ("1750316691", "2025-06-19 15:04:51+08:00"), ("soon", "2001-02-03 12:05:06+08:00")])
def test_times_that_rules_take(spark, text, stamp):
    rules = [Rule("t", "timestamp", regex=r"at=([^;]+);")]
    has(one(spark, f"<29>Jun 19 15:04:51 HOST01 Security-Auditing: 4656: at={text};", rules=rules), timestamp=stamp)


def test_rules_that_only_python_can_evaluate(spark):
    rules = [Rule("u", "username", regex=r"user=([[a-z]+)"), Rule("f", "file_name", regex=r"[[a-z]+\.txt")]
    has(one(spark, G1.replace("handle requested", "user=bob took a.txt"), rules=rules), username="bob", file_name="a.txt")
