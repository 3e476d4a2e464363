"""Records from matched lines: header fields by extractor, field rules over the message, derived fields.

Every field is one column, so a query that asks for few of them evaluates few patterns. NULL means missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.functions.regex import translate
from logloom.sources.library import Pattern, Rule

from .match import by_pattern, group_column, match, match_groups, python_groups

GROUPS = ("priority", "severity", "timestamp", "hostname", "event_id", "source_ip", "ip", "program", "message", "json_msg")
#: Groups without which an extractor cannot make a record.
NEEDED = {"rfc5424_json": ("priority", "timestamp", "hostname", "json_msg"), "ip_prefix_syslog": ("priority", "timestamp", "hostname", "program", "event_id", "message")}


@dataclass(frozen=True)
class Options:
    """The source's clock, the year of stamps without one, and what stands for a timestamp that cannot be read."""

    tz: str = "Asia/Shanghai"
    reference_year: int | None = None
    processing_time: str | None = None
    rule_format: str = ""

    @property
    def year(self) -> Column:
        return F.lit(self.reference_year) if self.reference_year else F.year(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), self.tz))

    @property
    def now(self) -> Column:
        return F.lit(self.processing_time).cast("timestamp") if self.processing_time else F.current_timestamp()


@dataclass(frozen=True)
class Fields:
    """What an extractor works on: the captured groups, the line, and the options.

    keep(name, column) makes an intermediate column of its own and gives a reference to it: for what several fields need.
    """

    line: Column
    group: Callable[[str], Column]
    options: Options
    keep: Callable[[str, Column], Column]


Extractor = Callable[[Fields], dict[str, Column]]


def _stamp(f: Fields) -> Column:
    """A captured time; one without its date takes it from the line."""
    text = f.group("timestamp")
    bare = text.rlike(r"^\d{2}:\d{2}:\d{2}(?:\.\d+)?$")
    return F.when(bare, S.moment(F.coalesce(S.bsd_stamp(f.line), text), f.options.tz, f.options.year)).otherwise(S.moment(text, f.options.tz, f.options.year))


def generic(f: Fields) -> dict[str, Column]:
    message = f.keep("message", F.coalesce(f.group("message"), f.line))
    own = f.group("priority").try_cast("int")
    pri = f.keep("pri", F.coalesce(own, S.leading_pri(f.line)))
    own_severity = F.when(own.isNotNull(), f.group("severity").try_cast("int"))
    said = f.keep("said", S.filled(S.stripped(message)))
    inner = f.keep("inner", S.filled(S.json_value(said, "event_content")))
    content = f.keep("content", S.unescape(F.coalesce(inner, said, f.line)))
    decision = F.when(inner.isNotNull(), "JSON 载荷 event_content 字段").when(said.isNotNull(), S.FROM_MESSAGE).otherwise(S.UNDECIDED)
    return {
        "priority": pri, "facility": S.facility(pri), "severity": F.coalesce(own_severity, S.severity(pri)), "timestamp": _stamp(f), "hostname": f.group("hostname"),
        "event_id": f.group("event_id"), "source_ip": f.group("source_ip"), "dvc_event_category": f.group("program"),
        "message": message, "message_content": content, "content": content, "raw_message": S.truncated(content), "decision": decision, "log_format": F.lit("generic"),
    }


def kv_parser(f: Fields) -> dict[str, Column]:
    message = f.group("message")
    pairs = f.keep("pairs", S.kv_pairs(message))
    said, original, given = (f.keep(k, S.filled(S.kv_last(pairs, k.upper()))) for k in ("message", "original_data", "severity"))
    pri = f.keep("pri", S.inner_pri(original))
    content = f.keep("content", F.when(said.isNotNull(), S.unescape(said)).otherwise(message))
    stamp = S.moment(F.coalesce(f.group("timestamp"), S.bsd_stamp(f.line)), f.options.tz, f.options.year)
    return {
        "priority": pri, "facility": S.facility(pri), "severity": F.coalesce(F.when(F.trim(given).rlike(r"^-*\d+$"), F.trim(given).try_cast("int")), S.severity(pri)),
        "timestamp": stamp, "syslog_ip": F.coalesce(f.group("ip"), f.group("source_ip")), "original_data": original,
        "message": message, "message_content": content, "content": F.when(said.isNotNull(), content), "raw_message": S.truncated(content),
        "decision": F.when(said.isNotNull(), "KV 的 MESSAGE 字段").when(message.isNotNull(), S.UNDECIDED), "log_format": F.lit("kv_structured"),
    }


def _with_pri(f: Fields, pri: Column) -> dict[str, Column]:
    return {"priority": pri, "facility": S.facility(pri), "severity": S.severity(pri), "hostname": f.group("hostname")}


def rfc5424_json(f: Fields) -> dict[str, Column]:
    payload = f.group("json_msg")
    stamp = S.moment(f.group("timestamp"), f.options.tz, f.options.year)
    return _with_pri(f, f.group("priority").try_cast("int")) | {"timestamp": stamp, "message_content": payload, "original_data": payload, "json_msg": payload, "log_format": F.lit("rfc5424_json")}


def rfc5424_plain(f: Fields) -> dict[str, Column]:
    message = f.group("message")
    pri = F.coalesce(f.group("priority").try_cast("int"), S.leading_pri(f.line), F.lit(0))
    stamp = S.moment(f.group("timestamp"), f.options.tz, f.options.year)
    return _with_pri(f, pri) | {"timestamp": stamp, "message": message, "message_content": message, "raw_message": S.truncated(message), "decision": F.lit(S.FROM_MESSAGE), "log_format": F.lit("rfc5424_plain")}


def windows_event(f: Fields) -> dict[str, Column]:
    pri, source, message = f.group("priority").try_cast("int"), f.group("program"), f.group("message")
    named = f.group("timestamp").rlike("^[A-Za-z]{3}")
    stamp = F.when(named, f.group("timestamp")).otherwise(F.coalesce(S.bsd_stamp(f.line), f.group("timestamp")))
    content = f.keep("content", S.stripped(message))
    kind = F.when(source.contains("Service_Control_Manager"), "service_control").when(source.contains("Security-Auditing"), "security_audit")
    return _with_pri(f, pri) | {
        "timestamp": S.moment(stamp, f.options.tz, f.options.year), "event_id": f.group("event_id").try_cast("long").cast("string"), "event_type": kind, "module": source, "risk_level": S.risk_of(S.severity(pri)),
        "message_content": content, "content": content, "raw_message": S.truncated(message), "decision": F.lit(S.FROM_MESSAGE), "log_format": F.lit("windows_event"),
    }


#: Extractors by name; more can be added. An unknown name means `generic`.
EXTRACTORS: dict[str, Extractor] = {"generic": generic, "kv_parser": kv_parser, "rfc5424_json": rfc5424_json, "rfc5424_plain": rfc5424_plain, "ip_prefix_syslog": windows_event}

TYPES = {"priority": "int", "facility": "int", "severity": "int", "timestamp": "timestamp"}
BASE = (
    "priority", "facility", "severity", "timestamp", "hostname", "syslog_ip", "source_ip", "event_id", "event_type", "module", "risk_level", "dvc_event_category",
    "message", "message_content", "content", "raw_message", "decision", "original_data", "json_msg", "log_format",
)
#: Fields that only rules set and that events show.
RULE_FIELDS = (
    "event_code", "device_ip", "device_name", "device_type", "source_device_ip", "source_device_name", "source_device_type", "destination_user", "source_user", "data_object_type",
    "file_name", "agent_address", "username", "user_domain", "protocol", "destination_ip", "source_port", "destination_port",
)


@dataclass(frozen=True)
class Message:
    """The text that rules work on, its JSON payload and the payload's top level."""

    text: Column
    payload: Column
    parsed: Column

    def json(self, key: str) -> Column:
        return S.json_at(self.payload, self.parsed, key)


def rule_value(rule: Rule, message: Message) -> Column:
    """What a rule takes from a message; NULL for nothing or an empty text."""
    if rule.extract_method == "kv_parse":
        key = rule.kv_key
        value = message.json(rule.json_key) if rule.json_key else F.coalesce(message.json(key), message.json(key.lower()), S.kv_first(message.text, key))
        return S.filled(value)
    if rule.extract_method == "regex" and rule.regex:
        java = translate(rule.regex, anchored=False)
        if java.python_only:
            return S.filled(python_groups(rule.regex, anchored=False)(message.text)[1 if java.n_groups else 0])
        return S.captured(message.text, java.java, 1 if java.n_groups else 0)
    return F.lit(None).cast("string")


def _applies(rule: Rule, patterns: list[Pattern], options: Options) -> list[int]:
    if options.rule_format and rule.format and rule.format != options.rule_format:
        return []
    return [i for i, p in enumerate(patterns) if not rule.type or not p.name or rule.type == p.name]


def rule_columns(rules: list[Rule], patterns: list[Pattern], message: Message, index: Column, options: Options) -> dict[str, Column]:
    """Each field that rules set: the last rule that applies and finds something wins."""
    found: dict[str, list[Column]] = {}
    for rule in rules:
        if rule.field_name != "message_content" and (where := _applies(rule, patterns, options)):
            found.setdefault(rule.field_name, []).insert(0, F.when(index.isin(where), rule_value(rule, message)))
    return {name: F.coalesce(*values) for name, values in found.items()}


def rule_message(rules: list[Rule], patterns: list[Pattern], message: Message, index: Column, options: Options) -> tuple[Column, Column]:
    """Content and its origin by rules for message_content: first those with a key, in order, then whole texts."""
    content, decision = [], []
    own = [(r, _applies(r, patterns, options)) for r in rules if r.field_name == "message_content"]
    for rule, where in own:
        for key, value, origin in ((rule.json_key, message.json, "JSON 载荷 {} 字段(LLM 标注)"), (rule.kv_key, lambda k: S.kv_first(message.text, k), "KV 的 {} 字段(LLM 标注)")):
            if key and where:
                got = F.when(index.isin(where), S.unescape(value(key)))
                content.append(got)
                decision.append(F.when(got.isNotNull(), origin.format(key)))
    for rule, where in own:
        origin = {"whole": "整个 message 即告警信息(LLM 标注 whole)", "unknown": "无法确定告警信息,输出整句 message(LLM 标注不确定)"}.get(rule.source)
        if origin and where:
            got = F.when(index.isin(where), message.text)
            content.append(got)
            decision.append(F.when(got.isNotNull(), origin))
    none = F.lit(None).cast("string")
    return F.coalesce(none, *content), F.coalesce(none, *decision)


def add_records(lines: DataFrame, patterns: list[Pattern], rules: list[Rule] = (), options: Options = Options(), text: str = "value", prefix: str = "") -> DataFrame:
    """The lines with <prefix>pattern_idx (unless they have it) and a column <prefix>record_<field> for each field, NULL where nothing matches.

    They are columns, not a struct, so that the optimiser keeps each from being worked out once for every use. All are made in one
    select, in which later ones refer to earlier ones by name.
    """
    df = lines if f"{prefix}pattern_idx" in lines.columns else match(lines, patterns, text, prefix)
    made: dict[str, Column] = {f"_{prefix}groups": match_groups(patterns, text, prefix)}
    names = [g for g in GROUPS if any(g in translate(p.regex).groups for p in patterns)]
    made |= {f"_{prefix}g_{g}": group_column(patterns, g, text, prefix, F.col(f"_{prefix}groups")) for g in names}

    def group(name: str) -> Column:
        return F.col(f"_{prefix}g_{name}") if name in names else F.lit(None).cast("string")

    index = F.col(f"{prefix}pattern_idx")
    kinds = [p.extractor if p.extractor in EXTRACTORS else "generic" for p in patterns]
    by_kind = {}
    for kind in dict.fromkeys(kinds):
        own = index.isin([i for i, k in enumerate(kinds) if k == kind])

        def keep(name: str, column: Column, kind: str = kind, own: Column = own) -> Column:
            made[f"_{prefix}k_{kind}_{name}"] = F.when(own, column)
            return F.col(f"_{prefix}k_{kind}_{name}")

        by_kind[kind] = EXTRACTORS[kind](Fields(F.col(text), group, options, keep))
    # An extractor whose groups are missing makes no record, only an error.
    broken = [i for i, p in enumerate(patterns) if any(g not in translate(p.regex).groups for g in NEEDED.get(kinds[i], ()))]
    for name in BASE:
        out = F.lit(None).cast(TYPES.get(name, "string"))
        for kind, columns in by_kind.items():
            where = [i for i, k in enumerate(kinds) if k == kind and i not in broken]
            if name in columns and where:
                out = F.when(index.isin(where), columns[name]).otherwise(out)
        made[f"_{prefix}{name}"] = out

    def at(name: str) -> Column:
        return F.col(f"_{prefix}{name}")

    made[f"_{prefix}input"] = S.filled(F.coalesce(at("message"), at("message_content")))
    made[f"_{prefix}payload"] = S.json_payload(F.coalesce(at("input"), F.col(text)))
    made[f"_{prefix}parsed"] = S.json_object(at("payload"))
    message, ok = Message(at("input"), at("payload"), at("parsed")), ~index.isin(broken) if broken else F.lit(True)
    ruled = rule_columns(list(rules), patterns, message, index, options)
    content, origin = rule_message(list(rules), patterns, message, index, options)
    made |= {f"_{prefix}r_{name}": F.when(ok, value) for name, value in {**ruled, "content": content, "origin": origin}.items()}

    def final(name: str) -> Column:
        given = at(name) if name in BASE else F.lit(None).cast("string")
        if name not in ruled:
            return given
        rule = F.col(f"_{prefix}r_{name}")
        # A value that is set by a rule but cannot be read is missing; the header's does not come back.
        read = S.rule_moment(rule, options.tz) if name == "timestamp" else S.integer(rule) if name in TYPES else rule
        return F.when(rule.isNotNull(), read).otherwise(given)

    out = {name: final(name) for name in (*BASE, *RULE_FIELDS)}
    out["message_content"] = F.coalesce(F.col(f"_{prefix}r_content"), out["message_content"])
    out["decision"] = F.coalesce(F.col(f"_{prefix}r_origin"), out["decision"])
    # A device's fields from each other; only where there is a message.
    there = message.text.isNotNull()
    out["hostname"] = F.coalesce(S.clean(out["hostname"]), F.when(there, S.clean(out["device_name"])))
    for source, target in (("device_name", "source_device_name"), ("device_ip", "source_device_ip"), ("device_type", "source_device_type"), ("event_id", "event_code")):
        out[target] = F.coalesce(S.clean(out[target]), F.when(there, S.clean(out[source])))
    out["device_type"] = F.when(there, S.device_type(out["device_type"])).otherwise(out["device_type"])
    given = by_pattern(patterns, lambda p: p.format, prefix)
    kind = F.coalesce(S.filled(given), at("log_format"))
    refined = F.when(message.parsed.isNotNull(), "rfc5424_json").otherwise("generic")
    out["log_format"] = F.when(ok, F.when(kind.isin("rfc5424_json", "generic"), refined).otherwise(kind))
    out["severity_is_int"] = F.lit(True) if "severity" not in ruled else F.col(f"_{prefix}r_severity").isNull()
    out["pattern_name"] = by_pattern(patterns, lambda p: p.name, prefix)
    out["parse_success"] = ok
    missing = by_pattern(patterns, lambda p: ", ".join(g for g in NEEDED.get(p.extractor, ()) if g not in translate(p.regex).groups), prefix)
    out["parse_errors"] = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("字段提取异常: no such group: "), missing)))
    shown = {"event_id", *BASE, *RULE_FIELDS}
    extra = [F.struct(F.lit(name).alias("key"), F.col(f"_{prefix}r_{name}").alias("value")) for name in ruled if name not in shown]
    pairs = F.filter(F.array(*extra), lambda e: e["value"].isNotNull()) if extra else None
    out["extra"] = F.map_from_entries(pairs) if extra else F.create_map().cast("map<string,string>")
    made |= {f"{prefix}record_{name}": F.when(index.isNotNull(), value) for name, value in out.items()}
    kept = [c for c in (*df.columns, *made) if not c.startswith(f"_{prefix}")]
    return df.select("*", *[column.alias(name) for name, column in made.items()]).select(*kept)


