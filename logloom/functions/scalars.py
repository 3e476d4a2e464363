"""Scalar functions on columns. A missing value is NULL; nothing here raises on bad input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing", month names, and keyword rules of event types in their order.
MISSING = ("unknown", "None", "N/A", "")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
EVENT_TYPE_RULES = (
    (("security_audit", "audit_", "security-auditing", "审计", "安全"), "SECURITY_ALERT"),
    (("登录", "login", "auth", "认证", "logout"), "AUTHENTICATION"),
    (("非法报文", "攻击", "入侵", "alert", "拦截", "威胁"), "SECURITY_ALERT"),
    (("网络", "network", "packet", "mac", "端口", "报文"), "NETWORK_ALERT"),
    (("service_control", "error", "错误", "无法启动", "失败", "fail", "异常"), "SYSTEM_ERROR"),
    (("system", "系统", "服务", "startup", "shutdown", "config", "配置", "操作"), "SYSTEM_EVENT"),
)
RISK_LEVELS = ("critical", "high", "medium", "low", "info")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean(value: Column) -> Column:
    """NULL for texts that mean a missing value."""
    return F.when(~value.isin(*MISSING), value)


def filled(value: Column) -> Column:
    """NULL for an empty text."""
    return F.nullif(value, F.lit(""))


def captured(text: Column, java: str, group: int) -> Column:
    """A group of the first match; NULL without a match or where it is empty."""
    return filled(F.regexp_extract(text, java, group))


def kv_pairs(text: Column) -> Column:
    """All KEY="value" pairs as structs (key in upper case, value with its escapes of quotes and backslashes undone)."""
    pair = r'(?dU)(\w+)="((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all(text, F.lit(pair), F.lit(i)) for i in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(F.upper(k).alias("key"), F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")).alias("value")))


def kv_last(pairs: Column, key: str) -> Column:
    """The value of the last pair with this key."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def kv_first(text: Column, key: str) -> Column:
    """The raw value of the first KEY="value" (the key may end a longer word)."""
    return captured(text, "(?dU)" + java_quote(key) + r'="((?:[^"\\]|\\.)*)"', 1)


def java_quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def json_payload(text: Column) -> Column:
    """From the first brace to a brace that ends the text."""
    return captured(text, r"(?s)(\{.*\}$)", 1)


def json_object(payload: Column) -> Column:
    """The top level of a JSON object as a map of texts (the last of equal keys wins); NULL for anything else."""
    return F.from_json(payload, "map<string,string>")


def is_json_object(text: Column) -> Column:
    return F.coalesce(json_object(json_payload(text)).isNotNull(), F.lit(False))


def json_value(text: Column, key: str) -> Column:
    """A top-level value as text: booleans read True and False, nested values stay JSON text."""
    return let(json_payload(text), lambda p: json_at(p, json_object(p), key))


def json_at(payload: Column, parsed: Column, key: str) -> Column:
    """The same from a payload and its map, where those are columns already."""
    raw = r'"' + java_quote(key) + r'"\s*:\s*(true|false)\b'
    return let(F.try_element_at(parsed, F.lit(key)), lambda v: F.when(v.isin("true", "false") & payload.rlike(raw), F.initcap(v)).otherwise(v))


def kv_or_json(text: Column, key: str) -> Column:
    """From a JSON payload by the key, then by its lower case; otherwise from KEY="value"."""
    return F.coalesce(json_value(text, key), json_value(text, key.lower()), kv_first(text, key))


def unescape(text: Column) -> Column:
    """JSON escapes undone in up to four rounds while any of u, r, n or t is left; text that is no JSON string stays."""

    def once(value: Column, _: Column) -> Column:
        read = F.from_json(F.concat(F.lit('["'), value, F.lit('"]')), "array<string>")
        whole = let(read, lambda r: F.when(F.size(r) == 1, F.element_at(r, 1)).otherwise(value))
        return F.when(value.rlike(r"\\[urnt]"), F.coalesce(whole, value)).otherwise(value)

    return F.when(text.rlike(r"\\[urnt]"), F.aggregate(F.sequence(F.lit(1), F.lit(4)), text, once)).otherwise(text)


def truncated(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# How the origin of the content is described.
UNDECIDED, FROM_MESSAGE = "无法自动决定,已回退整条 message,请人工确认", "message 组内容(告警描述)"


def integer(text: Column) -> Column:
    """An integer of ASCII digits; NULL for anything else (a sign included) and beyond 32 bits."""
    text = F.trim(text)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def moment(text: Column, tz: str, year: Column) -> Column:
    """A timestamp: ISO with Z (read on the source's clock `tz`), ISO with an offset, or `Mon d HH:MM:SS` of `year`. NULL otherwise."""
    return let(F.trim(text), lambda t: _moment(t, tz, year))


def _moment(text: Column, tz: str, year: Column) -> Column:
    iso = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:?\d{2})$"
    bsd = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})$"

    def part(pattern: str, i: int, kind: str = "int") -> Column:
        return F.regexp_extract(text, pattern, i).try_cast(kind)

    zone = F.regexp_extract(text, iso, 7)
    offset = F.when(zone == "Z", F.lit(tz)).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2)))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.initcap(F.regexp_extract(text, bsd, 1)))
    month = F.nullif(named, F.lit(0)).cast("int")
    from_iso = F.try_make_timestamp(part(iso, 1), part(iso, 2), part(iso, 3), part(iso, 4), part(iso, 5), part(iso, 6, "decimal(16,6)"), offset)
    from_bsd = F.try_make_timestamp(year, month, part(bsd, 2), part(bsd, 3), part(bsd, 4), part(bsd, 5, "decimal(16,6)"), F.lit(tz))
    return F.when(text.rlike(iso), from_iso).when(text.rlike(bsd), from_bsd)


def rule_moment(text: Column, tz: str) -> Column:
    """A timestamp that a rule took: ISO with a zone (Z is UTC), ISO without one or `Y-m-d H:M:S` on the source's clock, or seconds since 1970. NULL otherwise."""
    return let(F.trim(text), lambda t: _rule_moment(t, tz))


def _rule_moment(text: Column, tz: str) -> Column:
    zoned = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})(Z|[+-]\d{2}:?\d{2})$"
    local = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2}):(\d{1,2})$"

    def made(pattern: str, zone: Column) -> Column:
        parts = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, 6)]
        return F.try_make_timestamp(*parts, F.regexp_extract(text, pattern, 6).try_cast("decimal(16,6)"), zone)

    zone = F.regexp_extract(text, zoned, 7)
    offset = F.when(zone == "Z", "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2)))
    seconds = text.try_cast("decimal(16,6)")
    since = F.when(text.rlike(r"^\d{1,11}(?:\.\d{1,6})?$") & (seconds > 0), F.timestamp_micros((seconds * 1_000_000).cast("long")))
    return F.when(text.rlike(zoned), made(zoned, offset)).when(text.rlike(local), made(local, F.lit(tz))).otherwise(since)


def bsd_stamp(line: Column) -> Column:
    """The first `Mon d HH:MM:SS` anywhere in a line."""
    found = r"([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
    return filled(F.concat_ws(" ", *[filled(F.regexp_extract(line, found, i)) for i in (1, 2, 3)]))


def leading_pri(line: Column) -> Column:
    return captured(line, r"^<(\d+)>", 1).try_cast("int")


def inner_pri(text: Column) -> Column:
    """The first <n> of one to three digits anywhere."""
    return captured(text, r"<(\d{1,3})>", 1).try_cast("int")


def facility(pri: Column) -> Column:
    return F.floor(pri / 8).cast("int")


def severity(pri: Column) -> Column:
    return (pri % 8).cast("int")


def risk_of(severity_: Column, upper: bool = False) -> Column:
    """Risk by severity: 0 and 1 are critical, 4 is low, above is info."""
    names = [n.upper() if upper else n for n in RISK_LEVELS]
    return F.when(severity_ <= 1, names[0]).when(severity_ == 2, names[1]).when(severity_ == 3, names[2]).when(severity_ == 4, names[3]).otherwise(names[4])


def risk_level(given: Column, severity_: Column, severity_is_int: Column) -> Column:
    """A given level, else by a severity that is a number (one taken as text by a rule does not count)."""
    named = F.when(F.lower(given).isin(*RISK_LEVELS), F.upper(given))
    return F.coalesce(named, F.when(severity_is_int, risk_of(severity_, upper=True)), F.lit("INFO"))


def device_type(value: Column) -> Column:
    return F.when(value.rlike("Windows|Microsoft"), "windows_server").when(value.contains("OS"), "operating_system").when(F.lower(value).contains("network"), "network_device").otherwise(value)


def inferred_event_type(source: Column) -> Column:
    lower = F.lower(source)
    return F.when(lower.contains("security"), "security_audit").when(lower.contains("service_control"), "service_control")


def event_type(internal: Column, content: Column) -> Column:
    """By the internal type where it is a keyword, else by the first rule with a keyword in the content."""
    kind, text = F.lower(internal), F.lower(F.coalesce(content, F.lit("")))
    out = F.when(F.lit(False), "")
    for words, name in EVENT_TYPE_RULES:
        out = out.when(kind.isin(*words), name)
    for words, name in EVENT_TYPE_RULES:
        out = out.when(text.rlike("|".join(words)), name)
    return out.otherwise("UNKNOWN")


def nested_shape(text: Column) -> Column:
    """Whether a text looks like a whole syslog line: PRI, time and host."""
    shape = r"(?dU)^\s*<\d+>(?:\d+\s+)?(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+"
    return F.coalesce(text.rlike(shape) & (F.length(text) > 20), F.lit(False))


def numeric_kv(text: Column, key: str) -> Column:
    """Whether the key, as a word, has a whole number in KEY = n or KEY = "n", or alone in "key": n."""
    k = java_quote(key)
    return text.rlike(rf'(?i)\b{k}(?U:\s*)=(?U:\s*)"?-?\d+"?|"{k}"(?U:\s*):(?U:\s*)-?\d+(?=[,}}\s]|$)')
