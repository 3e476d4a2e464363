"""The event schema, and its projection from a record."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.operators.extract import Options

#: Fields that an event only has where they are set.
OPTIONAL = ("username", "user_domain", "protocol", "destination_ip", "source_port", "destination_port")


def event(record: str, line: str, options: Options = Options(), nested: Column | None = None, wanted: Collection[str] | None = None) -> Column:
    """The struct of an event from the columns <record>_<field> and the line column; NULL for no record. wanted: the fields to build, if not all."""

    class Record:
        def __getitem__(self, name: str) -> Column:
            return F.col(f"{record}_{name}")

    r = Record()
    empty = F.lit("")

    def text(*names: str) -> Column:
        return F.coalesce(*[S.clean(r[n]) for n in names], empty)

    content = text("message_content", "content")
    raw = F.coalesce(S.filled(r["raw_message"]), F.substring(content, 1, 500))
    scanned = F.concat_ws(" ", *[F.coalesce(r[n], empty) for n in ("message_content", "dvc_event_category", "content", "message")])
    internal = F.coalesce(S.clean(r["event_type"]), S.inferred_event_type(F.coalesce(*[S.clean(r[n]) for n in ("module", "dvc_event_category")])))
    payload = F.map_from_entries(F.filter(F.array(F.struct(F.lit("json_msg").alias("key"), r["json_msg"].alias("value"))), lambda e: e["value"].isNotNull()))
    if nested is not None:
        payload = F.when(nested.isNotNull(), F.map_concat(payload, F.create_map(F.lit("nested_syslog"), nested))).otherwise(payload)
    fields = {
        "priority": lambda: F.coalesce(r["priority"], F.lit(0)),
        "facility": lambda: F.coalesce(r["facility"], F.lit(0)),
        "severity": lambda: F.coalesce(r["severity"], F.lit(0)),
        "timestamp": lambda: F.coalesce(r["timestamp"], options.now),
        "syslog_ip": lambda: text("syslog_ip"),
        "hostname": lambda: text("hostname"),
        "event_id": lambda: text("event_id", "event_code"),
        "device_ip": lambda: text("device_ip", "hostname"),
        "device_name": lambda: text("device_name", "hostname"),
        "device_type": lambda: S.device_type(text("device_type")),
        "source_device_ip": lambda: text("source_device_ip", "device_ip", "hostname"),
        "source_device_name": lambda: text("source_device_name", "device_name", "hostname"),
        "source_device_type": lambda: text("source_device_type", "device_type"),
        "structured_data": lambda: payload,
        "original_data": lambda: text("original_data"),
        "message_content": lambda: content,
        "raw_message": lambda: raw,
    }
    fields |= {n: lambda n=n: text(n) for n in ("source_ip", "destination_user", "source_user", "data_object_type", "file_name", "dvc_event_category", "agent_address")}
    fields |= {
        "event_type": lambda: S.event_type(internal, scanned),
        "risk_level": lambda: S.risk_level(r["risk_level"], r["severity"], r["severity_is_int"]),
        "received_at": lambda: options.now,
        "parse_success": lambda: r["parse_success"],
        "parse_errors": lambda: r["parse_errors"],
        "log_format": lambda: F.coalesce(S.clean(r["log_format"]), F.lit("unknown")),
        "message_content_decision": lambda: F.coalesce(S.clean(r["decision"]), empty),
        "parsed_content": lambda: F.struct(F.col(line).alias("syslog")),
    }
    fields |= {n: lambda n=n: S.integer(r[n]) if n.endswith("_port") else S.clean(r[n]) for n in OPTIONAL}
    return F.when(r["parse_success"].isNotNull(), F.struct(*[value().alias(name) for name, value in fields.items() if wanted is None or name in wanted]))
