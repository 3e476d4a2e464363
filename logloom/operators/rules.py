"""Field rules: what guides to fields in messages, groups of like messages, and rules from an annotator's mappings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import numeric_kv
from logloom.functions.tokens import message_signature
from logloom.sources.library import Pattern, Rule

# Forms of guide words, and patterns for the kinds of values.
KV_KEY, CN_LABEL = r'\b([A-Z][A-Z0-9_]{2,})="', "(?<!\\S)([一-鿿]{1,8})[:：]"
KIND_PATTERNS = {
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}",
    "port": r"\d{1,5}",
    "protocol": r"[A-Za-z0-9+/._-]+",
    "username": r"\S+",
    "path": r"\S+",
    "number": r"\d+",
    "time": r"\d{2}:\d{2}(?::\d{2})?",
    "text": r".+",
}
SKIPPED, NUMERIC, LONGEST_TOKEN = {"original_data", "raw_message"}, {"facility", "severity", "priority"}, 40
#: Kinds whose own pattern a rule takes behind a label, and behind a keyword.
LABEL_KINDS, KEYWORD_KINDS = ("ip", "port", "protocol"), ("ip", "protocol")
STABLE_FORMS = 4


def guide_forms(messages: DataFrame, limit: int = 500, by: tuple[str, ...] = ()) -> DataFrame:
    """One row on the first `limit` messages (in the order of path and line_no): keys, labels, share of free texts, forms and the verdict. by: one for each value of these columns."""
    if by:
        order = Window.partitionBy(*by).orderBy("path", "line_no")
        some = messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    else:
        some = messages.orderBy("path", "line_no").limit(limit)
    own = some.select(*by, F.array_sort(F.array_distinct(F.regexp_extract_all("message", F.lit(KV_KEY), F.lit(1)))).alias("k"), F.array_sort(F.array_distinct(F.regexp_extract_all("message", F.lit(CN_LABEL), F.lit(1)))).alias("l"))
    free = F.avg(((F.size("k") == 0) & (F.size("l") == 0)).cast("double"))
    agg = own.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("k")))).alias("kv_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("cn_labels"),
        F.round(F.coalesce(free, F.lit(0.0)), 3).alias("free_text_ratio"),
        F.count_distinct("k").alias("k_forms"),
        F.count_distinct("l").alias("l_forms"),
    )
    by_key = F.size("kv_keys") >= 2
    forms = F.when(by_key, F.col("k_forms")).otherwise(F.col("l_forms"))
    return agg.select(*by, "kv_keys", "cn_labels", "free_text_ratio", F.when(by_key, F.size("kv_keys")).otherwise(F.size("cn_labels")).alias("total_forms"), forms.alias("n_line_sigs"), F.when(forms <= STABLE_FORMS, "stable").otherwise("mixed").alias("verdict"))


def message_groups(messages: DataFrame, most: int = 8, each: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(rank, signature, size, samples): the largest groups of messages by signature (first seen first), with their first messages. by: of each value of these columns."""
    signed = messages.select(*dict.fromkeys([*by, "path", "line_no", "message"]), message_signature(F.col("message")).alias("signature"))
    key = [*by, "signature"]
    sizes = signed.groupBy(*key).agg(F.count("*").alias("size"), F.min(F.struct("path", "line_no")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "first"))
    top = (sizes if by else sizes.orderBy(F.desc("size"), "first").limit(most)).withColumn("rank", rank).where(F.col("rank") <= most)
    order = Window.partitionBy(*key).orderBy("path", "line_no")
    numbered = signed.join(top if by else F.broadcast(top), key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    return numbered.groupBy(*by, "rank", "signature", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda x: x["message"]).alias("samples"))


def usable_mappings(mappings: Iterable[dict], samples: DataFrame | None = None, has_number: Callable[[str], bool] | None = None) -> list[dict]:
    """Mappings without skipped fields, over-long tokens, and numeric fields whose key has no number in the samples (column message), or by has_number."""
    if samples is not None:
        has_number = lambda key: samples.agg(F.max(numeric_kv(F.col("message"), key))).first()[0]
    kept = []
    for m in mappings:
        name, key = m.get("field_name"), m.get("kv_key")
        if not name or name in SKIPPED or not key and len(str(m.get("token") or "")) > LONGEST_TOKEN:
            continue
        if name in NUMERIC and key and has_number and not has_number(key):
            continue
        kept.append(m)
    return kept


def _message_rule(m: dict) -> dict | None:
    """What carries the message, of one mapping: the whole text, an unknown part, or one key; none of them gives no rule."""
    if m.get("source") in ("whole", "unknown"):
        return {"source": m["source"]}
    return next(({k: m[k]} for k in ("kv_key", "json_key") if m.get(k)), None)


def _value_pattern(name: str, kind: str, kinds: tuple[str, ...], numbers: tuple[str, ...]) -> str:
    if kind in kinds and name not in ("severity", "priority"):
        return KIND_PATTERNS[kind]
    return r"\d+" if name in ("severity", "priority") or kind in numbers else r"\S+"


def build_rules(pattern_name: str, mappings: Iterable[dict], tag: str = "") -> list[Rule]:
    """Rules for a pattern; the first mapping of a field that gives one counts, one without a guide word gives none.

    A label takes addresses, ports and protocols by their own patterns and else a run without white space; a keyword takes addresses
    and protocols by theirs, whole numbers for numbers and ports, and else such a run. Severity and priority are whole numbers.
    """
    rules: dict[str, Rule] = {}
    for m in mappings:
        name, kind = m.get("field_name"), m.get("kind", "text")
        if not name or name in rules:
            continue
        base = {"name": name, "field_name": name, "type": pattern_name, "format": tag}
        if name == "message_content":
            if carrier := _message_rule(m):
                rules[name] = Rule(**base, extract_method="message_content", **carrier)
        elif m.get("inner") == "pri":
            rules[name] = Rule(**base, extract_method="inner_pri")
        elif m.get("kv_key"):
            rules[name] = Rule(**base, extract_method="kv_parse", kv_key=m["kv_key"])
        elif m.get("json_key"):
            rules[name] = Rule(**base, extract_method="kv_parse", json_key=m["json_key"])
        elif m.get("token"):
            # For labels, the kind decides before the field does.
            value = KIND_PATTERNS[kind] if kind in LABEL_KINDS else _value_pattern(name, kind, (), ())
            rules[name] = Rule(**base, regex=rf"{re.escape(m['token'])}[:：]?\s*({value})")
        elif m.get("keyword"):
            value = _value_pattern(name, kind, KEYWORD_KINDS, ("number", "port"))
            rules[name] = Rule(**base, regex=rf"\b{re.escape(m['keyword'])}[=:\s]+\s*({value})")
    return list(rules.values())


def copied(rules: list[Rule], patterns: list[Pattern], tag: str) -> list[Rule]:
    """The rules of a file for each of its patterns."""
    return [Rule(**{**r.__dict__, "type": p.name, "format": tag}) for p in patterns for r in rules]


def read_answer(text: str) -> dict | list:
    """JSON out of a model's answer: without its thoughts and code fence, else from the first brace to the last."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text).strip()
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", text)
    try:
        found = json.loads(text)
    except ValueError:
        start, stop = text.find("{"), text.rfind("}")
        if start < 0 or stop < start:
            raise
        found = json.loads(text[start : stop + 1])
    return {"_format_list": found} if isinstance(found, list) else found
