"""Tokens of a line and their classes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a line that count, and those that form its path.
MOST, PREFIX = 64, 6

# The class of each token form, in the order in which they are tried.
CLASSES = (
    (r"^<\d+>$", "<PRI>"),
    (r"^<\d+>\d+$", "<PRI>"),
    (r"^<\d+>\w+$", "<PRI>"),
    (r"^\d{1,3}(?:\.\d{1,3}){3}$", "<IP>"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "<ISOTIME>"),
    (r"^\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?$", "<TIME>"),
    (r"^0x[0-9a-fA-F]+$", "<HEX>"),
    (r"^\d+(?:\.\d+)?$", "<NUM>"),
)
KV_TOKEN = r'^([A-Z][A-Z0-9_]{2,})="'
VARIABLE_CLASSES = ("<PRI>", "<IP>", "<ISOTIME>", "<TIME>", "<HEX>", "<NUM>")
MESSAGE_FORMS = ((r"^\d{1,3}(\.\d{1,3}){3}$", "<IP>"), (r"^\d+$", "<NUM>"), (r"^[0-9a-fA-F]+$", "<HEX>"))


def tokens(line: Column) -> Column:
    """Runs of anything but white space, MOST at most."""
    return F.slice(F.regexp_extract_all(line, F.lit(r"(?U)(\S+)"), F.lit(1)), 1, MOST)


def separators(line: Column) -> Column:
    """The white space between the tokens."""
    return F.slice(F.regexp_extract_all(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), F.lit(r"(?U)(\s+)"), F.lit(1)), 1, MOST - 1)


def token_class(token: Column) -> Column:
    typed = F.when(F.lit(False), "")
    for pattern, name in CLASSES:
        typed = typed.when(token.rlike("(?U)" + pattern), name)
    # All typed forms begin with a digit or an angle bracket.
    out = F.when(token.rlike(r"^\p{L}+$"), "<WORD>").when(token.rlike(r"(?U)^[<\d]"), typed.otherwise("<OTHER>"))
    return out.when(token.rlike(KV_TOKEN), F.concat(F.lit("KV:"), F.regexp_extract(token, KV_TOKEN, 1))).otherwise("<OTHER>")


def path_key(line_tokens: Column) -> Column:
    """The classes of the first tokens: lines with different ones never share a template."""
    return F.array_join(F.transform(F.slice(line_tokens, 1, PREFIX), token_class), " ")


def message_signature(message: Column) -> Column:
    """The first three tokens of a message, numbers and addresses by their form."""

    def form(token: Column) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, name in MESSAGE_FORMS:
            out = out.when(token.rlike(pattern), name)
        return out.otherwise(token)

    return F.array_join(F.transform(F.slice(tokens(message), 1, 3), form), " ")


def format_category(line: Column) -> Column:
    """The kind of format that a line's header shows."""
    day_time = r"[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
    n = F.size(tokens(line))
    kv = line.rlike(r'(?U)\w+="')
    return (
        F.when((n >= 3) & line.rlike(r"(?U)^\s*<\d+>\d+\s+\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.when(line.rlike(r"(?s)\{.*\}$"), "rfc5424_json").otherwise("generic"))
        .when((n >= 6) & line.rlike(r"(?U)^\s*<\d+>\w+\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"), "windows_event")
        .when(line.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\d*`"), "backtick_separated")
        .when(line.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}<"), "ip_prefixed_syslog")
        .when(line.contains("%%"), "huawei")
        .when((n >= 3) & line.rlike(rf"(?U)^\s*{day_time}"), F.when(kv, "tianrongxin_structured").otherwise("generic"))
        .when(kv, "tianrongxin_structured")
        .otherwise("generic")
    )
