"""What the places of a header mean: preset layouts, or an annotator's answer."""

from __future__ import annotations

import re
from typing import Protocol

from logloom.functions.scalars import MONTH_NAMES as MONTH_NAMES
from logloom.functions.tokens import CLASSES, KV_TOKEN, VARIABLE_CLASSES

#: Lines that a template must have before an annotator is asked about it, and questions asked in one run.
LEAST_LINES, MOST_QUESTIONS = 20, 5

# Forms of header tokens, names of header fields, and bounded word lists.
PRI_NUMBER, PRI_WORD, DAY, MONTH = r"<\d+>\d+", r"<\d+>\w+", r"\d{1,2}", r"[A-Za-z]{3}"
ISO_START, CLOCK_START, ADDRESS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*", r"\d{2}:\d{2}:\d{2}.*", r"\d{1,3}(?:\.\d{1,3}){3}"
HEADER_FIELDS = frozenset({"timestamp", "hostname", "program", "event_id", "source_ip", "priority", "severity", "message"})
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
LEVELS = ("notice", "error", "warn", "warning", "debug", "info", "crit", "critical", "alert", "emerg", "emergency", "verbose", "none")
BRACKET_DAY = rf"\[(?:{'|'.join(DAY_NAMES)})"
LEVEL = rf"\[(?:{'|'.join(LEVELS)})\]"

#: Layouts: least number of tokens, the forms of the first ones, and the fields by place.
LAYOUTS = (
    (3, (PRI_NUMBER, ISO_START), {1: "timestamp", 2: "hostname"}),
    (6, (PRI_WORD, DAY, CLOCK_START), {2: "timestamp", 3: "hostname", 4: "program", 5: "event_id"}),
    (4, (MONTH, DAY, CLOCK_START, ADDRESS), {3: "source_ip"}),
    (4, (MONTH, DAY, CLOCK_START), {2: "timestamp", 3: "hostname"}),
    (4, (BRACKET_DAY, MONTH, DAY, CLOCK_START), {3: "timestamp"}),
    (3, (r"\[\d{1,2}\.\d{1,2}", r"\d{2}:\d{2}:\d{2}\]"), {1: "timestamp", 2: "program"}),
)

class Annotator(Protocol):
    """Names header places and message fields. An implementation may call a language model; none is part of this package."""

    def header_fields(self, tokens: list[str], samples: list[str]) -> dict[int, str]: ...

    def field_mappings(self, samples: list[str]) -> list[dict]: ...


#: The typed classes, each as a group, in the order in which they are tried.
TYPED = re.compile("|".join(f"({pattern})" for pattern, _ in CLASSES))


def token_class(token: str) -> str:
    """The class of a token (as functions.tokens.token_class)."""
    # All typed forms begin with a digit or an angle bracket.
    if (token[:1] == "<" or token[:1].isdigit()) and (typed := TYPED.match(token)):
        return CLASSES[typed.lastindex - 1][1]
    if token.isalpha():
        return "<WORD>"
    kv = re.match(KV_TOKEN, token)
    return f"KV:{kv[1]}" if kv else "<OTHER>"


def varies(token: str) -> bool:
    """Whether a token stands for changing values: a wildcard, a typed value, anything with a digit."""
    return token == "<*>" or token_class(token) in VARIABLE_CLASSES or any(c.isdigit() for c in token)


def layout(tokens: list[str]) -> dict[int, str]:
    """The fields of the first layout that the tokens have."""
    for least, forms, found in LAYOUTS:
        if len(tokens) >= least and all(re.fullmatch(form, token, re.S) for form, token in zip(forms, tokens, strict=False)):
            found = dict(found)
            if forms == (MONTH, DAY, CLOCK_START) and len(tokens) > 4 and tokens[4].endswith(":"):
                found[4] = "program"
            return found
    return {}


def preset(template) -> dict[int, str]:
    """Fields of a template by the layouts; a PRI at the front is the priority."""
    tokens = template.samples[0].split() if template.samples else list(template.tokens)
    found = layout(tokens)
    if found and tokens and re.fullmatch(r"<\d+>\S*", tokens[0]):
        found[0] = "priority"
    return found


class Annotated:
    """Layouts first; for templates with enough lines, an annotator's answer on their form of header."""

    def __init__(self, known: dict[tuple, dict[int, str]]):
        self.known = known

    def __call__(self, template) -> dict[int, str]:
        if found := preset(template):
            return found
        return {} if template.count < LEAST_LINES else self.known.get(header_form(template), {})


def header_form(template) -> tuple:
    return tuple(token_class(t) for t in _sample_tokens(template)[:6])


def _sample_tokens(template) -> list[str]:
    return template.samples[0].split() if template.samples else list(template.tokens)


def annotated(annotator: Annotator, templates: list, most: int = MOST_QUESTIONS) -> Annotated:
    """Ask the annotator about the templates that have enough lines and no layout, once for each form of header, `most` times at most."""
    known: dict[tuple, dict[int, str]] = {}
    for t in templates:
        if t.count < LEAST_LINES or preset(t) or (form := header_form(t)) in known or len(known) >= most:
            continue
        toks = _sample_tokens(t)
        answer = annotator.header_fields(toks, list(t.samples))
        known[form] = {int(k): v for k, v in answer.items() if v in HEADER_FIELDS and 0 <= int(k) < len(toks)}
    return Annotated(known)
