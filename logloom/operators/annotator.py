"""Asking a language model: an interface with retries and cooldown, and an annotator that checks the answers.

No client is part of this package; anything with `ask(prompt, system) -> str` will do.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from logloom.operators.rules import KIND_PATTERNS, SKIPPED, read_answer
from logloom.operators.semantics import HEADER_FIELDS
from logloom.sources.library import Pattern

log = logging.getLogger("logloom")

SYSTEM = "You analyse log lines. Answer with one JSON object and nothing else."
HEADER_PROMPT = "The first tokens of a log line are numbered below. Say which of them are header fields; allowed fields: {fields}.\nAnswer: {{\"fields\": [{{\"position\": 0, \"field_name\": \"...\"}}]}}\nTokens:\n{tokens}\nLines of the same form:\n{samples}"
MAPPING_PROMPT = "Say which fields the messages below hold, each with what guides to it: kv_key (KEY=\"value\"), json_key, token (a label before the value) or keyword (a word before it), and kind, one of {kinds}. message_content may instead have source whole or unknown.{forwarded}\nAnswer: {{\"mappings\": [{{\"field_name\": \"...\", \"kv_key\": \"...\"}}]}}\nMessages:\n{samples}"
FORWARDED = " The messages wrap a forwarded line: priority and severity come from its own <number>; give them inner pri."
REVIEW_PROMPT = "Each entry is a learned log template with its count and a sample. Name as noise only those that clearly are no log line (no priority, time, host or program) and occur twice at most; when in doubt, keep. Say whether the lines wrap forwarded ones.\nAnswer: {{\"noise_names\": [], \"forwarded\": false}}\nTemplates:\n{templates}"
#: Samples or templates shown in one question, and characters of each sample. A review has as many questions as all templates with their whole samples need.
SHOWN, CHARS = 40, 300


class Client(Protocol):
    def ask(self, prompt: str, system: str) -> str: ...


class Asking:
    """JSON answers of a client. Empty, unreadable and failed answers are asked for again, after n times `wait` seconds; calls are `cooldown` seconds apart."""

    def __init__(self, client: Client, cooldown: float = 5.0, retries: int = 3, wait: float = 5.0, enabled: bool = True, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.client, self.cooldown, self.retries, self.wait, self.enabled = client, cooldown, retries, wait, enabled
        self.sleep, self.clock = sleep, clock
        self.last: float | None = None

    def json(self, prompt: str, system: str = SYSTEM, retries: int | None = None) -> dict | None:
        """The answer, or None if there is none after all tries."""
        if not self.enabled:
            return None
        tries = retries or self.retries
        for attempt in range(1, tries + 1):
            if self.last is not None and (rest := self.cooldown - (self.clock() - self.last)) > 0:
                self.sleep(rest)
            try:
                self.last = self.clock()
                text = (self.client.ask(prompt, system) or "").strip()
                if not text:
                    raise ValueError("empty answer")
                found = read_answer(text)
                if isinstance(found, dict):
                    return found
                raise ValueError("no JSON object")
            except Exception as e:
                log.warning("question failed (%d of %d): %s", attempt, tries, e)
            if attempt < tries:
                self.sleep(self.wait * attempt)
        return None


def _shown(samples: Iterable[str]) -> str:
    return "\n".join(s[:CHARS] for s in list(samples)[:SHOWN])


class ModelAnnotator:
    """An annotator that asks a model. Answers that do not keep to the form are left out; no answer names nothing."""

    def __init__(self, asking: Asking, forwarded: bool = False):
        self.asking, self.forwarded = asking, forwarded

    def header_fields(self, tokens: list[str], samples: list[str]) -> dict[int, str]:
        numbered = "\n".join(f"{i}: {t}" for i, t in enumerate(tokens))
        answer = self.asking.json(HEADER_PROMPT.format(fields=", ".join(sorted(HEADER_FIELDS)), tokens=numbered, samples=_shown(samples))) or {}
        found: dict[int, str] = {}
        for entry in _entries(answer, "fields"):
            position, name = entry.get("position"), entry.get("field_name")
            if isinstance(position, int) and not isinstance(position, bool) and 0 <= position < len(tokens) and name in HEADER_FIELDS:
                found.setdefault(position, name)
        return found

    def field_mappings(self, samples: list[str]) -> list[dict]:
        prompt = MAPPING_PROMPT.format(kinds=", ".join(KIND_PATTERNS), forwarded=FORWARDED if self.forwarded else "", samples=_shown(samples))
        answer, kept = self.asking.json(prompt) or {}, []
        guides = ("kv_key", "json_key", "token", "keyword", "source", "inner")
        for entry in _entries(answer, "mappings"):
            own = {k: v for k, v in entry.items() if k in ("field_name", "kind", *guides) and isinstance(v, str) and v}
            if "field_name" in own and own["field_name"] not in SKIPPED and any(g in own for g in guides):
                kept.append(own)
        return kept

    def check_templates(self, patterns: list[Pattern]) -> tuple[list[str], bool]:
        """Names of patterns that are noise, and whether any lines wrap forwarded ones. All patterns are asked about; of a question without an answer nothing is noise."""
        found: list[str] = []
        forwarded = False
        for asked in _questions(patterns):
            listed = "\n".join(json.dumps({"name": p.name, "count": p.count, "sample": p.sample}, ensure_ascii=False) for p in asked)
            answer = self.asking.json(REVIEW_PROMPT.format(templates=listed), retries=2) or {}
            names, noise = {p.name for p in asked}, answer.get("noise_names")
            found += [n for n in map(str, noise if isinstance(noise, list) else []) if n in names]
            forwarded |= answer.get("forwarded") is True
        return found, forwarded


def _questions(patterns: list[Pattern]) -> Iterator[list[Pattern]]:
    """All patterns in their order, cut where a question has SHOWN of them or their samples would be longer than SHOWN times CHARS; a longer sample has its own."""
    asked: list[Pattern] = []
    chars = 0
    for p in patterns:
        if asked and (len(asked) == SHOWN or chars + len(p.sample) > SHOWN * CHARS):
            yield asked
            asked, chars = [], 0
        asked.append(p)
        chars += len(p.sample)
    if asked:
        yield asked


def _entries(answer: dict, name: str) -> list[dict]:
    """The list of objects of an answer, whether it is named or the whole answer was a list."""
    found = answer.get(name, answer.get("_format_list"))
    return [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []


def without_noise(patterns: list[Pattern], annotator: ModelAnnotator) -> list[Pattern]:
    noise = set(annotator.check_templates(patterns)[0])
    return [p for p in patterns if p.name not in noise]
