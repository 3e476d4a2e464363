"""Settings from the environment, and from a file of NAME=value lines where one is given; the environment wins."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "LOGLOOM_"


@dataclass(frozen=True)
class Settings:
    """Paths of libraries and results, the source's clock, and how an annotator is asked. Each is read from LOGLOOM_<NAME>."""

    patterns: str = "stage1_patterns.yaml"
    rules: str = "stage2_patterns.yaml"
    output: str = "result"
    tz: str = "Asia/Shanghai"
    #: package.module:name of a callable that gives an annotator; empty for none.
    annotator: str = ""
    annotator_enabled: bool = True
    cooldown_seconds: float = 5.0
    retries: int = 3
    retry_seconds: float = 5.0
    #: Lines without a pattern after which a stream's learner is called, and seconds without new ones after which it is called earlier.
    learn_after_lines: int = 50
    learn_after_idle_seconds: float = 3.0
    #: The share of lines that a learned library should match; below it the command line says so.
    coverage: float = 0.98

    @staticmethod
    def read(path: str = ".env", environment: dict[str, str] | None = None) -> Settings:
        given = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    name, sign, value = line.strip().partition("=")
                    if sign and not name.startswith("#"):
                        given[name.strip()] = value.strip().strip("\"'")
        given |= os.environ if environment is None else environment
        return Settings(**{f.name: _as(f.type, given[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in given})


def _as(kind: str, text: str) -> str | bool | int | float:
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind, str)(text)
