"""Pattern dialects: library patterns are written for Python, Spark evaluates Java ones."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class JavaPattern:
    """A pattern in Java syntax, the number of each named group, and whether only Python can evaluate it."""

    source: str
    java: str
    groups: dict[str, int]
    n_groups: int
    python_only: bool


@functools.lru_cache(maxsize=1 << 14)
def translate(source: str, anchored: bool = True) -> JavaPattern:
    """Translate a Python pattern. anchored: it must match from the start of the text.

    Names become numbers (Java names cannot hold an underscore); `(?dU)` makes the dot stop at line feeds alone and
    the classes \\w, \\d and \\s cover Unicode, as Python's do.
    """
    compiled = re.compile(source)
    out, i, in_class, python_only = [], 0, False, False
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            following = source[i + 1]
            out.append(r"\z" if following == "Z" and not in_class else c + following)
            i += 2
            continue
        if in_class:
            if c == "[" or source.startswith("&&", i):
                python_only = True
            in_class = not (c == "]" and i > class_start + 1)
        elif c == "[":
            in_class = True
            class_start = i + (source[i + 1 : i + 2] == "^")
        elif source.startswith("(?P<", i):
            i = source.index(">", i) + 1
            out.append("(")
            continue
        elif source.startswith("(?P=", i):
            stop = source.index(")", i)
            out.append(f"(?:\\{compiled.groupindex[source[i + 4 : stop]]})")
            i = stop + 1
            continue
        elif source.startswith("(?(", i):
            python_only = True
        out.append(c)
        i += 1
    body = "".join(out)
    java = f"(?dU)^(?:{body})" if anchored else f"(?dU){body}"
    return JavaPattern(source, java, dict(compiled.groupindex), compiled.groups, python_only)
