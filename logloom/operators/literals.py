"""Which patterns of a large library a line can match: an index of the literal texts that patterns require.

A pattern matches only lines that hold its literal parts. Of these one is chosen for each pattern, the one that the fewest patterns
share. All chosen texts form one trie, written as one Java pattern, which finds every chosen text in a line in one scan. The texts that are
found say which patterns are tried, in the order of the library, together with those that have no literal part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chosen text: at least, at most. Longer parts are cut.
LEAST, MOST = 3, 24


def literal(values: list, schema: str) -> Column:
    """A list as one constant, whatever its size: the plan holds one value."""
    return F.from_json(F.lit(json.dumps(values)), schema)


def required(source: str) -> list[str]:
    """The literal parts that every match of a Python pattern holds, each as long as possible."""
    tree = parser.parse(source)
    found: list[str] = []
    run: list[str] = []

    def done() -> None:
        if run:
            found.append("".join(run))
            run.clear()

    def walk(items) -> None:
        for op, what in items:
            if op is code.LITERAL:
                run.append(chr(what))
            elif op is code.SUBPATTERN and not what[1] & re.IGNORECASE:
                walk(what[3])
            elif op is code.ATOMIC_GROUP:
                walk(what)
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
                done()
                if what[0] >= 1:
                    walk(what[2])
                    done()
            elif op is not code.AT:
                done()

    if not tree.state.flags & re.IGNORECASE:
        walk(tree)
        done()
    return found


def pieces(part: str) -> Iterator[str]:
    """Texts of a literal part that can stand for it: what begins at the end of a word, and the part itself."""
    starts = {0, *(m.start() for m in re.finditer(r"(?<=\w)\W+(?=\w)|(?<=\W)\w", part))}
    return (piece for s in starts if len(piece := part[s : s + MOST]) >= LEAST)


def chosen(sources: list[str]) -> list[str | None]:
    """For each pattern a text that its matches hold: the one that the fewest patterns may choose, of these the longest; None where there is none."""
    own = [{piece for part in required(s) for piece in pieces(part)} for s in sources]
    shared = Counter(piece for some in own for piece in some)
    return [min(some, key=lambda x: (shared[x], x[0].isalnum(), -len(x), x), default=None) for some in own]


def _quoted(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else f"\\x{{{ord(char):x}}}"


def trie_pattern(texts: list[str]) -> str:
    """A Java pattern for the longest of the texts at a place."""
    trie: dict = {}
    for text in texts:
        node = trie
        for char in text:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [_quoted(c) + written(then) for c, then in sorted(node.items()) if c]
        if not ways:
            return ""
        out = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return out + "?" if "" in node else out

    # The first characters as a class let the scan pass over the others quickly.
    return f"(?=[{''.join(_quoted(c) for c in sorted(trie))}]){written(trie)}"


#: Slots of the table from texts to patterns; patterns that share one are tried together.
SLOTS = 1 << 12


def candidates(line: Column, sources: list[str]) -> Column:
    """The numbers of the patterns that may match a line, in order: all that match are among them."""
    keys = chosen(sources)
    always = [i for i, key in enumerate(keys) if key is None]
    texts = sorted({key for key in keys if key})
    if not texts:
        return literal(always, "array<int>")
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for text in texts:
        # Of texts from one place only the longest is found: it stands for its beginnings too.
        slots[zlib.crc32(text.encode()) % SLOTS] += [i for i, key in enumerate(keys) if key and text.startswith(key)]
    table = literal([sorted(set(s)) for s in slots], "array<array<int>>")
    seen = F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?=({trie_pattern(texts)}))"), F.lit(1)))
    of = F.transform(seen, lambda t: F.element_at(table, (F.crc32(t) % SLOTS + 1).cast("int")))
    return F.array_sort(F.array_distinct(F.concat(literal(always, "array<int>"), F.flatten(of))))
