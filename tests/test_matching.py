"""First match in large libraries against trying every pattern in plain Python, and the index of literal texts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import literals
from logloom.operators import match as M
from logloom.sources.library import Pattern


@pytest.mark.parametrize(
    ("source", "parts"),
    [
        (r"^<(?P<p>\d+)>kind\ one (?P<m>.+)$", ["<", ">kind one "]),
        (r"^(?:abc)+(?P<x>def)?g", ["abc", "g"]),
        (r"(?i)abc", []),
        (r"^a(?i:bcd)efg", ["a", "efg"]),
        (r"^(?:one|two) three", [" three"]),
        (r"^a\bb(?=c)d", ["ab", "d"]),
        (r"^[ab]c{2,}d*e", ["c", "e"]),
    ],
)
def test_required_parts(source, parts):
    assert literals.required(source) == parts


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab .é🎉", min_size=1, max_size=5), min_size=1, max_size=12), st.text("ab .é🎉x", max_size=30))
def test_trie_finds_the_longest_text_at_each_place(texts, line):
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), literals.trie_pattern(sorted(texts)))
    found = [m[1] for m in re.finditer(f"(?=({python}))", line)]
    expected = [max((t for t in texts if line.startswith(t, i)), key=len, default=None) for i in range(len(line))]
    assert found == [t for t in expected if t]


def first_in_python(patterns, line):
    for i, p in enumerate(patterns):
        if m := re.match(p.regex, line):
            return i, {k: v for k, v in m.groupdict().items() if v}
    return None, {}


@pytest.mark.parametrize("chained", [0, 1000])
def test_large_library_equals_trying_all(spark, monkeypatch, chained):
    monkeypatch.setattr(M, "CHAINED", chained)
    r = random.Random(chained)
    words = ["kernel:", "sshd", "kern", "kernel", "a.b", "[x]", "ünï", "err=1", "  ", "日本"]
    patterns = []
    for i in range(120):
        own = [re.escape(r.choice(words)) for _ in range(r.randint(1, 3))]
        form = r.choice([r"^(?P<a>\w+) {} (?P<b>.+)$", r"^{}(?P<b>.*)$", r"^(?P<a>\S+)?\s*{}", r"^(?i:{}) (?P<a>\d+)", r"^(?:{}|other) (?P<b>.+)$"])
        patterns.append(Pattern(f"p{i}", form.replace("{}", " ".join(own)), priority=i))
    # Conditionals are evaluated in Python.
    patterns[70:70] = [Pattern("only", r"^(?P<a>q)?(?(a)x|kernel) (?P<b>.+)$")]
    patterns.append(Pattern("none", r"^(?P<a>\d+)$"))
    lines = [" ".join(r.choice([*words, "12", "q", "qx", "other", "KERNEL"]) for _ in range(r.randint(1, 5))) for _ in range(400)] + ["", "12", "kernel \ue000\ue001 x", None]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    found = M.match(frame, patterns).select("n", "pattern_idx", M.group_column(patterns, "a").alias("a"), M.group_column(patterns, "b").alias("b"), M.by_pattern(patterns, lambda p: p.name).alias("name")).orderBy("n").collect()
    for row, line in zip(found, lines, strict=True):
        at, groups = first_in_python(patterns, line) if line is not None else (None, {})
        assert (row["pattern_idx"], row["a"], row["b"], row["name"]) == (at, groups.get("a"), groups.get("b"), None if at is None else patterns[at].name), line
    assert {None, 70} < {row["pattern_idx"] for row in found} and len({row["pattern_idx"] for row in found}) > 15


def test_few_patterns_are_tried(spark):
    sources = [rf"^<\d+>unit{i} (?P<m>.+)$" for i in range(2000)]
    frame = spark.createDataFrame([("<1>unit77 x",), ("nothing",)], "value string")
    found = [r[0] for r in frame.select(literals.candidates(F.col("value"), sources)).collect()]
    # Patterns of one slot are tried together.
    assert 77 in found[0] and len(found[0]) <= 8 and found[1] == []
