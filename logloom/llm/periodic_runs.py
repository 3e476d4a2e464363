"""Periodic runs of words: stretches that repeat with a smallest period, found by a harmonic grid of LCE queries.

For each period p, neighbouring grid points jp and (j+1)p are compared: the words that agree from them on (forward), and the words
that agree before them (backward) are longest common extensions, answered by a suffix array of the words, one of the reversed words,
and range minima over their LCP arrays. A run of period p spans from jp less the backward extension to (j+1)p plus the forward one.
The grid has n/p points for period p, so n log n in all. Many texts are one sequence, with separators that equal nothing, so no
extension leaves its text, and the grid need not start anew in each text.

A run of at least `least` periods has its first grid point in its first period, and the next least - 2 grid points in it as well,
so only where the words of as many grid points are equal can a run begin; the extensions are asked for from there alone, and
the suffix arrays hold the texts that have such a place. A multiple of a run's period gives the same stretch: the smallest period
of each stretch is kept (of two periods p < q in a stretch of 2q words or more, p's greatest common divisor with q is one too).

Defined results: a null text counts as empty; a text without words has no runs and collapses to ""; repeated rows and null ids
are returned as they are; words are told apart byte by byte (case counts); texts of any length are treated whole, in memory that grows
with n log n for n words; an empty table gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, in_workers, slices

#: Text bytes that are treated at once; LCE queries that are asked at once.
SLICE, QUERIES = 1 << 19, 1 << 19


class Extensions:
    """Longest common extensions of a sequence of integers, from its suffix array, LCP array and range minima."""

    def __init__(self, values: np.ndarray):
        n = self.n = len(values)
        rank = np.unique(values, return_inverse=True)[1].astype(np.int32)
        levels, step = [rank], 1
        # Prefix doubling: level k has the order of all stretches of 2^k values.
        while n > 1 and rank.max() < n - 1:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank.astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int32)
            new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
            levels.append(rank := new)
            step *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        # LCP of neighbours in the suffix array: equal stretches are skipped, longest first.
        left, right, lcp = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            level = levels.pop()
            same = np.flatnonzero((left < n) & (right < n))
            same = same[level[left[same]] == level[right[same]]]
            # A stretch that the end cuts short equals no other, as it is a suffix.
            lcp[same] += 1 << k
            left[same] += 1 << k
            right[same] += 1 << k
        self.minima = [lcp]
        while 2 << (k := len(self.minima) - 1) <= len(lcp):
            last = self.minima[k]
            self.minima.append(np.minimum(last[: -(1 << k)], last[1 << k :]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values agree from places i on and from other places j on; 0 at the end of the sequence."""
        found = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(inside), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.minima[k][low[own]], self.minima[k][high[own] - (1 << k)])
        found[inside] = out
        return found


def grid_points(values: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places jp, period p) where grid points jp, (j+1)p ... (j+least-1)p hold equal values; for p up to longest / least."""
    for p in range(1, longest // least + 1):
        same = values[:-p:p] == values[p::p]
        found = same[: len(same) - least + 2]
        for k in range(1, least - 1):
            found = found & same[k : len(same) - least + 2 + k]
        if found.any():
            yield np.flatnonzero(found) * p, p


def runs_of(values: np.ndarray, longest: int, least: int, shortest: int) -> np.ndarray:
    """(start, end, smallest period) of the runs of a sequence, in order.

    values: texts of `longest` integers at most with separators that equal nothing between them; least: how many periods a run has at
    least (3 or more), shortest: how many values.
    """
    forward = backward = None
    n, kept, some, number = len(values), [np.zeros((0, 3), np.int64)], [], 0

    def asked() -> None:
        nonlocal forward, backward
        if forward is None:
            forward, backward = Extensions(values), Extensions(values[::-1].copy())
        at, p = (np.concatenate(x) for x in zip(*some, strict=True))
        ahead = forward.common(at, at + p)
        behind = backward.common(n - at, n - at - p)
        start, end = at - behind, at + p + ahead
        good = (end - start >= least * p) & (end - start >= shortest)
        kept.append(np.unique(np.stack((start[good], end[good], p[good]), 1), axis=0))

    for at, p in grid_points(values, longest, least):
        some.append((at, np.full(len(at), p, np.int64)))
        number += len(at)
        if number >= QUERIES:
            asked()
            some, number = [], 0
    if some:
        asked()
    found = np.unique(np.concatenate(kept), axis=0)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def find_runs(texts: list[list[bytes]], least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several lists of words: rows of (list, start, length, period) in order, and the bounds of each list in them."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(texts)), np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists with a separator before each, and the place of each list's first word."""
        first = np.cumsum(lengths[which] + 1) - lengths[which]
        out = -1 - np.arange(int((lengths[which] + 1).sum()), dtype=np.int64)
        at = np.arange(int(lengths[which].sum())) - np.repeat(np.cumsum(lengths[which]) - lengths[which], lengths[which])
        out[at + np.repeat(first, lengths[which])] = ids[at + np.repeat(begins[which], lengths[which])]
        return out, first

    found = []
    # Lists of like length go together: a long one has many periods.
    for size in np.unique(np.frexp(lengths.astype(np.float64))[1]).tolist():
        which = np.flatnonzero(np.frexp(lengths.astype(np.float64))[1] == size)
        longest = int(lengths[which].max())
        if longest < max(least, shortest):
            continue
        values, first = joined(which)
        there = np.zeros(len(which), bool)
        for at, _ in grid_points(values, longest, least):
            there[np.searchsorted(first, at, side="right") - 1] = True
        if not there.any():
            continue
        which = which[there]
        values, first = joined(which)
        runs = runs_of(values, int(lengths[which].max()), least, shortest)
        own = np.searchsorted(first, runs[:, 0], side="right") - 1
        found.append(np.stack((which[own], runs[:, 0] - first[own], runs[:, 1] - runs[:, 0], runs[:, 2]), 1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows, np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, with one space between them. runs: rows of (start, length, period)."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, length, period>> by start and period, collapsed) of every row.

    Words are stretches without ASCII white space, numbered from 0. A run has `least` periods (3 or more) and `shortest` words at least.
    collapsed is the text without the words that a run repeats.
    """
    if least < 3:
        raise ValueError("runs of fewer than three periods need other grid points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t.encode().split() for t in part.column("text").to_pylist()]
                rows, bounds = find_runs(texts, least, shortest)
                parts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
                left = (collapsed(words, rows[a:b, 1:]) for words, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts), pa.array((x.decode() for x in left), pa.string())], names=["id", "runs", "collapsed"])
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return in_workers(rows, run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the greatest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    columns = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("best.start")).alias("start"), F.col("best.length"), (-F.col("best.period")).alias("period")
    milli = F.expr("1000 * best.length div -best.period").alias("exponent_milli")
    return columns.select(id_col, "n_runs", start, length, period, milli, "runs_sha256", "collapsed_sha256")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with periodic tails made in a tenth of the texts, decided by the id.

    h is the CRC-32 of the id as text, g = h div 10. Where h mod 10 is 0 and the text has n > 0 words, the words from a = g mod n on
    repeat those from a to a + p - 1, for p = 1 + (n - a) div (3 + g mod 8), and stand with single spaces. A null id changes nothing.
    """
    h = F.crc32(docs[id_col].cast("string"))
    words = F.regexp_extract_all(docs[text_col], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("CASE WHEN size(words) > 0 THEN g % size(words) END"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias(text_col))
